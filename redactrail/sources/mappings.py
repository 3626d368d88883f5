"""Tables of substitutions: a data source over SQLite files, and where a run or a user has theirs.

    spark.read.format("mappings").option("path", "/data/run/mappings.db").load()
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from redactrail.functions import paths as P

NAMES = ("pii_mappings.db", "mappings.db")
COLUMNS = {"original": "string", "attribute_type": "string", "replacement": "string", "source": "string", "confidence": "double", "generated_by": "string", "deleted": "boolean"}
DATABASES = ("postgres", "postgresql", "mysql")
PER_USER = ("{user}.db", "{user}/pii_mappings.db", "{user}/mappings.db")


class MappingReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(f"no mappings at {self.path}")
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as database:
            there = {row[1] for row in database.execute("PRAGMA table_info(mappings)")}
            if not there:
                raise ValueError("this database has no table of mappings")
            listed = ", ".join(c if c in there else f"NULL AS {c}" for c in COLUMNS)
            for *row, deleted in database.execute(f"SELECT {listed} FROM mappings ORDER BY 2, 1"):
                yield *row, None if deleted is None else bool(deleted)


class MappingSource(DataSource):
    """Columns that a database doesn't have are null."""

    @classmethod
    def name(cls) -> str:
        return "mappings"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema) -> DataSourceReader:
        return MappingReader(self.options["path"])


def read(spark: SparkSession, location: str, table: str = "mappings", **options: str) -> DataFrame:
    """The mappings of a file, or of a database by its URL (jdbc:…, whose driver must be there)."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=table, **options).load()
    return spark.read.format("mappings").option("path", location).load()


def discovered(listing: DataFrame) -> DataFrame:
    """The first file of a listing that has the name of a table of mappings."""
    return listing.where(P.base(P.segments(F.col("path"))).isin(*NAMES)).orderBy("path").limit(1)


def is_database(location: str) -> bool:
    return bool(re.search(r"[.](db|sqlite3?)$", location, re.IGNORECASE)) or location.split("://")[0] in DATABASES or location.startswith("jdbc:")


def resolved(listing: DataFrame, users: DataFrame, given: str | None = None) -> DataFrame:
    """(user, path): the table of each user; a database that is given, by file or URL, is everybody's.

    given: that, or null for what the listing has: the user's own table, else the one of the run.
    """
    if given and is_database(given):
        return users.select("user", F.lit(given).alias("path"))
    own, common = per_user(listing, users), discovered(listing.where(~F.col("path").contains("/")))
    shared = common.first()
    return users.select("user").join(own, "user", "left").select("user", F.coalesce("path", F.lit(shared["path"] if shared else None)).alias("path")).where("path IS NOT NULL")


def per_user(listing: DataFrame, users: DataFrame) -> DataFrame:
    """(user, path): each user's own table in a folder's listing, by the first place that has one."""
    places = F.array(*[F.struct(F.lit(i).alias("rank"), F.format_string(t.replace("{user}", "%s"), "user").alias("path")) for i, t in enumerate(PER_USER)])
    wanted = users.select("user", F.explode(places).alias("x")).select("user", "x.rank", "x.path")
    return wanted.join(listing.select("path"), "path").groupBy("user").agg(F.min_by("path", "rank").alias("path"))
