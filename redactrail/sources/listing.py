"""Listings of trees as DataFrames: folders, archives, and object stores, by a Python data source.

    register(spark)
    spark.read.format("listing").option("path", "/data/run").load()          # side, path, size, truncated
    spark.read.format("listing").option("path", "/data/run.zip").load()

Spark's own file listing leaves out hidden folders and empty files, which a review must see. An archive is read with one
partition, a folder or store with one for each branch that the planner's descent finds. `content` reads the files
themselves, a store's objects by the same client. Where that client isn't installed, `spark_files` lists and reads a store
by Spark's own connectors.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from redactrail.functions.paths import parse_location

SCHEMA = "side string, path string, size bigint, truncated boolean"
#: Pages of a store's listing that are read of a branch (0: all), levels of descent, children that make a level too wide,
#: branches at most, and objects that a worker fetches at once.
PAGES, DEPTH, WIDE, BRANCHES, FETCHES = 0, 4, 12, 64, 16


@dataclass
class Branch(InputPartition):
    prefix: str
    shallow: bool = False


def open_location(text: str) -> tuple[str, str]:
    """(kind, location): "folder", "archive" or "store"; errors say what is wrong with any other."""
    if not (text or "").strip():
        raise ValueError("no location given")
    if text.startswith("gs://"):
        return "store", text.rstrip("/")
    if found := parse_location(text):
        return "store", found[0]
    path = Path(text).expanduser()
    if path.is_dir():
        return "folder", str(path)
    if not path.exists():
        raise FileNotFoundError(f"nothing at {text}")
    if path.suffix.lower() == ".zip":
        return "archive", str(path)
    raise ValueError(f"{text} is no folder, archive or store")


def walk(root: str, prefix: str = "", shallow: bool = False) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files below a folder, hidden and empty ones as well."""
    for folder, below, names in os.walk(os.path.join(root, prefix)):
        below.sort()
        for name in sorted(names):
            full = os.path.join(folder, name)
            if os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)
        if shallow:
            return


def descend(children: Callable[[str], list[str]], base: str, depth: int = DEPTH, wide: int = WIDE, most: int = BRANCHES) -> tuple[list[str], list[str]]:
    """(branches, stepped past): the prefixes to read, each by itself, and those whose own files must be read besides.

    Goes down while there are not too many branches; a prefix without children or with more than `wide` stays whole, which
    doesn't keep its siblings from being split.
    """
    done: list[str] = []
    open_, past = children(base), [base]
    for _ in range(depth - 1):
        below = {b: children(b) for b in open_}
        split = [b for b in open_ if 0 < len(below[b]) <= wide]
        whole = [b for b in open_ if b not in split]
        fresh = [c for b in split for c in below[b]]
        if not split or len(done) + len(whole) + len(fresh) > most:
            break
        done, open_, past = done + whole, fresh, past + split
    return done + open_, past


def pages(client, bucket: str, prefix: str, shallow: bool = False) -> Iterator[dict]:
    """The pages of a store's listing; client: with list_objects_v2, as public object stores' clients have."""
    asked = {"Bucket": bucket, "Prefix": prefix} | ({"Delimiter": "/"} if shallow else {})
    while True:
        page = client.list_objects_v2(**asked)
        yield page
        if not page.get("NextContinuationToken"):
            return
        asked["ContinuationToken"] = page["NextContinuationToken"]


def store_children(client, bucket: str) -> Callable[[str], list[str]]:
    return lambda prefix: [c["Prefix"] for page in pages(client, bucket, prefix, True) for c in page.get("CommonPrefixes", [])]


def folder_children(root: str) -> Callable[[str], list[str]]:
    return lambda prefix: sorted(os.path.join(prefix, e.name) for e in os.scandir(os.path.join(root, prefix)) if e.is_dir(follow_symlinks=False))


def bucket_of(location: str) -> tuple[str, str]:
    """The bucket of a store's location, and the prefix that its keys begin with."""
    bucket, _, prefix = location.split("://", 1)[1].partition("/")
    return bucket, f"{prefix}/" if prefix else ""


def store_keys(client, bucket: str, prefix: str, shallow: bool = False, most_pages: int = PAGES) -> tuple[list[tuple[str, int]], bool]:
    """(key, size) of a branch, and whether it was cut short after most_pages pages (0: never; nor if shallow)."""
    found, n = [], 0
    for page in pages(client, bucket, prefix, shallow):
        found += [(o["Key"], o.get("Size", 0)) for o in page.get("Contents", []) if not o["Key"].endswith("/")]
        n += 1
        if most_pages and not shallow and n >= most_pages:
            return found, bool(page.get("NextContinuationToken"))
    return found, False


def _client(location: str, options: dict):
    try:
        import boto3
    except ImportError as e:
        raise ImportError("a store needs boto3 here; spark_files() reads it by Spark's own connectors") from e
    endpoint = "https://storage.googleapis.com" if location.startswith("gs://") else None
    return boto3.Session(profile_name=options.get("profile")).client("s3", region_name=options.get("region"), endpoint_url=endpoint)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.side = self.options.get("side", "")
        self.kind, self.location = open_location(self.options.get("path", ""))
        self.most_pages = int(self.options.get("pages", PAGES))

    def _bucket(self) -> tuple[str, str]:
        return bucket_of(self.location)

    def partitions(self) -> list[InputPartition]:
        if self.kind == "archive":
            return [Branch("")]
        if self.kind == "folder":
            base, children = "", folder_children(self.location)
        else:
            bucket, base = self._bucket()
            children = store_children(_client(self.location, self.options), bucket)
        branches, past = descend(children, base)
        return [*map(Branch, branches), *[Branch(p, True) for p in past]] if branches else [Branch(base)]

    def read(self, partition: Branch) -> Iterator[tuple]:
        if self.kind == "archive":
            with zipfile.ZipFile(self.location) as archive:
                yield from ((self.side, i.filename, i.file_size, False) for i in archive.infolist() if not i.is_dir())
        elif self.kind == "folder":
            yield from ((self.side, path, size, False) for path, size in walk(self.location, partition.prefix, partition.shallow))
        else:
            bucket, base = self._bucket()
            keys, cut = store_keys(_client(self.location, self.options), bucket, partition.prefix, partition.shallow, self.most_pages)
            yield from ((self.side, key[len(base) :], size, cut) for key, size in keys)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    from redactrail.sources.mappings import MappingSource

    spark.dataSource.register(ListingSource)
    spark.dataSource.register(MappingSource)


def content(root: str, path: Column, **options: str) -> Column:
    """The bytes of files of a folder, archive or store; null for paths that lead out of it or nowhere."""
    kind, location = open_location(root)

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        return pd.Series(read_files(kind, location, paths.tolist(), options), dtype=object)

    return read(path)


@lru_cache(maxsize=4)
def _archive(location: str, changed: float) -> tuple[zipfile.ZipFile, set[str]]:  # noqa: ARG001  a changed archive is another
    archive = zipfile.ZipFile(location)
    return archive, set(archive.namelist())


def read_files(kind: str, location: str, paths: list[str | None], options: dict | None = None) -> list[bytes | None]:
    if kind == "archive":
        archive, names = _archive(location, os.path.getmtime(location))
        return [archive.read(p) if p in names else None for p in paths]
    if kind == "store":
        client, (bucket, base) = _client(location, options or {}), bucket_of(location)
        with ThreadPoolExecutor(FETCHES) as pool:
            return list(pool.map(lambda p: read_object(client, bucket, base, p), paths))
    top = os.path.realpath(location)
    found: list[bytes | None] = []
    for path in paths:
        full = os.path.realpath(os.path.join(top, path or ""))
        inside = full.startswith(top + os.sep) and os.path.isfile(full)
        found.append(Path(full).read_bytes() if inside else None)
    return found


def read_object(client, bucket: str, base: str, path: str | None) -> bytes | None:
    """An object of a store by its path below base; null if there is none, or if the path has empty or upward steps."""
    if not path or {"", ".."} & set(path.split("/")):
        return None
    try:
        return client.get_object(Bucket=bucket, Key=base + path)["Body"].read()
    except Exception as e:
        if getattr(e, "response", {}).get("Error", {}).get("Code") in ("NoSuchKey", "404"):
            return None
        raise


def spark_files(spark: SparkSession, location: str) -> DataFrame:
    """(path, size, content) of a store by Spark's connectors; they leave out empty objects and hidden folders.

    Sizes alone don't read any content.
    """
    root = re.sub("^s3://", "s3a://", location.rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.col("path"), "^" + re.escape(root.replace("file:///", "file:/")) + "/+", "")
    return files.select(below.alias("path"), F.col("length").alias("size"), "content")


def snapshot(listing: DataFrame, folder: str, location: str, max_age: int = 3600) -> DataFrame:
    """The listing of a location, kept under `folder` for max_age seconds, with its flag of being cut short.

    A snapshot that can't be read is made anew.
    """
    spark = listing.sparkSession
    import hashlib

    at = f"{folder}/{hashlib.sha1(location.encode()).hexdigest()}"
    now = spark.range(1).select(F.unix_timestamp()).first()[0]
    try:
        kept = spark.read.parquet(at)
        listed = kept.agg(F.max("listed_at")).first()[0]
        if listed is not None and now - listed < max_age:
            return kept.drop("listed_at")
    except Exception as e:  # noqa: BLE001  no snapshot yet, or a broken one
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e) and "Parquet" not in str(e):
            raise
    listing.withColumn("listed_at", F.lit(now)).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at).drop("listed_at")
