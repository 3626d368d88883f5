import duckdb
import pytest

import __spark_entry__ as entry
from redactrail.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "documents", "pages", "benchmark", "conversations")


def plain(value):
    if value is None or value != value:
        return None
    return int(value) if hasattr(value, "__int__") and not isinstance(value, (str, bytes, float)) else float(value) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert got
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        cursor = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(names) == columns and got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
