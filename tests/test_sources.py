import os
import sqlite3
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from redactrail import cli
from redactrail.sources import listing, mappings
from redactrail.streaming import live

FILES = {"a/x.txt": b"one", "a/.hidden/y.txt": b"", "_pii/output/z.txt": b"three", "top.txt": b"4"}


@pytest.fixture
def root(tmp_path):
    for path, content in FILES.items():
        os.makedirs((tmp_path / "tree" / path).parent, exist_ok=True)
        (tmp_path / "tree" / path).write_bytes(content)
    return str(tmp_path / "tree")


def rows(df):
    return {r["path"]: r["size"] for r in df.collect()}


def test_folders_and_archives(spark, root, tmp_path):
    listing.register(spark)
    expected = {p: len(c) for p, c in FILES.items()}
    df = spark.read.format("listing").option("path", root).option("side", "left").load()
    assert rows(df) == expected and df.rdd.getNumPartitions() >= 3 and df.first()["side"] == "left"
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("dir/", "")
        for path, content in FILES.items():
            z.writestr(path, content)
    assert rows(spark.read.format("listing").option("path", str(tmp_path / "t.zip")).load()) == expected
    for at in (root, str(tmp_path / "t.zip")):
        got = spark.createDataFrame([(p,) for p in [*FILES, "../out.txt", "none"]], "path string")
        read = {r["path"]: r["c"] and bytes(r["c"]) for r in got.select("path", listing.content(at, F.col("path")).alias("c")).collect()}
        assert read == {**{p: c or read[p] for p, c in FILES.items()}, "../out.txt": None, "none": None}


@pytest.mark.parametrize(("at", "error"), [("", ValueError), ("/none/there", FileNotFoundError), (__file__, ValueError)])
def test_bad_locations(at, error):
    with pytest.raises(error):
        listing.open_location(at)


class Store:
    """A client of an object store with pages of two keys."""

    def __init__(self, keys):
        self.keys, self.calls = sorted(keys), 0

    def list_objects_v2(self, Bucket, Prefix, Delimiter=None, ContinuationToken="0"):
        self.calls += 1
        own = [k for k in self.keys if k.startswith(Prefix)]
        tops = sorted({Prefix + k[len(Prefix) :].split("/")[0] + "/" for k in own if "/" in k[len(Prefix) :]}) if Delimiter else []
        own = [k for k in own if not Delimiter or "/" not in k[len(Prefix) :]]
        at = int(ContinuationToken)
        page = {"Contents": [{"Key": k, "Size": len(k)} for k in own[at : at + 2]], "CommonPrefixes": [{"Prefix": t} for t in tops] if not at else []}
        return page | ({"NextContinuationToken": str(at + 2)} if at + 2 < len(own) else {})


def test_descent_into_stores():
    keys = [f"run/mail/p{i}/d{j}.txt" for i in range(3) for j in range(5)] + [f"run/wide/w{i}/x.txt" for i in range(20)] + ["run/loose.txt", "run/mail/m.txt"]
    client = Store(keys)
    branches, past = listing.descend(listing.store_children(client, "b"), "run/")
    assert "run/wide/" in branches and {f"run/mail/p{i}/" for i in range(3)} <= set(branches) and set(past) >= {"run/", "run/mail/"}
    got = [k for b in branches for k, _ in listing.store_keys(client, "b", b, most_pages=0)[0]] + [k for p in past for k, _ in listing.store_keys(client, "b", p, True)[0]]
    assert sorted(got) == sorted(keys)
    some, cut = listing.store_keys(client, "b", "run/mail/p0/", most_pages=2)
    assert len(some) == 4 and cut and not listing.store_keys(client, "b", "run/mail/p0/", most_pages=3)[1]


class Missing(Exception):
    response = {"Error": {"Code": "NoSuchKey"}}  # noqa: RUF012


class Body:
    def __init__(self, data):
        self.read = lambda: data


def test_objects_of_stores(monkeypatch):
    there = {"run/raw/a.eml": b"Subject: x\n\nbody", "run/b": b""}

    class Client:
        def get_object(self, Bucket, Key):  # noqa: N803
            assert Bucket == "bucket"
            if Key == "run/broken":
                raise OSError("no connection")
            if Key not in there:
                raise Missing
            return {"Body": Body(there[Key])}

    monkeypatch.setattr(listing, "_client", lambda location, options: Client())
    kind, location = listing.open_location("s3://bucket/run/")
    assert kind == "store"
    paths = ["raw/a.eml", "b", "none", "../run/b", "", None, "/b"]
    assert listing.read_files(kind, location, paths) == [there["run/raw/a.eml"], b"", None, None, None, None, None]
    with pytest.raises(OSError, match="no connection"):
        listing.read_files(kind, location, ["broken"])


def test_stores_by_sparks_connectors(spark, root):
    assert {r["path"]: bytes(r["content"]) for r in listing.spark_files(spark, f"file://{root}").collect()} == {"a/x.txt": b"one", "top.txt": b"4"}


def test_folders_with_one_large_child_are_split(spark, tmp_path):
    listing.register(spark)
    for i in range(5):
        os.makedirs(tmp_path / "only" / f"p{i}")
        (tmp_path / "only" / f"p{i}" / "x.txt").write_text("x")
    df = spark.read.format("listing").option("path", str(tmp_path)).load()
    assert len(rows(df)) == 5 and df.rdd.getNumPartitions() >= 5


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("left", "a", 1, True)], listing.SCHEMA)
    more = spark.createDataFrame([("left", "b", 1, False)], listing.SCHEMA)
    at = str(tmp_path / "snap")
    assert listing.snapshot(df, at, "s3://x").first()["truncated"] is True
    assert rows(listing.snapshot(more, at, "s3://x")) == {"a": 1} and rows(listing.snapshot(more, at, "s3://y")) == {"b": 1}
    time.sleep(1.1)
    assert rows(listing.snapshot(more, at, "s3://x", max_age=1)) == {"b": 1}


def test_mappings(spark, tmp_path):
    listing.register(spark)
    at = str(tmp_path / "mappings.db")
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE mappings (id INTEGER PRIMARY KEY, original TEXT, attribute_type TEXT, replacement TEXT, deleted INTEGER)")
        db.executemany("INSERT INTO mappings (original, attribute_type, replacement, deleted) VALUES (?, ?, ?, ?)", [("b", "name", None, 0), ("a", "name", "x", 1)])
    got = mappings.read(spark, at).collect()
    assert [(r["original"], r["replacement"], r["deleted"], r["confidence"]) for r in got] == [("a", "x", True, None), ("b", None, False, None)]
    sqlite3.connect(str(tmp_path / "empty.db")).close()
    with pytest.raises(Exception, match="no table"):
        mappings.read(spark, str(tmp_path / "empty.db")).collect()
    files = spark.createDataFrame([("u1.db",), ("u2/mappings.db",), ("u2/pii_mappings.db",), ("x/y.db",)], "path string")
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user string")
    assert {tuple(r) for r in mappings.per_user(files, users).collect()} == {("u1", "u1.db"), ("u2", "u2/pii_mappings.db")}
    assert mappings.discovered(files).first()["path"] == "u2/mappings.db"
    every = files.union(spark.createDataFrame([("mappings.db",)], "path string"))
    assert {tuple(r) for r in mappings.resolved(every, users).collect()} == {("u1", "u1.db"), ("u2", "u2/pii_mappings.db"), ("u3", "mappings.db")}
    assert {r["path"] for r in mappings.resolved(every, users, "jdbc:x").collect()} == {"jdbc:x"} and mappings.resolved(files, users).count() == 2
    assert mappings.is_database("x.SQLite") and mappings.is_database("postgres://h/d") and not mappings.is_database("/folder")


def test_review_of_two_trees(spark, tmp_path):
    for path in ("raw/m/a@example.com/1.txt", "raw/m/a@example.com/2.txt", "out/m/a@example.com/1.txt", "raw/m/x/3.txt", "out/m/x/3.txt"):
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_text(path)
    rows, doubles = cli.open_review(spark, str(tmp_path), str(tmp_path), "raw", "out", per_app=1)
    got = {r["label"]: r for r in rows.collect()}
    assert {k: v["how"] for k, v in got.items()} == {"m/a@example.com/1.txt": "exact", "m/a@example.com/2.txt": "missing", "m/x/3.txt": "exact"}
    assert got["m/a@example.com/1.txt"]["kept"] == ["a@example.com"] and sum(r["sampled"] for r in got.values()) == 1 and sorted(r["id"] for r in got.values()) == [0, 1, 2]
    alone, _ = cli.open_review(spark, str(tmp_path), str(tmp_path))
    assert {r["how"] for r in alone.collect()} == {"single"}
    (tmp_path / "out/m/x/3.txt").write_text("other words")
    with sqlite3.connect(str(tmp_path / "map.db")) as db:
        db.execute("CREATE TABLE mappings (original TEXT, attribute_type TEXT, replacement TEXT)")
        db.execute("INSERT INTO mappings VALUES ('Words', 'x', 'other')")
    out = {name: str(tmp_path.parent / f"{tmp_path.name}-{name}") for name in ("out", "metrics", "marks")}
    cli.main(["--root", str(tmp_path)])
    cli.main(["--left", str(tmp_path), "--right", str(tmp_path), "--only", "raw", "--right-only", "out", "--map", str(tmp_path / "map.db"), *[x for name, at in out.items() for x in (f"--{name}", at)]])
    assert spark.read.parquet(out["out"]).count() == 3
    metrics = {r["left"]: r for r in spark.read.parquet(out["metrics"]).collect()}
    assert metrics["raw/m/x/3.txt"]["added_sample"] == ["other", "words"] and not metrics["raw/m/x/3.txt"]["identical"] and metrics["raw/m/a@example.com/2.txt"]["removed"] is None
    assert {(r["side"], r["kind"], r["value"]) for r in spark.read.parquet(out["marks"]).collect()} == {("right", "original", "Words"), ("right", "replacement", "other")}
    both = cli.open_reviews(spark, [{"left": str(tmp_path), "right": str(tmp_path), "left_only": "raw", "right_only": "out"}, {"left": str(tmp_path / "out"), "right": str(tmp_path / "out")}])
    assert {r["review_id"].split("-")[0]: r["n"] for r in both.groupBy("review_id").agg(F.count("*").alias("n")).collect() if r["review_id"].startswith("out")} == {"out": 2} and both.count() == 5


def test_streams(spark, tmp_path):
    record = "sid string, left string, seq long, viewed boolean, reviewed boolean, comments array<string>"
    spark.createDataFrame([("s", "l", 1, True, False, ["x"]), ("s", "l", 2, True, True, None)], record).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(record).parquet(str(tmp_path / "in"))
    live.verdict_table(log, str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    from redactrail.operators import review

    assert [(r["left"], r["reviewed"]) for r in review.verdicts(spark.read.parquet(str(tmp_path / "table"))).collect()] == [("l", True)]
    q = live.latest(log).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latest").first()["seq"] == 2
    spark.createDataFrame([("app", "a", "Ann", False), ("app", "b", "Ann", True)], "app string, left string, token string, kept boolean").write.parquet(str(tmp_path / "t"))
    q = live.learned_counts(spark.readStream.schema("app string, left string, token string, kept boolean").parquet(str(tmp_path / "t"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("counts").first()) == ("app", "Ann", 1, 1)
