import re

import pytest
from pyspark.sql import functions as F

from redactrail.functions import paths as P
from redactrail.functions import text as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "parts"), [("a/b/c.txt", ["a", "b", "c.txt"]), ("a\\b.txt", ["a", "b.txt"]), ("/a/./b//c", ["/", "a", "b", "c"]), ("", [])])
def test_segments(spark, path, parts):
    assert one(spark, P.segments(F.col("p")), p=path) == parts


@pytest.mark.parametrize(("path", "label"), [("u/raw/x/raw", "u/x/raw"), ("u/Files/a.txt", "u/a.txt"), ("raw", "raw"), ("a.txt", "a.txt")])
def test_labels_drop_layout_but_not_names(spark, path, label):
    assert one(spark, P.label(P.segments(F.col("p"))), p=path) == label


@pytest.mark.parametrize(("path", "is_document"), [
    ("a/b.PDF", True), ("a/b.bin", False), ("_pii/a.txt", False), ("a/.git/b.txt", False), ("a/.env", False), ("a/x.env", True),
    ("node_modules/a.txt", False), ("a/_b.txt", False), ("README", False), ("", False), ("a/b.", False),
])
def test_documents(spark, path, is_document):
    assert one(spark, P.is_document(P.segments(F.col("p"))), p=path) is is_document


def test_selection(spark):
    pick = lambda path, **how: one(spark, P.selected(P.segments(F.col("p")), **how), p=path)
    assert pick("_pii/out/a.txt", only="_PII") and not pick("x/a.txt", only="_pii") and not pick("_pii/a.txt")
    assert not pick("u/out/a.txt", exclude="OUT") and not pick("u/a.tmp.txt", drop_globs=["*.tmp.txt"]) and pick("u/a.txt", drop_globs=["*.tmp.txt"])


@pytest.mark.parametrize(("name", "reason"), [
    ("mara.lind@example.com", "email"), ("dm_mara", "conversation"), ("MPDM-x", "conversation"), ("call 0123456789", "number"), ("12345678", None), ("Mara.Lind", "person"),
    ("mara.json", None), ("SQai.SQai", None), ("data-platform", None), ("", None), (None, None), ("a.b", None),
])
def test_personal_names(spark, name, reason):
    got = one(spark, P.looks_personal(F.col("n")), n=name)
    assert got is None if reason is None else reason in got


def test_kept_names(spark):
    got = one(spark, P.kept_names(F.col("l"), F.col("r")), l="mail/raw/a@example.com/x/1.txt", r="mail/files/a@example.com/y/1.txt")
    assert got == ["a@example.com"] and one(spark, P.kept_names(F.col("l"), F.col("r")), l="a@example.com/1.txt", r=None) == []


def test_ids_and_masks(spark):
    import hashlib

    assert one(spark, P.session_id(F.col("l"), F.col("r")), l="a", r="x/out") == "out-" + hashlib.sha256(b"a\0x/out").hexdigest()[:12]
    assert one(spark, P.mapping_id(F.col("l"), F.col("r")), l="email", r="v") == hashlib.sha1(b"email\0v").hexdigest()[:16]
    assert one(spark, P.masked_url(F.col("u")), u="postgres://me:secret@host/db") == "postgres://me:***@host/db"
    assert one(spark, P.human_size(F.length("x") * 2048), x="y") == "2.0 KB"


@pytest.mark.parametrize(("at", "root"), [("s3://b/run/_pii/output/", "s3://b/run"), ("s3://b/run/_PII", "s3://b/run"), ("s3://_pii", "s3://_pii"), ("/x/output", "/x/output"), ("s3://b/_pii", "s3://b")])
def test_run_roots(spark, at, root):
    assert one(spark, P.run_root(F.col("p")), p=at) == root == P.resolve_root(at)


@pytest.mark.parametrize(("text", "found"), [
    ("s3://b//x/", ("s3://b/x", None)), ("arn:aws:s3:::b/x/", ("s3://b/x", None)),
    ("https://eu-west-1.console.aws.amazon.com/s3/buckets/b?prefix=a%20b/&region=eu-north-1", ("s3://b/a b", "eu-north-1")),
    ("https://s3.console.aws.amazon.com/s3/object/b?prefix=x/y.pdf", ("s3://b/x", None)),
    ("https://my.bucket.s3.eu-west-1.amazonaws.com/k/", ("s3://my.bucket/k", "eu-west-1")), ("https://s3-eu-west-1.amazonaws.com/b/k", ("s3://b/k", "eu-west-1")),
    ("https://example.com/s3/buckets/b", None), ("/tmp/x", None), ("", None), (None, None), ("https://s3.amazonaws.com/", None),
])
def test_locations(text, found):
    assert P.parse_location(text) == found


def test_tokens_are_runs_of_their_characters_and_texts_are_not_split(spark):
    texts = ["", " ", "ab abc abcd", "-a_b.c+d@e-", "ÄbcÄdefg\u0000hij\nklm\U0001f600nop\u017fqrs", "a.b @@@ ___ 1.5 12 123", "\u0130xyz ABC abc ABC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for made, least, low in ((T.content_tokens, 3, False), (T.vocabulary_tokens, 1, True)):
        found = df.select("t", F.lower("t").alias("low"), made(F.col("t")).alias("x"))
        assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
        for r in found.collect():
            assert r["x"] == list(dict.fromkeys(w for w in re.split(T.TOKEN_BREAK, r["low"] if low else r["t"]) if len(w) >= least))


def test_tokens(spark):
    assert one(spark, T.content_tokens(F.col("t")), t="Mail a.b@c.de, x of the THE the!") == ["Mail", "a.b@c.de", "the", "THE"]
    assert one(spark, T.vocabulary_tokens(F.col("t")), t="A b-c, a") == ["a", "b-c"]
    assert one(spark, T.name_tokens(F.col("t")), t="610-Alpha_Report.pdf") == ["610", "alpha", "report", "pdf"]
    assert one(spark, T.content_tokens(F.col("t")), t=None) == []
    bad = spark.createDataFrame([(b"a\xffb",)], "b binary").select(T.decoded(F.col("b")).alias("x")).first()["x"]
    assert bad == "a�b"


def test_whole_values():
    marks = {"leak": ["Ann"], "original": ["Ann Lee", "Lee", "x."]}
    assert T.whole_value_spans("Ann Lee, ANN! Annex lee x.y", marks) == [(0, 3, "leak"), (4, 7, "original"), (9, 12, "leak"), (20, 23, "original"), (24, 26, "original")]
