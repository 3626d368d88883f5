"""A redaction run made from the table of documents: both listings, in one SQL text that Spark and DuckDB read alike.

Left: <source>/raw/<lang>/doc_<id>.txt. Right: every 17th document is missing, `raw` became `files`, every 5th file has a
partly rewritten name, one source folder a new one, and in texts e-mail addresses and runs of 4 or more digits are
replaced, and words that end in "ent" (its stand-ins for names), but in every third document, which leaks what was replaced elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+"

LEFT = """
SELECT doc_id, concat(coalesce(source, 'none'), '/raw/', coalesce(lang, 'xx'), '/doc_', lpad(CAST(doc_id AS string), 7, '0'), '.txt') AS path,
  CAST({octets} AS bigint) AS size, coalesce(text, '') AS text
FROM documents
"""

RIGHT = """
SELECT doc_id, concat(CASE WHEN source = 'src3' THEN 'unit_moved' ELSE coalesce(source, 'none') END, '/files/', coalesce(lang, 'xx'), '/',
    CASE WHEN doc_id % 5 = 0 THEN concat('doc_', CAST(doc_id * 7 % 1000 AS string), '_masked.txt') ELSE concat('doc_', lpad(CAST(doc_id AS string), 7, '0'), '.txt') END) AS path,
  CAST({octets} AS bigint) AS size, text
FROM (
  SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 1 THEN text ELSE regexp_replace(CASE WHEN instr(text, '@') > 0 THEN regexp_replace(replace(text, 'ent ', 'alias '), '{mail}', 'person@example.com'{all}) ELSE replace(text, 'ent ', 'alias ') END, '[0-9][0-9][0-9][0-9]+', '0000'{all}) END AS text
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id % 17 <> 0) AS kept
) AS masked
"""

#: How both dialects say what differs: octets of a text, and to replace all matches.
SPARK = {"octets": "octet_length(coalesce(text, ''))", "all": "", "mail": MAIL}
DUCKDB = {"octets": "strlen(coalesce(text, ''))", "all": ", 'g'", "mail": MAIL}


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return spark.sql(sql.format(**SPARK).replace("FROM documents", "FROM {documents}"), documents=documents)


def left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, text of the source tree."""
    return _made(spark, sf_dir, LEFT)


def right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, text of the output tree."""
    return _made(spark, sf_dir, RIGHT)


def duckdb_views() -> str:
    """Common table expressions l and r of both trees, with bucket, base and label as the operators make them."""
    names = "['raw', 'files', 'file', 'output', 'out', 'input', 'in', 'redacted', 'original', 'originals', 'source', 'src', 'data', 'documents']"
    cut = f"""SELECT *, list_filter(segs[1:-2], lambda x: NOT list_contains({names}, lower(x))) AS bucket_, segs[-1] AS base FROM (SELECT *, string_split(path, '/') AS segs FROM {{}})"""
    named = "SELECT *, array_to_string(bucket_, '/') AS bucket, array_to_string(list_append(bucket_, base), '/') AS label, coalesce(bucket_[1], base) AS app FROM ({})"
    return (
        f"l0 AS ({LEFT.format(**DUCKDB)}), r0 AS ({RIGHT.format(**DUCKDB)}), l AS MATERIALIZED ({named.format(cut.format('l0'))}), r AS MATERIALIZED ({named.format(cut.format('r0'))})"
    )
