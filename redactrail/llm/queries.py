"""The queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from redactrail.llm import avi_media, byte_bpe, chunk_dedup, huffman_ids, near_dedup, packing, quality, url_filter, voronoi_knn, warc_revisits
from redactrail.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.resolved_captures(table(spark, sf_dir, "pages"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.fit(pages, URL_RULES), URL_RULES)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.digests(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe, op2_warc_revisits, op3_chunk_dedup, op4_huffman_ids, op5_quality_classifier, op6_url_filter,
        op7_near_dedup, op8_avi_media, op9_best_fit_packing, op10_voronoi_knn,
    )
    return {f.__name__: f for f in found}


TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT), 0) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc_revisits.ORACLE_SQL, "op10_voronoi_knn": TOP_K_SQL}
