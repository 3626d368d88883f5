"""Connected components of an edge table that no driver ever holds: alternating large-star and small-star rounds.

A graph of at most SMALL edges, a few megabytes, is solved in one task. For larger ones each round hangs every vertex under
the smallest it knows; stars merge in a few rounds, their number growing with the
logarithm of the largest component. Edges of a round are a written table, so lost executors cost a round at most. So are
the least neighbours, else the joins would use the partitions that these were summed in; this way the joins shuffle both
sides themselves, and adaptive execution can split a vertex with very many edges.

Cases. Null ends and loops are dropped, repeated edges count once. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import forget, written

#: Edges that one task may hold.
SMALL = 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of the edges (a, b), with the smallest id of its component."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", narrow=True)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] <= SMALL:
            return now.repartition(1).mapInArrow(_solve, "id long, component long")
        if state == before:
            break
        before = state
        least: list[DataFrame] = []
        then = written(_small_star(_large_star(now, least), least), "edges", narrow=True)
        forget(now, *least)
        now = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges that come: labels are handed on until none changes, doubling their reach each time."""
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches], strict=True)] or [np.zeros(0, np.int64)] * 2
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for vertices in (a, b, before[a], before[b]):  # the ends, and what they hang under
            np.minimum.at(label, vertices, least)
        label = label[label]
    for start in range(0, len(ids), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.record_batch([pa.array(ids[part]), pa.array(ids[label[part]])], names=["id", "component"])


def _large_star(edges: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Every neighbour of a vertex that is larger than it, under the least; adds the working table it needs to `tables`."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", narrow=True)
    tables.append(least)
    return both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, under the least."""
    edges = written(edges, "stars", narrow=True)  # read twice
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
    tables += [edges, least]
    under = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return under.union(least.select("u", F.col("m").alias("v"))).distinct()
