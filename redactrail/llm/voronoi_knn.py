"""Exact top-k search by inner product as a Voronoi kNN join.

`top_k` answers every query row against all rows.

Method. Pivots, a bounded sample of the vectors, divide all vectors into cells by the nearest pivot. For each cell a summary
is kept: how many vectors, and the largest distance from the pivot. For a vector x of cell j, and p its pivot with radius r,
the inner product with a query q lies within q.p - |q| r and q.p + |q| r. Each query gets a first lower bound on its k-th
best score from the summaries, and a better one by solving its own cell. It is then sent only to the cells whose upper bound
reaches that, where it is solved locally; only scores that reach the bound come back, and the best k of them are the answer.

At scale. Vectors become whole numbers before anything else, so scores and bounds are exact up to rounding, for which bounds
are widened. Cells of more than BLOCK vectors are dealt to several blocks by hash, queries for a block to groups of at most
about QUERIES: no task gets an unbounded group, however many copies a vector has. The pivots (at most PIVOTS) and the
summaries, one for each pivot, are all that a driver holds.

Cases. Vectors that are null or hold a null, NaN or infinite component take no part, neither do null ids. Empty vectors and
shorter ones count as filled up with zeros. Rows that repeat id and vector count once; rows of the query's own id are no
candidates. Fewer than k candidates: all of them. Ties: the smaller id. Empty table: empty result. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactrail.llm.common import pick, written

PIVOTS, BLOCK, QUERIES = 256, 4096, 1024


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that take part."""
    rows = pick(df, vec_id=id_col, e=vector_col).where("vec_id IS NOT NULL AND e IS NOT NULL")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(finite).select(F.col("vec_id").cast("long"), F.transform("e", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")).distinct()


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of vectors as whole numbers in doubles, exact up to 2**53, filled up with zeros."""
    found = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        found[i, : len(v)] = v
    return found


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row; is_query: a condition on vec_id."""
    spark = df.sparkSession
    rows = written(whole_vectors(df, id_col, vector_col, scale), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, dim = size["n"], max(1, size["dim"] or 1)
    m = int(min(PIVOTS, max(1, round(total**0.5 / 4))))
    # of copies of a vector one can be a pivot
    chosen = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
    pivots = _matrix([r["v"] for r in chosen], dim)
    squares = (pivots**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1).to_pylist(), dim)
                d = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + squares
                cell = d.argmin(1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    cells = written(rows.mapInArrow(assign, "vec_id long, v array<long>, cell int, far double"), "cells")
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each pivot
    counts, radius = np.zeros(len(pivots), int), np.zeros(len(pivots))
    for r in summary:
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-9) + 1e-6
    blocks = -(-counts // BLOCK)
    n_blocks = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), F.col("cell") + 1) if len(blocks) else F.lit(1)
    data = cells.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int").alias("block"))
    asked = cells.where(is_query(F.col("vec_id")))

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and cell, the least and the greatest score that a vector there can have."""
        middle, slack = x @ pivots.T, np.sqrt((x**2).sum(1))[:, None] * radius + 1e-6
        return middle - slack, middle + slack

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for their own cell, with a bound from the summaries."""
        for batch in batches:
            low, _ = bounds(_matrix(batch.column(1).to_pylist(), dim))
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(counts[order], axis=1) > k  # more than k, for one of them may be the query itself
            at = np.where(enough.any(1), enough.argmax(1), -1)
            bound = np.where(at >= 0, np.take_along_axis(low, order, 1)[np.arange(len(low)), at], -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bound)], names=["vec_id", "v", "cell", "bound"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for the other cells whose upper bound reaches theirs."""
        for batch in batches:
            own, bound = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            _, high = bounds(_matrix(batch.column(1).to_pylist(), dim))
            go = (high >= bound[:, None]) & (counts > 0)
            go[np.arange(len(own)), own] = False
            q, cell = np.nonzero(go)
            for at in range(0, len(q), 4096):
                rows = pa.array(q[at : at + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cell[at : at + 4096], pa.int32()), batch.column(3).take(rows)], names=["vec_id", "v", "cell", "bound"])

    def local(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy(np.int64)
            x = _matrix(right["v"].to_numpy(), dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                scores = _matrix(part["v"].to_numpy(), dim) @ x.T
                own = part["vec_id"].to_numpy(np.int64)
                scores[own[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(scores, best, 1)
                good = (value >= part["bound"].to_numpy()[:, None]) & np.isfinite(value)
                i, j = np.nonzero(good)
                found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[best[i, j]], "score": value[i, j].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    def solve(queries: DataFrame) -> DataFrame:
        """The best k of each query and block that reach its bound."""
        sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        # a row for each block, as a table: so the joins shuffle by themselves and can be split, or broadcast it if it is small
        many = written(sent.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "groups", narrow=True)
        sent = sent.join(many, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), "groups").cast("int")).drop("groups")
        copies = data.join(many, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        both = sent.groupBy("cell", "block", "part").cogroup(copies.groupBy("cell", "block", "part"))
        return both.applyInPandas(local, "query_id long, vec_id long, score long")

    def best(answers: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return answers.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    at_home = written(best(solve(asked.select("vec_id", "v", "cell").mapInArrow(first, "vec_id long, v array<long>, cell int, bound double"))), "home")
    reached = at_home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    again = asked.select("vec_id", "v", "cell").join(reached, "vec_id", "left").fillna(float("-inf"), ["bound"])
    elsewhere = solve(again.mapInArrow(onward, "vec_id long, v array<long>, cell int, bound double"))
    return best(at_home.select("query_id", "vec_id", "score").union(elsewhere)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
