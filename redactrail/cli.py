"""Command line: opens a review of two trees and writes its rows.

    python -m redactrail.cli --left DIR --right DIR [--only raw] [--right-only out] --out DIR [--per-app 100] [--salt TEXT]
    python -m redactrail.cli --root DIR --out DIR          (halves guessed from the folders' names)

With --metrics DIR, what the documents of each pair say is compared and written; with --map DB and --marks DIR, the values of
a table of substitutions that they hold.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrail.functions import formats
from redactrail.functions import paths as P
from redactrail.operators import align, diff, layout, review
from redactrail.operators.stages import settled
from redactrail.sources import listing, mappings


def side(spark: SparkSession, location: str, only: str | None, exclude: str | None, drop: list[str]):
    """The documents of a location, and whether its listing was cut short."""
    files = settled(spark.read.format("listing").option("path", location).load())
    segs = P.segments(F.col("path"))
    return files.where(P.selected(segs, only, exclude, drop)).select("path", "size"), bool(files.agg(F.max("truncated")).first()[0])


def open_review(spark: SparkSession, left: str, right: str, left_only: str | None = None, right_only: str | None = None, left_exclude: str | None = None, right_exclude: str | None = None, drop_globs=(), ignore=P.LAYOUT, per_app: int = review.PER_APP, salt: str = ""):
    """Rows of a review: (rows, variants). rows: id, left, right, how, lb, rb, label, kept, app, sampled.

    A left location that is the right one with nothing to tell them apart is reviewed alone: each file beside itself.
    """
    listing.register(spark)
    ignore = tuple({*ignore, *(s.lower() for s in (left_only, right_only) if s)})
    a, cut_a = side(spark, left, left_only, left_exclude, list(drop_globs))
    single = left == right and not (left_only or right_only or left_exclude or right_exclude)
    b, cut_b = (a, cut_a) if single else side(spark, right, right_only, right_exclude, list(drop_globs))
    left_side, right_side = settled(align.prepared(a, ignore)), settled(align.prepared(b, ignore))
    if single:
        pairs = left_side.select(F.col("path").alias("left"), F.col("path").alias("right"), F.lit("single").alias("how"))
    else:
        pairs = align.align(left_side, right_side)
        rest = align._rest(left_side, pairs, "left")
        beyond = align.out_of_scope(rest, right_side, siblings_from=left_side)
        left_side = settled(left_side.join(beyond.select("path"), "path", "left_anti"))
    rows = align.review_rows(left_side.limit(0) if cut_a or cut_b else left_side, right_side, pairs, ignore) if not single else align.numbered(
        pairs.join(left_side.select(F.col("path").alias("left"), F.col("size").alias("lb"), "label"), "left").select("left", "right", "how", "lb", F.col("lb").alias("rb"), "label", F.array().cast("array<string>").alias("kept"))
    )
    return review.sampled(rows, salt, per_app), layout.variants(a, ignore)


def documents(rows: DataFrame, end: str, location: str) -> DataFrame:
    """(path, text, bytes, digest, pages): what the documents at one end of a review's rows say, and of their files."""
    paths = rows.where(F.col(end).isNotNull()).select(F.col(end).alias("path")).distinct()
    files = paths.withColumn("content", listing.content(location, F.col("path")))
    pages = F.size(formats.page_sizes(F.col("path"), F.col("content")))
    return files.select(
        "path", formats.document_text(F.col("path"), F.col("content")).alias("text"), F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("digest"),
        F.when(pages >= 0, pages).alias("pages"),
    )


def open_reviews(spark: SparkSession, jobs: list[dict]) -> DataFrame:
    """The rows of several reviews, each with its review_id; jobs: arguments of open_review()."""
    each = [open_review(spark, **job)[0].withColumn("review_id", P.session_id(F.lit(job["left"]), F.lit(job["right"]))) for job in jobs]
    return reduce(DataFrame.unionByName, each)


def main(arguments: list[str] | None = None) -> None:
    asked = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("root", "left", "right", "only", "right-only", "exclude", "right-exclude", "salt", "out", "metrics", "map", "marks"):
        asked.add_argument(f"--{name}", default="" if name == "salt" else None)
    asked.add_argument("--drop", action="append", default=[])
    asked.add_argument("--per-app", type=int, default=review.PER_APP)
    a = asked.parse_args(arguments)
    spark = SparkSession.builder.appName("redactrail").getOrCreate()
    left, right, only, right_only, exclude = a.left, a.right, a.only, a.right_only, a.exclude
    if a.root:
        listing.register(spark)
        left = right = P.resolve_root(a.root)
        guess = layout.autosplit(spark.read.format("listing").option("path", left).load())
        only, right_only = guess["source"], guess["output"]
        exclude = None if only else right_only
        print(guess)
    if not (left and right):
        asked.error("give --root, or --left and --right")
    rows, doubles = open_review(spark, left, right, only, right_only, exclude, a.right_exclude, a.drop, per_app=a.per_app, salt=a.salt)
    rows = settled(rows)
    if a.out:
        rows.write.mode("overwrite").parquet(a.out)
    if a.metrics:
        diff.metrics(rows.select("left", "right", "how"), documents(rows, "left", left), documents(rows, "right", right)).write.mode("overwrite").parquet(a.metrics)
    if a.map and a.marks:
        vocabulary = diff.vocabulary(mappings.read(spark, a.map))
        sides = [diff.marks(documents(rows, end, at), vocabulary).withColumn("side", F.lit(end)) for end, at in (("left", left), ("right", right))]
        reduce(DataFrame.unionByName, sides).write.mode("overwrite").parquet(a.marks)
    for r in align.counts(rows).collect():
        print(r["how"], r["n"])
    for r in doubles.collect():
        print("double copies under", r["segment"], r["n"])


if __name__ == "__main__":
    main()
