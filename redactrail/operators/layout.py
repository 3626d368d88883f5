"""What a tree's folders say: layout names, a guess of its halves, double copies, and the audit of folder names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactrail.functions import paths as P

LAYOUT_DEPTH, SIBLINGS, AUDIT_DEPTH, SHARED = 4, 8, 4, 20


def layout_names(listing: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """(name, files, depth): folder names of levels that have few names, but for those that every path has."""
    parents = P.parents(P.segments(F.col("path")))
    at = listing.select(F.posexplode(parents).alias("depth", "seg")).where(F.col("depth") <= LAYOUT_DEPTH)
    each = at.groupBy("depth", F.lower("seg").alias("name")).agg(F.count("*").alias("n"))
    levels = each.groupBy("depth").agg(F.count("*").alias("names")).where(F.col("names") <= siblings)
    found = each.join(levels, "depth").groupBy("name").agg(F.sum("n").alias("files"), F.min("depth").alias("depth"))
    total = listing.agg(F.count("*").alias("total"))
    return found.join(F.broadcast(total)).where("files < total").select("name", "files", "depth")  # one row


def autosplit(listing: DataFrame) -> dict:
    """The best guess of source and output folder, with all candidates; from layout names, of which there are few.

    Source: of the names that mark sources the shallowest, then most frequent; none means the tree itself is the source.
    Output: the candidate with about as many files, a marker counting a quarter more; without a source the shallowest
    marker.
    """
    rows = {r["name"]: (r["files"], r["depth"]) for r in layout_names(listing).collect()}
    files = lambda n: rows[n][0]
    markers = [n for n in dict.fromkeys(P.SOURCE_MARKERS + P.OUTPUT_MARKERS) if n in rows]
    others = sorted((n for n in rows if n not in markers), key=lambda n: (-files(n), n))
    options = sorted([*markers, *others[:4]], key=lambda n: -files(n))

    def fork(names) -> str | None:
        return min((n for n in names if n in rows), key=lambda n: (rows[n][1], -files(n)), default=None)

    source = fork(P.SOURCE_MARKERS)
    if source is None:
        output = fork(P.OUTPUT_MARKERS)
    else:
        covers = lambda n: min(files(n), files(source)) / max(files(n), files(source)) + 0.25 * (n in P.OUTPUT_MARKERS)
        output = max((n for n in options if n != source), key=covers, default=None)
    warning = None
    if output is None:
        warning = "no folder of the output found"
    elif source and files(output) < files(source) / 2:
        warning = f"{output} has {files(output)} of the {files(source)} documents of {source}"
    return {"options": [{"name": n, "files": files(n)} for n in options], "source": source, "output": output, "warn": warning}


def variants(listing: DataFrame, ignore=P.LAYOUT) -> DataFrame:
    """(segment, n): layout segments of paths that differ in their layout only, so that a side holds documents twice."""
    segs = P.segments(F.col("path"))
    rows = listing.select(P.label(segs, ignore).alias("label"), F.filter(P.parents(segs), lambda x: F.lower(x).isin(*ignore)).alias("extra"))
    twice = rows.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return rows.join(twice, "label").select(F.explode("extra").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


def folder_map(pairs: DataFrame, left_dirs: DataFrame | None = None, ignore=P.LAYOUT, partial: bool = False) -> DataFrame:
    """(path, parent, name, out, files, state, risk, also, n_shared, shared) of each source folder down to AUDIT_DEPTH.

    Pairs of equal depth vote for what a folder became; the majority wins, ties by the first pair in order, the others are
    in `also`. n_shared: how many other folders have the same output; shared: the first SHARED of them. left_dirs (bucket) adds folders without votes, unless partial.
    """
    a, b = P.bucket(P.segments(F.col("left")), ignore), P.bucket(P.segments(F.col("right")), ignore)
    rows = pairs.where("right IS NOT NULL").select("left", a.alias("a"), b.alias("b")).where("size(a) = size(b) AND size(a) > 0")
    depth = lambda c: F.explode(F.sequence(F.lit(1), F.least(F.size(c), F.lit(AUDIT_DEPTH))))
    votes = rows.select("left", "a", "b", depth("a").alias("k")).select("left", F.slice("a", F.lit(1), F.col("k")).alias("folder"), F.element_at("b", F.col("k")).alias("out"))
    tally = votes.groupBy("folder", "out").agg(F.count("*").alias("n"), F.min("left").alias("first"))
    order = Window.partitionBy("folder").orderBy(F.desc("n"), "first")
    ranked = tally.withColumn("rank", F.row_number().over(order))
    also = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.col("out"))))
    voted = ranked.groupBy("folder").agg(F.max(F.when(F.col("rank") == 1, F.col("out"))).alias("out"), F.sum("n").alias("files"), also.alias("also"))
    if left_dirs is not None and not partial:
        every = left_dirs.where("size(bucket) > 0").select("bucket").distinct().select("bucket", depth("bucket").alias("k")).select(F.slice("bucket", F.lit(1), F.col("k")).alias("folder")).distinct()
        none = every.join(voted, "folder", "left_anti")
        voted = voted.unionByName(none.select("folder", F.lit(None).cast("string").alias("out"), F.lit(0).cast("long").alias("files"), F.array().cast("array<string>").alias("also")))
    path, name = F.array_join("folder", "/"), F.element_at("folder", -1)
    parent = F.array_join(F.slice("folder", F.lit(1), F.size("folder") - 1), "/")
    state = F.when(F.col("out").isNull(), "none").when(F.col("out") == name, "kept").otherwise("changed")
    named = voted.select(path.alias("path"), parent.alias("parent"), name.alias("name"), "out", "files", state.alias("state"), "also")
    claims = named.where("out IS NOT NULL").select("parent", "out", "path")
    turn = F.row_number().over(Window.partitionBy("parent", "out").orderBy("path"))
    few = claims.withColumn("turn", turn).where(F.col("turn") <= SHARED + 1).groupBy("parent", "out").agg(F.array_sort(F.collect_list("path")).alias("claimed"))
    n = claims.groupBy("parent", "out").agg(F.count("*").alias("n"))
    shared = F.slice(F.coalesce(F.array_except("claimed", F.array("path")), F.array().cast("array<string>")), 1, SHARED)
    joined = named.join(few, ["parent", "out"], "left").join(n, ["parent", "out"], "left").withColumn("n_shared", F.coalesce(F.col("n") - 1, F.lit(0)))
    return joined.select("path", "parent", "name", "out", "files", "state", F.when(F.col("state") != "changed", P.looks_personal(F.col("name"))).alias("risk"), "also", "n_shared", shared.alias("shared"))
