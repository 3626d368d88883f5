"""What changed in each pair, and which values were personal: diffs, dictionary marks, and leaks learned from the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactrail.functions import text as T

SAMPLES, LEAST_TOKEN = 14, 3
LEAST_REWROTE, LEAST_RATE = 2, 0.25


def tokenised(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, tokens): each text's token set, worked out once and used for everything below."""
    return texts.select(key, T.content_tokens(F.col("text")).alias("tokens"))


def metrics(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """What was removed and added in each row of a review, with the first SAMPLES tokens of each.

    rows: left, right, how; left and right: path and text of the documents, and if they have them, their files' bytes (a
    number) and digest, by which they are identical then, and pages. A missing document has null counts.
    """

    def side(df: DataFrame, end: str, p: str) -> DataFrame:
        has = lambda c, other: F.col(c) if c in df.columns else other
        text = F.col("text")
        own = has("bytes", F.octet_length(text)).alias(f"{p}bytes"), has("digest", text).alias(f"{p}digest"), has("pages", F.lit(None).cast("int")).alias(f"{p}pages")
        return df.select(F.col("path").alias(end), F.length(text).alias(f"{p}chars"), T.content_tokens(text).alias(f"{p}tokens"), *own)

    paged = [F.col("lpages").alias("left_pages"), F.col("rpages").alias("right_pages")] if "pages" in left.columns else []
    both = rows.join(side(left, "left", "l"), "left").join(side(right, "right", "r"), "right", "left")
    removed, added = F.array_except("ltokens", "rtokens"), F.array_except("rtokens", "ltokens")
    here = F.col("right").isNotNull()
    with_sets = both.select("*", F.when(here, removed).alias("_removed"), F.when(here, added).alias("_added"))
    return with_sets.select(
        "left", "how",
        F.col("lbytes").cast("long").alias("left_bytes"), F.col("rbytes").cast("long").alias("right_bytes"),
        F.col("lchars").cast("long").alias("left_chars"), F.col("rchars").cast("long").alias("right_chars"),
        F.when(here, F.size("_removed").cast("long")).alias("removed"), F.when(here, F.size("_added").cast("long")).alias("added"),
        F.when(here, F.col("ldigest") == F.col("rdigest")).alias("identical"),
        F.slice(F.array_sort("_removed"), 1, SAMPLES).alias("removed_sample"), F.slice(F.array_sort("_added"), 1, SAMPLES).alias("added_sample"), *paged,
    )


def removed_tokens(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(token, n): in how many pairs each token was removed."""
    a = tokenised(left).select(F.col("path").alias("left"), F.col("tokens").alias("a"))
    b = tokenised(right).select(F.col("path").alias("right"), F.col("tokens").alias("b"))
    gone = rows.select("left", "right").join(a, "left").join(b, "right").select(F.explode(F.array_except("a", "b")).alias("token"))
    return gone.groupBy("token").agg(F.count("*").alias("n"))


def pair_tokens(rows: DataFrame, left: DataFrame, right: DataFrame, limit_per_app: int | None = None) -> DataFrame:
    """(app, left, token, kept): each token of a pair's source, and whether the output has it too.

    rows: app, left, right. limit_per_app: learn from the first documents of an app only, in order of paths.
    """
    own = rows.where("right IS NOT NULL").select("app", "left", "right")
    if limit_per_app:
        order = Window.partitionBy("app").orderBy("left")
        own = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit_per_app).drop("_n")
    a = tokenised(left).select(F.col("path").alias("left"), F.col("tokens").alias("a"))
    b = tokenised(right).select(F.col("path").alias("right"), F.col("tokens").alias("b"))
    both = own.join(a, "left").join(b, "right")
    gone = both.select("app", "left", F.array_except("a", "b").alias("gone"), F.array_intersect("a", "b").alias("stays"))
    each = gone.select("app", "left", F.size("gone").alias("_n"), F.posexplode(F.concat("gone", "stays")).alias("_at", "token"))
    return each.select("app", "left", "token", (F.col("_at") >= F.col("_n")).alias("kept"))


def learned(tokens: DataFrame) -> DataFrame:
    """(app, token, rewrote, kept): in how many documents of an app a token was rewritten, and in how many it stayed."""
    stays = F.col("kept").cast("long")
    return tokens.groupBy("app", "token").agg(F.sum(1 - stays).alias("rewrote"), F.sum(stays).alias("kept"))


def leaks(counts: DataFrame) -> DataFrame:
    """(app, token, rate): tokens that stay in some documents though they are rewritten elsewhere in the app."""
    rate = F.col("rewrote") / (F.col("rewrote") + F.col("kept"))
    found = counts.where((F.col("rewrote") >= LEAST_REWROTE) & (rate >= LEAST_RATE) & (F.col("kept") > 0))
    return found.select("app", "token", F.round(rate, 6).alias("rate"))


def leaks_by_document(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(app, left, token): the leaks that each document still holds."""
    return tokens.where("kept").join(leaks(counts), ["app", "token"], "left_semi").select("app", "left", "token")


def vocabulary(mappings: DataFrame) -> DataFrame:
    """(kind, value, first_token) of a table of substitutions (original, replacement, and deleted if it has that).

    kind: `original` for values that were replaced, `replacement` for what they became, `leak` for values that were found
    but left alone.
    """
    rows = mappings.where(~F.coalesce(F.col("deleted").cast("boolean"), F.lit(False))) if "deleted" in mappings.columns else mappings
    blank = F.coalesce(F.trim("replacement"), F.lit("")) == ""
    kinds = F.array(
        F.struct(F.when(blank, "leak").otherwise("original").alias("kind"), F.trim("original").alias("value")),
        F.struct(F.lit("replacement").alias("kind"), F.when(~blank, F.trim("replacement")).alias("value")),
    )
    flat = rows.select(F.explode(kinds).alias("x")).select("x.kind", "x.value").where(F.length("value") >= LEAST_TOKEN).distinct()
    return flat.withColumn("first_token", T.first_token(F.col("value"))).where("first_token IS NOT NULL")


def marks(texts: DataFrame, vocab: DataFrame, most: int | None = None, key: str = "path") -> DataFrame:
    """(path, kind, value): the values of the vocabulary that each text holds, whatever their case.

    Texts and values meet in a value's first token; a text's candidates come together, and it is searched for all of them at
    once. Texts that share a path are told apart by their digests, so none is searched for another's candidates. A text gets
    its `most` longest values of a kind (None: all).
    """
    own = texts.select(key, F.md5("text").alias("_digest"), "text")
    tokens = own.select(key, "_digest", F.explode(T.vocabulary_tokens(F.col("text"))).alias("first_token"))
    met = tokens.join(vocab, "first_token").groupBy(key, "_digest").agg(F.collect_set(F.struct("kind", "value")).alias("_values"))
    both = own.select(key, "_digest", F.lower("text").alias("_text")).join(met, [key, "_digest"])
    held = F.filter("_values", lambda v: F.col("_text").contains(F.lower(v["value"])))
    found = both.select(key, F.explode(held).alias("_v")).select(key, "_v.kind", "_v.value").distinct()
    if most is None:
        return found
    order = Window.partitionBy(key, "kind").orderBy(F.desc(F.length("value")), "value")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
