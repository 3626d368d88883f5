"""Working on the rows of a review: samples, search, roll-ups, verdicts, and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactrail.functions import paths as P

PER_APP, HITS = 100, 300


def sampled(rows: DataFrame, salt: str, per_app: int = PER_APP) -> DataFrame:
    """The rows with `app` and `sampled`: up to per_app of each app, the same for the same salt; 0 samples all.

    The sample is the rows of least salted hash, so it doesn't depend on how rows are stored.
    """
    named = rows.withColumn("app", P.app(F.col("label")))
    if not per_app:
        return named.withColumn("sampled", F.lit(True))
    drawn = sample(rows.select("label", "left"), salt, per_app).select("label", "left", F.lit(True).alias("sampled"))
    return named.join(drawn, ["label", "left"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(False))).select(*named.columns, "sampled")


def sample(rows: DataFrame, salt: str, per_app: int = PER_APP) -> DataFrame:
    """The sampled rows alone; the window's limit keeps all but per_app rows of an app from being shuffled."""
    named = rows.withColumn("app", P.app(F.col("label")))
    if not per_app:
        return named
    drawn = Window.partitionBy("app").orderBy(F.sha2(F.concat(F.lit(salt), "app", "label"), 256), "label", "left")
    return named.withColumn("_turn", F.row_number().over(drawn)).where(F.col("_turn") <= per_app).drop("_turn")


def shown(rows: DataFrame, look: str) -> DataFrame:
    """The sampled rows and, after them, the hits of a search that are not among them; rows: of sampled()."""
    hits = rows.where(~F.col("sampled")).select(*rows.columns)
    return rows.where("sampled").withColumn("found", F.lit(False)).unionByName(ranked(hits, look).drop("rank").withColumn("found", F.lit(True)))


def dropped(rows: DataFrame, per_app: int = PER_APP) -> DataFrame:
    """How many rows of each app a sample leaves out."""
    n = rows.groupBy(P.app(F.col("label")).alias("app")).agg(F.count("*").alias("n"))
    return n.select("app", F.greatest(F.col("n") - per_app, F.lit(0)).alias("dropped")).where("dropped > 0")


def search(rows: DataFrame, look: str, most: int = HITS) -> DataFrame:
    """Rows that hold all terms, in any order, with their rank; the best `most` of them by rank and label.

    Rank 0: the file's name is the phrase; 1: it contains it; 2: it holds all terms; 3: label or paths do.
    """
    return ranked(rows, look).orderBy("rank", "label", "left").limit(most)


def ranked(rows: DataFrame, look: str) -> DataFrame:
    """All hits of search()."""
    phrase = look.strip().lower()
    terms = phrase.split()
    name = F.lower(P.base(P.segments(F.col("label"))))
    text = F.lower(F.concat_ws(" ", "label", "left", "right"))
    every = lambda c: _all([c.contains(t) for t in terms])
    rank = F.when(name == phrase, 0).when(name.contains(phrase), 1).when(every(name), 2).otherwise(3)
    return rows.where(every(text)).withColumn("rank", rank)


def _all(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found &= c
    return found


def verdicts(log: DataFrame) -> DataFrame:
    """The state of each (sid, left) from a log of records (sid, left, seq, viewed, reviewed, comments): the last counts.

    Blank comments are dropped; a last record that says nothing deletes.
    """
    said = F.filter(F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    clean = log.withColumn("comments", said)
    last = clean.groupBy("sid", "left").agg(F.max_by(F.struct("viewed", "reviewed", "comments"), "seq").alias("r"))
    flat = last.select("sid", "left", F.coalesce("r.viewed", F.lit(False)).alias("viewed"), F.coalesce("r.reviewed", F.lit(False)).alias("reviewed"), "r.comments")
    return flat.where("viewed OR reviewed OR size(comments) > 0")


def migrated(marks: DataFrame, column: str = "mark") -> DataFrame:
    """Marks of all generations, as JSON, in today's form: a bare verdict, {v, note}, or {viewed, reviewed, comments}.

    A bare verdict or v other than an empty one means reviewed; a note becomes a comment.
    """
    raw = F.col(column)
    old = F.from_json(raw, "v string, note string, viewed boolean, reviewed boolean, comments array<string>")
    bare = F.regexp_extract(raw, '^\\s*"(.*)"\\s*$', 1)
    note = F.when(F.trim(F.coalesce(old["note"], F.lit(""))) != "", F.array(F.trim(old["note"]))).otherwise(F.array().cast("array<string>"))
    is_bare = raw.rlike('^\\s*"')
    reviewed = F.when(is_bare, bare != "").otherwise(F.coalesce(old["reviewed"], F.coalesce(old["v"], F.lit("")) != ""))
    viewed = F.when(is_bare, bare != "").otherwise(F.coalesce(old["viewed"], F.coalesce(old["v"], F.lit("")) != ""))
    comments = F.when(is_bare, F.array().cast("array<string>")).otherwise(F.coalesce(old["comments"], note))
    return marks.select(*[c for c in marks.columns if c != column], viewed.alias("viewed"), reviewed.alias("reviewed"), comments.alias("comments"))


def mark_app(rows: DataFrame, sid: str, app: str, seq: int) -> DataFrame:
    """Log records that review every sampled row of an app at once."""
    own = rows.where((F.col("app") == app) & F.col("sampled"))
    return own.select(F.lit(sid).alias("sid"), "left", F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("viewed"), F.lit(True).alias("reviewed"), F.array().cast("array<string>").alias("comments"))


def rollup(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Counts of each app with its share of the run's bytes, and of the run in the row whose app is null.

    rows: left, how, lb, label; state: of verdicts(), one session's.
    """
    own = rows.join(state.select("left", "viewed", "reviewed", F.size("comments").alias("comments")), "left", "left")
    flag = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))
    folder = F.array_join(F.slice(F.split("label", "/"), F.lit(1), F.greatest(F.size(F.split("label", "/")) - 1, F.lit(0))), "/")
    named = own.withColumn("app", P.app(F.col("label"))).withColumn("folder", folder)
    total = own.agg(F.sum("lb")).first()[0] or 0
    share = F.round(F.sum(F.coalesce("lb", F.lit(0))) / F.lit(float(total)), 6) if total else F.lit(0.0)
    return named.rollup("app").agg(
        F.count("*").alias("files"), flag("reviewed").alias("reviewed"), flag("viewed").alias("viewed"), flag("comments").alias("comments"),
        F.sum((F.col("how") == "missing").cast("long")).alias("missing"), F.sum(F.coalesce("lb", F.lit(0))).alias("bytes"), F.countDistinct("folder").alias("folders"), share.alias("share"),
    )


def queue(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that are not reviewed, with the ids of the next and the previous one of their app."""
    open_ = rows.join(state.where("reviewed").select("left"), "left", "left_anti").withColumn("app", P.app(F.col("label")))
    order = Window.partitionBy("app").orderBy("id")
    return open_.withColumn("next_id", F.lead("id").over(order)).withColumn("previous_id", F.lag("id").over(order))


def tree(rows: DataFrame) -> DataFrame:
    """Rows in the order of a tree view: depth first, folders before files at each level."""
    parts = F.split("label", "/")
    last = F.size(parts) - 1
    key = F.transform(parts, lambda x, i: F.concat(F.when(i < last, "0").otherwise("1"), x))
    return rows.withColumn("depth", last).orderBy(key)
