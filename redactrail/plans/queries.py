"""The registered queries: each operator over the synthetic run, with the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrail.functions import formats, text
from redactrail.functions import paths as P
from redactrail.operators import align, diff, layout, review
from redactrail.operators.stages import settled
from redactrail.plans import synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = synthetic.duckdb_views()
#: Exact pairs, and what they leave on both sides.
EXACT = """
px AS (
  SELECT a.path AS "left", b.path AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY bucket, base ORDER BY path) AS turn FROM l) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY bucket, base ORDER BY path DESC) AS turn FROM r) b USING (bucket, base, turn)
), lx AS (SELECT * FROM l WHERE path NOT IN (SELECT "left" FROM px)), rx AS (SELECT * FROM r WHERE path NOT IN (SELECT "right" FROM px))
"""
TOKENS = "list_distinct(list_filter(string_split_regex({}, '[^A-Za-z0-9@._+-]+'), lambda x: length(x) >= 3))"
ROWS = """
pr AS (SELECT "left", "right", 'exact' AS how FROM px), rv AS (
  SELECT l.path AS "left", pr."right", coalesce(how, 'missing') AS how, l.size AS lb, r.size AS rb, l.label, l.app FROM l LEFT JOIN pr ON pr."left" = l.path LEFT JOIN r ON r.path = pr."right"
)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return align.prepared(synthetic.left(spark, sf_dir)), align.prepared(synthetic.right(spark, sf_dir))


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both trees, each masked and written once: queries read paths, sizes and texts of them several times."""
    return settled(synthetic.left(spark, sf_dir)), settled(synthetic.right(spark, sf_dir))


def after_exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = sides(spark, sf_dir)
    pairs = align.exact(a, b)
    return align._rest(a, pairs, "left"), align._rest(b, pairs, "right")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(*sides(spark, sf_dir))


def rows_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact pairs and missing documents: left, right, how, lb, rb, label, app."""
    pairs = align.exact(a, b)
    both = pairs.unionByName(align.missing(a, pairs))
    own = a.select(F.col("path").alias("left"), F.col("size").alias("lb"), "label", P.app(F.col("label")).alias("app"))
    return both.join(own, "left").join(b.select(F.col("path").alias("right"), F.col("size").alias("rb")), "right", "left")


NOISY = """
SELECT path, size FROM l UNION ALL SELECT concat('__MACOSX/', path), 1 FROM l WHERE doc_id % 10 = 0
UNION ALL SELECT concat('_state/', path), 1 FROM l WHERE doc_id % 10 = 1 UNION ALL SELECT concat(path, '.bin'), 1 FROM l WHERE doc_id % 10 = 2
"""


@query(f"""WITH {VIEWS}, noisy AS ({NOISY}) SELECT path, size, lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) AS ext, CAST(len(string_split(path, '/')) AS integer) AS depth
FROM noisy WHERE NOT starts_with(path, '_') AND NOT ends_with(path, '.bin')""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = synthetic.left(spark, sf_dir).select("doc_id", "path", "size")  # noqa: E741
    noisy = spark.sql(NOISY.replace("FROM l", "FROM {l}"), l=l)
    segs = P.segments(F.col("path"))
    return noisy.where(P.is_document(segs)).select("path", "size", P.extension(P.base(segs)).alias("ext"), F.size(segs).alias("depth"))


@query(f"WITH {VIEWS} SELECT path, label, app FROM r")
def normalise_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = align.prepared(synthetic.right(spark, sf_dir))
    return b.select("path", "label", P.app(F.col("label")).alias("app"))


@query(f'WITH {VIEWS}, {EXACT} SELECT "left", "right" FROM px')
def pair_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.exact(*sides(spark, sf_dir)).select("left", "right")


#: A folder for each customer: a file of the same name on both sides, a renamed one, and a second renamed one in some.
FOLDERS = """
SELECT concat(c_mktsegment, '/{layout}/c', CAST(c_custkey AS string), '/', name) AS path, CAST(c_custkey AS bigint) AS size FROM (
  SELECT c_custkey, c_mktsegment, 'same.txt' AS name FROM customer UNION ALL SELECT c_custkey, c_mktsegment, '{other}.txt' FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment, '{other}_too.txt' FROM customer WHERE c_custkey % 3 = 0
) AS files
"""
_PARTS = "SELECT *, string_split(path, '/')[1] || '/' || string_split(path, '/')[3] AS bucket, string_split(path, '/')[4] AS base FROM ({})"


@query(f"""WITH l AS ({_PARTS.format(FOLDERS.format(layout="raw", other="letter"))}), r AS ({_PARTS.format(FOLDERS.format(layout="files", other="page"))}), {EXACT}
SELECT a."left", b."right" FROM (SELECT bucket, min(path) AS "left" FROM lx GROUP BY bucket HAVING count(*) = 1) a
JOIN (SELECT bucket, min(path) AS "right" FROM rx GROUP BY bucket HAVING count(*) = 1) b USING (bucket)""")
def pair_sole(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = [FOLDERS.format(layout="raw", other="letter"), FOLDERS.format(layout="files", other="page")]
    a, b = (align.prepared(spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customer)) for sql in made)
    pairs = align.exact(a, b)
    return align.sole(align._rest(a, pairs, "left"), align._rest(b, pairs, "right")).select("left", "right")


@query(f"""WITH {VIEWS}, {EXACT} SELECT a.path AS "left", b.path AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY size DESC, path) AS turn FROM lx) a
JOIN (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY size DESC, path) AS turn FROM rx) b USING (bucket, turn)""")
def pair_by_size_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.by_size_rank(*after_exact(spark, sf_dir)).select("left", "right")


@query(f"""WITH {VIEWS}, {EXACT} SELECT a."left", b."right" FROM (SELECT base, min(path) AS "left" FROM lx GROUP BY base HAVING count(*) = 1) a
JOIN (SELECT base, min(path) AS "right" FROM rx GROUP BY base HAVING count(*) = 1) b USING (base)""")
def pair_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unique_name(*after_exact(spark, sf_dir)).select("left", "right")


#: For renamed folders the shape has to tell people apart: two folders below, of remainders that no two of 97 * 101 share.
PEOPLE = """
SELECT DISTINCT concat('people/', {name}, '/', kind, '/page.txt') AS path, CAST(1 AS bigint) AS size FROM (
  SELECT c_custkey AS id, concat('kind', CAST(c_custkey % 97 AS string)) AS kind FROM customer
  UNION ALL SELECT c_custkey, concat('also', CAST(c_custkey % 101 AS string)) FROM customer
) AS people
"""
OURS, THEIRS = PEOPLE.format(name="concat('person', CAST(id AS string))"), PEOPLE.format(name="concat('alias', CAST(id * 7 AS string))")


@query(f"""WITH a AS (SELECT string_split(path, '/')[2] AS name, array_to_string(list_sort(list_distinct(list(string_split(path, '/')[3]))), ',') AS shape FROM ({OURS}) GROUP BY 1),
b AS (SELECT string_split(path, '/')[2] AS name, array_to_string(list_sort(list_distinct(list(string_split(path, '/')[3]))), ',') AS shape FROM ({THEIRS}) GROUP BY 1)
SELECT 'people/' || a.name AS left_dir, 'people/' || b.name AS right_dir FROM a JOIN b USING (shape) WHERE shape IN (SELECT shape FROM a GROUP BY 1 HAVING count(*) = 1) AND shape IN (SELECT shape FROM b GROUP BY 1 HAVING count(*) = 1)""")
def align_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    trees = [align.prepared(spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customer)) for sql in (OURS, THEIRS)]
    found = align.renamed_folders(*trees, by_profile=False)
    under = lambda c: F.concat(F.array_join("parent", "/"), F.lit("/"), F.col(c))
    return found.select(under("left_name").alias("left_dir"), under("right_name").alias("right_dir"))


@query()
def pair_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    pairs = align.align(a, b)
    return pairs.unionByName(align.missing(a, pairs))


@query(f"WITH {VIEWS}, {EXACT}, {ROWS} SELECT how, count(*) AS n FROM rv GROUP BY how")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.counts(rows(spark, sf_dir))


@query(f"WITH {VIEWS}, {EXACT} SELECT path AS \"left\", label FROM lx")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return align.missing(a, align.exact(a, b)).select("left", P.label(P.segments(F.col("left"))).alias("label"))


def _units(siblings: str) -> str:
    level = "SELECT DISTINCT bucket_, k, array_to_string(bucket_[1:k-1], '/') AS parent, bucket_[k] AS name FROM (SELECT DISTINCT bucket_ FROM {}), (SELECT unnest([1, 2]) AS k) WHERE k <= len(bucket_)"
    return f"""WITH {VIEWS}, {EXACT}, left_ AS ({level.format("lx")}), right_ AS ({level.format("r")}), sib AS ({level.format(siblings)}),
carried AS (SELECT DISTINCT s.parent FROM sib s JOIN right_ t ON s.parent = t.parent AND s.name = t.name),
absent AS (SELECT bucket_, min(k) AS k FROM left_ a WHERE NOT EXISTS (SELECT 1 FROM right_ t WHERE t.parent = a.parent AND t.name = a.name) GROUP BY bucket_),
units AS (SELECT bucket_, array_to_string(bucket_[1:k], '/') AS unit FROM absent WHERE array_to_string(bucket_[1:k-1], '/') IN (SELECT parent FROM carried))
SELECT unit, count(*) AS n FROM lx JOIN units USING (bucket_) GROUP BY unit"""


@query(_units("l"))
def out_of_scope_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    rest = align._rest(a, align.exact(a, b), "left")
    return align.out_of_scope(rest, b, siblings_from=a).groupBy("unit").agg(F.count("*").alias("n"))


@query(_units("lx"))
def out_of_scope_units_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    rest = align._rest(a, align.exact(a, b), "left")
    return align.out_of_scope(rest, b).groupBy("unit").agg(F.count("*").alias("n"))


@query(f"""WITH {VIEWS}, both_ AS (SELECT path, label, segs FROM l UNION ALL SELECT path, label, segs FROM r), twice AS (SELECT label FROM both_ GROUP BY label HAVING count(*) > 1)
SELECT segment, count(*) AS n FROM (SELECT unnest(list_filter(segs[1:-2], lambda x: list_contains(['raw', 'files'], lower(x)))) AS segment FROM both_ JOIN twice USING (label)) GROUP BY segment""")
def variant_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = synthetic.left(spark, sf_dir).select("path").union(synthetic.right(spark, sf_dir).select("path"))
    return layout.variants(both)


@query(f"""WITH {VIEWS}, both_ AS (SELECT segs FROM l UNION ALL SELECT segs FROM r), each_ AS (SELECT depth - 1 AS depth, lower(segs[depth]) AS name, count(*) AS n FROM both_, (SELECT unnest(range(1, 6)) AS depth) WHERE depth < len(segs) GROUP BY 1, 2)
SELECT name, CAST(sum(n) AS bigint) AS files, CAST(min(depth) AS integer) AS depth FROM each_ WHERE depth IN (SELECT depth FROM each_ GROUP BY depth HAVING count(*) <= 8) GROUP BY name HAVING sum(n) < (SELECT count(*) FROM both_)""")
def layout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = synthetic.left(spark, sf_dir).select("path").union(synthetic.right(spark, sf_dir).select("path"))
    return layout.layout_names(both)


_REASON = """CASE WHEN regexp_matches({name}, '[^@\\s/]+@[^@\\s/]+[.][A-Za-z]{{2,}}') THEN 'an email address'
  WHEN starts_with(lower({name}), 'dm_') OR starts_with(lower({name}), 'dm-') OR starts_with(lower({name}), 'mpdm_') OR starts_with(lower({name}), 'mpdm-') THEN 'a chat that is called by who takes part'
  WHEN regexp_matches({name}, '[0-9]{{9,}}') THEN 'nine digits or more in a row'
  WHEN regexp_matches({name}, '^[A-Z]?[a-z]{{2,}}[.][A-Z]?[a-z]{{2,}}$') AND lower(string_split({name}, '.')[1]) NOT IN ({stop}) AND lower(string_split({name}, '.')[2]) NOT IN ({stop}) THEN 'a person''s name' END"""
_STOP = ", ".join(f"'{n}'" for n in P.NOT_NAMES)


@query(f"""WITH {VIEWS}, {EXACT}, un AS (SELECT a."left", b."right" FROM (SELECT base, min(path) AS "left" FROM lx GROUP BY base HAVING count(*) = 1) a JOIN (SELECT base, min(path) AS "right" FROM rx GROUP BY base HAVING count(*) = 1) b USING (base)),
p AS (SELECT l.path AS first, l.bucket_ AS a, r.bucket_ AS b FROM (SELECT "left", "right" FROM px UNION ALL SELECT * FROM un) x JOIN l ON l.path = x."left" JOIN r ON r.path = x."right" WHERE len(l.bucket_) = len(r.bucket_)),
v AS (SELECT first, array_to_string(a[1:k], '/') AS path, b[k] AS out FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE k <= len(a)),
t AS (SELECT path, out, count(*) AS n, min(first) AS first FROM v GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first) AS rank FROM t),
f AS (SELECT path, max(out) FILTER (rank = 1) AS out, CAST(sum(n) AS bigint) AS files, coalesce(array_to_string(list_sort(list(out) FILTER (rank > 1)), ' '), '') AS also, string_split(path, '/')[-1] AS name, array_to_string(string_split(path, '/')[1:-2], '/') AS parent FROM w GROUP BY path),
g AS (SELECT *, CASE WHEN out = name THEN 'kept' ELSE 'changed' END AS state, list(path) OVER (PARTITION BY parent, out) AS all_ FROM f)
SELECT path, parent, name, out, files, state, CASE WHEN state <> 'changed' THEN {_REASON.format(name="name", stop=_STOP)} END AS risk, also, len(all_) - 1 AS n_shared, array_to_string(list_sort(list_filter(all_, lambda x: x <> path))[1:20], ' ') AS shared FROM g""")
def folder_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    pairs = settled(align.exact(a, b))
    named = align.unique_name(align._rest(a, pairs, "left"), align._rest(b, pairs, "right"))
    return layout.folder_map(pairs.union(named)).withColumns({c: F.array_join(c, " ") for c in ("also", "shared")})


#: Folder names of all the kinds that the test of names tells apart.
NAMES = """
SELECT CASE CAST(c_custkey % 8 AS integer) WHEN 0 THEN concat('user', CAST(c_custkey AS string), '@example.com') WHEN 1 THEN concat('dm_person_', CAST(c_custkey AS string))
  WHEN 2 THEN concat('id', CAST(c_custkey + 1000000000 AS string)) WHEN 3 THEN concat('maria.', CASE WHEN c_custkey % 3 = 0 THEN 'jones' ELSE 'json' END) WHEN 4 THEN concat('data-', CAST(c_custkey AS string))
  WHEN 5 THEN 'Anna.Smith' WHEN 6 THEN 'SQaw.SQaw' ELSE lower(c_name) END AS name FROM customer
"""


@query(f"SELECT name, reason, count(*) AS n FROM (SELECT name, {_REASON.format(name='name', stop=_STOP)} AS reason FROM ({NAMES})) WHERE reason IS NOT NULL GROUP BY name, reason")
def personal_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = spark.sql(NAMES.replace("FROM customer", "FROM {customer}"), customer=customer)
    found = names.select("name", P.looks_personal(F.col("name")).alias("reason")).where("reason IS NOT NULL")
    return found.groupBy("name", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {VIEWS}, {EXACT}, {ROWS}, b AS (SELECT rv."left", rv."right", rv.how, x.text AS a, y.text AS b FROM rv JOIN l x ON x.path = rv."left" LEFT JOIN r y ON y.path = rv."right"),
ta AS (SELECT "left", unnest({TOKENS.format("a")}) AS token FROM b WHERE "right" IS NOT NULL), tb AS (SELECT "left", unnest({TOKENS.format("b")}) AS token FROM b WHERE "right" IS NOT NULL),
gone AS (SELECT "left", count(*) AS n, list_sort(list(token))[1:14] AS some FROM ta ANTI JOIN tb USING ("left", token) GROUP BY 1), new_ AS (SELECT "left", count(*) AS n, list_sort(list(token))[1:14] AS some FROM tb ANTI JOIN ta USING ("left", token) GROUP BY 1)
SELECT b."left", how, CAST(strlen(a) AS bigint) AS left_bytes, CAST(strlen(b) AS bigint) AS right_bytes, CAST(length(a) AS bigint) AS left_chars, CAST(length(b) AS bigint) AS right_chars,
CASE WHEN "right" IS NOT NULL THEN coalesce(gone.n, 0) END AS removed, CASE WHEN "right" IS NOT NULL THEN coalesce(new_.n, 0) END AS added, CASE WHEN "right" IS NOT NULL THEN a = b END AS identical,
CASE WHEN "right" IS NOT NULL THEN coalesce(array_to_string(gone.some, ' '), '') END AS removed_sample, CASE WHEN "right" IS NOT NULL THEN coalesce(array_to_string(new_.some, ' '), '') END AS added_sample
FROM b LEFT JOIN gone ON gone."left" = b."left" LEFT JOIN new_ ON new_."left" = b."left\"""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = trees(spark, sf_dir)
    found = diff.metrics(rows_of(align.prepared(a), align.prepared(b)).select("left", "right", "how"), a.select("path", "text"), b.select("path", "text"))
    return found.withColumns({c: F.array_join(c, " ") for c in ("removed_sample", "added_sample")})


def learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = trees(spark, sf_dir)
    return diff.pair_tokens(rows_of(align.prepared(a), align.prepared(b)), a.select("path", "text"), b.select("path", "text"))


_SETS = f"""ta AS (SELECT rv.app, "left", unnest({TOKENS.format("x.text")}) AS token FROM rv JOIN l x ON x.path = rv."left" WHERE "right" IS NOT NULL),
tb AS (SELECT rv.app, "left", unnest({TOKENS.format("y.text")}) AS token FROM rv JOIN r y ON y.path = rv."right"), tk AS (SELECT ta.*, tb.token IS NOT NULL AS kept FROM ta LEFT JOIN tb ON ta."left" = tb."left" AND ta.token = tb.token)"""
_LEARNED = f"WITH {VIEWS}, {EXACT}, {ROWS}, {_SETS}, lc AS (SELECT app, token, count(*) FILTER (NOT kept) AS rewrote, count(*) FILTER (kept) AS kept FROM tk GROUP BY 1, 2)"


@query(f"{_LEARNED} SELECT token, CAST(sum(rewrote) AS bigint) AS n FROM lc GROUP BY token HAVING sum(rewrote) > 0 ORDER BY n DESC, token LIMIT 100")
def removed_tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 100 tokens that most pairs lost."""
    a, b = trees(spark, sf_dir)
    pairs = rows_of(align.prepared(a), align.prepared(b)).where("right IS NOT NULL")
    return diff.removed_tokens(pairs, a.select("path", "text"), b.select("path", "text")).orderBy(F.desc("n"), "token").limit(100)


@query(f"{_LEARNED} SELECT app, token, rewrote, kept FROM lc")
def learned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.learned(learning(spark, sf_dir))


@query(f"{_LEARNED} SELECT app, token, round(rewrote / (rewrote + kept), 6) AS rate FROM lc WHERE rewrote >= 2 AND kept > 0 AND rewrote / (rewrote + kept) >= 0.25")
def derived_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.leaks(diff.learned(learning(spark, sf_dir)))


#: A table of substitutions: words of the benchmark, some of them replaced, some found but left alone.
MAPPINGS = """
SELECT DISTINCT word AS original, CASE WHEN length(word) % 3 = 0 THEN CAST(NULL AS string) ELSE concat('alias_', word) END AS replacement, false AS deleted
FROM (SELECT {words} AS word FROM benchmark) AS words WHERE length(word) >= 9
"""


@query(f"""WITH {VIEWS}, m AS ({MAPPINGS.format(words="unnest(string_split_regex(text, '[^A-Za-z0-9]+'))")}),
v AS (SELECT DISTINCT kind, value, lower(value) AS low, list_filter(string_split_regex(lower(value), '[^A-Za-z0-9@._+-]+'), lambda x: x <> '')[1] AS first_token FROM (
  SELECT CASE WHEN replacement IS NULL THEN 'leak' ELSE 'original' END AS kind, original AS value FROM m UNION ALL SELECT 'replacement', replacement FROM m WHERE replacement IS NOT NULL)),
t AS (SELECT path, lower(text) AS low_text, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^A-Za-z0-9@._+-]+'), lambda x: x <> ''))) AS first_token FROM r)
SELECT DISTINCT path, kind, value FROM t JOIN v USING (first_token) WHERE contains(low_text, low)""")
def vocab_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mappings = spark.sql(MAPPINGS.format(words="explode(split(text, '[^A-Za-z0-9]+'))").replace("FROM benchmark", "FROM {benchmark}"), benchmark=benchmark)
    return diff.marks(trees(spark, sf_dir)[1].select("path", "text"), diff.vocabulary(mappings))


_DRAWN = "row_number() OVER (PARTITION BY app ORDER BY sha256('salt' || app || label), label)"


@query(f"WITH {VIEWS}, {EXACT}, {ROWS} SELECT app, label FROM (SELECT app, label, {_DRAWN} AS turn FROM rv) WHERE turn <= 20")
def sample_per_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sample(rows(spark, sf_dir), "salt", 20).select("app", "label")


@query(f"""WITH {VIEWS}, {EXACT}, {ROWS} SELECT rank, label FROM (SELECT CASE WHEN lower(string_split(label, '/')[-1]) = 'doc 12' THEN 0 WHEN contains(lower(string_split(label, '/')[-1]), 'doc 12') THEN 1
  WHEN contains(lower(string_split(label, '/')[-1]), 'doc') AND contains(lower(string_split(label, '/')[-1]), '12') THEN 2 ELSE 3 END AS rank, label, "left" FROM rv
  WHERE contains(lower(concat_ws(' ', label, "left", "right")), 'doc') AND contains(lower(concat_ws(' ', label, "left", "right")), '12')) ORDER BY rank, label, "left" LIMIT 300""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.search(rows(spark, sf_dir), "doc 12").select("rank", "label")


@query(f'WITH {VIEWS}, {EXACT}, {ROWS} SELECT row_number() OVER (ORDER BY label, "left") - 1 AS id, label, {_DRAWN} <= 20 AS sampled FROM rv')
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sampled(align.numbered(rows(spark, sf_dir)), "salt", 20).select("id", "label", "sampled")


#: A log of verdicts: each event speaks of one document, the later the event the more it counts; some take all back.
LOG = """
SELECT 'review' AS sid, concat('src', CAST(user_id % 20 AS string), '/raw/', CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'de' END, '/doc_', lpad(CAST(event_id % 500 AS string), 7, '0'), '.txt') AS "left", event_id AS seq,
  event_id % 3 <> 0 AS viewed, event_id % 5 = 0 AS reviewed, CASE WHEN event_id % 4 = 0 THEN {list} ELSE {none} END AS comments FROM events
"""
_LOG_DUCK = LOG.format(list="[event_type, ' ']", none="['']")
_STATE = f"""st AS (SELECT sid, "left", viewed, reviewed, len(list_filter(comments, lambda x: trim(x) <> '')) AS n_comments FROM (SELECT *, row_number() OVER (PARTITION BY sid, "left" ORDER BY seq DESC) AS turn FROM ({_LOG_DUCK})) WHERE turn = 1)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(LOG.format(list="array(event_type, ' ')", none="array('')").replace("FROM events", "FROM {events}").replace('"left"', "`left`"), events=events)


@query(f"""WITH {_STATE} SELECT sid, "left", viewed, reviewed, CAST(n_comments AS integer) AS n_comments FROM st WHERE viewed OR reviewed OR n_comments > 0""")
def verdict_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.verdicts(log(spark, sf_dir)).select("sid", "left", "viewed", "reviewed", F.size("comments").alias("n_comments"))


@query(f"""WITH {VIEWS}, {EXACT}, {ROWS}, {_STATE} SELECT app, count(*) AS files, CAST(sum(coalesce(CAST(reviewed AS integer), 0)) AS bigint) AS reviewed, CAST(sum(coalesce(CAST(viewed AS integer), 0)) AS bigint) AS viewed,
CAST(sum(coalesce(n_comments, 0)) AS bigint) AS comments, CAST(sum(CAST(how = 'missing' AS integer)) AS bigint) AS missing, CAST(sum(lb) AS bigint) AS bytes, count(DISTINCT regexp_replace(label, '/[^/]*$', '')) AS folders,
round(CAST(sum(lb) AS double) / (SELECT sum(lb) FROM rv), 6) AS share
FROM rv LEFT JOIN (SELECT * FROM st WHERE viewed OR reviewed OR n_comments > 0) USING ("left") GROUP BY ROLLUP (app)""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rollup(rows(spark, sf_dir), review.verdicts(log(spark, sf_dir)))


#: Documents of up to 100 lines of JSON, every tenth broken and every seventh empty.
LINES = """
SELECT CAST(floor(event_id / 100) AS bigint) AS doc, event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' WHEN event_id % 7 = 0 THEN '' ELSE props END AS line FROM events
"""


@query(f"SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY event_id) AS integer) AS record_no, NOT json_valid(line) AS bad FROM ({LINES}) WHERE trim(line) <> ''")
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = spark.sql(LINES.replace("FROM events", "FROM {events}").replace("{broken", "{{broken"), events=events)
    docs = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return formats.jsonl_records(docs, "doc").select("doc", "record_no", "bad")


def _replaced(value: str, steps) -> str:
    for pattern, to in steps:
        value = "regexp_replace({}, '{}', {}, 'g')".format(value, pattern, " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in to) or "''")
    return value


#: The entities that pages have.
_SHOWN = _replaced("html", formats.HTML_STEPS)
for _entity, _sign in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
    _SHOWN = f"replace({_SHOWN}, '{_entity}', '{_sign}')"
_SHOWN = _replaced(_SHOWN, formats.BLANK_STEPS)


@query(f"SELECT page_id, CAST(length(t) AS integer) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {_SHOWN} AS t FROM pages)")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", formats.html_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


#: Turns of conversations as mails: the source's in base64, the output's as it is, its digits replaced in every second one.
_TURNS = """
SELECT concat('mail', CAST(conv_id AS string), '_', CAST(turn AS string), '.eml') AS path, coalesce(role, '') AS role, coalesce(text, '') AS a,
  CASE WHEN turn % 2 = 0 THEN regexp_replace(coalesce(text, ''), '[0-9]+', 'number'{all}) ELSE coalesce(text, '') END AS b FROM conversations
"""


@query(f"""WITH t AS ({_TURNS.format(all=", 'g'")}), s AS (SELECT path, {TOKENS.format("a")} AS a, {TOKENS.format("b")} AS b FROM t)
SELECT path AS "left", CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS bigint) AS removed, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x) AND x <> '8bit')) AS bigint) AS added FROM s""")
def extract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mails say differs, though their bytes have nothing in common."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mails = spark.sql(_TURNS.format(all="").replace("FROM conversations", "FROM {conversations}"), conversations=turns)
    head = F.concat(F.lit("Subject: turn\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: same8\n\n"))
    encoded = F.encode(F.concat(F.regexp_replace(head, "same8", "base64"), F.base64(F.encode("a", "UTF-8")), F.lit("\n")), "UTF-8")
    plain = F.encode(F.concat(F.regexp_replace(head, "same8", "8bit"), F.col("b")), "UTF-8")
    side = lambda data: mails.select("path", formats.document_text(F.col("path"), data).alias("text"))
    pairs = mails.select(F.col("path").alias("left"), F.col("path").alias("right"), F.lit("exact").alias("how"))
    found = diff.metrics(pairs, side(encoded), side(plain))
    return found.select("left", (F.col("removed") - 1).alias("removed"), (F.col("added") - 1).alias("added"))


@query()
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an HTML file, every conversation's turn as a mail, read by the extension of its name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("data"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mails = turns.select(F.concat(F.lit("mail"), "conv_id", F.lit("_"), "turn", F.lit(".eml")).alias("name"), F.encode(F.concat(F.lit("Subject: turn\nFrom: "), "role", F.lit("@example.com\n\n"), "text"), "UTF-8").alias("data"))
    return formats.views(pages.union(mails)).select("name", "kind", F.size(text.content_tokens(F.col("text"))).alias("n_tokens"))
