import json
import random
import re

import pytest
from pyspark.sql import functions as F

from redactrail.operators import align, diff, layout, review


def tree(spark, files):
    files = files if isinstance(files, dict) else dict.fromkeys(files, 1)
    return align.prepared(spark.createDataFrame(list(files.items()), "path string, size bigint"))


def pairs(spark, left, right):
    return sorted(tuple(r) for r in align.align(tree(spark, left), tree(spark, right)).collect())


@pytest.mark.parametrize(("left", "right", "expected"), [
    (["u/raw/c/a.pdf"], ["u/out/c/a.pdf"], [("u/raw/c/a.pdf", "u/out/c/a.pdf", "exact")]),
    (["c/610-Alpha-Report-CR-471.pdf", "c/7.txt"], ["c/610-Beta Co-Report-CR-471.pdf", "c/8.txt"], [("c/610-Alpha-Report-CR-471.pdf", "c/610-Beta Co-Report-CR-471.pdf", "fuzzy"), ("c/7.txt", "c/8.txt", "sole")]),
    (["c/x.pdf", "c/only.pdf"], ["c/x.pdf"], [("c/x.pdf", "c/x.pdf", "exact")]),
    ({"c/a1.txt": 900, "c/b1.txt": 100}, {"c/q.txt": 104, "c/r.txt": 890}, [("c/a1.txt", "c/r.txt", "size"), ("c/b1.txt", "c/q.txt", "size")]),
    (["a/k.pdf"], ["b/z/k.pdf"], [("a/k.pdf", "b/z/k.pdf", "name")]),
    (["p/x/page.txt", "q/x/page.txt"], ["r/y/page.txt", "s/y/page.txt"], []),
])
def test_passes(spark, left, right, expected):
    assert pairs(spark, left, right) == expected


def test_equal_names_in_a_folder_are_used_once(spark):
    assert pairs(spark, ["raw/a.txt", "files/a.txt"], ["out/a.txt"]) == [("files/a.txt", "out/a.txt", "exact")]


def test_renamed_folders_by_shape_and_by_bytes(spark):
    left = {"cal/ann/events/p.txt": 900, "cal/ann/acl.txt": 10, "cal/bob/events/p.txt": 100, "cal/bob/acl.txt": 12, "cal/cy/only.txt": 5, "cal/cy/more/z.txt": 5}
    right = {"cal/x1/events/p.txt": 104, "cal/x1/acl.txt": 12, "cal/x2/events/p.txt": 880, "cal/x2/acl.txt": 10, "cal/x3/only.txt": 6, "cal/x3/more/z.txt": 6}
    got = {l: (r, h) for l, r, h in pairs(spark, left, right)}  # noqa: E741
    assert got["cal/ann/events/p.txt"] == ("cal/x2/events/p.txt", "exact") and got["cal/bob/acl.txt"] == ("cal/x1/acl.txt", "exact") and got["cal/cy/more/z.txt"] == ("cal/x3/more/z.txt", "exact")


def test_ties_of_bytes_are_no_evidence(spark):
    left, right = {f"c/{n}/p.txt": 500 for n in ("a", "b")}, {f"c/{n}/p.txt": 500 for n in ("x", "y")}
    assert align.renamed_folders(tree(spark, left), tree(spark, right)).collect() == []


def test_large_folders_go_by_rank(spark, monkeypatch):
    monkeypatch.setattr(align, "PAIRWISE", 3)
    left, right = {f"c/l{i}.txt": 100 * i for i in range(1, 5)}, {f"c/r{i}x.txt": 100 * i + 7 for i in range(1, 5)}
    assert pairs(spark, left, right) == [(f"c/l{i}.txt", f"c/r{i}x.txt", "size") for i in range(1, 5)]


def test_missing_and_truncated(spark):
    left = tree(spark, ["a/x.txt", "a/y.txt"])
    found = align.exact(left, tree(spark, ["a/x.txt"]))
    assert [tuple(r) for r in align.missing(left, found).collect()] == [("a/y.txt", None, "missing")] and align.missing(left, found, truncated=True).collect() == []


def test_out_of_scope(spark):
    unit = lambda left, right: {r["unit"] for r in align.out_of_scope(tree(spark, left), tree(spark, right)).collect()}
    assert unit(["jira/n4/s/a.txt", "jira/n5/s/a.txt"], ["jira/n4/s/a.txt"]) == {"jira/n5"}
    assert unit(["cal/ann/a.txt", "cal/bob/a.txt"], ["cal/x/a.txt", "cal/y/a.txt"]) == set()
    assert unit(["u/a/b/deep/x.txt", "u/a/c/x.txt"], ["u/a/b/x.txt"]) == set()


def test_rows_are_numbered_over_all_ranges(spark):
    rows = spark.range(1000).select(F.format_string("%04d", 999 - F.col("id")).alias("label"), F.lit("l").alias("left"))
    assert [r["label"] for r in align.numbered(rows).orderBy("id").collect()] == [f"{i:04d}" for i in range(1000)]
    assert align.numbered(rows).agg(F.min("id"), F.max("id")).first() == (0, 999)


def listing(spark, paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, size bigint")


def test_layout_and_autosplit(spark):
    both = listing(spark, [f"u/id{i}/{h}/a.txt" for i in range(30) for h in ("raw", "files")])
    assert {r["name"] for r in layout.layout_names(both).collect()} == {"raw", "files"}
    guess = layout.autosplit(listing(spark, [f"u/raw/{i}.txt" for i in range(100)] + [f"u/files/{i}.txt" for i in range(98)] + ["u/redacted/1.txt"]))
    assert (guess["source"], guess["output"], guess["warn"]) == ("raw", "files", None)
    guess = layout.autosplit(listing(spark, [f"github/{i}.txt" for i in range(50)] + [f"_pii/output/github/{i}.txt" for i in range(50)]))
    assert (guess["source"], guess["output"]) == (None, "_pii")
    assert layout.autosplit(listing(spark, [f"u/raw/{i}.txt" for i in range(100)] + ["u/redacted/1.txt"]))["warn"]
    assert layout.autosplit(listing(spark, ["a.txt"]))["output"] is None


def test_variants(spark):
    assert {tuple(r) for r in layout.variants(listing(spark, ["u/raw/a.txt", "u/Files/a.txt", "u/raw/b.txt"])).collect()} == {("raw", 1), ("Files", 1)}


def test_folder_map(spark):
    found = layout.folder_map(
        spark.createDataFrame([("m/ann.lee/1.txt", "m/x/1.txt"), ("m/ann.lee/2.txt", "m/x/2.txt"), ("m/ann.lee/3.txt", "m/y/3.txt"), ("m/bob/1.txt", "m/x/4.txt"), ("m/a.txt", None), ("q/z/1.txt", "q/1.txt")], "left string, right string"),
        tree(spark, ["m/gone.folk/1.txt"]).select("bucket"),
    )
    rows = {r["path"]: r for r in found.collect()}
    assert rows["m"]["state"] == "kept" and rows["m"]["files"] == 4
    assert (rows["m/ann.lee"]["out"], rows["m/ann.lee"]["also"], rows["m/ann.lee"]["shared"], rows["m/ann.lee"]["risk"]) == ("x", ["y"], ["m/bob"], None)
    assert rows["m/gone.folk"]["state"] == "none" and rows["m/gone.folk"]["risk"] == "a person's name" and "q" not in rows


def labels(spark, n):
    return spark.createDataFrame([(f"app{i % 3}/doc {i}.txt", f"l{i}", f"r{i}") for i in range(n)], "label string, left string, right string")


def test_samples(spark):
    rows = labels(spark, 300)
    got = lambda salt, n=20: {r["label"] for r in review.sample(rows, salt, n).collect()}
    assert len(got("a")) == 60 and got("a") == {r["label"] for r in review.sample(rows.repartition(7), "a", 20).collect()} and got("a") != got("b")
    assert len(got("a", 0)) == 300 and {r["dropped"] for r in review.dropped(rows, 20).collect()} == {80}
    assert {r["label"] for r in review.sampled(rows, "a", 20).where("sampled").collect()} == got("a")


def test_search(spark):
    rows = spark.createDataFrame([("m/Report.pdf", "x", None), ("m/old report.pdf", "x", "y"), ("m/report 2024 final.pdf", "x", "y"), ("report/a.pdf", "x", "final"), ("m/b.pdf", "x", "y")], "label string, left string, right string")
    assert [(r["rank"], r["label"]) for r in review.search(rows, "report.pdf").collect()] == [(0, "m/Report.pdf"), (1, "m/old report.pdf")]
    assert [r["rank"] for r in review.search(rows, " final REPORT").collect()] == [2, 3]
    assert review.search(rows, "report", most=2).count() == 2


def test_verdicts_and_rollup(spark):
    log = spark.createDataFrame([("s", "l0", 1, True, True, ["x", " "]), ("s", "l0", 2, False, False, [" "]), ("s", "l1", 1, True, False, None), ("s", "l2", 3, False, False, ["no"])], "sid string, left string, seq long, viewed boolean, reviewed boolean, comments array<string>")
    state = review.verdicts(log)
    assert {(r["left"], r["viewed"], tuple(r["comments"])) for r in state.collect()} == {("l1", True, ()), ("l2", False, ("no",))}
    rows = labels(spark, 9).withColumn("how", F.when(F.col("left") == "l3", "missing").otherwise("exact")).withColumn("lb", F.lit(10))
    total = {r["app"]: r for r in review.rollup(rows, state).collect()}
    assert (total[None]["files"], total[None]["viewed"], total[None]["comments"], total[None]["missing"], total[None]["bytes"]) == (9, 1, 1, 1, 90) and total["app0"]["folders"] == 1


def test_old_marks(spark):
    marks = [json.dumps("ok"), json.dumps({"v": "bad", "note": " why "}), json.dumps({"viewed": True, "reviewed": False, "comments": ["c"]})]
    got = review.migrated(spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "i int, mark string")).orderBy("i").collect()
    assert [(r["viewed"], r["reviewed"], r["comments"]) for r in got] == [(True, True, []), (True, True, ["why"]), (True, False, ["c"])]


def test_queue_tree_and_bulk(spark):
    rows = labels(spark, 6).withColumn("id", F.substring("left", 2, 9).cast("long"))
    state = spark.createDataFrame([("l3", True)], "left string, reviewed boolean")
    got = {r["id"]: (r["previous_id"], r["next_id"]) for r in review.queue(rows, state).collect()}
    assert got == {0: (None, None), 1: (None, 4), 4: (1, None), 2: (None, 5), 5: (2, None)}
    order = [r["label"] for r in review.tree(spark.createDataFrame([("b.txt",), ("z/a.txt",), ("a/c/d.txt",), ("a/b.txt",)], "label string")).collect()]
    assert order == ["a/c/d.txt", "a/b.txt", "z/a.txt", "b.txt"]
    assert review.mark_app(review.sampled(rows, "s", 1), "s", "app1", 9).count() == 1


def test_diffs(spark):
    left = spark.createDataFrame([("a", "Mail ann@example.com of ünit"), ("b", "same"), ("c", "gone")], "path string, text string")
    right = spark.createDataFrame([("x", "Mail who@example.com of ünit"), ("y", "same")], "path string, text string")
    rows = spark.createDataFrame([("a", "x", "exact"), ("b", "y", "sole"), ("c", None, "missing")], "left string, right string, how string")
    got = {r["left"]: r for r in diff.metrics(rows, left, right).collect()}
    assert (got["a"]["removed_sample"], got["a"]["added_sample"], got["a"]["identical"]) == (["ann@example.com"], ["who@example.com"], False)
    assert got["a"]["left_bytes"] == got["a"]["left_chars"] + 1 and got["b"]["identical"] and got["c"]["removed"] is None
    assert [tuple(r) for r in diff.removed_tokens(rows.where("right is not null"), left, right).collect()] == [("ann@example.com", 1)]


def test_learned_leaks(spark):
    left = spark.createDataFrame([(f"a{i}", "Ann said hello") for i in range(4)], "path string, text string")
    right = spark.createDataFrame([(f"b{i}", "who said hello" if i < 2 else "Ann said hello") for i in range(4)], "path string, text string")
    rows = spark.createDataFrame([("app", f"a{i}", f"b{i}") for i in range(4)], "app string, left string, right string")
    tokens = diff.pair_tokens(rows, left, right)
    counts = diff.learned(tokens)
    assert {r["token"]: (r["rewrote"], r["kept"]) for r in counts.collect()} == {"Ann": (2, 2), "said": (0, 4), "hello": (0, 4)}
    assert [tuple(r) for r in diff.leaks(counts).collect()] == [("app", "Ann", 0.5)]
    assert {r["left"] for r in diff.leaks_by_document(tokens, counts).collect()} == {"a2", "a3"}
    assert diff.pair_tokens(rows, left, right, limit_per_app=1).select("left").distinct().count() == 1


def test_pair_tokens_without_structs_for_each_token(spark):
    rows = spark.createDataFrame([("m", "a", "x"), ("m", "b", "y"), ("m", "c", None)], "app string, left string, right string")
    left = spark.createDataFrame([("a", "one two two"), ("b", "one six"), ("c", "one")], "path string, text string")
    right = spark.createDataFrame([("x", "one new"), ("y", "")], "path string, text string")
    found = diff.pair_tokens(rows, left, right)
    assert sorted(tuple(r) for r in found.collect()) == [("m", "a", "one", True), ("m", "a", "two", False), ("m", "b", "one", False), ("m", "b", "six", False)]
    assert "named_struct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_of_texts_that_share_a_path(spark):
    texts = spark.createDataFrame([("p", "a plan of ours"), ("p", "planners met a plan-b"), ("p", "a plan again"), ("q", "planners")], "path string, text string")
    vocab = diff.vocabulary(spark.createDataFrame([("plan", None), ("plan-b", None)], "original string, replacement string"))
    assert sorted(tuple(r) for r in diff.marks(texts, vocab).collect()) == [("p", "leak", "plan"), ("p", "leak", "plan-b")]
    texts = spark.createDataFrame([("p", "a plan of ours"), ("p", "oxplan plan-b")], "path string, text string")
    vocab = diff.vocabulary(spark.createDataFrame([("xplan", None), ("plan of", None), ("plan-b", None)], "original string, replacement string"))
    assert sorted(r["value"] for r in diff.marks(texts, vocab).collect()) == ["plan of", "plan-b"]
    texts = spark.createDataFrame([("p", "one plan"), ("p", "planners")], "path string, text string")
    vocab = diff.vocabulary(spark.createDataFrame([("plan", None)], "original string, replacement string"))
    assert [tuple(r) for r in diff.marks(texts, vocab).collect()] == [("p", "leak", "plan")]


def test_marks(spark):
    mappings = spark.createDataFrame([("Ann Lee", "X Y", False), ("Ann Leeds", None, False), ("ab", "cd", False), ("old", "new", True), ("plan", " ", None)], "original string, replacement string, deleted boolean")
    vocab = diff.vocabulary(mappings)
    texts = spark.createDataFrame([("d", "ANN LEEDS met x y on a plan, old")], "path string, text string")
    assert {(r["kind"], r["value"]) for r in diff.marks(texts, vocab).collect()} == {("original", "Ann Lee"), ("leak", "Ann Leeds"), ("replacement", "X Y"), ("leak", "plan")}
    assert {r["value"] for r in diff.marks(texts, vocab, most=1).where("kind = 'leak'").collect()} == {"Ann Leeds"}


def test_shown_rows_are_the_sample_and_hits(spark):
    rows = spark.createDataFrame([(i, f"a/doc {i}.txt", f"a/doc {i}.txt", None, i < 3) for i in range(20)], "id long, label string, left string, right string, sampled boolean")
    got = {(r["id"], r["found"]) for r in review.shown(rows, "doc 1").collect()}
    assert got == {(0, False), (1, False), (2, False), *[(i, True) for i in range(10, 20)]}


def test_turns_in_ranges(spark):
    rows = [(["hot"] if i % 10 else [f"f{i}"], i * 7 % 50, f"p{i:03d}") for i in range(200)]
    got = {r["path"]: r["turn"] for r in align.by_turn(spark.createDataFrame(rows, "bucket array<string>, size long, path string").repartition(7)).collect()}
    for bucket in {tuple(b) for b, *_ in rows}:
        own = sorted((-size, path) for b, size, path in rows if tuple(b) == bucket)
        assert [got[path] for _, path in own] == list(range(1, len(own) + 1))


def plain_cascade(left, right):
    """Pairs by loops over folders: left and right map paths, whose first segment is the side, to sizes."""
    below = lambda path: path.split("/", 1)[1]
    folder = lambda path: below(path).rpartition("/")[0]
    name = lambda path: path.rsplit("/", 1)[1]
    tokens = lambda path: {t for t in re.split("[^a-z0-9]+", name(path).lower()) if len(t) > 1}
    found, a, b = {}, dict(left), dict(right)

    def take(x, y, how):
        found[x] = (y, how)
        del a[x], b[y]

    for at in sorted({folder(p) for p in left}):
        here = lambda side: sorted(p for p in side if folder(p) == at)  # noqa: B023, E731
        for x in here(a):
            for y in [y for y in here(b) if name(x) == name(y)]:
                take(x, y, "exact")
        for x in here(a):
            shared = sorted(((len(tokens(x) & tokens(y)), y) for y in here(b)), reverse=True)
            if shared and shared[0][0] >= 2 and (len(shared) == 1 or shared[0][0] > shared[1][0]):
                take(x, shared[0][1], "fuzzy")
        if len(here(a)) == len(here(b)) == 1:
            take(here(a)[0], here(b)[0], "sole")
        for x in sorted(here(a), key=lambda p: (-left[p], p)):
            if here(b):
                take(x, min(here(b), key=lambda y: (abs(right[y] - left[x]), y)), "size")  # noqa: B023
    for x in sorted(a):
        same = [y for y in b if name(y) == name(x)]
        if len(same) == 1 and sum(name(z) == name(x) for z in left if z not in found) == 1:
            take(x, same[0], "name")
    return sorted((x, y, how) for x, (y, how) in found.items())


def test_cascade_by_brute_force(spark):
    r = random.Random(11)
    words = ["report", "mail", "north", "plan", "draft", "note", "cr"]
    make = lambda side: {f"{side}/f{r.randrange(12)}/{'-'.join(r.choice(words) for _ in range(r.randint(1, 4)))}{r.randrange(4)}.txt": r.randrange(40) for _ in range(130)}
    left, right = make("raw"), make("files")
    expected = plain_cascade(left, right)
    assert {how for *_, how in expected} >= {"exact", "fuzzy", "size"}
    assert pairs(spark, left, right) == expected


def test_byte_profiles_by_brute_force(spark):
    r = random.Random(12)
    ours = {f"p{i}": {f"{j}.txt": r.randrange(1, 1000) for j in r.sample(range(6), 5)} for i in range(14)}
    theirs = {f"q{i}": {f: s + r.randrange(-s // 5, s // 5 + 1) for f, s in own.items()} for i, own in enumerate(ours.values()) if i % 5}
    theirs |= {"q_a": dict(theirs["q1"]), "q_z": {"0.txt": 3}}
    apart = lambda a, b: sum(abs(a[k] - b[k]) for k in a.keys() & b.keys()) / (sum(max(a[k], b[k]) for k in a.keys() & b.keys()) or 1) if a.keys() & b.keys() else 1.0
    free, expected = dict(theirs), set()
    for name in sorted(ours):
        near = sorted((apart(ours[name], other), n) for n, other in free.items())
        if near[0][0] <= 0.3 and (near[1][0] > 0 if near[0][0] == 0 else near[1][0] >= 1.6 * near[0][0]):
            expected.add((name, near[0][1]))
            del free[near[0][1]]
    listed = lambda side: {f"cal/{n}/{f}": s for n, own in side.items() for f, s in own.items()}
    found = align.renamed_folders(tree(spark, listed(ours)), tree(spark, listed(theirs))).collect()
    assert {(x["left_name"], x["right_name"]) for x in found} == expected and len(expected) > 3
