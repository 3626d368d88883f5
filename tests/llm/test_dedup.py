"""Operators 3 and 7 against brute force, with planted copies."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from redactrail.llm import chunk_dedup, common, near_dedup
from redactrail.llm import components as components_module
from redactrail.llm.components import components

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, n, seed):
    words, r = text.split(), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = "edited" + str(r.randrange(10**6))
    return " ".join(words)


def plain_links(texts, common=0.001, words=5):
    """(i, j) of the texts of weighted Jaccard similarity 0.8 or more, by tuples of words and plain counts."""
    docs = [Counter(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)) if w) for w in ((t or "").split() for t in texts)]
    df = Counter(x for d in docs for x in d)
    idf = {x: 1 if n / len(texts) <= common else (1 + math.log(len(texts) / n) / math.log(1 / common)) / 2 for x, n in df.items()}
    weights = [{x: (1 + math.log(n)) * idf[x] for x, n in d.items()} for d in docs]
    for i, a in enumerate(weights):
        for j in range(i):
            both = sum(min(w, weights[j][x]) for x, w in a.items() if x in weights[j])
            if both and both / (sum(a.values()) + sum(weights[j].values()) - both) >= 0.8:
                yield i, j


def brute_force(texts, common=0.001):
    parent = list(range(len(texts)))
    for i, j in plain_links(texts, common):
        low, high = sorted((parent[i], parent[j]))
        parent = [low if p == high else p for p in parent]
    return parent


def test_near_duplicates_are_found_and_others_left(documents):
    texts = [prose(120, i) for i in range(30)]
    texts += [edited(texts[i], 2, i) for i in range(10)] + [texts[3], texts[3]] + [edited(texts[20], 1, 100 + j) for j in range(12)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(texts)).collect()}
    expected = brute_force(texts)
    assert found == dict(enumerate(expected))
    kept = near_dedup.deduplicated(documents(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected)) and kept.columns == documents(["x"]).columns


def test_links_around_the_similarity(documents):
    """A family without a centre, one with, and others: every link of the plain version, none besides."""
    r, base, other = random.Random(9), prose(300, 77), prose(250, 78)
    texts = [prose(200, 2000 + i) for i in range(60)]
    texts += [edited(base, r.randint(1, 9), 3000 + i) for i in range(60)]
    texts += [other] + [edited(other, r.randint(1, 12), 4000 + i) for i in range(30)]
    r.shuffle(texts)
    expected = brute_force(texts)
    assert 100 < len(set(expected)) < 145
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(texts)).collect()} == dict(enumerate(expected))


def test_near_dedup_of_odd_rows(documents):
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(ODD)).collect()}
    assert found == {i: 3 if i == 4 else i for i in range(len(ODD))}
    assert near_dedup.classes(documents(ODD).limit(0)).collect() == []
    # no id: kept; of an id's texts only those that are copies go
    texts, ids = ["a b", "a b", "c", "c d e", "a b", "c d e"], [4, 4, None, 4, 5, 9]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.deduplicated(documents(texts, ids)).collect()) == [(0, "c"), (4, "a b"), (4, "c d e")]
    with pytest.raises(ValueError):
        near_dedup.classes(documents(["x"]).selectExpr("'a' AS doc_id", "text"))


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    a = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:340], rng.integers(0, 1 << 63, 60, dtype=np.uint64)]))
    w = {int(x): float(rng.choice([1, 1, 1, 2.1, 0.4])) for x in np.concatenate([a, b])}
    wa, wb = np.array([w[int(x)] for x in a]), np.array([w[int(x)] * (1.5 if x % 3 == 0 else 1) for x in b])
    agree = []
    for seed in range(20):
        shift = np.uint64(seed * 7919)
        both = near_dedup.samples(np.concatenate([a ^ shift, b ^ shift]), np.concatenate([wa, wb]), np.array([0, len(a)]))
        agree.append((both[0] == both[1]).mean())
    assert abs(np.mean(agree) - near_dedup.weighted_jaccard((a, wa), (b, wb))) < 0.03


def test_common_shingles_are_counted_over_all_documents(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON", 0.1)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 400)
    line = "this line stands in very many of all documents"
    texts = [f"{prose(30, i)} {line}" if i % 2 == 0 else prose(30, i) for i in range(200)]
    found, idf = near_dedup.common_shingles(documents(texts), len(texts))
    assert set(near_dedup.shingles(line)[0]) == set(found)
    assert np.allclose(idf, (1 + np.log(2) / np.log(10)) / 2)


def test_joins_of_hot_keys_are_split(spark):
    """A hub's edges are one key: with low thresholds the plan splits it."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        df = components_module._large_star(spark.range(1, 20_000).selectExpr("id AS u", "id - id AS v"), [])
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_large_buckets_are_dealt_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = prose(150, 1)
    texts = [edited(base, 1, i) for i in range(120)] + [prose(150, 1000 + i) for i in range(240)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(texts)).collect()}
    assert {found[i] for i in range(120)} == {0} and all(found[i] == i for i in range(120, 360))


def family(n, seed):
    """Pairs just over the similarity, whose members are just under it to all others."""
    r, base, texts = random.Random(seed), prose(1200, seed).split(), []
    for i in range(n):
        shared = [(at, f"pair{i}x{at}") for at in r.sample(range(2, 1196, 5), 3)]
        for member in "ab":
            words = list(base)
            free = [at for at in range(2, 1196, 5) if at not in dict(shared)]
            for at, word in [*shared, *((at, f"own{i}{member}{at}") for at in r.sample(free, 13))]:
                words[at] = word
            texts.append(" ".join(words))
    return texts


def test_links_in_families_just_under_the_similarity(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON", 2)  # all of these documents are the family: no shingle counts less
    monkeypatch.setattr(near_dedup, "REST_BLOCK", 16)
    texts = family(60, 3)
    expected = brute_force(texts, 2)
    assert len(set(expected)) > 10
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(texts)).collect()} == dict(enumerate(expected))


@pytest.mark.parametrize("small", [0, components_module.SMALL])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components_module, "SMALL", small)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, None)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_working_tables_are_cleaned_up(spark, documents, tmp_path):
    before = set(common.WORKING)
    found = near_dedup.classes(documents(["a b c", "a b c"])).collect()
    own = common.WORKING - before
    assert len(found) == 2 and own and all(os.path.isdir(p) for p in own)
    common.clean(spark)
    assert not common.WORKING and not any(os.path.isdir(p) for p in own | before)


def test_driver_lets_go_of_garbage_after_each_table(spark):
    """Whole collections of the JVM's heap: of its collectors, the last one listed is that of the old generation."""
    whole = lambda: list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())[-1].getCollectionCount()
    common.written(spark.range(3), "numbers")
    before = whole()
    common.written(spark.range(3), "numbers")
    assert whole() > before


def test_components_of_one_task():
    r = random.Random(1)
    for n in (1, 2, 30, 3000):
        ids = r.sample(range(10**9), n + 1)
        edges = [(ids[r.randrange(n + 1)], ids[r.randrange(n + 1)]) for _ in range(n // 2)] + ([(ids[i], ids[i + 1]) for i in range(n)] if n == 30 else [])
        root = {}
        for u, v in edges:
            for x in (u, v):
                root.setdefault(x, {x})
            if root[u] is not root[v]:
                both = root[u] | root[v]
                for x in both:
                    root[x] = both
        batch = pa.record_batch([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], names=["u", "v"])
        found = dict(pair for b in components_module._solve(iter([batch.slice(0, 3), batch.slice(3)])) for pair in zip(*[c.to_pylist() for c in b.columns], strict=True))
        assert found == {x: min(own) for x, own in root.items()}
    assert list(components_module._solve(iter([]))) == []


def test_shared_passages(documents):
    passage = prose(70, 99)
    texts = [prose(200, i) for i in range(20)]
    for i, at in ((2, 0), (7, 300), (11, 555)):
        texts[i] = texts[i][:at] + " " + passage + " " + texts[i][at:]
    texts += [None, "", "short"]
    found = {r["doc_id"]: r for r in chunk_dedup.repeats(documents(texts)).collect()}
    assert set(found) == {2, 7, 11} and found[2]["removed_bytes"] == 0 and found[7]["first_docs"] == [2]
    after = {r["doc_id"]: r for r in chunk_dedup.deduplicated(documents(texts)).collect()}
    assert all(after[i]["text"] == t for i, t in enumerate(texts) if i not in (7, 11))
    assert passage in after[2]["text"]
    core = passage[90:-90]
    assert core not in after[7]["text"] and core not in after[11]["text"]
    for i in (7, 11):
        assert after[i]["n_chars"] == len(after[i]["text"]) >= len(texts[i]) - len(passage)
        start = next(k for k, (a, b) in enumerate(zip(texts[i], after[i]["text"], strict=False)) if a != b)
        assert texts[i].endswith(after[i]["text"][start + 20 :])


def test_chunk_ends_follow_the_content():
    text = prose(3000, 4).encode()
    a = set(chunk_dedup.chunk_ends(text, np.array([0]))[0])
    b = {e - 7 for e in chunk_dedup.chunk_ends(b"insert " + text, np.array([0]))[0]}
    assert len(a & b) > 0.97 * len(a)
    own = sorted(a)
    sizes = np.diff([0, *own])
    assert own[-1] == len(text) and sizes[:-1].min() >= chunk_dedup.LEAST and sizes.max() <= chunk_dedup.MOST
    both = chunk_dedup.chunk_ends(text + text, np.array([0, len(text)]))
    assert both[0] == both[1] == own


def test_passages_by_plain_windows(documents):
    """Bytes of all runs of chunks of 150 bytes at least that stand in two documents, each run cut as short as can be."""
    texts = [prose(60, i % 6) + " " + prose(60, 50 + i) for i in range(12)]
    seen, cuts = {}, []
    for i, t in enumerate(texts):
        data = t.encode()
        ends = chunk_dedup.chunk_ends(data, np.array([0]))[0]
        own = [(a, next((e for e in ends if e >= a + chunk_dedup.MIN_BYTES), None)) for a in [0, *ends]]
        cuts.append([(a, b, data[a:b]) for a, b in own if b is not None])
        for *_, c in cuts[-1]:
            seen.setdefault(c, set()).add(i)
    expected = {i: len({k for a, b, c in own if len(seen[c]) > 1 for k in range(a, b)}) for i, own in enumerate(cuts)}
    assert {r["doc_id"]: r["repeated_bytes"] for r in chunk_dedup.repeats(documents(texts)).collect()} == {i: n for i, n in expected.items() if n}


def test_phrases_of_unrelated_documents_are_no_passage(documents):
    text = prose(120, 7)
    data = text.encode()
    ends = chunk_dedup.chunk_ends(data, np.array([0]))[0]
    # each chunk with its surroundings, which decide where it ends, in a document of its own; no two in the same
    others = [f"{prose(30, 300 + i)} {data[max(0, a - 60) : b].decode()} {prose(30, 600 + i)}" for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    texts = [*others, text]
    assert chunk_dedup.repeats(documents(texts)).collect() == []
    assert {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicated(documents(texts)).collect()} == dict(enumerate(texts))


def test_first_copy_of_a_passage_has_no_holes(documents):
    passage = prose(100, 8)
    texts = [f"{prose(30, 400)} {passage[200:300]} {prose(30, 401)}", f"{prose(40, 402)} {passage} {prose(40, 403)}", f"{prose(40, 404)} {passage} {prose(40, 405)}"]
    after = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicated(documents(texts)).collect()}
    assert after[0] == texts[0] and after[1] == texts[1] and passage[80:-80] not in after[2]


def test_earlier_passage_within_a_longer_one_goes(documents):
    """Where a longer passage stands first, the part of it that an earlier document holds goes but for the windows across its borders."""
    passage, before, after = prose(150, 9), prose(60, 410), prose(60, 411)
    longer = f"{before} {passage} {after}"
    texts = [f"{prose(30, 412)} {passage} {prose(30, 413)}", f"{prose(40, 414)} {longer} {prose(40, 415)}", f"{prose(40, 416)} {longer} {prose(40, 417)}"]
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicated(documents(texts)).collect()}
    assert cut[0] == texts[0]
    side = chunk_dedup.MIN_BYTES + chunk_dedup.MOST
    assert passage[side:-side] in texts[1] and passage[side:-side] not in cut[1]
    assert len(texts[1]) - len(passage) <= len(cut[1]) <= len(texts[1]) - len(passage) + 2 * side
    assert f"{before} {passage[:60]}" in cut[1] and f"{passage[-60:]} {after}" in cut[1]
    assert before[100:] not in cut[2] and passage[90:-90] not in cut[2] and after[:-100] not in cut[2]


def test_odd_rows_have_no_passages(documents):
    assert chunk_dedup.repeats(documents(ODD)).collect() == []
    assert chunk_dedup.repeats(documents(ODD).limit(0)).collect() == []
    same = documents(["x " * 500] * 3, [1, 1, None])
    assert chunk_dedup.repeats(same).collect() == []
    assert chunk_dedup.deduplicated(documents(ODD)).count() == len(ODD)
    clash = documents(["x"]).withColumn("cuts", F.lit(1)).withColumn("cut_doc", F.lit(2)).withColumn("fresh_text", F.lit(3))
    assert chunk_dedup.deduplicated(clash).collect() == clash.collect()
    with pytest.raises(ValueError):
        chunk_dedup.repeats(documents(["x"]).selectExpr("'a' AS doc_id", "text"))
