"""URL filter: rules by host and path, and for all other URLs the ratio of two character language models.

`judged` gives every URL its host, path, rule and verdict; `fit` learns the models, `best_rules` finds rules.

Method. The URLs that a rule decides are the examples: the allowed ones train the model of accepted URLs, the blocked ones
that of rejected URLs. Both are variable-order Markov models: the chance of a character after up to ORDER characters is
(n(context, character) + SMOOTHING * chance by the shorter context) / (n(context) + SMOOTHING), so contexts that were never
seen leave the word to shorter ones. A URL's score is the difference of both models' log-likelihoods, divided by its
length. The threshold is calibrated on every FOLDS-th example (by hash of the URL), which the models don't learn from: the
one that treats accepted and rejected examples alike best (balanced accuracy).

At scale. Counts are exact, by context and character, and lie in a table that grows with what is learned; nobody holds it
whole. URLs are scored in batches: the distinct n-grams of a batch are joined to the table, and the counts found come back
to the batch, so rows grow with the batches' n-grams, and no key gets more than a row from each batch. Calibration gathers a
histogram of fixed size.

Cases. Null URLs or such without "://": host and path empty, no rule; models judge the text as it is, a null as empty.
Empty URLs have score 0. Without examples of both sides every score is 0 and the threshold 0: allowed. Scores equal to the
threshold: allowed. Of rules that fit, the longest wins, of equally long ones the blocking. Repeated rows: judged each.
Null ids are kept. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import mapped, pick, shuffle_partitions, written

ORDER, SMOOTHING, FOLDS = 5, 2.0, 5
#: The histogram of scores for calibration: from -SPAN to SPAN in STEPS steps.
SPAN, STEPS = 8.0, 3200
#: URLs and characters of a batch, and n-grams that a task sums before it sends them.
URLS, CHARACTERS, GRAMS = 8192, 1 << 18, 1 << 22

LOWER = {i: i + 32 for i in range(65, 91)}
#: Digits are one character for the models: numbers in paths name pages, not kinds of pages.
DIGITS = bytes(48 if 48 <= i < 58 else i for i in range(256))
Rule = tuple[str, str]  # ("allow" or "block", host and path)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first "://" up to "/", "?", "#", A-Z lower-cased; path: from there up to "?", "#"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class Rules:
    """Finds the longest rule that fits a host, or a domain above it, and the start of a path."""

    def __init__(self, rules: list[Rule]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        fits, name = [], host
        while True:
            fits += [(len(rule), verdict == "block", rule, verdict) for start, rule, verdict in self.by_host.get(name, ()) if path.startswith(start)]
            _, dot, name = name.partition(".")
            if not dot:
                break
        return max(fits)[2:] if fits else None


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By order the (context, character), the context, and each character's URL; the first two as numbers.

    A number is the bytes themselves, up to six, under the order and kind: no two n-grams share one.
    """
    raw = [u.encode("utf-8", "replace").translate(DIGITS) for u in urls]
    pad = bytes([2]) * ORDER
    data = np.frombuffer(b"".join(pad + x for x in raw), np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(sizes + ORDER) - sizes
    owner = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    both, context = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    before = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        if k:
            before |= data[at - k] << (8 * (k - 1))
        context[k] = before | (k << 48)
        both[k] = (before << 8) | data[at] | ((ORDER + 1 + k) << 48)
    return both, context, owner


def scores(urls: list[str], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each URL the difference of its log-likelihoods as accepted and rejected, by its length.

    keys: n-grams in order, without those that never occur; counts: how often each occurs among rejected and accepted URLs.
    """
    both, context, owner = _grams(urls)
    keys, counts = np.append(keys, np.int64(1) << 60), np.append(counts, [[0, 0]], axis=0)

    def met(grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, grams)
        return np.where((keys[at] == grams)[:, None], counts[at], 0)

    p = np.full((len(owner), 2), 1 / 256)
    for k in range(ORDER + 1):
        p = (met(both[k]) + SMOOTHING * p) / (met(context[k]) + SMOOTHING)
    ln = np.log(p)
    n = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, ln[:, 1] - ln[:, 0], minlength=len(urls)) / np.maximum(n, 1)


@dataclass(frozen=True)
class Model:
    """counts: (key, rejected, accepted) of all n-grams of examples, None without examples of both sides."""

    counts: DataFrame | None
    threshold: float


def _batches(each: Iterator[tuple], n: int = 2048) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in each:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= n or size >= CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _examples(group: list[tuple], rules: Rules, held_out: bool) -> Iterator[tuple[int, str]]:
    """(side, URL) of the URLs that a rule decides, in the fold for calibration or in the others."""
    for (url,) in group:
        found = rules.best(*host_and_path(url))
        if found and (crc32(url.encode("utf-8", "replace")) % FOLDS == 0) == held_out:
            yield int(found[1] == "allow"), url


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(id, url, score) of rows (id, url)."""
    from pyspark.sql.pandas.types import to_arrow_type

    if model.counts is None:
        return rows.select("id", "url", F.lit(0.0).alias("score"))
    kind = rows.schema["id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()

    def batch(each: Iterator[tuple]) -> Iterator[tuple]:
        for group in _batches(each, URLS):
            both, context, _ = _grams([u or "" for _, u in group])
            yield [i for i, _ in group], [u for _, u in group], np.unique(np.concatenate([both.ravel(), context.ravel()])).tolist()

    schema = pa.schema([("ids", pa.list_(arrow)), ("urls", pa.list_(pa.string())), ("keys", pa.list_(pa.int64()))])
    batches = mapped(rows.select("id", "url"), batch, schema, f"ids array<{name}>, urls array<string>, keys array<long>", flush=1)
    batches = written(batches.withColumn("batch", F.monotonically_increasing_id()), "urls")
    found = batches.select("batch", F.explode("keys").alias("key")).join(model.counts.hint("merge"), "key")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("rejected", "long"), ("accepted", "long"))]
    both = found.select("batch", F.lit(None).cast(f"array<{name}>").alias("ids"), F.lit(None).cast("array<string>").alias("urls"), "key", "rejected", "accepted").union(batches.select("batch", "ids", "urls", *nothing))
    dealt = both.repartition(shuffle_partitions(rows.sparkSession), "batch").sortWithinPartitions("batch", F.col("key").asc_nulls_last())

    def score(each: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(each, key=lambda r: r[0]):
            counts: list[tuple[int, int, int]] = []
            for _, ids, urls, *count in group:  # the batch itself comes last
                if ids is None:
                    counts.append(tuple(count))
                else:
                    known = np.array(counts, np.int64).reshape(-1, 3)
                    yield from zip(ids, urls, scores([u or "" for u in urls], known[:, 0], known[:, 1:]).tolist(), strict=True)

    return mapped(dealt, score, pa.schema([("id", arrow), ("url", pa.string()), ("score", pa.float64())]), f"id {name}, url string, score double")


def fit(df: DataFrame, rules: list[Rule], url_col: str = "url") -> Model:
    """Models of the URLs that the rules decide, counted over all of df."""
    urls = pick(df, url=url_col)

    def count(batches: Iterator[tuple]) -> Iterator[tuple]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[tuple]:
            for side, parts in enumerate(held):
                keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
                yield from ((k, c * (1 - side), c * side) for k, c in zip(keys.tolist(), n.tolist(), strict=True))
                parts.clear()

        own = Rules(rules)
        for group in _batches(batches):
            for side in (0, 1):
                mine = [u for s, u in _examples(group, own, False) if s == side]
                if mine:
                    held[side] += [x.ravel() for x in _grams(mine)[:2]]
            if sum(len(x) for parts in held for x in parts) >= GRAMS:
                yield from flush()
        yield from flush()

    schema = pa.schema([("key", pa.int64()), ("rejected", pa.int64()), ("accepted", pa.int64())])
    partial = mapped(urls, count, schema, "key long, rejected long, accepted long")
    counts = written(partial.groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")), "ngrams")
    seen = counts.agg(F.max("rejected"), F.max("accepted")).first()
    if not seen[0] or not seen[1]:
        return Model(None, 0.0)

    def examples(each: Iterator[tuple]) -> Iterator[tuple]:
        own = Rules(rules)
        for group in _batches(each):
            yield from _examples(group, own, True)

    held_out = mapped(urls, examples, pa.schema([("id", pa.int32()), ("url", pa.string())]), "id int, url string")
    step = F.floor((F.col("score") + SPAN) / (2 * SPAN) * STEPS)
    histogram = scored(held_out, Model(counts, 0.0)).groupBy("id", F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), step)).cast("int").alias("step")).count().collect()  # 2 * STEPS rows at most
    both = np.zeros((2, STEPS), np.int64)
    for side, at, n in histogram:
        both[side, at] = n
    return Model(counts, calibrated(both))


def calibrated(seen: np.ndarray) -> float:
    """The threshold of best balanced accuracy from histograms of rejected and accepted examples; 0 without either."""
    if not seen[0].any() or not seen[1].any():
        return 0.0
    rejected = np.concatenate([[0], np.cumsum(seen[0])]) / seen[0].sum()  # under each threshold
    accepted = 1 - np.concatenate([[0], np.cumsum(seen[1])]) / seen[1].sum()
    quality = rejected + accepted
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float(-SPAN + 2 * SPAN * best[np.argmin(np.abs(best - STEPS / 2))] / STEPS)


def judged(df: DataFrame, model: Model, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the rule's verdict, else the models'."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        own = Rules(rules)
        for page_id, url, score in each:
            host, path = host_and_path(url)
            rule, verdict = own.best(host, path) or (None, "allow" if score >= model_threshold else "block")
            yield page_id, host, path, rule, verdict, score

    model_threshold = model.threshold
    schema = pa.schema([("page_id", to_arrow_type(kind)), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])
    return mapped(scored(pick(df, id=id_col, url=url_col), model), rows, schema, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string, score double")
