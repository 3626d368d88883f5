"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

`classes` gives every document its class, `deduplicated` keeps one document of each class.

Weights. A document's shingles are its runs of five words (the whole text, if it has fewer). A shingle's weight is
(1 + ln tf) * idf, with idf = (1 + ln(N / df) / ln(1 / COMMON)) / 2 for a shingle in df of all N documents, COMMON * N at
least; rarer ones have the idf of that share, 1. So idf falls smoothly from 1 to 1/2 with the share of documents, and
depends on nothing else, whatever the size of the corpus. As weights differ by a factor of 2 at most, pairs of plain
similarity 8/9 or more are links whatever is common, and pairs below 2/3 never.

Only shingles in more than COMMON * N documents must be known by name, and there are at most 1 / COMMON times as many as a
document has on average: a bound that doesn't grow with the corpus. Each task counts its documents in chunks and lets go of
what at most COMMON / 2 of a chunk's documents hold; the sums of what is left, over all tasks, miss at most half of COMMON,
so they are a complete list of candidates, twice that bound at most, which a second pass counts exactly over all documents.
Small partitions are read together, so that a task sees 4 / COMMON documents or more and lets go of what only two of them
hold, or one.

Samples. For a shingle x and sample k, r and c are Gamma(2, 1) and b uniform; with weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; the shingle of least a is the sample, with its t. The draws come from a table of 2**16 triples
in order of a at weight 1, indexed by the top bits of a 64-bit mix of x and k whose other bits break ties: so the sample
among weights of 1, most of them, is the least mix, and a is worked out for the others only.

Candidates. BANDS bands of ROWS samples: a pair of similarity 0.8 meets in no band with a chance of 3e-5. In a bucket each
document proposes its nearest others by the share of equal samples, and the bucket's most central document; buckets over
BLOCK documents are compared in blocks, each with itself and with a block of the most central, so that no task gets an
unbounded group and no bucket emits all its pairs. Proposals whose samples agree so little that a similarity of 0.8 is
5 standard deviations away are dropped (of links, 3 in ten million). The best proposal of each document is verified first, on whole texts; of the
others only those between documents that are still in different classes. Classes are connected components.

The rest. What nobody proposed is compared as well: in buckets whose documents are in several classes by then, all pairs
between classes, block against block, that agree that much and whose weights could reach the similarity are verified on
whole texts. A bucket's largest class meets the others only, never itself. Texts come to a block once, not once a pair, and
only links that join classes leave it, so rows grow with the documents; the comparisons within a block pair do not, in a
family whose members are just under the similarity.

Exact copies are folded into one text before all that, named by its smallest doc_id, and join its class at the end.

Cases. Null text and text without words: no shingles, a class of its own. Repeated rows of an id with the same text: as
copies; `deduplicated` keeps one row. An id with several different texts: each text has a class, and `classes` gives the id
the least of them; `deduplicated` drops only the rows whose own text is a copy. Null document ids: not compared; no row in
`classes`, kept by `deduplicated`. Ids that are no whole numbers: ValueError. Ties: the smaller doc_id. Empty table: empty
result. Extra columns are not read by `classes` and are kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactrail.llm.common import forget, mapped, pick, quoted, shuffle_partitions, unused, whole, word_hashes, written
from redactrail.llm.components import components

WORDS, SIMILARITY, COMMON = 5, 0.8, 0.001
BANDS, ROWS, BLOCK, PROPOSALS = 20, 4, 1024, 2
#: Shingles that a task counts at once, and into how many groups the partners of a document are dealt for verification.
CHUNK_SHINGLES, FANOUT = 1 << 22, 1024
#: Documents of a block where all pairs between classes are compared: whole texts of two blocks are held at once.
REST_BLOCK = 256
SAMPLES = BANDS * ROWS
#: The least share of equal samples (their low bytes) of a pair that may reach the similarity.
AGREE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / SAMPLES) ** 0.5
TABLE_BITS = 16


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triples (r, ln c, b) and ln a at weight 1, in its order."""
    random = np.random.default_rng(20240607)
    size = 1 << TABLE_BITS
    r, c, b = random.gamma(2, 1, size), random.gamma(2, 1, size), random.random(size)
    ln_a = np.log(c) + r * b - r
    order = np.argsort(ln_a)
    return r[order], np.log(c[order]), b[order], ln_a[order]


@lru_cache(maxsize=1)
def keys() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ (key >> np.uint64(3))) * key
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as hashes in order, and how often each occurs."""
    h = word_hashes(text or "")
    n = max(1, len(h) - WORDS + 1) if len(h) else 0
    rolled = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled.sort()
    first = np.flatnonzero(np.concatenate([[True], rolled[1:] != rolled[:-1]])) if n else np.zeros(0, np.int64)
    return rolled[first], np.diff(np.append(first, n))


def weights(found: np.ndarray, tf: np.ndarray, common: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = 1 + np.log(tf)
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        w = np.where(common[at] == found, w * idf[at], w)
    return w


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (hashes in order, weights); 0 if either is empty."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if len(both) else 0.0


def samples(found: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of documents whose shingles begin at `starts` of found and w: 64-bit names of (shingle, t), one row each."""
    r, ln_c, b, unit_a = draws()
    other = np.flatnonzero(w != 1)
    owner = np.searchsorted(starts, other, side="right") - 1
    ln_w, top, none = np.log(w[other]), np.uint64(64 - TABLE_BITS), np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(starts), SAMPLES), np.uint64)
    group = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(other) else other
    weighted, many = owner[group], np.diff(np.append(group, len(other)))
    for k, key in enumerate(keys()):
        mixed = mix(found, key)
        special = mixed[other]
        mixed[other] = none
        out[:, k] = np.minimum.reduceat(mixed, starts)
        if len(other):
            slot = (special >> top).astype(np.int64)
            t = np.floor(ln_w / r[slot] + b[slot])
            ln_a = ln_c[slot] - r[slot] * (t - b[slot]) - r[slot]
            # the least of each document, ties to the least mix
            tied = np.where(ln_a == np.repeat(np.minimum.reduceat(ln_a, group), many), special, none)
            best = np.flatnonzero(tied == np.repeat(np.minimum.reduceat(tied, group), many))
            best = best[np.flatnonzero(np.append(True, owner[best][1:] != owner[best][:-1]))]
            least = out[weighted, k]
            unit = np.where(least == none, np.inf, unit_a[(least >> top).astype(np.int64)])
            wins = (ln_a[best] < unit) | ((ln_a[best] == unit) & (special[best] < least))
            name = special[best] + (t[best].astype(np.int64) * 0x5851F42D4C957F2D).astype(np.uint64)
            out[weighted, k] = np.where(wins, name, least)
    return out


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in more than COMMON of all documents, in order, and their idf."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(documents, their shingles) in chunks of CHUNK_SHINGLES to twice as many; only a small task's one has fewer."""
        ready, held, size = None, [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py())[0])
                size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    if ready is not None:
                        yield ready
                    ready, held, size = (len(held), np.concatenate(held)), [], 0
        if ready is None and held:
            yield len(held), np.concatenate(held)
        elif ready is not None:
            yield ready[0] + len(held), np.concatenate([ready[1], *held])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, every in chunks(batches):
            least = COMMON / 2 * n
            cell = (every >> np.uint64(42)).view(np.int64)  # 2**22 cells: few shingles share one with a frequent one
            every = every[(np.bincount(cell, minlength=1 << 22) > least)[cell]]
            del cell
            found, df = np.unique(every, return_counts=True)
            found, df = found[df > least], df[df > least]
            for at in range(0, len(found), 1 << 16):
                yield pa.record_batch([pa.array(found[at : at + (1 << 16)].view(np.int64)), pa.array(df[at : at + (1 << 16)])], names=["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        df = np.zeros(len(wanted), np.int64)
        for _, every in chunks(batches):
            at = np.minimum(np.searchsorted(wanted, every), len(wanted) - 1)
            df += np.bincount(at[wanted[at] == every], minlength=len(wanted))
        met = np.flatnonzero(df)
        for at in range(0, len(met), 1 << 16):
            part = met[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(wanted[part].view(np.int64)), pa.array(df[part])], names=["shingle", "n"])

    def summed(texts: DataFrame, f, least: float) -> tuple[np.ndarray, np.ndarray]:
        rows = texts.mapInArrow(f, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
        found = rows.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(found)
        return found[order], rows.column("n").to_numpy()[order]

    texts = docs.select("text")
    # tasks that see few documents could let go of nothing
    large = texts.coalesce(max(1, int(total * COMMON / 4)))
    wanted, _ = summed(large, candidates, COMMON / 2 * total)
    if not len(wanted):
        return wanted, np.zeros(0)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # 2 / COMMON times a document's shingles at most
    found, df = summed(texts, count, COMMON * total)
    return found, (1 + np.log(total / df) / np.log(1 / COMMON)) / 2


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, text_id, bands, low, weight): the text's digest, a key for each band, the samples' low bytes, all weights' sum.

    A text without words has no bands. idf: a broadcast of common_shingles().
    """

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        def flush() -> Iterator[tuple]:
            full = [x for x in held if len(x[2])]
            if full:
                sizes = [len(x[2]) for x in full]
                found = np.concatenate([x[2] for x in full])
                w = weights(found, np.concatenate([x[3] for x in full]), *idf.value)
                starts = np.cumsum([0, *sizes[:-1]])
                totals = np.add.reduceat(w, starts)
                out = samples(found, w, starts)
                by_band = out.reshape(len(full), BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
                for i in range(ROWS):
                    key = (key ^ by_band[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(31)
                low = (out ^ (out >> np.uint64(17))).astype(np.uint8)
            i = 0
            for doc_id, text_id, found, _ in held:
                if len(found):
                    yield doc_id, text_id, key[i].view(np.int64).tolist(), low[i].tobytes(), float(totals[i])
                    i += 1
                else:
                    yield doc_id, text_id, [], b"", 0.0

        held, size = [], 0
        for doc_id, text_id, text in each:
            held.append((doc_id, text_id, *shingles(text)))
            size += len(held[-1][2])
            if size >= 1 << 18:
                yield from flush()
                held, size = [], 0
        yield from flush()

    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("low", pa.binary()), ("weight", pa.float64())])
    return mapped(docs.select("doc_id", digest(F.col("text")), "text"), rows, schema, "doc_id long, text_id binary, bands array<long>, low binary, weight double")


def digest(text) -> Column:
    """128 bits of a text; a null's as an empty text's."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def proposals(signed: DataFrame) -> DataFrame:
    """(a, b, agree): pairs a < b of documents that share a band and may be near, some for each document and band."""
    rows = signed.where(F.size("bands") > 0).select("doc_id", F.explode("bands").alias("band"))
    # a table, so that the join shuffles both sides itself and can split a band that very many documents share; merged, not
    # broadcast: the buckets grow with the documents
    shared = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared", narrow=True)
    open_ = rows.join(shared.hint("merge"), "band").join(signed.select("doc_id", "low").hint("merge"), "doc_id")
    # a bucket of at most BLOCK is one block; a larger one's documents go to blocks by hash, some of them to all blocks
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(1)), blocks).cast("int")
    # the anchors of a large bucket: BLOCK / 4 or so, whichever its size
    anchor = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.lit(1), (F.col("n") / F.lit(BLOCK // 4)).cast("int"))) == 0
    block = F.explode(F.when((blocks > 1) & anchor, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine)))
    dealt = open_.select("band", block.alias("block"), "doc_id", "low").repartition(shuffle_partitions(signed.sparkSession), "band", "block").sortWithinPartitions("band", "block", "doc_id")
    found = dealt.mapInArrow(_near, "a long, b long, agree double")
    return found.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proposals of each block of rows (band, block, doc_id, low), which come in order."""

    def proposed(keys: np.ndarray, ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(ids)))
        two = starts[sizes == 2]
        agree = (low[two] == low[two + 1]).mean(1)
        near = agree >= AGREE
        parts = [(ids[two[near]], ids[two[near] + 1], agree[near])]
        parts += [_block(ids[at : at + n], low[at : at + n]) for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True)]
        a, b, agree = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree)], names=["a", "b", "agree"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)], axis=1)
        low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SAMPLES)
        now = [keys, batch.column(2).to_numpy(), low]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
        last = int(np.flatnonzero((now[0] != now[0][-1]).any(1)).max(initial=-1)) + 1  # the last block may go on
        kept = [x[last:] for x in now]
        if last:
            yield proposed(*[x[:last] for x in now])
    if kept is not None:
        yield proposed(*kept)


def _block(ids: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of more than two documents, each one's nearest others and the most central one."""
    n = len(ids)
    at = np.arange(SAMPLES) * 256 + low
    times = np.bincount(at.ravel(), minlength=256 * SAMPLES)
    mode = times.reshape(SAMPLES, 256).argmax(1)
    centre = int((low == mode).sum(1).argmax())
    a, b, value = [], [], []
    most = min(PROPOSALS, n - 1)
    for start in range(0, n, 128):
        part = low[start : start + 128]
        if n < 64:
            agree = (part[:, None, :] == low[None, :, :]).sum(2).astype(np.int16)
        else:
            agree = np.zeros((len(part), n), np.int16)
            for k in range(SAMPLES):
                agree += part[:, k, None] == low[None, :, k]
        own = np.arange(start, start + len(part))
        agree[np.arange(len(part)), own] = -1
        best = np.concatenate([np.argpartition(-agree, most - 1, axis=1)[:, :most], np.full((len(part), 1), centre)], axis=1)
        reached = np.take_along_axis(agree, best, 1)
        i, j = np.nonzero(reached >= AGREE * SAMPLES)
        a.append(ids[own[i]])
        b.append(ids[best[i, j]])
        value.append(reached[i, j] / SAMPLES)
    return np.concatenate(a), np.concatenate(b), np.concatenate(value)


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b): the pairs whose texts reach the weighted Jaccard similarity.

    A document's partners are dealt to FANOUT groups at most, to each of which its text goes once; every partner's text goes
    to its group once.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(FANOUT)).cast("int").alias("part")
    partners = pairs.select("a", part, F.col("b").alias("doc_id"))
    needed = partners.union(pairs.select("a", part, F.col("a").alias("doc_id")).distinct())
    both = needed.hint("merge").join(texts, "doc_id").select("a", "part", (F.col("doc_id") != F.col("a")).alias("partner"), "doc_id", "text")
    both = both.repartition(shuffle_partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "partner")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        own = None
        for a, _, partner, b, text in each:
            found, tf = shingles(text)
            features = found, weights(found, tf, *idf.value)
            if not partner:
                own = features
            elif weighted_jaccard(own, features) >= SIMILARITY:
                yield a, b

    return mapped(both, rows, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def _between(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of a pair of blocks' rows (band, lo, hi, mine, doc_id, class, low, bands, weight): the pairs of rows that may be links.

    They are in different classes, agree, have weights that could reach the similarity, and share no earlier band.
    """
    band, lo, hi = rows[0][:3]
    mine, kinds, weight = (np.array([r[k] for r in rows]) for k in (3, 5, 8))
    low = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, SAMPLES)
    bands = np.array([r[7] for r in rows], np.int64)
    x, y = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    found = [(x[:0], x[:0])]
    for at in range(0, len(x), 64):
        part = x[at : at + 64]
        i, j = np.nonzero(kinds[part][:, None] != kinds[y][None, :])
        i, j = part[i], y[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        close = np.minimum(weight[i], weight[j]) >= (SIMILARITY - 1e-9) * np.maximum(weight[i], weight[j])
        i, j = i[close], j[close]
        close = (low[i] == low[j]).sum(1) >= AGREE * SAMPLES
        i, j = i[close], j[close]
        first = bands[i, (bands[i] == bands[j]).argmax(1)] == band
        found.append((i[first], j[first]))
    i, j = (np.concatenate(each) for each in zip(*found, strict=True))
    return i, j


def rest_blocks(first: DataFrame, known: DataFrame) -> DataFrame:
    """(band, lo, hi, mine, doc_id, class, low, bands, weight): of each pair of blocks the documents of pairs not settled yet."""
    own = first.join(known.select(F.col("id").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    own = written(own.select("doc_id", F.coalesce("component", "doc_id").alias("class"), "low", "bands", "weight"), "classed")
    rows = own.select("doc_id", "class", F.explode("bands").alias("band"))
    per = rows.groupBy("band", "class").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    # the largest class of a large bucket has blocks of its own, which come after those of the others and meet only them
    small = F.col("n") <= REST_BLOCK
    others = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("top.n")) / REST_BLOCK)).cast("int")
    largest = F.when(small, 0).otherwise(F.ceil(F.col("top.n") / REST_BLOCK)).cast("int")
    mixed = written(mixed.select("band", others.alias("others"), largest.alias("largest"), F.col("top.class").alias("top")), "mixed", narrow=True)
    in_largest = (F.col("class") == F.col("top")) & (F.col("largest") > 0)
    hashed = F.xxhash64("doc_id", F.lit(3))
    mine = F.when(in_largest, F.col("others") + F.pmod(hashed, F.greatest("largest", F.lit(1)))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.when(in_largest, F.col("others")).otherwise(F.col("others") + F.col("largest")) - 1)
    placed = rows.join(mixed.hint("merge"), "band").select("band", "doc_id", mine.alias("mine"), F.explode(met).alias("other"))
    placed = placed.select("band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "doc_id")
    placed = placed.join(own.hint("merge"), "doc_id").select("band", "lo", "hi", "mine", "doc_id", "class", "low", "bands", "weight")

    def pick_open(each: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(each, key=lambda r: r[:3]):
            held = list(group)
            if len(held) > 1:
                i, j = _between(held)
                for k in np.unique(np.concatenate([i, j])).tolist():
                    yield held[k]

    return mapped(_dealt(placed), pick_open, pa.schema(_REST), _REST_SPARK)


_REST = [("band", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("mine", pa.int32()), ("doc_id", pa.int64()), ("class", pa.int64()), ("low", pa.binary()), ("bands", pa.list_(pa.int64())), ("weight", pa.float64())]
_REST_SPARK = "band long, lo int, hi int, mine int, doc_id long, class long, low binary, bands array<long>, weight double"


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "doc_id")


def rest_links(blocks: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b): links that join classes, from all pairs of rest_blocks(), on whole texts."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(each, key=lambda r: r[:3]):
            held, features = [], []
            for r in group:
                found, tf = shingles(r[9])
                held.append(r[:9])
                features.append((found, weights(found, tf, *idf.value)))
            root = {r[5]: r[5] for r in held}

            def top(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(*map(np.ndarray.tolist, _between(held)), strict=True):
                x, y = top(held[i][5]), top(held[j][5])
                if x != y and weighted_jaccard(features[i], features[j]) >= SIMILARITY:
                    root[max(x, y)] = min(x, y)
                    yield held[i][4], held[j][4]

    both = _dealt(blocks.join(texts.hint("merge"), "doc_id").select(*[name for name, _ in _REST], "text"))
    return mapped(both, rows, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, copy_of, node, class): every id and text, the text's least id, its name, and that of its class's first text.

    A text's name is its least id, or for further texts with the same least id a number of 62 bits from its digest.
    """
    idf = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, docs.count()))
    signed = written(signatures(docs, idf), "signed")
    wordy = signed.where(F.size("bands") > 0)
    # a table, so that the joins below shuffle both sides themselves and can split a text that very many documents share
    least = wordy.groupBy("text_id").agg(F.min("doc_id").alias("copy_of"))
    turn = F.row_number().over(Window.partitionBy("copy_of").orderBy("text_id"))  # the different texts of one id
    other = F.lit(1 << 62) + F.pmod(F.xxhash64("text_id"), F.lit(1 << 62))
    copies = written(least.withColumn("node", F.when(turn == 1, F.col("copy_of")).otherwise(other)), "copies", narrow=True)
    firsts = copies.select("text_id", F.col("copy_of").alias("doc_id"), "node")
    chosen = wordy.join(firsts.hint("merge"), ["text_id", "doc_id"]).dropDuplicates(["text_id", "doc_id"])
    first = written(chosen.select(F.col("node").alias("doc_id"), "bands", "low", "weight"), "first")
    texts_of = docs.select("doc_id", digest(F.col("text")).alias("text_id"), "text")

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = firsts.join(nodes.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
        joined = texts_of.join(wanted.hint("merge"), ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"])
        return written(joined.select(F.col("node").alias("doc_id"), "text"), "texts")

    pairs = written(proposals(first), "pairs", narrow=True)
    own = texts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))))
    best = F.max(F.struct("agree", F.expr("-least(a, b)"), "a", "b"))
    each = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    tried = each.groupBy("end").agg(best.alias("x")).select("x.a", "x.b").distinct()
    links = written(verified(tried, own, idf), "links", narrow=True)
    known = written(components(links), "known", narrow=True)
    of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_in, a) <> coalesce(b_in, b)").select("a", "b").join(tried, ["a", "b"], "left_anti")
    more = written(verified(rest, own, idf), "links", narrow=True)
    as_edges = lambda found: found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    grouped = written(components(as_edges(known).union(more)), "known", narrow=True)
    blocks = written(rest_blocks(first, grouped), "rest", narrow=True)
    forget(own, first)
    own = texts(blocks)
    last = written(rest_links(blocks, own, idf), "links", narrow=True)
    forget(own, blocks, pairs, links, more)
    if not last.isEmpty():
        grouped = written(components(as_edges(grouped).union(last)), "known", narrow=True)
    named = copies.join(grouped.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left")
    named = written(named.select("text_id", "copy_of", "node", F.coalesce("component", "node").alias("class")), "named", narrow=True)
    ids = signed.select("doc_id", "text_id", (F.size("bands") > 0).alias("wordy")).join(named.hint("merge"), "text_id", "left")
    alone = lambda c: F.when(F.col("wordy"), F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return ids.select("doc_id", "text_id", alone("copy_of"), alone("node"), alone("class"))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(df, doc_id=whole(df, id_col), text=text_col).where("doc_id IS NOT NULL")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of): a row for each id; class_id is the least id of its class, copy_of that of its text."""
    return _labelled(_documents(df, id_col, text_col)).groupBy("doc_id").agg(F.min("class").alias("class_id"), F.min("copy_of").alias("copy_of"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows of the texts that are the first of their class, under their least id; and those without id."""
    own, key = _labelled(_documents(df, id_col, text_col)), unused("digest", df)
    kept = written(own.where("class = node AND doc_id = copy_of").select(F.col("doc_id").cast(df.schema[id_col].dataType).alias(id_col), F.col("text_id").alias(key)), "kept", narrow=True)
    rows = df.withColumn(key, digest(F.col(quoted(text_col))))
    found = rows.where(F.col(quoted(id_col)).isNotNull()).join(kept.hint("merge"), [id_col, key], "left_semi").dropDuplicates([id_col, key])
    return found.select(*map(quoted, df.columns)).union(df.where(F.col(quoted(id_col)).isNull()))
