"""Substring deduplication by content-defined chunks under a gear rolling hash.

`repeats` finds the passages that documents share, `deduplicated` removes all but the first copy of each.

Method. A gear hash of the last 16 bytes runs over a text's UTF-8 bytes; where its bits 8 to 8 + BITS are zero, a chunk
ends, unless it would be shorter than LEAST bytes; chunks of MOST bytes end anyway. Ends depend on nearby bytes only, so
after an insertion the chunks of two texts soon agree again. Shared is what another document holds in one piece: a window is
the least run of chunks from a chunk on that has `min_bytes` bytes, compared as a whole by a 64-bit digest.
A window in several documents is shared, and a run of shared windows that directly follow each other is a passage. Two
documents that share a run of chunks of at least `min_bytes` share all windows in it; phrases that are each found in
another document share none. A false match of digests can mark one window.

A shared window that stands here for the first time (smallest doc_id, there the first) stays whole; what other shared
windows cover goes, but for bytes of those that stay. So each shared window stays whole in its first document, also where an
earlier passage lies around or beside it, and a passage of an earlier document goes also where it stands within a longer one
that is new: of that one, the windows across its borders stay, up to MIN_BYTES + MOST bytes on each side. A passage of which
each window has an earlier document, but not all the same, goes, too.

A passage of n bytes is found but for the way to its first chunk end and, at its end, less than two chunks, some 70 bytes
together; with min_bytes 150, shared passages of over 50 words are found and common lines and phrases are left alone.

At scale. Digests are grouped with partial sums, and those that are shared are written before they are joined back to the
windows: so the join shuffles both sides itself, and adaptive execution can split a digest that a third of all windows have.
Only a document's own shared windows ever come together.

Cases. Null text: as the empty text, no chunks; `deduplicated` leaves it null. Repeats within one document alone are left.
Repeated rows of an id count as one document. Null ids: not compared, left as they are. Ids that are no whole numbers:
ValueError. Empty table: empty result. Extra
columns are not read by `repeats` and are kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import mapped, pick, quoted, unused, whole, written

BITS, LEAST, MOST, MIN_BYTES = 4, 16, 96, 150
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, starts: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of texts that begin at `starts` of data, counted from each text's start."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    whole = np.append((raw[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
    found = np.flatnonzero(((h & np.uint32(((1 << BITS) - 1) << 8)) == 0) & whole) + 1
    bounds = np.append(starts, len(raw))
    at = np.searchsorted(found, bounds, side="right")
    ends = []
    for i in range(len(starts)):
        own, last = [], 0
        size = int(bounds[i + 1] - bounds[i])
        for c in (found[at[i] : at[i + 1]] - bounds[i]).tolist():
            if c - last < LEAST:
                continue
            while c - last > MOST:
                last += MOST
                own.append(last)
            if c - last >= LEAST:
                own.append(c)
                last = c
        while size - last > MOST:
            last += MOST
            own.append(last)
        if size > last:
            own.append(size)
        ends.append(own)
    return ends


def windows(ends: list[int], min_bytes: int) -> list[tuple[int, int]]:
    """The least run of chunks of min_bytes bytes from each chunk on, as (start, end) in order."""
    found, at = [], 0
    for start in [0, *ends[:-1]]:
        while at < len(ends) and ends[at] - start < min_bytes:
            at += 1
        if at == len(ends):
            break
        found.append((start, ends[at]))
    return found


def chunks(df: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, starts, ends, digests) of the windows of each text of df (doc_id, text)."""
    digest = xxhash.xxh3_64_intdigest

    def batch(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = [len(x) for _, x in held]
        ends = chunk_ends(b"".join(x for _, x in held), np.cumsum([0, *sizes[:-1]])) if sum(sizes) else [[] for _ in held]
        over = [windows(own, min_bytes) for own in ends]
        spans = [span for own in over for span in own]
        offsets = pa.array(np.cumsum([0, *map(len, over)]), pa.int32())
        at = np.repeat(np.arange(len(held)), [len(w) for w in over]).tolist()
        digests = np.array([digest(held[i][1][a:b]) for i, (a, b) in zip(at, spans, strict=True)], np.uint64).view(np.int64)
        both = np.array(spans, np.int32).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x))) for x in (both[:, 0], both[:, 1], digests)]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), *lists], names=["doc_id", "starts", "ends", "digests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                held.append((i.as_py(), (text.as_py() or "").encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= 1 << 20:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, starts array<int>, ends array<int>, digests array<long>")


def passages(doc_id: int, marks: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Of a document's shared windows (number, start, end, first document, its start, digest): all passages, and what to remove.

    Both as (start, end, first document of its first window, or the document itself if a window of the passage stays).
    """
    runs: list[list[tuple[int, int, int, int, int, int]]] = []
    for mark in sorted(set(marks)):
        if runs and mark[0] - runs[-1][-1][0] <= 1:
            runs[-1].append(mark)
        else:
            runs.append([mark])
    found: list[tuple[int, int, int]] = []
    gone: list[tuple[int, int, int]] = []
    kept: list[tuple[int, int]] = []
    for run in runs:
        stays = False
        for new, part in groupby(run, key=lambda m: m[3:5] == (doc_id, m[1])):
            part = list(part)
            start, end = part[0][1], max(m[2] for m in part)
            if new:
                kept.append((start, end))
                stays = True
            else:
                gone.append((start, end, part[0][3]))
        span = run[0][1], max(m[2] for m in run), doc_id if stays else run[0][3]
        if found and span[0] < found[-1][1]:  # overlaps the one before, with other documents
            found[-1] = (found[-1][0], max(found[-1][1], span[1]), found[-1][2])
        else:
            found.append(span)
    removed: list[tuple[int, int, int]] = []
    for start, end, first in gone:
        parts = [(max(start, removed[-1][1]) if removed else start, end)]
        for a, b in kept:
            parts = [piece for x, y in parts for piece in ((x, min(y, a)), (max(x, b), y)) if piece[0] < piece[1]]
        removed += [(x, y, first) for x, y in parts if x < y]
    return found, removed


def repeats(df: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document that shares a passage: (doc_id, repeated_bytes, removed_bytes, first_docs, spans, removed).

    spans: the passages as (start, end, first_doc) in UTF-8 bytes; removed: what of them is not the first copy;
    first_docs: the documents that hold the first copies.
    """
    docs = pick(df, doc_id=whole(df, id_col), text=text_col).where("doc_id IS NOT NULL")
    cut = written(chunks(docs, min_bytes), "chunks")
    rows = cut.select("doc_id", F.posexplode("digests").alias("i", "digest"), "starts", "ends")
    rows = rows.select("doc_id", "digest", "i", F.expr("starts[i]").alias("start"), F.expr("ends[i]").alias("end"))
    first = F.min(F.struct("doc_id", "start")).alias("first")
    shared = rows.groupBy("digest").agg(first, F.max("doc_id").alias("last_doc")).where("first.doc_id < last_doc")
    shared = shared.select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    shared = written(shared, "shared")
    marked = rows.join(shared.hint("merge"), "digest").groupBy("doc_id").agg(F.collect_list(F.struct("i", "start", "end", "first_doc", "first_start", "digest")).alias("marks"))

    def each(docs: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, marks in docs:
            found, removed = passages(doc_id, [(m["i"], m["start"], m["end"], m["first_doc"], m["first_start"], m["digest"]) for m in marks])
            if found:
                as_rows = [[{"start": a, "end": b, "first_doc": c} for a, b, c in x] for x in (found, removed)]
                yield doc_id, sum(b - a for a, b, _ in found), sum(b - a for a, b, _ in removed), sorted({c for _, _, c in [*found, *removed]}), *as_rows

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("repeated_bytes", pa.int64()), ("removed_bytes", pa.int64()), ("first_docs", pa.list_(pa.int64())), ("spans", span), ("removed", span)])
    text = "array<struct<start:int,end:int,first_doc:bigint>>"
    return mapped(marked, each, schema, f"doc_id long, repeated_bytes long, removed_bytes long, first_docs array<long>, spans {text}, removed {text}")


def deduplicated(df: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """df with all but the first copies of passages cut out of the texts; a column size_col, if any, counts characters anew."""
    cut_doc, own_cuts, fresh_text = (unused(name, df) for name in ("cut_doc", "cuts", "fresh_text"))
    cuts = written(repeats(df, min_bytes, id_col, text_col).where("removed_bytes > 0").select(F.col("doc_id").alias(cut_doc), F.col("removed").alias(own_cuts)), "cuts")

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text: str | None, spans) -> str | None:
            if text is None or spans is None:
                return text
            data, at, kept = text.encode("utf-8", "replace"), 0, []
            for span in spans:
                kept.append(data[at : span["start"]])
                at = span["end"]
            return b"".join([*kept, data[at:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    joined = df.join(cuts.hint("merge"), whole(df, id_col) == F.col(cut_doc), "left")
    fresh = joined.withColumn(fresh_text, F.when(F.col(own_cuts).isNull(), F.col(quoted(text_col))).otherwise(without(F.col(quoted(text_col)), F.col(own_cuts))))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col(fresh_text).alias(c))
        elif c == size_col:
            columns.append(F.when(F.col(own_cuts).isNull(), F.col(quoted(c))).otherwise(F.length(fresh_text).cast(df.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col(quoted(c)))
    return fresh.select(*columns)
