"""Token ids in files of canonical, length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

`write_documents` tokenises whole texts, counts all ids, and writes them in ascending document order; `read_documents`
reads the files back. `encode`, `decode` and `decode_slice` work on arrays of ids.

The files: under `<path>/codebook` the length of each id's code (canonical codes follow from the lengths: shorter codes
first, ids in order within a length), under `<path>/blocks` Parquet rows, each a block that is decoded by itself with the
codebook. A block holds whole documents: `shard`, `block`, `start_in_shard`, `n_ids`, the documents' ids and token counts,
`bits` (each document's codes from a whole byte on, most significant bit first) and `checkpoints` (little-endian unsigned
64-bit bit offsets of every INTERVAL-th id of each document). Shards are ranges of document ids, in order.

Code lengths are optimal under the limit (package-merge over global counts). Decoding takes one table look-up an id, side
by side for the stretches between checkpoints.

At scale. Texts are tokenised once; the ids lie in a compressed table while they are counted. The counts, one for each id
of the vocabulary, are all that a driver gets, besides quantiles of the document ids and a total for each shard. Only coded
documents are shuffled. A block is closed at BLOCK_IDS ids, so a document of any length has its own block at most.

Cases. Null text: as the empty text, the end id alone. Null document ids come first. Repeated ids and rows: kept, next to
each other. Document ids that are no whole numbers: ValueError. Empty table: no blocks, empty result. Extra columns are not read. An id without a code: ValueError.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrail.llm.common import forget, mapped, pick, shared_folder, shuffle_partitions, whole, written
from redactrail.llm.hf_ids import encoded

#: The longest code in bits, ids between checkpoints, ids after which a block is closed.
LIMIT, INTERVAL, BLOCK_IDS = 16, 128, 1 << 17


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(used) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: codes count up by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        codes[own] = code + np.arange(len(own))
        code = (code + len(own)) << 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """By the next `limit` bits: id << 5 | code length."""
    table = np.zeros(1 << limit, np.uint32)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    entries = (used.astype(np.uint32) << 5) | lengths[used]
    filled = np.repeat(entries, 1 << (limit - lengths[used].astype(np.int64)))
    table[: len(filled)] = filled  # canonical codes cover the table from its start in this order
    assert not len(used) or codes[used[0]] == 0
    return table


def encode(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, interval: int = INTERVAL) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Codes documents of the given sizes, one after the other.

    Returns the bits, each document's first byte (and the end), all checkpoints as bit offsets in their document, and how
    many of them each document has.
    """
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(sizes)
    begins = ends - sizes
    before = np.concatenate([[0], np.cumsum(size)])
    bits = before[ends] - before[begins]
    first = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
    shift = np.repeat((first[:-1] << 3) - before[begins], sizes)
    at = before[:-1] + shift
    words = np.zeros((int(first[-1]) + 15) // 8 + 1, np.uint64)
    if len(ids):
        code = codes[ids].astype(np.uint64)
        word = at >> 6
        room = 64 - (at & 63) - size  # negative: the code goes on in the next word
        over = np.flatnonzero(room < 0)
        part = code << np.maximum(room, 0).astype(np.uint64)
        part[over] = code[over] >> (-room[over]).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[starts]] = np.add.reduceat(part, starts)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    many = -(-sizes // interval)
    steps = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    points = before[np.repeat(begins, many) + steps * interval] - np.repeat(before[begins], many)
    return words.astype(">u8").tobytes()[: int(first[-1])], first, points.astype("<u8"), many


def decode(bits: bytes, points: np.ndarray, counts: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of stretches that begin at the bit offsets `points` and have `counts` ids, one after the other."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-counts, kind="stable")
    at = points[order].astype(np.int64)
    to = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    ids = np.empty(int(counts.sum()), np.uint32)
    mask, active, fallen = np.uint32((1 << limit) - 1), len(at), np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    for k in range(int(left.max(initial=0))):
        if fallen[k] < active:
            active = int(fallen[k])
            at, to = at[:active], to[:active]
        entry = table[(window[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & mask]
        ids[to + k] = entry >> 5
        at = at + (entry & 31)
    return ids


def stretches(sizes: np.ndarray, interval: int = INTERVAL) -> np.ndarray:
    """Ids of each stretch between checkpoints of documents of these sizes."""
    many = -(-sizes // interval)
    found = np.full(int(many.sum()), interval, np.int64)
    full = many > 0
    found[np.cumsum(many)[full] - 1] = sizes[full] - (many[full] - 1) * interval
    return found


def decode_slice(bits: bytes, points: np.ndarray, size: int, start: int, stop: int, table: np.ndarray, interval: int = INTERVAL, limit: int = LIMIT) -> np.ndarray:
    """The ids start to stop of one document, decoded from the nearest checkpoint on."""
    stop = min(stop, size)
    if start >= stop:
        return np.empty(0, np.uint32)
    a, b = start // interval, -(-stop // interval)
    counts = stretches(np.array([size]), interval)[a:b]
    return decode(bits, np.asarray(points)[a:b], counts, table, limit)[start - a * interval : stop - a * interval]


def tokenised(df: DataFrame, tokenizer_path: str, end_id: int = 1, chunks: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): each whole text's ids and end_id, little-endian unsigned 32-bit integers.

    The last row of a task has no ids but how often each id occurs in its rows, 64-bit integers by id.
    """

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        end = end_id.to_bytes(4, "little")
        total = np.zeros(0, np.int64)
        held, size = [], 0
        for doc_id, ids in encoded(each, tokenizer_path, chunks):
            yield doc_id, ids + end, None
            held.append(ids + end)
            size += len(ids)
            if size >= 4 << 20:
                total, held, size = added(total, held), [], 0
        yield None, None, added(total, held).tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
    return mapped(pick(df, doc_id=whole(df, id_col), text=text_col), rows, schema, "doc_id long, ids binary, counts binary")


def added(total: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """total, by id, and the ids of the parts."""
    own = np.bincount(np.frombuffer(b"".join(parts), "<u4")) if parts else np.zeros(0, np.int64)
    if len(own) > len(total):
        own, total = total, own.astype(np.int64)
    total[: len(own)] += own
    return total


def id_counts(tokens: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts, by id; as long as the largest id needs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in batch.column(0):
                own = np.frombuffer(own.as_py(), np.int64)
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts")
    found = rows.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return counts


def write_tokens(tokens: DataFrame, path: str, limit: int = LIMIT, interval: int = INTERVAL, block_ids: int = BLOCK_IDS) -> None:
    """Writes rows of tokenised() in ascending doc_id order. tokens is read three times: it should be a written table."""
    spark = tokens.sparkSession
    counts = id_counts(tokens)
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    shards = shuffle_partitions(spark)
    tokens = tokens.where("ids IS NOT NULL")
    cuts = sorted(set(tokens.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.25 / shards)))
    spark.createDataFrame([(limit, interval, bytes(lengths))], "code_limit int, checkpoint_interval int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def code(each: Iterator[tuple]) -> Iterator[tuple]:
        def flush(held: list[tuple]) -> Iterator[tuple]:
            parts = [np.frombuffer(ids or b"", "<u4") for _, ids in held]
            sizes = np.array([len(x) for x in parts], np.int64)
            bits, first, points, many = encode(np.concatenate(parts), sizes, lengths, codes, interval)
            ends = np.cumsum(many)
            for i, (doc_id, _) in enumerate(held):
                shard = 0 if doc_id is None else bisect_left(cuts, doc_id)
                yield shard, doc_id, int(sizes[i]), bits[first[i] : first[i + 1]], points[ends[i] - many[i] : ends[i]].tobytes()

        held, size = [], 0
        for row in each:
            held.append(row)
            size += len(row[1] or b"")
            if size >= 4 << 20:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    coded = mapped(
        tokens.select("doc_id", "ids"), code,
        pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("points", pa.binary())]),
        "shard int, doc_id long, n long, bits binary, points binary",
    )

    def block(each: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        shard = number = start = size = 0

        def close() -> tuple:
            offset, bits, points = 0, [], []
            for _, _, _, own, marks in held:
                bits.append(own)
                points.append(np.frombuffer(marks, "<u8") + np.uint64(8 * offset))
                offset += len(own)
            return shard, number, start, size, [x[1] for x in held], [x[2] for x in held], b"".join(bits), np.concatenate(points).astype("<u8").tobytes()

        for row in each:
            if held and (row[0] != shard or size >= block_ids):
                yield close()
                start, number = (start + size, number + 1) if row[0] == shard else (0, 0)
                held, size = [], 0
            shard = row[0]
            held.append(row)
            size += row[2]
        if held:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary())])
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    blocks = mapped(dealt, block, schema, "shard int, block int, start_in_shard long, n_ids long, doc_ids array<long>, n_tokens array<long>, bits binary, checkpoints binary", flush=16)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def write_documents(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, chunks: str = "word", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises whole texts and writes their ids under path."""
    tokens = written(tokenised(df, tokenizer_path, end_id, chunks, id_col, text_col), "ids")
    write_tokens(tokens, path)
    forget(tokens)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, dict[int, int], int]:
    """The blocks, the decoding table, the ids before each shard, and the checkpoint interval."""
    blocks = spark.read.parquet(f"{path}/blocks")
    limit, interval, lengths = spark.read.parquet(f"{path}/codebook").first()
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row for each shard
    before, starts = 0, {}
    for shard, n in totals:
        starts[shard] = before
        before += n
    return blocks, decoding_table(np.frombuffer(bytes(lengths), np.uint8), limit), starts, interval


def read_documents(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): what the files hold; start counts the ids of all documents before.

    With digests_only without the ids.
    """
    from zlib import crc32

    blocks, table, starts, interval = read_blocks(spark, path)
    limit = int(len(table)).bit_length() - 1

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for shard, start, doc_ids, sizes, bits, points in each:
            counts = stretches(np.array(sizes, np.int64), interval)
            ids = decode(bits, np.frombuffer(points, "<u8"), counts, table, limit).astype("<u4", copy=False)
            at, begin = 0, starts[shard] + start
            for doc_id, n in zip(doc_ids, sizes, strict=True):
                own = ids[at : at + n].tobytes()
                yield doc_id, begin + at, n, crc32(own), *(() if digests_only else (own,))
                at += n

    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    text = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not digests_only:
        schema, text = [*schema, ("ids", pa.binary())], text + ", ids binary"
    return mapped(blocks.select("shard", "start_in_shard", "doc_ids", "n_tokens", "bits", "checkpoints"), rows, pa.schema(schema), text)


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 1, chunks: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df's documents to a new path in the shared folder and reads them back, without the ids."""
    path = shared_folder(df.sparkSession, "huffman")
    write_documents(df, path, tokenizer_path, end_id, chunks, id_col, text_col)
    return read_documents(df.sparkSession, path, digests_only=True)
