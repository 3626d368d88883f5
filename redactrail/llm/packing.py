"""Best-fit packing of token sequences by bin completion with branch and bound.

`pieces` cuts documents into pieces of at most `capacity` tokens, `pack` gives each piece its sequence and offset, and
`sequences` puts the packed ids together.

Method. Only lengths matter for how pieces fit, and there are at most `capacity` of them, so the driver solves a histogram
of fixed size, whatever the number of documents. Bin completion takes the largest length left and enumerates fillings of
the rest of its sequence, leaving out those that another one dominates; a filling is used as many times as the counts
allow at once. A branch is given up when its waste exceeds what the incumbent permits. The first incumbent is best-fit
decreasing over the histogram; when it meets the lower bound, as with many short documents, the search is over before it
begins. `nodes` and `width` bound the search, not the data: the incumbent packs every piece, but with fillings left out or
the search given up it may not be the best. `least_sequences` in the result, the lower bound, says how far off it can be.

Pieces are dealt to the plan's places by their rank within their length, counted in ranges of (length, doc_id, piece), so
that no length, however common, is gathered in one task. Only counts by range and length reach the driver.

Cases. Null text: as the empty text, one end id. Longer documents than `capacity` are cut into whole pieces and one
shorter first piece. Repeated rows and ids: packed one by one. Null document ids are kept. Empty table: empty result.
Extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import mapped, pick, shuffle_partitions, sorted_shards, unused, written
from redactrail.llm.rank_ids import encoded

Pattern = tuple[tuple[int, int], ...]  # (length, how many), lengths falling
Plan = list[tuple[Pattern, int]]  # (pattern, in how many sequences)

#: Branches that the search tries, and fillings that it tries at each.
NODES, FILLINGS = 4000, 6


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and with with_ids the ids themselves: each document's pieces.

    A document is its whole text's ids and end_id; the first piece takes what is over after whole pieces.
    """
    id_type = df.schema[id_col].dataType

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        end = end_id.to_bytes(4, "little")
        for doc_id, ids in encoded(each, tokenizer_path):
            ids += end
            size = len(ids) // 4
            start, stop = 0, size % capacity or capacity
            for piece in range(-(-size // capacity)):
                part = ids[4 * start : 4 * stop]
                yield doc_id, piece, start, stop - start, crc32(part), *([part] if with_ids else [])
                start, stop = stop, stop + capacity

    from pyspark.sql.pandas.types import to_arrow_type

    schema = [("doc_id", to_arrow_type(id_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    text = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        schema, text = [*schema, ("ids", pa.binary())], text + ", ids binary"
    return mapped(pick(df, doc_id=id_col, text=text_col), rows, pa.schema(schema), text)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the tokens' share, or more for pieces that can't stand together."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    lengths = sorted(counts)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    for least in [n for n in lengths if 2 * n <= capacity]:
        alone = sum(c for n, c in counts.items() if n > capacity - least)
        halves = {n: c for n, c in counts.items() if capacity - least >= n > capacity // 2}
        room = sum((capacity - n) * c for n, c in halves.items())
        small = sum(n * c for n, c in counts.items() if least <= n <= capacity // 2)
        bound = max(bound, alone + sum(halves.values()) + max(0, -(-(small - room) // capacity)), large)
    return bound


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over the histogram: whole groups of equal sequences take pieces at once."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def add(room: int, pattern: Pattern, copies: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((pattern, copies))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            each = room // length
            pattern, copies = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            full = min(copies, left // each)
            over = left - full * each if full < copies else 0
            if full:
                add(room - each * length, (*pattern, (length, each)), full)
            if over:
                add(room - over * length, (*pattern, (length, over)), 1)
            if copies > full + bool(over):
                add(room, pattern, copies - full - bool(over))
            left -= full * each + over
        each = capacity // length
        if left >= each:
            add(capacity - each * length, ((length, each),), left // each)
        if left % each:
            add(capacity - left % each * length, ((length, left % each),), 1)
    return [run for room in sorted(groups) for run in groups[room]]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces fit into places of the sizes of a's pieces, so that a leaves what is easier to pack."""
    rooms = sorted(a)
    for n in sorted(b, reverse=True):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            return False
        insort(rooms, rooms.pop(at) - n)
    return True


def fillings(counts: dict[int, int], lengths: list[int], room: int, waste: int, most: int | None) -> list[tuple[int, ...]]:
    """Undominated multisets of the lengths that leave at most `waste` of the room, the fullest first.

    Up to `most` of the first that are found; None: all there are.
    """
    found: list[tuple[int, ...]] = []
    tries = [64 * most if most else math.inf]

    def extend(room: int, upto: int, chosen: tuple[int, ...]) -> None:
        tries[0] -= 1
        if tries[0] < 0 or most and len(found) >= 4 * most:
            return
        at = min(upto, bisect_right(lengths, room))
        if room <= waste:
            found.append(chosen)
        for i in range(at - 1, -1, -1):
            n = lengths[i]
            if counts[n] > chosen.count(n):
                extend(room - n, i + 1, (*chosen, n))
            if tries[0] < 0 or room == 0:
                return

    extend(room, len(lengths), ())
    found.sort(key=lambda x: (-sum(x), len(x)))
    kept: list[tuple[int, ...]] = []
    for x in found:
        if not any(dominates(a, x) for a in kept):
            kept.append(x)
    return kept[:most]


def plan(counts: dict[int, int], capacity: int, nodes: float = NODES, width: int | None = FILLINGS) -> Plan:
    """A packing of the histogram: sequences of each pattern.

    Optimal if it meets lower_bound, or with nodes=math.inf and width=None, which search everything, in exponential time.
    """
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    used, bound = sum(c for _, c in best), lower_bound(counts, capacity) if counts else 0
    total = sum(n * c for n, c in counts.items())
    left = [nodes]

    def search(counts: dict[int, int], chosen: Plan, n_used: int, wasted: int) -> None:
        nonlocal best, used
        if not counts:
            if n_used < used:
                best, used = list(chosen), n_used
            return
        left[0] -= 1
        allowed = (used - 1) * capacity - total - wasted
        if allowed < 0 or left[0] < 0:
            return
        lengths = sorted(counts)
        top = lengths[-1]
        rest = counts | {top: counts[top] - 1}
        for x in fillings(rest, [n for n in lengths if rest[n]], capacity - top, min(allowed, capacity), width):
            need = Counter((top, *x))
            waste = capacity - top - sum(x)
            copies = min(counts[n] // k for n, k in need.items()) if width else 1
            if waste:
                copies = min(copies, max(1, ((used - 1) * capacity - total - wasted) // waste))
            after = {n: c for n in counts if (c := counts[n] - copies * need.get(n, 0))}
            chosen.append((tuple(sorted(need.items(), reverse=True)), copies))
            search(after, chosen, n_used + copies, wasted + copies * waste)
            chosen.pop()
            if used <= bound or left[0] < 0:
                return

    if used > bound:
        import sys

        depth = sys.getrecursionlimit()
        sys.setrecursionlimit(max(depth, 20_000))
        try:
            search(counts, [], 0, 0)
        finally:
            sys.setrecursionlimit(depth)
    return best


def places(chosen: Plan) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, where its pieces go in turn: (pieces before, first sequence, pieces in each sequence, offset)."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    before: Counter = Counter()
    first = 0
    for pattern, copies in chosen:
        offset = 0
        for length, many in pattern:
            found[length].append((before[length], first, many, offset))
            before[length] += copies * many
            offset += length * many
        first += copies
    return dict(found)


def pack(cut: DataFrame, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id, offset, n_sequences and least_sequences: each sequence gapless from offset 0.

    n_sequences: how many there are, as few as the search finds; least_sequences: how many any packing needs at least. cut:
    rows with doc_id, piece and length (1 to capacity); other columns are kept, but for those four names.
    """
    cut = cut.drop("sequence_id", "offset", "n_sequences", "least_sequences")
    spark = cut.sparkSession
    at = cut.columns.index("length")
    ranged = sorted_shards(cut, ["length", "doc_id", "piece"], shuffle_partitions(spark))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(cut.schema)
    spark_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def number(each: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        own, seen, last = TaskContext.get().partitionId(), 0, None
        for row in each:
            seen = seen + 1 if row[at] == last else 0
            last = row[at]
            yield *row, own, seen

    part, seen = unused("part", cut), unused("seen", cut)
    extra = [(part, pa.int32()), (seen, pa.int64())]
    numbered = written(mapped(ranged, number, pa.schema([*schema, *[pa.field(n, t) for n, t in extra]]), f"{spark_schema}, `{part}` int, `{seen}` long"), "pieces")
    by_part = sorted(tuple(r) for r in numbered.groupBy("length", part).agg(F.count("*")).collect())
    base: dict[tuple[int, int], int] = {}
    counts: Counter = Counter()
    for length, part, n in by_part:
        base[length, part] = counts[length]
        counts[length] += n
    chosen = plan(counts, capacity, nodes)
    totals = sum(n for _, n in chosen), lower_bound(counts, capacity) if counts else 0
    to = places(chosen)
    starts = {n: [x[0] for x in runs] for n, runs in to.items()}
    sent = spark.sparkContext.broadcast((base, to, starts))  # counts by length and part: no more than lengths and parts

    def place(each: Iterator[tuple]) -> Iterator[tuple]:
        base, to, starts = sent.value
        for *row, part, seen in each:
            length = row[at]
            rank = base[length, part] + seen
            before, first, many, offset = to[length][bisect_right(starts[length], rank) - 1]
            turn, within = divmod(rank - before, many)
            yield *row, first + turn, offset + within * length, *totals

    names = ("sequence_id", "offset", "n_sequences", "least_sequences")
    return mapped(numbered, place, pa.schema([*schema, *[pa.field(n, pa.int64()) for n in names]]), ", ".join([spark_schema, *[f"{n} long" for n in names]]))


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """pieces() and pack() in turn; the cut pieces are a table in between, so that texts are encoded once."""
    return pack(written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "cut"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence put together; packed: of pack_documents with_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
