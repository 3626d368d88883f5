"""Media columns: AVI files of motion-JPEG frames, their lossless frames, and clips between shots.

`store` makes an AVI file of a payload of bytes, `load` reads it back through the file's index, `clips` finds the shots and
gives a row for each clip. `write_avi`, `read_avi`, `encode_frames`, `decode_frames` and `shots` work without Spark.

Storage. A payload is padded with spaces to whole frames of 16 x 12 samples of 8 bits. Every frame is an intra-coded JPEG of
the lossless process (SOF3): each sample is predicted from its left neighbour, at the left edge from the one above, and the
differences are Huffman-coded. Nothing is quantised, so the bytes come back as they were. Frames of any size and of one
component are read, with any Huffman table of the file and predictors 1 and 2. `clips` reads baseline frames, as cameras make
them, too: their luminance.

Shots. Between neighbouring frames the histograms of 16 grey levels are compared; a cut is where the difference exceeds the
mean by DEVIATIONS standard deviations of the differences WINDOW frames around, and LEAST_CUT of the samples: so lively
passages have higher thresholds than quiet ones. Clips are the stretches between cuts, timed by the file's frame rate.

Frames are coded side by side in arrays: a loop goes over the 192 samples of a frame, not over frames. Documents are coded
in groups of about GROUP frames, longer ones in parts of as many.

Files. Of several video streams the first is read; frames in `rec ` lists, with or without an index, count, and a dropped
frame (of no bytes) repeats the picture before it.

Cases. Null text: as the empty text, one frame of spaces. Repeated rows: each by itself, equal texts give equal values. Null
ids are kept. Empty table: empty result. Extra columns are not read. A file that is no AVI, is cut short, or has frames of
other processes: ValueError from the functions; `clips` gives one row with the reason instead.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from redactrail.llm.baseline_jpeg import is_baseline, luma
from redactrail.llm.common import mapped, pick

WIDTH, HEIGHT, RATE, GROUP = 16, 12, 25, 6144
UNIT = WIDTH * HEIGHT
WINDOW, DEVIATIONS, LEAST_CUT, LEVELS = 8, 2.5, 0.25, 16

#: Code lengths of the categories 0 to 8 of differences in the files that are written; no code is all ones.
CATEGORY_BITS = (4, 3, 3, 3, 3, 3, 3, 3, 5)


def _codes(lengths: list[int]) -> list[int]:
    """Canonical codes of symbols in order, lengths not falling."""
    codes, code, last = [], 0, 0
    for n in lengths:
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return codes


@lru_cache(maxsize=1)
def _difference_codes() -> tuple[np.ndarray, np.ndarray, bytes]:
    """By difference + 255: the code with its extra bits, its length; and the DHT segment."""
    order = sorted(range(9), key=lambda c: (CATEGORY_BITS[c], c))
    by = dict(zip(order, _codes([CATEGORY_BITS[c] for c in order]), strict=True))
    codes, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        codes[d + 255], sizes[d + 255] = (by[c] << c) | extra, CATEGORY_BITS[c] + c
    counts = bytes(sum(CATEGORY_BITS[c] == n for c in range(9)) for n in range(1, 17))
    return codes, sizes, b"\xff\xc4" + struct.pack(">H", 2 + 1 + 16 + 9) + b"\x00" + counts + bytes(order)


@lru_cache(maxsize=1)
def _frame_head() -> bytes:
    frame = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00"
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"  # predictor 1, no point transform
    return b"\xff\xd8" + _difference_codes()[2] + frame + scan


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """The JPEG of each row of 192 samples."""
    found: list[bytes] = []
    codes, sizes, _ = _difference_codes()
    head = _frame_head()
    for at in range(0, len(samples), GROUP):
        px = samples[at : at + GROUP].reshape(-1, HEIGHT, WIDTH).astype(np.int16)
        n = len(px)
        d = px.copy()
        d[:, :, 1:] -= px[:, :, :-1]
        d[:, 1:, 0] -= px[:, :-1, 0]
        d[:, 0, 0] -= 128
        index = d.reshape(n, UNIT) + 255
        code, size = np.empty((n, UNIT + 1), np.uint64), np.empty((n, UNIT + 1), np.int64)
        code[:, :-1], size[:, :-1] = codes[index], sizes[index]
        bits = size[:, :-1].sum(1)
        size[:, -1] = -bits % 8
        code[:, -1] = (1 << size[:, -1]) - 1  # filled up with ones
        first = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
        raw = _packed(code.ravel(), size.ravel(), int(first[-1]))
        marks = raw == 255  # a zero byte follows each of these
        to = np.arange(len(raw)) + np.concatenate([[0], np.cumsum(marks)[:-1]])
        stuffed = np.zeros(len(raw) + int(marks.sum()), np.uint8)
        stuffed[to] = raw
        before = np.concatenate([[0], np.cumsum(marks)])
        bounds = (first + before[first]).tolist()
        data = stuffed.tobytes()
        found += [head + data[a:b] + b"\xff\xd9" for a, b in zip(bounds, bounds[1:], strict=False)]
    return found


def _packed(code: np.ndarray, size: np.ndarray, n_bytes: int) -> np.ndarray:
    """Codes of less than 32 bits one after the other, most significant bit first."""
    at = np.cumsum(size) - size
    word = at >> 6
    room = 64 - (at & 63) - size
    words = np.zeros((n_bytes + 7) // 8 + 2, np.uint64)
    part = code << np.maximum(room, 0).astype(np.uint64)
    over = np.flatnonzero(room < 0)
    part[over] = code[over] >> (-room[over]).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[starts]] = np.add.reduceat(part, starts)
    words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[:n_bytes]


@lru_cache(maxsize=64)
def _head_of(head: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, predictor, DHT content) of a lossless frame's segments before the scan's data."""
    at, shape, tables = 2, None, {}
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            raise ValueError("no JPEG marker")
        kind, n = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + n]
        if kind == 0xC4:
            while body:
                values = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + values]
                body = body[17 + values :]
        elif kind == 0xC3:
            precision, height, width, components = struct.unpack(">BHHB", body[:6])
            if precision != 8 or components != 1:
                raise ValueError("only one component of 8 bits is read")
            shape = width, height
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a frame of the lossless process")
        elif kind == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif kind == 0xDA:
            table, predictor, transform = body[2] >> 4, body[3], body[5] & 15
            if shape is None or table not in tables or predictor not in (1, 2) or transform:
                raise ValueError("a scan that is not read")
            return *shape, predictor, tables[table]
        at += 2 + n
    raise ValueError("no scan")


@lru_cache(maxsize=16)
def _lookup(table: bytes) -> tuple[np.ndarray, int]:
    """By the next bits: (difference + 512) << 6 | length of code and extra bits; and how many bits."""
    lengths = [n for n in range(1, 17) for _ in range(table[n - 1])]
    symbols = table[16:]
    codes = _codes(lengths)
    most = max(n + c for n, c in zip(lengths, symbols, strict=True))
    if most > 25 or max(symbols) > 9:
        raise ValueError("differences of more than 8 bits")
    found = np.zeros(1 << most, np.uint32)
    for code, n, c in zip(codes, lengths, symbols, strict=True):
        for extra in range(1 << c):
            d = extra if c == 0 or extra >> (c - 1) else extra - (1 << c) + 1
            at = ((code << c) | extra) << (most - n - c)
            found[at : at + (1 << (most - n - c))] = ((d + 512) << 6) | (n + c)
    return found, most


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of lossless JPEG frames of one size, a row each."""
    parts: list[np.ndarray] = []
    head, known = b"", None
    for at in range(0, len(frames), GROUP):
        scans = []
        for frame in frames[at : at + GROUP]:
            if known is None or not frame.startswith(head):
                cut = _scan_start(frame)
                own = _head_of(frame[:cut])
                if known is not None and own != known:
                    raise ValueError("frames of different kinds in one file")
                head, known = frame[:cut], own
            end = frame.rfind(b"\xff\xd9")
            if end < 0:
                raise ValueError("a frame is cut short")
            scans.append(frame[len(head) : end])
        width, height, predictor, table = known
        parts.append(_scans(scans, width, height, predictor, table))
    return np.concatenate(parts) if parts else np.zeros((0, UNIT), np.uint8)


def frame_samples(frames: list[bytes]) -> np.ndarray:
    """The samples of lossless frames, and the luminance of baseline ones, a row each.

    An empty frame was dropped: the picture before it stands on, or the first one if there is none before.
    """
    full = [f for f in frames if f]
    if not full:
        raise ValueError("no frames")
    plain = [is_baseline(f) for f in full]
    lossless = iter(decode_frames([f for f, p in zip(full, plain, strict=True) if not p]) if not all(plain) else ())
    pictures = [luma(f).ravel() if p else next(lossless) for f, p in zip(full, plain, strict=True)]
    if len({p.shape for p in pictures}) > 1:
        raise ValueError("frames of different sizes in one file")
    return np.stack(pictures)[np.maximum(np.cumsum([len(f) > 0 for f in frames]) - 1, 0)]


def _scan_start(frame: bytes) -> int:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        n = struct.unpack(">H", frame[at + 2 : at + 4])[0]
        at += 2 + n
        if frame[at - n - 1] == 0xDA:
            return at
    raise ValueError("no scan")


def _scans(scans: list[bytes], width: int, height: int, predictor: int, table: bytes) -> np.ndarray:
    lookup, most = _lookup(table)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    kept = np.ones(len(raw), bool)
    kept[1:] = (raw[1:] != 0) | (raw[:-1] != 255)
    before = np.concatenate([[0], np.cumsum(kept)])
    bounds = np.cumsum([0, *map(len, scans)])
    wide = np.concatenate([raw[kept], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    at, last = before[bounds[:-1]] << 3, len(window) - 1
    mask, size = np.uint32((1 << most) - 1), width * height
    d = np.empty((size, len(scans)), np.int16)
    for k in range(size):
        entry = lookup[(window[np.minimum(at >> 3, last)] >> (32 - most - (at & 7)).astype(np.uint32)) & mask]
        d[k] = (entry >> 6).astype(np.int16) - 512
        at = at + (entry & 63)
    if (at > before[bounds[1:]] << 3).any():
        raise ValueError("a frame is cut short")
    d = d.T.reshape(-1, height, width)
    if predictor == 1:
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
        px = np.cumsum(d, axis=2)
    else:
        d[:, 0, :] = np.cumsum(d[:, 0, :], axis=1) + 128
        px = np.cumsum(d, axis=1)
    return (px & 255).astype(np.uint8).reshape(-1, size)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file of one stream of motion-JPEG frames, with an index."""
    sizes = np.array([len(f) for f in frames], np.int64)
    most = int(sizes.max(initial=0))
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # each frame is a key frame
    index[:, 2] = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    index[:, 3] = sizes
    movie = b"".join([_chunk(b"00dc", f) for f in frames])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + movie) + _chunk(b"idx1", index.tobytes()))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks of a stretch; a list's name is its kind, its start after that."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if at + 8 + n > len(data):
            raise ValueError("the file is cut short")
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, at + 8 + n
        else:
            yield name, at + 8, at + 8 + n
        at += 8 + n + (n & 1)


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a movi list, those in its `rec ` lists included."""
    for name, a, b in _walk(data, start, end):
        if name == b"rec ":
            yield from _chunks(data, a, b)
        else:
            yield name, a, b


def _stream(data: bytes, start: int, end: int) -> tuple[bytes | None, float]:
    """Of a header list, the number of the first video stream (None if no stream is described) and microseconds a frame."""
    lapse, number, seen = 40_000.0, None, 0
    for name, a, b in _walk(data, start, end):
        if name == b"avih":
            lapse = struct.unpack("<I", data[a : a + 4])[0] or lapse
        elif name == b"strl":
            head = next((x for n, x, _ in _walk(data, a, b) if n == b"strh"), None)
            if head is not None and data[head : head + 4] == b"vids" and number is None:
                number = b"%02d" % seen
                scale, rate = struct.unpack("<II", data[head + 20 : head + 28])
                lapse = 1e6 * scale / rate if scale and rate else lapse
            seen += 1
    return number, lapse


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames of the first video stream in the order of the index (or of the file, without one), and microseconds a frame.

    Reads idx1 indexes with offsets from the movi list or the file's start, and standard indexes (ix##) of large files.
    Dropped frames are empty.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    lapse, number, entries, movies, standard = 40_000.0, None, None, [], []
    for _, start, end in _walk(data, 0, len(data)):
        for name, a, b in _walk(data, start, end):
            if name == b"hdrl":
                number, lapse = _stream(data, a, b)
            elif name == b"movi":
                movies.append((a, b))
            elif name == b"idx1":
                entries = np.frombuffer(data[a : b - (b - a) % 16], "<u4").reshape(-1, 4)
    if not movies:
        raise ValueError("no movi list")
    if number is None:
        number = next((n[:2] for movie in movies for n, _, _ in _chunks(data, *movie) if n[2:] in (b"dc", b"db")), b"00")
    if entries is not None and len(movies) == 1:
        video = entries[np.isin(entries[:, 0], [int.from_bytes(number + x, "little") for x in (b"dc", b"db")])]
        if len(video):
            base = movies[0][0] - 4
            if data[base + int(video[0, 2]) : base + int(video[0, 2]) + 4] != video[0, :1].tobytes():
                base = 0
            return [data[base + o + 8 : base + o + 8 + n] for o, n in video[:, 2:].tolist()], lapse
    chunks = [(name, a, b) for movie in movies for name, a, b in _chunks(data, *movie)]
    for name, a, b in chunks:
        if name == b"ix" + number:
            wide, kind, n = data[a], data[a + 3], struct.unpack("<I", data[a + 4 : a + 8])[0]
            base = struct.unpack("<Q", data[a + 12 : a + 20])[0]
            if kind == 1 and wide == 2:
                standard += [data[base + o : base + o + (size & 0x7FFFFFFF)] for o, size in np.frombuffer(data[a + 24 : a + 24 + 8 * n], "<u4").reshape(-1, 2).tolist()]
    return standard or [data[a:b] for name, a, b in chunks if name in (number + b"dc", number + b"db")], lapse


def timed(cuts: np.ndarray, frames: int, lapse: float) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start and end in milliseconds) of the clips between cuts."""
    bounds = [0, *cuts.tolist(), frames]
    return [(a, b - a, a * lapse / 1000, b * lapse / 1000) for a, b in zip(bounds, bounds[1:], strict=False)]


def shots(samples: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For films that begin at the rows `starts` of samples, the frames (from 0) where a new shot begins."""
    n, size = samples.shape
    ends = np.append(starts[1:], n)
    levels = np.bincount((np.arange(n)[:, None] * LEVELS + (samples >> 4)).ravel(), minlength=n * LEVELS).reshape(n, LEVELS)
    d = np.zeros(n)
    d[1:] = np.abs(levels[1:] - levels[:-1]).sum(1) / (2 * size)
    first, last = np.repeat(starts, ends - starts) + 1, np.repeat(ends, ends - starts)
    here = np.arange(n)
    d[starts[starts < n]] = 0
    a, b = np.minimum(np.maximum(here - WINDOW, first), last), np.minimum(here + WINDOW + 1, last)
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    many = np.maximum(b - a, 1)
    mean = (sums[b] - sums[a]) / many
    spread = np.sqrt(np.maximum((squares[b] - squares[a]) / many - mean * mean, 0))
    cut = (d > mean + DEVIATIONS * spread + 1e-9) & (d >= LEAST_CUT)
    cut[starts[starts < n]] = False
    at = np.flatnonzero(cut)
    split = np.searchsorted(at, np.append(starts, n))
    return [at[split[i] : split[i + 1]] - starts[i] for i in range(len(starts))]


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with spaces up to a positive multiple of a frame, and how many bytes the text has."""
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT)), len(data)


def _groups(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= GROUP * UNIT:
            yield held
            held, n = [], 0
    if held:
        yield held


def films(payloads: list[bytes]) -> list[bytes]:
    """The AVI file of each payload."""
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    ends = np.cumsum([len(x) // UNIT for x in payloads]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def restored(media: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int, float, float]]]]:
    """The payload and the timed() clips of each AVI file that films() made, read from its bytes."""
    each = [read_avi(x) for x in media]
    samples = decode_frames([f for frames, _ in each for f in frames])
    many = np.array([len(frames) for frames, _ in each])
    ends = np.cumsum(many)
    raw = samples.tobytes()
    cuts = shots(samples, ends - many)
    clips = [timed(own, len(frames), lapse) for own, (frames, lapse) in zip(cuts, each, strict=True)]
    return [raw[UNIT * a : UNIT * b] for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True)], clips


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the AVI file of each whole text."""
    kind, arrow = _id(df, id_col)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(each, lambda r: len(r[1] or "")):
            both = [padded(text) for _, text in group]
            for (doc_id, _), (_, n), media in zip(group, both, films([p for p, _ in both]), strict=True):
                yield doc_id, n, media

    schema = pa.schema([("doc_id", arrow), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return mapped(pick(df, doc_id=id_col, text=text_col), rows, schema, f"doc_id {kind}, n_bytes long, media binary", flush_bytes=4 << 20)


def load(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """(doc_id, data): what store() was given, from the files' bytes."""
    kind, arrow = _id(df, id_col)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(each, lambda r: len(r[1])):
            for (doc_id, _, n), payload in zip(group, restored([bytes(m) for _, m, _ in group])[0], strict=True):
                yield doc_id, payload[:n]

    return mapped(pick(df, doc_id=id_col, media=media_col, n=bytes_col), rows, pa.schema([("doc_id", arrow), ("data", pa.binary())]), f"doc_id {kind}, data binary", flush_bytes=4 << 20)


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, clip, first_frame, n_frames, start_ms, end_ms, error): the clips of each AVI file.

    Null files have no rows; a file that can't be read has one, with the reason.
    """
    kind, arrow = _id(df, id_col)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, media in each:
            if media is None:
                continue
            try:
                frames, lapse = read_avi(bytes(media))
                samples = frame_samples(frames)
            except (ValueError, KeyError, struct.error, IndexError) as e:
                yield doc_id, 0, None, None, None, None, str(e)
                continue
            for i, clip in enumerate(timed(shots(samples, np.array([0]))[0], len(samples), lapse)):
                yield doc_id, i, *clip, None

    schema = pa.schema([("doc_id", arrow), ("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("error", pa.string())])
    return mapped(pick(df, doc_id=id_col, media=media_col), rows, schema, f"doc_id {kind}, clip int, first_frame long, n_frames long, start_ms double, end_ms double, error string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text, reads the file back, and returns digests of both and the clips as a feature: their milliseconds.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_clips).
    """
    from hashlib import sha256
    from zlib import crc32

    kind, arrow = _id(df, id_col)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(each, lambda r: len(r[1] or "")):
            both = [padded(text) for _, text in group]
            media = films([p for p, _ in both])
            for (doc_id, _), (_, n), film, payload, clips in zip(group, both, media, *restored(media), strict=True):
                feature = f"{len(payload) // UNIT} frames, clips " + " ".join(f"{start:g}-{end:g}" for *_, start, end in clips)
                yield doc_id, n, len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(film), sha256(film).hexdigest(), feature, len(clips)

    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_clips", pa.int64())]
    text = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields)
    return mapped(pick(df, doc_id=id_col, text=text_col), rows, pa.schema([("doc_id", arrow), *fields]), f"doc_id {kind}, {text}")


def _id(df: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    return kind.simpleString(), to_arrow_type(kind)
