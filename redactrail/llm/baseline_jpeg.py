"""The luminance of baseline JPEG frames (sequential DCT, Huffman-coded, 8 bits), as motion-JPEG files have them.

Components may be sampled differently and restart intervals used; frames without Huffman tables get the usual ones. What
else a frame holds is passed over, but has to be decoded to get to the next luminance block. Progressive and arithmetic
frames and those cut short: ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# The usual Huffman tables (codes of each length from 1 to 16, then their symbols), and the zigzag order.
DC_LENGTHS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
DC_SYMBOLS = "00 01 02 03 04 05 06 07 08 09 0a 0b"
AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_SYMBOLS = (
    """01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17
    18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74
    75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2
    c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa""",
    """00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1
    25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73
    74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9
    ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa""",
)
#: By place in the zigzag, the place in a block: diagonals in turn, up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: code length << 8 | symbol; 0 for no code."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


def usual_tables() -> dict[int, list[int]]:
    """By class << 4 | number."""
    dc = bytes.fromhex(DC_SYMBOLS)
    return {i: lookup(bytes(DC_LENGTHS[i]), dc) for i in (0, 1)} | {16 + i: lookup(bytes(AC_LENGTHS[i]), bytes.fromhex(AC_SYMBOLS[i])) for i in (0, 1)}


def is_baseline(frame: bytes) -> bool:
    return any(kind in (0xC0, 0xC1) for kind, _ in _segments(frame))


def _segments(frame: bytes):
    """(kind, body) of the segments up to the scan; the scan's body is its header and all that follows."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no JPEG marker")
        if frame[at + 1] == 0xFF:  # a fill byte
            at += 1
            continue
        n = struct.unpack(">H", frame[at + 2 : at + 4])[0]
        if frame[at + 1] == 0xDA:
            yield 0xDA, frame[at + 4 :]
            return
        yield frame[at + 1], frame[at + 4 : at + 2 + n]
        at += 2 + n


class _Bits:
    """A scan's bits between two restart markers."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.window = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
        self.at, self.end = 0, 8 * (len(raw) - 8)

    def symbol(self, table: list[int]) -> int:
        entry = table[self.window[self.at >> 3] >> (16 - (self.at & 7)) & 0xFFFF]
        self.at += entry >> 8
        if not entry or self.at > self.end:
            raise ValueError("a frame is cut short")
        return entry & 0xFF

    def value(self, n: int) -> int:
        """A signed number of n bits."""
        if not n:
            return 0
        v = self.window[self.at >> 3] >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("a frame is cut short")
        return v if v >> (n - 1) else v - (1 << n) + 1


def luma(frame: bytes) -> np.ndarray:
    """The first component's samples, by row and column."""
    tables, quantisers, components, interval, size = usual_tables(), {}, [], 0, None
    for kind, body in _segments(frame):
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                quantisers[body[0] & 15] = values.astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            precision, height, width, count = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("samples of other than 8 bits")
            size = height, width
            components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("a frame of another process")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            return _scan(body, size, components, tables, quantisers, interval)
    raise ValueError("no scan")


def _scan(body: bytes, size, components, tables, quantisers, interval: int) -> np.ndarray:
    head = 4 + 2 * body[0]
    if size is None or body[0] != len(components):
        raise ValueError("scans of single components are not read")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    end = body.rfind(b"\xff\xd9")
    data = body[head : end if end >= 0 else len(body)]
    parts, at = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[at:i])
            at = i + 2
    parts.append(data[at:])
    if len(components) == 1:
        components = [(components[0][0], 1, 1, components[0][3])]
    h, v = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-size[1] // (8 * h)), -(-size[0] // (8 * v))
    first = components[0]
    blocks = np.zeros((down * first[2], across * first[1], 64))
    before: dict[int, int] = {}
    bits = None
    for unit in range(across * down):
        if unit % (interval or across * down) == 0:
            if not parts:
                raise ValueError("a frame is cut short")
            bits, before = _Bits(parts.pop(0)), dict.fromkeys(chosen, 0)
        for ident, ch, cv, _ in components:
            dc, ac = tables[chosen[ident] >> 4], tables[16 + (chosen[ident] & 15)]
            for i in range(ch * cv):
                before[ident] += bits.value(bits.symbol(dc))
                block = blocks[unit // across * cv + i // ch, unit % across * ch + i % ch] if ident == first[0] else None
                if block is not None:
                    block[0] = before[ident]
                k = 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    if symbol & 15:
                        k += symbol >> 4
                        value = bits.value(symbol & 15)
                        if block is not None and k < 64:
                            block[k] = value
                        k += 1
                    elif symbol == 0xF0:
                        k += 16
                    else:
                        break
    placed = np.zeros_like(blocks)
    placed[..., ZIGZAG] = blocks * quantisers[first[3]]
    square = placed.reshape(*blocks.shape[:2], 8, 8)
    px = COSINES.T @ square @ COSINES + 128
    whole = px.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    own = -(-size[0] * first[2] // v), -(-size[1] * first[1] // h)
    return np.clip(np.rint(whole[: own[0], : own[1]]), 0, 255).astype(np.uint8)
