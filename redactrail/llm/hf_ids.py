"""Ids of whole texts from the tokenizers library, which encodes each distinct chunk of a text once.

A chunk ends where neither the normaliser nor the split pattern of the tokenizer looks across, so the ids of a text are
those of its chunks, one after the other: "space" chunks (common.CHUNK) for byte-level tokenizers with the usual split
pattern, "word" chunks (runs without white space) for those that drop white space. The chunks of many texts are
dictionary-encoded by Arrow; only what is distinct among them is looked up, in a memo of bounded size of what a worker has
met lately, or by the library; the ids are then taken by index. Strings of added tokens in a text become these tokens, as
in the library's plain call.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from redactrail.llm.common import CHUNK, WHITE_SPACE

CHUNKS = {"space": CHUNK, "word": re.compile(f"[^{WHITE_SPACE}]+")}

#: Characters that Arrow splits at, though they are no white space for tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")

#: Texts that are looked up together, and about how many characters of them.
TOGETHER, TOGETHER_CHARS = 4096, 4 << 20

#: Words in a worker's memo, and the longest of them; beyond that many it keeps what the last texts have.
MEMO_WORDS, MEMO_CHARS = 600_000, 48


class ChunkEncoder:
    """Encodes texts; new chunks go to the library many at once.

    New chunks that are one word are written into one text, whose ids are cut where a word's first ("space") or last
    ("word") token stands; should there not be as many cuts as words, and for all other chunks, each is encoded by itself.
    The memo is a pair of Arrow and numpy arrays: words, and their ids one after the other.
    """

    def __init__(self, path: str, chunks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = CHUNKS[chunks].findall
        self.spaced = chunks == "space"
        self.word = r"^ \p{L}+" if self.spaced else r"^\p{L}+"
        with open(path, encoding="utf-8") as file:
            normalizer = json.load(file)["normalizer"] or {"type": None}
        self.lowers = any(x["type"] == "Lowercase" for x in normalizer.get("normalizers", [normalizer]))
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith("\u0120") if self.spaced else token.endswith("</w>"))]] = True
        self.marks = [np.frombuffer(ids, "<u4") for _, ids in self._singly([",", "."])]
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        texts = list(texts)
        if self.spaced or any(map(SEPARATORS.search, texts)):
            cut = pa.array([self.chunks(text) for text in texts], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        met = cut.flatten().dictionary_encode()
        ids, sizes = self._of_chunks(met.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids)).take(met.indices)
        raw = lists.flatten().to_numpy().astype("<u4", copy=False).tobytes()
        stops = (4 * lists.offsets.to_numpy().astype(np.int64)[cut.offsets.to_numpy()]).tolist()
        return map(raw.__getitem__, map(slice, stops, stops[1:]))

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other, and how many each has.

        A mark after a word is a piece of its own. Words are looked up as the normaliser has them; ASCII letters only, where
        lower cases are one to one.
        """
        marked = pc.match_substring_regex(chunks, self.word + "[,.]$")
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        is_word = pc.match_substring_regex(bare, self.word + "$")
        met = (pc.if_else(is_word, pc.ascii_lower(bare), bare) if self.lowers else bare).dictionary_encode()
        ids, sizes = self._of_words(met.dictionary)
        index = met.indices.to_numpy()
        marked, comma = (np.asarray(x) for x in (marked, pc.ends_with(chunks, ",")))
        own = sizes[index]
        many = own + np.where(marked, np.where(comma, len(self.marks[0]), len(self.marks[1])), 0)
        out = np.zeros(int(many.sum()), np.uint32)
        ends = np.cumsum(many)
        at = np.repeat(ends - many - np.cumsum(own) + own, own) + np.arange(int(own.sum()))
        out[at] = taken(ids, sizes, index)
        for here, mark in ((marked & comma, self.marks[0]), (marked & ~comma, self.marks[1])):
            for k, value in enumerate(mark):
                out[ends[here] - len(mark) + k] = value
        return out, many

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words and other chunks, which the memo learns."""
        at = pc.index_in(words, self.words)
        new = words.filter(at.is_null())
        plain = np.asarray(pc.match_substring_regex(new, self.word + "$"))
        listed = new.to_pylist()
        found = dict(self._words([w for w, p in zip(listed, plain, strict=True) if p])) | dict(self._singly([w for w, p in zip(listed, plain, strict=True) if w and not p])) | {"": b""}
        parts = list(map(found.__getitem__, listed))
        before = len(self.words)
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(parts), "<u4")])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, parts), np.int64, len(parts)) // 4])
        index = at.fill_null(0).to_numpy().astype(np.int64)
        index[np.asarray(at.is_null())] = before + np.arange(len(new))
        keep = np.ones(len(sizes), bool)
        keep[before:] = np.asarray(pc.less_equal(pc.utf8_length(new), MEMO_CHARS))
        if before + len(new) > MEMO_WORDS:
            recent = np.zeros(len(sizes), bool)
            recent[index] = True
            keep &= recent
        known = pa.concat_arrays([self.words, new])
        if keep.all():
            self.words, self.ids, self.sizes = known, ids, sizes
        else:
            self.words, self.ids, self.sizes = known.filter(pa.array(keep)), ids[np.repeat(keep, sizes)], sizes[keep]
        return taken(ids, sizes, index), sizes[index]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            text = "".join(some) if self.spaced else " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.edge[ids]) + (not self.spaced)
            if len(cuts) != len(some) or (cuts[0] if self.spaced else cuts[-1] - len(ids)):
                yield from self._singly(some)
                continue
            raw, ends = ids.tobytes(), (4 * (np.append(cuts[1:], len(ids)) if self.spaced else cuts)).tolist()
            yield from zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)

    def _singly(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(chunks), 4096):
            some = chunks[at : at + 4096]
            for chunk, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                yield chunk, array("I", got.ids).tobytes()


def taken(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Of values that lie one after the other, `sizes` to each part, those of the parts `index`."""
    own = sizes[index]
    starts = (np.cumsum(sizes) - sizes)[index]
    return values[np.repeat(starts - np.cumsum(own) + own, own) + np.arange(int(own.sum()))]


@lru_cache(maxsize=2)
def encoder(path: str, chunks: str) -> ChunkEncoder:
    """The encoder of a tokenizer file, made once in each worker."""
    return ChunkEncoder(path, chunks)


def encoded(rows: Iterator[tuple], path: str, chunks: str, together: int = TOGETHER, chars: int = TOGETHER_CHARS) -> Iterator[tuple]:
    """(key, text) rows to (key, ids); a null text counts as empty. Looks up some texts together, up to about `chars`."""
    own = encoder(path, chunks)
    held: list[tuple] = []
    size = 0
    for key, text in rows:
        held.append((key, text or ""))
        size += len(held[-1][1])
        if len(held) >= together or size >= chars:
            yield from zip([k for k, _ in held], own.encode([t for _, t in held]), strict=True)
            held, size = [], 0
    if held:
        yield from zip([k for k, _ in held], own.encode([t for _, t in held]), strict=True)
