"""The ids of a byte-level BPE file of the tokenizers library, by ranks.

Where a vocabulary's ids follow the order of its merges, merging by rank gives the ids that the tokenizers library gives,
several times as fast. `RankEncoder` takes the ranks from the library's JSON file, refuses files of which that isn't true,
and holds the first texts of each worker against the library itself. Texts that hold the string of an added token go to the
library whole.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts of each worker that the tokenizers library encodes as well, and the longest part of them.
CHECKED, CHECKED_CHARS = 16, 20_000

#: Longer texts are cut near here, at a space between two letters, which no piece spans.
LONG = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class RankEncoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content["pre_tokenizer"]
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merges = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and content["normalizer"] is None
        if not plain or any(a >= b for a, b in zip(merges, merges[1:], strict=False)) or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("the ids of this file don't follow from ranks")
        made = set(merges)
        ranks = {token: i for token, i in ranks.items() if len(token) == 1 or i in made}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.unchecked = path, CHECKED
        self.added = [x["content"] for x in content["added_tokens"]]
        self.library = None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(token in text for token in self.added):
            return self._by_library(text)
        ids = b"".join(array("I", self.encoding.encode_ordinary(part)).tobytes() for part in cut(text))
        if self.unchecked and 0 < len(text) <= CHECKED_CHARS:
            self._check(text, ids)
        return ids

    def _by_library(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _check(self, text: str, ids: bytes) -> None:
        self.unchecked -= 1
        if self._by_library(text) != ids:
            raise ValueError("ranks and the tokenizers library disagree")


def cut(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * LONG:
        end = text.find(" ", at + LONG)
        while end != -1 and not (text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end = text.find(" ", end + 1)
        if end == -1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> RankEncoder:
    """The encoder of a file, made once in each worker."""
    return RankEncoder(path)


def encoded(rows: Iterator[tuple], path: str) -> Iterator[tuple]:
    """(key, text) rows to (key, ids); a null text counts as empty."""
    encode = encoder(path).encode
    for key, text in rows:
        yield key, encode(text or "")
