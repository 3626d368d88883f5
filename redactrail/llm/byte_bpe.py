"""Byte-level BPE by backtracking over longest matches, exact and in linear time.

`encode_documents` gives each document's token ids, `decode_documents` the bytes of ids.

Method. The vocabulary's tokens, their bytes mapped to Latin-1 characters, form an Aho-Corasick automaton, which finds the
longest token at each place of a piece in one pass. The encoder takes the longest token, and the next shorter token that is
a prefix of it whenever the place it ends at is known to lead nowhere or the token can't stand beside its predecessor; with
no token left it steps back. Two tokens can stand side by side if merging by rank would never join across them, which the
merge trees of both tell; the answers are memoised. Every place is given up once at most, hence linear time.

Cases. Null text: as the empty text, no ids. Null ids: null bytes. Repeated rows: a row each. Null document ids are kept.
Empty table: empty result. Extra columns are not read, whatever their names. A text of one huge word takes time in
proportion to its length and isn't kept in the memo.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from redactrail.llm.common import CHUNK, MEMO_CHARS, MEMO_JOINED, Memo, mapped, pick

#: Answers of the compatibility of tokens that are kept.
PAIR_ENTRIES = 1_000_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines: token in base 64, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class BacktrackingBPE:
    """Encodes and decodes by ranks; pattern splits texts into the pieces that are encoded each by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = [len(token) for token in self.bytes_of]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of each token that merging can make
        self.shorter: dict[int, int | None] = {}  # the longest proper prefix that is such a token
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: Memo[list[int]] = Memo()
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and not self._learn(token, rank):
                continue  # a piece may be this token as a whole, but merging never makes it
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = None
        for rank in self.shorter:
            token = self.bytes_of[rank]
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) in self.shorter), None)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.pairs.clear()

    def _learn(self, token: bytes, rank: int) -> bool:
        """Finds the two tokens that merge last into token, if any do."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            known = a is not None and b is not None and (n == 1 or a in self.halves) and (len(token) - n == 1 or b in self.halves)
            if known and self._apart(a, b, rank):
                self.halves[rank] = (a, b)
                return True
        return False

    def _apart(self, a: int, b: int, below: int = NEVER) -> bool:
        """Whether merges of ranks under `below` never join across the border of the tokens a and b.

        Goes back in time from both tokens: the part at the border that was merged later is undone first.
        """
        of, ranks, halves = self.bytes_of, self.ranks, self.halves
        a_ends = b_ends = below
        while True:
            joined = ranks.get(of[a] + of[b])
            if joined is not None and joined < a_ends and joined <= b_ends and joined < below:
                return False
            merged_a, merged_b = halves.get(a), halves.get(b)
            if merged_a is None and merged_b is None:
                return True
            if merged_b is None or (merged_a is not None and a > b):
                a_ends, a = a, merged_a[1]
            else:
                b_ends, b = b, merged_b[0]

    def compatible(self, a: int, b: int) -> bool:
        answer = self.pairs.get((a, b))
        if answer is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            answer = self.pairs[a, b] = self._apart(a, b)
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        for end, (rank, length) in self.matches(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends grow, so the last one is the longest
        lengths, shorter, compatible, known = self.lengths, self.shorter, self.compatible, self.pairs.get
        ids: list[int] = []
        lost = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            while token is not None:
                end = at + lengths[token]
                if not lost[end] and (not ids or known((ids[-1], token)) or compatible(ids[-1], token)):
                    ids.append(token)
                    at = end
                    token = longest[at] if at < size else None
                    break
                token = shorter[token]
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of the text")
                lost[at] = 1
                token = ids.pop()
                at -= lengths[token]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for chunk in CHUNK.findall(text):
            own = memo[chunk]
            if own is None:
                own = []
                for piece in self.pieces(chunk):
                    part = memo[piece]
                    if part is None:
                        part = self.encode_piece(piece.encode())
                        if len(piece) <= MEMO_CHARS:
                            memo.put(piece, part)
                    own = own + part if own else part
                if len(chunk) <= MEMO_JOINED:
                    memo.put(chunk, own)
            ids += own
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BacktrackingBPE:
    """The codec of a rank file, made once in each worker."""
    return BacktrackingBPE(read_ranks(path), pattern)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each whole text, little-endian unsigned 32-bit integers in a binary."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        encode = codec(ranks_path, pattern).encode
        for doc_id, text in each:
            ids = encode(text or "")
            yield doc_id, len(ids), array("I", ids).tobytes()

    return _over(df, rows, id_col, text_col, [("n_tokens", pa.int64(), "long"), ("ids", pa.binary(), "binary")])


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): what the ids stand for."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        decode = codec(ranks_path, pattern).decode
        for doc_id, ids in each:
            yield doc_id, None if ids is None else decode(array("I", ids))

    return _over(df, rows, id_col, ids_col, [("bytes", pa.binary(), "binary")])


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass."""
    from hashlib import sha256

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(ranks_path, pattern)
        decimal = [b"%d" % i for i in range(len(own.bytes_of))]
        for doc_id, text in each:
            ids = own.encode(text or "")
            yield doc_id, len(ids), sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), sha256(own.decode(ids)).hexdigest()

    return _over(df, rows, id_col, text_col, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")])


def _over(df: DataFrame, rows, id_col: str, value_col: str, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(df.schema[id_col].dataType)), *[(n, t) for n, t, _ in columns]])
    spark_schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {s}" for n, _, s in columns)
    return mapped(pick(df, doc_id=id_col, value=value_col), rows, schema, spark_schema)
