"""Operators 1, 4 and 9 against the public tokenizers."""

import math
import random
from array import array
from collections import Counter
from functools import lru_cache
from hashlib import sha256
from itertools import product
from zlib import crc32

import numpy as np
import public_tokenizers as public
import tiktoken
from llm_cases import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redactrail.llm import byte_bpe, hf_ids, huffman_ids, packing, rank_ids

RANKS = public.path("byte_bpe_multi_50k.tiktoken")


def library(name):
    t = Tokenizer.from_file(public.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_byte_bpe_round_trip(documents):
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.round_trip_digests(documents(ODD), RANKS, public.PATTERN).collect()}
    encoded = byte_bpe.encode_documents(documents(ODD), RANKS, public.PATTERN)
    decoded = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode_documents(encoded, RANKS, public.PATTERN).collect()}
    for i, text in enumerate(ODD):
        ids = own.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == sha256((text or "").encode()).hexdigest()
        assert decoded[i] == (text or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_is_exact(text):
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}) if not hasattr(test_byte_bpe_is_exact, "own") else test_byte_bpe_is_exact.own
    test_byte_bpe_is_exact.own = own
    bpe = byte_bpe.codec(RANKS, public.PATTERN)
    assert bpe.encode(text) == own.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_backtracking_on_a_small_vocabulary():
    tokens = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aa", b"aab", b"cab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    bpe = byte_bpe.BacktrackingBPE(ranks, "(?s).+")
    plain = tiktoken.Encoding("p", pat_str="(?s).+", mergeable_ranks=ranks | {bytes([i]): 100 + i for i in range(256) if bytes([i]) not in ranks}, special_tokens={})
    for n in range(1, 8):
        for text in map("".join, product("abc", repeat=n)):
            assert bpe.encode(text) == plain.encode_ordinary(text), text


SPACES_AND_MARKS = st.sampled_from([*" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff", "Ab", "z,", "É", "Σς", "İ", "e\u0301", "'s", "12", "), ", "<|endoftext|>", "<|startoftext|>", "<|END"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(SPACES_AND_MARKS, max_size=30).map("".join)))
def test_chunks_give_the_librarys_ids(text):
    for name, chunks in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "space")):
        expected = library_cached(name)(text)
        assert array("I", next(iter(hf_ids.encoder(public.path(name), chunks).encode([text])))).tolist() == expected
    assert array("I", rank_ids.encoder(public.path("byte_bpe_50k.json")).encode(text)).tolist() == library_cached("byte_bpe_50k.json")(text)


@lru_cache
def library_cached(name):
    return library(name)


def test_long_texts_are_cut_where_no_piece_is(monkeypatch):
    text = " ".join(random.Random(1).choice(["word", "other", "12", "x,", "\n"]) for _ in range(3000))
    whole = rank_ids.encoder(public.path("byte_bpe_50k.json")).encode(text)
    monkeypatch.setattr(rank_ids, "LONG", 100)
    assert rank_ids.encoder(public.path("byte_bpe_50k.json")).encode(text) == whole


def test_huffman_files(spark, documents, tmp_path):
    encode = library("word_bpe_49k.json")
    ids = [7, 3, 5, 1, 1, 9, 2, 8, 20, 4]
    df = documents(ODD, ids)
    huffman_ids.write_documents(df, str(tmp_path / "h"), public.path("word_bpe_49k.json"))
    got = huffman_ids.read_documents(spark, str(tmp_path / "h")).orderBy("start").collect()
    start = 0
    expected = sorted(zip(ids, ODD, strict=True), key=lambda x: x[0])
    assert [r["doc_id"] for r in got] == [i for i, _ in expected]
    for r in got:
        own = array("I", bytes(r["ids"])).tolist()
        assert own in [[*encode(t), 1] for i, t in expected if i == r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), crc32(bytes(r["ids"])))
        start += len(own)


def test_huffman_of_an_empty_table(documents, spark):
    assert huffman_ids.round_trip(documents(["x"]).limit(0), public.path("word_bpe_49k.json")).collect() == []


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for limit in (4, 6, 16):
        counts = rng.integers(0, 1000, 14) ** 3
        lengths = huffman_ids.code_lengths(counts, limit)
        used = counts > 0
        assert lengths[used].min() > 0 and lengths.max() <= limit and not lengths[~used].any()
        assert sum(2.0 ** -int(n) for n in lengths[used]) == 1
    import heapq

    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 99))
    assert (counts * huffman_ids.code_lengths(counts, 16)).sum() == cost
    assert huffman_ids.code_lengths(np.array([0, 5]))[1] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=300), min_size=1, max_size=5))
def test_huffman_round_trip_and_slices(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    sizes = np.array([len(d) for d in docs])
    lengths = huffman_ids.code_lengths(np.bincount(flat, minlength=41))
    bits, first, points, many = huffman_ids.encode(flat, sizes, lengths, huffman_ids.canonical_codes(lengths), 16)
    table = huffman_ids.decoding_table(lengths)
    ends = np.cumsum(many)
    for i, d in enumerate(docs):
        own, mine = bits[first[i] : first[i + 1]], points[ends[i] - many[i] : ends[i]]
        assert huffman_ids.decode(own, mine, huffman_ids.stretches(sizes[i : i + 1], 16), table).tolist() == d
        assert huffman_ids.decode_slice(own, mine, len(d), 5, 40, table, 16).tolist() == d[5:40]


def fewest(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=10))
def test_bin_completion_finds_the_fewest_sequences(lengths):
    counts = Counter(lengths)
    chosen = packing.plan(counts, 30)
    got = Counter()
    for pattern, copies in chosen:
        assert sum(n * k for n, k in pattern) <= 30
        for n, k in pattern:
            got[n] += k * copies
    assert got == counts and sum(c for _, c in chosen) == fewest(lengths, 30) >= packing.lower_bound(counts, 30)
    assert sum(c for _, c in packing.plan(counts, 30, math.inf, None)) == fewest(lengths, 30)


def test_packing(documents):
    encode = library("byte_bpe_50k.json")
    df = documents(ODD, [7, 3, 5, 1, 1, 9, 2, 8, 20, None])
    rows = packing.pack_documents(df, public.path("byte_bpe_50k.json"), capacity=64, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in zip([7, 3, 5, 9, 2, 8, 20, None], ODD[:3] + ODD[5:], strict=True):
        own = sorted((r["piece"], r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert array("I", b"".join(x[2] for x in own)).tolist() == [*encode(text), 0]
        assert all(len(x[2]) == 256 for x in own[1:])
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert {(r["n_sequences"], r["least_sequences"]) for r in rows} == {(len(by_sequence), packing.lower_bound(Counter(r["length"] for r in rows), 64))}
    clash = packing.pieces(df, public.path("byte_bpe_50k.json"), 64).selectExpr("*", "1 AS part", "2 AS seen", "3 AS offset")
    assert packing.pack(clash, 64).where("part = 1 AND seen = 2").count() == len(rows)
    assert packing.pack_documents(df.limit(0), public.path("byte_bpe_50k.json")).collect() == []
    made = packing.sequences(packing.pack_documents(df, public.path("byte_bpe_50k.json"), capacity=64, with_ids=True)).collect()
    assert sum(r["n_tokens"] for r in made) == sum(r["length"] for r in rows) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in made)
