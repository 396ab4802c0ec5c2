import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import packing

TEXTS = [None, "", " ", "a", "a  b   c \n d", "The  cat.\n\nÉté 123's won't", "x" * 5000, "word " * 3000, "tab\tand nbsp   end ", "same", "same", "<|endoftext|> it", "a <|endoftext|> b  c", "glued<|endoftext|>to", "<|endoftext|><|endoftext|>", "<|endoftext|", "end <|endoftext|>", "日本語 テキスト 🙂🙂", " lead", "a \nb"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows, tokenizer, capacity):
    """(doc_id, piece, start, length, ids_crc32) of each piece, without Spark."""
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        for k, end in enumerate(range(first, len(ids) + 1, capacity)):
            own = ids[0 if k == 0 else end - capacity : end]
            out.append((doc_id, k, end - len(own), len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, tokenizer, capacity):
    rows = [*enumerate(TEXTS), (0, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "zz", 3) for i, t in rows], "doc_id long, text string, length string, piece int")
    got = packing.pack_documents(docs, capacity=capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute(rows, tokenizer, capacity)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(placed) <= -(-sum(r.length for r in got) // capacity) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    packed = packing.pack_documents(docs, keep_ids=True)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert zlib.crc32(ids[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    patterns = packing.best_two_fit(counts, 40)
    used = np.zeros(41, int)
    for times, uses in patterns:
        assert sum(k * n for k, n in uses.items()) <= 40
        for k, n in uses.items():
            used[k] += times * n
    assert (used == counts).all()


def test_two_smaller_pieces_replace_the_smallest():
    # greedy: 60 + 30 leaves 10; 30 gives way to 22 + 18, which fill the gap of 40
    counts = np.bincount([60, 30, 22, 18], minlength=101)
    assert packing.best_two_fit(counts, 100)[0] == (1, {60: 1, 22: 1, 18: 1})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "a", "The", "'s", "é", "\u00a0", "日本", "🙂", "123", ".", "\x00", "\r\n", "s’"]), max_size=12))
def test_ids_are_those_of_the_tokenizer(parts):
    text = "".join(parts)
    assert np.frombuffer(_bpe().ids(text), "<u4").tolist() == _reference().encode(text, add_special_tokens=False).ids


@lru_cache
def _bpe():
    return packing.ByteBpe()


@lru_cache
def _reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_best_two_fit(lengths, capacity):
    """The same rule piece by piece: lists of lengths, one a sequence."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        while gap and len(own) > 1:
            small = own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small]
            if not pairs or max(pairs)[0] <= small:
                break
            total = max(pairs)[0]
            _, a, b = max((p for p in pairs if p[0] == total), key=lambda p: -min(p[1:]))
            own.remove(small)
            for x in (a, b):
                own.append(x)
                left.remove(x)
            gap += small - total
            own.sort(reverse=True)
            left = sorted([*left, small], reverse=True)
        out.append(own)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_plan_is_that_of_single_pieces(lengths):
    """A pattern is used as long as its lengths last, as single pieces would choose it again each time."""
    counts = np.bincount(lengths, minlength=31) if lengths else np.zeros(31, int)
    patterns = packing.best_two_fit(counts, 30)
    plain = plain_best_two_fit(lengths, 30)
    got = sum(times for times, _ in patterns)
    assert got == len(plain)
    assert got <= 2 * -(-sum(lengths) // 30)
    assert got <= max(sum(x > 15 for x in lengths), -(-sum(lengths) // 30)) * 3 // 2 + 1
