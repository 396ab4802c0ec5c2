import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import pieces

TEXTS = ["", " ", "a", "Hello  world\t!", "the quick brown fox, jumping", "  lead and   runs    of spaces ", "Éêaux ouèle çch Überßen ñoño", "日本語 テキスト 🙂 \x00\x01", "aaaa" * 20, "<s> </s> <0x0A> <unk>", "line\nnext\r\n", "é ﬁ ①"]


@pytest.fixture(scope="module")
def sp():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    return pieces.PieceModel()


@pytest.fixture(scope="module")
def dropped():
    return pieces.PieceModel(dropout=0.3, seed=7)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_without_dropout_as_the_library(sp, plain):
    more = TEXTS + ["x" * 500, "word" * 100 + " tail", "ź" * 300]
    assert [ids(x) for x in plain.encode_all(more, [0] * len(more))] == [sp.encode(t) for t in more]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("the andrgoébß ▁\n🙂日 "), max_size=60))
def test_agendas_agree_and_decoding_is_lossless(text):
    own = pieces.PieceModel.__dict__.get("_test") or pieces.PieceModel(dropout=0.4, seed=3)
    pieces.PieceModel._test = own
    for variant in (0, 5):
        raw = own.encode_all([text], [variant])[0]
        assert ids(raw) == [k for u in own.units(text) for k in own.segment(u, variant)]
        assert own.decode(raw) == text


def test_variants_differ_and_repeat(dropped):
    text = "considering international representations of understanding " * 3
    got = [dropped.encode_all([text], [v])[0] for v in range(8)]
    assert len(set(got)) > 4 and got == [dropped.encode_all([text], [v])[0] for v in range(8)]
    assert {dropped.decode(x) for x in got} == {text}
    assert pieces.PieceModel(dropout=1.0).segment("the", 0) == [pieces.PieceModel().symbol[c] for c in " the"]


def test_share_of_skipped_merges(dropped, plain):
    words = ["understanding%d" % k for k in range(400)]
    assert sum(map(len, dropped.segment_all([(0, w) for w in words]))) > sum(map(len, plain.segment_all([(0, w) for w in words])))


def test_query_form(spark, sp):
    rows = [*enumerate([None, *TEXTS, "▁literal ▁▁", "long word " * 4000]), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = pieces.encoded_and_decoded(docs, dropout=0.2).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(i), zlib.crc32((t or "").encode())) for i, t in rows)
    encoded = pieces.encode(docs, dropout=0.2)
    assert sorted((str(r.doc_id), r.n_pieces, r.ids_crc32) for r in got) == sorted((str(r.doc_id), len(r.ids) // 4, zlib.crc32(r.ids)) for r in encoded.collect())
    back = pieces.decode(encoded).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encoded_and_decoded(docs.limit(0)).collect() == []


def test_occurrences_and_documents_are_split_apart(spark, plain):
    text = " ".join(["understanding"] * 300)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in pieces.encode(docs).collect()}
    assert len(set(got.values())) == 40
    assert got == {r.doc_id: bytes(r.ids) for r in pieces.encode(docs.repartition(7)).collect()}
    own = pieces.PieceModel(dropout=0.1, seed=1)
    keys = np.arange(12_000, dtype=np.uint64) * np.uint64(977)
    one = own._occurrences(["a"] * 12_000, keys)
    assert plain._segment_equal(["a"], [()])[1].tolist() == [1] and abs(sum(len(w) > 4 for w in one) / 12_000 - 0.1) < 0.015
    words = own._occurrences(["understanding"] * 12_000, keys)
    assert len(set(words)) > 8
    assert own.encode_each([text, text], [3, 4])[0] == own.encode_each([text], [3])[0] and len(set(own.encode_each([text, text], [3, 4]))) == 2


def test_long_and_short_agendas_agree_on_keys(monkeypatch, dropped):
    units, keys = ["reconsideration", "aaaaaaaaab", "the", ""] * 50, np.arange(200, dtype=np.uint64) << np.uint64(40)
    short = dropped._occurrences(units, keys)
    monkeypatch.setattr(pieces, "LONG", -1)
    dropped._clear()
    assert dropped._occurrences(units, keys) == short


def test_what_a_merge_offers_is_looked_up_at_once(monkeypatch, dropped):
    calls, look = [], pieces.PieceModel._look
    monkeypatch.setattr(pieces.PieceModel, "_look", lambda self, left, right: (calls.append(len(left)), look(self, left, right))[1])
    units = ["international", "understanding", "日本語テキスト🙂\x00éß▁x"]
    got, steps = dropped._segment_equal(units, [(1, 3), (0, 2), (0, 1)])
    assert len({len(u) for u in units}) == 1 and len(calls) == steps.max() + 1
    assert dropped.decode(got[2]) == units[2] and dropped.decode(got[0]) == units[0]


def test_nodes_are_the_same_however_many_step_together(monkeypatch, dropped):
    texts = [*TEXTS, "understanding " * 40, "日本 語x " * 30, "w" * 300 + " tail", "naïve " + "ab" * 90]
    documents = list(range(len(texts)))
    dropped._clear()
    want = dropped.encode_each(texts, documents)
    keys = [(u, int(k)) for t, d in zip(texts, documents, strict=True) for u, k in zip(dropped.units(t), pieces.mix(np.uint64(d) + np.arange(len(dropped.units(t)), dtype=np.uint64) * np.uint64(pieces._A)), strict=True)]
    assert [k for x in want for k in ids(x)] == [k for u, key in keys for k in dropped.segment_key(u, key)]
    for name, value in (("TOGETHER", 2), ("TOGETHER_CHARS", 30), ("CACHE_UNITS", 3)):
        monkeypatch.setattr(pieces, name, value)
        dropped._clear()
        assert dropped.encode_each(texts, documents) == want
    assert [dropped.encode_each([t], [d])[0] for t, d in zip(texts, documents, strict=True)] == want


def test_spans():
    assert pieces._spans(np.asarray([5, 0, 9]), np.asarray([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert pieces._spans(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
