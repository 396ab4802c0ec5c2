import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import katz
from quernstone.llm._common import Store


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(docs, order):
    """The model by dictionaries: (counts of grams by length, p of a token given those before it, scores of the documents)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    counts = [None, *(Counter() for _ in range(order))]
    for (_, t), h in zip(docs, held, strict=True):
        own = [None, *toks(t)]
        for at in range(1, len(own)):
            for k in range(1, min(order, at + 1) + 1):
                counts[k][tuple(own[at - k + 1 : at + 1])] += not h
    counts = [None, *(Counter({g: c for g, c in x.items() if c}) for x in counts[1:])]
    return counts, model(counts), [(i, h, toks(t)) for (i, t), h in zip(docs, held, strict=True)]


def model(counts):
    """p(word, history), by the definition."""

    def discounts(grams):
        n = Counter(grams.values())
        out = {}
        for r in range(1, 6):
            d = -1
            if n[1] and n[r] and 6 * n[6] != n[1]:
                a = 6 * n[6] / n[1]
                d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return out

    d = [None, *map(discounts, counts[1:])]
    kept = lambda c, k: c * d[k].get(c, 1)
    total, mass1 = sum(counts[1].values()), sum(kept(c, 1) for c in counts[1].values())
    size1 = total if total - mass1 > 1e-9 else total + 1
    after = {}
    for grams in counts[2:]:
        for g, c in grams.items():
            after.setdefault(g[:-1], {})[g[-1]] = c

    @lru_cache(None)
    def context(h):
        own, k = after[h], len(h) + 1
        count, mass = sum(own.values()), sum(kept(c, k) for c in own.values())
        size = count if count - mass > 1e-9 else count + 1
        return size, (1 - mass / size) / (1 - sum(p(x, h[1:]) for x in own))

    def p(w, h):
        if not h:
            return kept(counts[1][(w,)], 1) / size1 if counts[1][(w,)] else 1 - mass1 / size1
        if h not in after:
            return p(w, h[1:])
        size, weight = context(h)
        return kept(after[h][w], len(h) + 1) / size if w in after[h] else weight * p(w, h[1:])

    return p


def scores(docs, order):
    counts, p, texts = brute(docs, order)
    c1, total, out = counts[1], sum(counts[1].values()), []
    for i, h, d in texts:
        base = sum(math.log10((c1[(w,)] + 0.5) / (total + 0.5 * (len(c1) + 1))) for w in d)
        own = [None, *d]
        score = sum(math.log10(p(own[at], tuple(own[max(0, at - order + 1) : at]))) for at in range(1, len(own)))
        out.append((i, h, len(d), sum(c1[(w,)] > 0 for w in d), total, base, score))
    return out


def corpus():
    rng = random.Random(4)
    words = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(90)] + [None, "", "The the\tTHE\x0bthe É é", "a b   c", "x " * 300, "same text", "same text"]
    return [*enumerate(texts), (None, "no id here"), (7, "again seven")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kind string").repartition(2)


@pytest.mark.parametrize(("order", "chunk_bytes", "hot"), [(2, 400, 50_000), (3, 400, 20), (3, 1 << 22, 50_000), (3, 1500, 5), (4, 400, 20)])
def test_scores(spark, order, chunk_bytes, hot):
    docs = corpus()
    got = katz.score_documents(frame(spark, docs), order=order, chunk_bytes=chunk_bytes, hot=hot).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(scores(docs, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    if order == 2:  # the words are drawn one by one, so longer contexts tell nothing
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_chunks_are_gathered_in_passes(spark, monkeypatch):
    """From order 3 on, asks are made of a part of the chunks at once, and no text is lost or scored twice."""
    stored, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df, name, *by, append=False: (stored.append(name), put(self, df, name, *by, append=append))[1])
    docs = corpus()
    got = katz.score_documents(frame(spark, docs), order=4, chunk_bytes=400, hot=20).collect()
    assert [stored.count(f"asked-{k}") for k in (2, 3, 4)] == [1, 2, 3]
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(scores(docs, 4), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_longer_contexts_tell_more_where_texts_have_them(spark):
    rng = random.Random(3)
    docs = []
    for i in range(150):
        own = [rng.randrange(12), rng.randrange(12)]
        for _ in range(60):
            own.append((own[-2] * 5 + own[-1] * 7 + (rng.random() < 0.1)) % 12)
        docs.append((i, " ".join(f"w{k}" for k in own)))
    held = lambda order, c: sum(r[c] for r in katz.score_documents(frame(spark, docs), order=order).where("held_out").collect())
    assert held(3, "score") > 0.5 * held(2, "score") and held(2, "score") > held(2, "base_score")


@pytest.mark.parametrize("chunk_bytes", [400, 1500, 1 << 22])
def test_stored_counts_give_probabilities_that_add_up_to_one(spark, chunk_bytes):
    docs = corpus()
    store = Store(spark, "test-katz")
    katz.score_documents(frame(spark, docs), order=3, chunk_bytes=chunk_bytes, hot=20, store=store).collect()
    tables = [t.collect() for t in katz.count_tables(store, 3)]
    n = spark.read.parquet(f"{store.base}/chunks").where("kind = 0").count()
    buckets = [max(1, n // 6), max(1, n // 2)]
    words, grams = {}, [None, Counter(), Counter(), Counter()]
    for r in tables[0]:
        for k, (w, c) in enumerate(zip(katz.loosen(r.a).split(b"\n"), katz.unpack(r.b).tolist(), strict=True)):
            words[k * buckets[0] + r.bucket] = w.decode() or None
            if c:
                grams[1][(w.decode() or None,)] = c
    names = {None: {k: (w,) for k, w in words.items()}}
    for order in (2, 3):
        made = {}
        for r in tables[order - 1]:
            own = r.chunk if r.bucket < 0 else None
            contexts, last = np.cumsum(katz.unpack(r.a)).tolist(), katz.unpack(r.b).tolist()
            for k, (v, w, c) in enumerate(zip(contexts, last, katz.unpack(r.c).tolist(), strict=True)):
                gram = (*(names[own][v] if v < 0 else names[None][v]), words[w])
                grams[order][gram] += c
                made.setdefault(own, {})[-1 - k if r.bucket < 0 else k * buckets[1] + r.bucket] = gram
        names = made
    want, _, _ = brute(docs, 3)
    assert grams[1:] == want[1:]
    p = model(grams)
    vocabulary = [*(w for (w,) in grams[1]), "never seen"]
    for h in [(), ("w1",), (None,), ("never",), ("w1", "w1"), ("x", "x"), (None, "w2"), ("never", "w1"), *list(grams[2])[:20]]:
        if h[-1:] != (None,) or len(h) == 1:
            assert sum(p(w, h) for w in vocabulary) == pytest.approx(1)


def test_empty(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packed_numbers():
    for x in ([], [0], [255, 256], [-1, 5], [1 << 40, 3]):
        assert katz.unpack(katz.pack(np.asarray(x, np.int64))).tolist() == x


def test_ordered_keys_of_any_size():
    rng = np.random.default_rng(1)
    small = [rng.integers(0, 5, 200) for _ in range(3)]
    for keys in (small, [small[0] << 40, small[1] << 50, small[2]]):
        first, back = katz.ordered(*keys)
        rows = list(zip(*(k.tolist() for k in keys), strict=True))
        assert [rows[i] for i in first] == sorted(set(rows)) and [rows[first[k]] for k in back] == rows
    assert [len(x) for x in katz.ordered(np.zeros(0, int), np.zeros(0, int))] == [0, 0]
    assert katz.ranks(np.asarray([30, -1, 7])).tolist() == [2, 0, 1]


def test_texts_are_split_many_at_once():
    texts = ["  The\tthe \n", "", None, " \x0b\x0c\r", "É\xa0é\x1cA\x85b  İ", "x\x00y Z", "end"]
    got = katz.tokens(pa.array(texts)).to_pylist()
    assert got == [[w or "" for w in toks(t)] for t in texts]


def test_words_of_a_partition_are_counted_where_they_lie():
    lists = [[b"", b"a", "é".encode()], [b""], [b"", b"b", b"a"]]
    counts = [[3, 0, 1], [2], [1, 0, 7]]
    rows = [(10 + katz.ASK, c, 4, katz.squeeze(b"\n".join(w)), katz.pack(np.asarray(n)), None, None) for c, w, n in zip((9, 2, 5), lists, counts, strict=True)]
    made = [katz._answer_words(6)(katz._rows(x)).to_pylist() for x in (rows, rows[::-1])]
    assert made[0] == made[1]  # numbers do not depend on the order in which messages come
    *answers, counted = made[0]
    words, total = katz.loosen(counted["a"]).split(b"\n"), katz.unpack(counted["b"]).tolist()
    assert dict(zip(words, total, strict=True)) == {b"": 6, b"a": 7, b"b": 0, "é".encode(): 1}
    for x in answers:
        own = lists[{9: 0, 2: 1, 5: 2}[x["chunk"]]]
        assert [words[k // 6] for k in katz.unpack(x["c"]).tolist()] == own
        assert katz.unpack(x["a"]).tolist() == [total[words.index(w)] * 4 + 2 * (w in (b"b", "é".encode())) for w in own]


def test_sums_are_made_only_for_contexts_that_need_them(monkeypatch):
    rng = np.random.default_rng(2)
    at, total, lower = rng.integers(0, 40, 500), rng.integers(0, 9, 500), rng.integers(1, 30, 500)
    every, some, sizes, plain = katz.context_sums(at, total, lower, 40), np.asarray([7, 3, 39]), [], katz.context_sums
    monkeypatch.setattr(katz, "context_sums", lambda *x: (sizes.append((len(x[0]), x[3])), plain(*x))[1])
    assert (katz.sums_of(some, at, total, lower, 40) == every[some]).all()
    assert sizes == [(int(np.isin(at, some).sum()), 3)]
    assert katz.sums_of(some[:0], at, total, lower, 40).shape == (0, 2 * katz.K + 2)
