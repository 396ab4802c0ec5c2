import random
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import minhash
from quernstone.llm.shingles import shingle_hashes, word_hashes


def shingle_counts(text, width=5):
    import re

    w = re.findall("[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]|(?:[0-9a-z]|[^\x00-\x7f\u00a0\u3000-\u303f\u2000-\u206f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff])+", (text or "").lower())
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def jaccard(a, b):
    """Probability Jaccard by its definition."""
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
    keys = {*p, *q}
    return sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in keys) for i in p if i in q)


def brute(docs, threshold):
    n, c = len(docs), [shingle_counts(t) for _, t in docs]
    near = [[i != j and ((docs[i][1] or "") == (docs[j][1] or "") or bool(c[i] and c[j] and jaccard(c[i], c[j]) >= threshold)) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            todo += [j for j in range(n) if near[k][j] and j not in seen]
            seen |= {j for j in range(n) if near[k][j]}
        out.append((docs[i][0], min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)))
    return sorted(out, key=str)


def test_words_and_shingles():
    texts = ["The cat, the CAT sat.", "", "é1 Ü", "the cat the cat sat", "a" * 3_000_000 + " b", "!!"]
    h, owner = word_hashes(texts)
    assert list(h[owner == 0]) == list(h[owner == 3]) and len(h) == 14
    assert h[0] != h[1] and h[0] == h[2] and h[1] == h[3]
    s, owner, n, _ = shingle_hashes(texts, 5)
    assert list(n) == [5, 0, 2, 5, 2, 0] and list(owner) == [0, 2, 3, 4] and s[0] == s[2]


def test_estimate_is_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = np.concatenate([a[:200], a[:40], a[:40]]), np.concatenate([a[60:300], a[60:90]])
    got = minhash.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, 8192)
    want = jaccard(Counter(x.tolist()), Counter(y.tolist()))
    assert abs((got[0] == got[1]).mean() - want) < 0.03
    exact = minhash.probability_jaccard(np.unique(x, return_counts=True), np.unique(y, return_counts=True))
    assert exact == pytest.approx(want)


def test_against_all_pairs(spark):
    rng = random.Random(9)
    words = ["w%d" % k for k in range(400)]
    docs = []
    for k in range(12):
        base = rng.choices(words, k=rng.randint(30, 150))
        docs.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(docs[-1] if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new"
            docs.append(copy)
    texts = [" ".join(d) for d in docs] + [None, "", "", "!!", "!!", "?", "one two", "One, two!", "one", "a b c d e", "x y " * 200, "x y " * 201, " ".join(docs[0]).upper()]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True)) + [(None, texts[0]), (None, "null only"), (5000, texts[3]), (5000, texts[3])]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, uid int").repartition(3)
    got = minhash.near_duplicates(df, block=3).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows, 0.8)
    assert Counter(r.class_id for r in got if r.kept) == Counter({r.class_id for r in got})
    assert all(r.uid == 1 for r in got)


def test_chain_of_one_bucket_is_complete(spark):
    # far ends differ, neighbours are near: one class, although the first text is near to few
    base = ["t%d" % k for k in range(200)]
    docs = []
    for k in range(25):
        docs.append((k, " ".join(["z%d" % j for j in range(4 * k)] + base[4 * k :])))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(docs, 0.8)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scripts_without_spaces_are_words_of_one_letter():
    texts = ["日本語の、テキスト", "日 本 語 の テ キ ス ト", "one\u00a0two\u2014three", "one two three", "étude"]
    h, owner = word_hashes(texts)
    assert list(h[owner == 0]) == list(h[owner == 1]) and (owner == 0).sum() == 8
    assert list(h[owner == 2]) == list(h[owner == 3]) and (owner == 4).sum() == 1


def test_near_copies_without_spaces(spark):
    rng = random.Random(2)
    base = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    docs = [(1, base), (2, base[:150] + "異" + base[151:]), (3, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} == dict(brute(docs, 0.8))


def test_a_bucket_of_many_components_is_divided(spark):
    """All share a passage, so they meet in common buckets; only near copies are linked."""
    rng = random.Random(7)
    words = ["w%d" % k for k in range(3000)]
    common = rng.choices(words, k=60)
    docs = []
    for k in range(18):
        own = common + rng.choices(words, k=40)
        docs.append((2 * k, " ".join(own)))
        own[70] = "changed"
        docs.append((2 * k + 1, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (2, 1024):
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block=block).collect()}
        assert got == dict(brute(docs, 0.8)) and got[1] == 0 and got[3] == 2


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_planted_pairs_are_found(spark, similarity):
    """Recall by similarity: pairs whose probability Jaccard is just above the mark."""
    rng = random.Random(int(similarity * 100))
    counted = lambda words: np.unique(shingle_hashes([" ".join(words)], 5)[0], return_counts=True)
    words = ["w%d" % k for k in range(20_000)]
    docs = []
    for k in range(60):
        own = rng.choices(words, k=400)
        docs.append((2 * k, " ".join(own)))
        copy, at = list(own), list(range(5, 395, 5))
        rng.shuffle(at)
        for p in at:
            trial = [*copy[:p], "x%d" % p, *copy[p + 1 :]]
            if minhash.probability_jaccard(counted(own), counted(trial)) < similarity:
                break
            copy = trial
        docs.append((2 * k + 1, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(60))


def test_large_buckets_lose_no_link(spark):
    """All share a passage; pairs share little more, so at this threshold most bands of eight registers miss them."""
    rng = random.Random(5)
    words = ["w%d" % k for k in range(5000)]
    common = rng.choices(words, k=64)
    docs = []
    for k in range(30):
        own = rng.choices(words, k=36)
        docs.append((2 * k, " ".join(common + own)))
        docs.append((2 * k + 1, " ".join(common + own[:14] + rng.choices(words, k=22))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = dict(brute(docs, 0.55))
    assert sum(want[2 * k + 1] == 2 * k for k in range(30)) > 20 and len(set(want.values())) >= 30
    for listed in (256, 4):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(minhash, "LISTED", listed, raising=False)
            assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, threshold=0.55, block=1).collect()} == want


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(4)
    for size in (3, 40, 3000):
        for kept in (0.2, 0.7, 0.95):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)[rng.integers(0, size, size)]
            b = np.where(rng.random(size) < kept, a, rng.integers(0, 2**63, size, dtype=np.uint64))
            x, y = (np.unique(v, return_counts=True) for v in (a, b))
            exact = minhash.probability_jaccard(x, y)
            p, q = minhash.folded(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
            assert exact <= minhash.bound(p, q) + 1e-6 <= minhash._common(p[None], q)[0] + 1e-5
            assert minhash._common(p[None], q)[0] <= minhash._common(p.reshape(1, -1, 8).sum(axis=2), q.reshape(-1, 8).sum(axis=1))[0] + 1e-5
            frequent = np.sort(rng.choice(x[0], max(1, len(x[0]) // 3), replace=False))
            (i, rest_x), (j, rest_y) = (minhash.prefix(v, n / n.sum(), frequent, np.arange(len(frequent)) + 2, 0.8) for v, n in (x, y))
            shares = [dict(zip(v[at].tolist(), (n[at] / n.sum()).tolist(), strict=True)) for (v, n), at in ((x, i), (y, j))]
            met = sum(min(s, shares[1].get(k, 0)) for k, s in shares[0].items())
            assert max(rest_x, rest_y) < 0.6 + 1e-9 and exact <= met + max(rest_x, rest_y) + 1e-9
