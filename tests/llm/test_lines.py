import random

from quernstone.llm import lines


def brute(docs, min_words):
    """Deletes every line of a run of min_words words that also starts earlier, trying all runs."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    split = {i: [] if docs[i][1] is None else docs[i][1].split("\n") for i in order}
    seen, gone = set(), {i: set() for i in order}
    for i in order:
        own = split[i]
        for s in range(len(own)):
            words = 0
            for e in range(s, len(own)):
                words += len([w for w in own[e].split(" ") if w])
                run = "\n".join(own[s : e + 1])
                if words >= min_words:
                    if run in seen:
                        gone[i] |= set(range(s, e + 1))
                    seen.add(run)
    return sorted(((docs[i][0], None if docs[i][1] is None else "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]), len(split[i]), len(gone[i])) for i in order), key=str)


def check(spark, docs, min_words):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, uid string, n_lines int").repartition(3)
    got = lines.dedup_lines(df, min_words=min_words).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in got), key=str) == brute(docs, min_words)
    assert all(r.uid == "x" for r in got)


def test_random_documents(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b c", "d e f", "", "  g ", "h"]
    docs = [(k, "\n".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for k in range(40)]
    docs += [(k + 40, rng.choice(docs)[1] + "\nzz%d\n" % k + rng.choice(docs)[1]) for k in range(15)]
    check(spark, docs, 6)


def test_edges(spark):
    run = "\n".join("w%d x y" % k for k in range(40))
    docs = [(5, run), (2, None), (3, ""), (4, ""), (1, "p\n" + run + "\nq"), (6, run + "\n" + run), (7, run), (7, run), (None, run), (8, "same words here now " * 3), (9, "same words here now " * 3), (10, "a\n" * 30), (11, "\n".join(["t"] * 30))]
    check(spark, docs, 12)


def test_short_runs_stay(spark):
    check(spark, [(1, "a b c\nd"), (2, "a b c\ne"), (3, "d\ne")], 5)


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_native(spark):
    df = lines.dedup_lines(spark.createDataFrame([(1, "a b\nc"), (2, "a b\nc")], "doc_id long, text string"), min_words=2)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
