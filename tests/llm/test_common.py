import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import _common
from quernstone.llm._common import Store, components, ranked


def test_ranked_is_a_weighted_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), k, rng.randint(1, 4)) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, w int").repartition(5)
    got = {(r.a, r.b): r.rn for r in ranked(Store(spark, "t"), df, [F.col("a"), F.col("b")], "r", F.col("w")).collect()}
    at = 1
    for a, b, w in sorted(rows):
        assert got[a, b] == at
        at += w
    assert ranked(Store(spark, "t"), df.limit(0), [F.col("a")], "r").collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(1, None), (7, 7)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    touched = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.root for r in components(Store(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in touched}
    assert components(Store(spark, "t"), spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_slices():
    texts = [None, "", "a" * 10, "é" * 4, None, "b", "c" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    for most in (1, 9, 11, 1000):
        parts = [p.column(0).to_pylist() for p in _common.slices(batch, 1, most)]
        assert [i for p in parts for i in p] == list(range(7)) and all(len(p) == 1 or sum(len((texts[i] or "").encode()) for i in p) <= most for p in parts)
    assert list(_common.slices(batch.slice(0, 0), 1)) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, how):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k != 4")
    want = left.join(right.drop("n"), "k", how)
    got = _common.join_hot(left, right, ["k"], "n", how)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert _common.join_hot(left.limit(0), right.limit(0), ["k"], "n", how).collect() == []


def test_a_cluster_must_name_its_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session)


def test_stores_are_discarded(spark, tmp_path):
    before = _common.Store.opened()
    store = _common.Store(spark, "lifetime")
    store.put(spark.range(3), "t")
    folder = store.base.removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder + "/t")
    _common.Store.discard(keep=before)
    assert not os.path.exists(folder) and _common.Store.opened() == before
