import math

import numpy as np
import pytest

from quernstone.llm import embedding


def brute(rows, threshold):
    """{row number: (n_links, component_id)} by comparing all pairs."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= threshold
    links = {i: [j for j in range(n) if j != i and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]) and near(rows[i][1], rows[j][1])] for i in range(n)}
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cell_rows", "block"), [(4096, 4096), (12, 7), (40, 1000)])
def test_against_all_pairs(spark, cell_rows, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    near = base[rng.integers(0, 12, 60)] + rng.normal(scale=0.12, size=(60, 8))
    chain = [[math.cos(0.3 * k), math.sin(0.3 * k)] + [0.0] * 6 for k in range(12)]
    vectors = [list(map(float, v)) for v in (*base, *near, *chain)]
    vectors += [vectors[0]] * 9 + [[x * 3 for x in vectors[1]]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, vectors[3][:4]), (907, vectors[3][:4]), (None, vectors[3]), (908, [1e-200] * 8), (909, [1e200] * 8), (3, vectors[5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cid int")
    got = embedding.near_vectors(df, threshold=0.95, cell_rows=cell_rows, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute([(i, [x / 1e200 for x in v] if i == 909 else [x * 1e200 for x in v] if i == 908 else v) for i, v in rows], 0.95)
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
