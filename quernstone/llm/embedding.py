"""Exact metric range join of vectors: all pairs whose cosine reaches a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store, components

SAMPLE = 4096
MOST_PIVOTS = 1024
BLOCK = 4096
#: Slack of distances, far above rounding of doubles and far below the threshold.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` vectors of the sample, each the farthest from those before it."""
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        nearest = np.minimum(nearest, 2 - 2 * sample @ sample[chosen[-1]])
        at = int(nearest.argmax())
        if nearest[at] <= SLACK:
            break
        chosen.append(at)
    return sample[chosen]


def cells(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit vector, which later cells it visits).

    If x lies in cell i, y in cell j and d(x, y) <= eps, then x is within eps of
    the boundary between the cells, so (d(x,pj)^2 - d(x,pi)^2) / 2d(pi,pj) <= eps.
    Of two cells only the vectors of the first visit the second, so a pair meets once.
    """
    far = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = far.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, SLACK**2))[home]
    visits = (far - far[np.arange(len(x)), home][:, None]) / (2 * between) <= eps
    return home, visits & (np.arange(len(pivots))[None, :] > home[:, None])


def _labels(pairs: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each linked row of a block reaches by links within the block."""
    (i, j), (a, b) = pairs, (ids[0].copy(), ids[1].copy())
    while True:
        low = np.minimum(a[i], b[j])
        if (low == a[i]).all() and (low == b[j]).all():
            return a, b
        np.minimum.at(a, i, low)
        np.minimum.at(b, j, low)


def linked_classes(classes: DataFrame, store: Store, threshold: float, cell_rows: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """(cid, links, label) partial results for distinct vectors ``cid, dim, vector, copies``.

    ``links`` counts copies of the vectors linked with cid and ``label`` is a vector
    that it reaches; sum the one and unite by the other.  Cells hold any number of
    vectors: they are joined in blocks of about ``block`` homes by ``block`` probes.
    """
    spark, eps = classes.sparkSession, float(np.sqrt(2 - 2 * threshold)) + SLACK
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = classes.select("dim", "vector", F.xxhash64("cid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    pivots = {}
    for dim, n in dims.items():
        own = [r["vector"] for r in sample if r["dim"] == dim]
        if own:
            pivots[dim] = spread_pivots(_units(np.asarray(own, np.float64)), min(MOST_PIVOTS, -(-n // cell_rows)))
    send = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors of those sampled

    def assigned(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        dim = batch.column("dim").to_numpy()
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            p = send.value.get(int(d))
            x = _matrix(batch.column("vector").take(pa.array(rows)), int(d))
            yield int(d), rows, *((np.zeros(len(rows), int), np.zeros((len(rows), 1), bool)) if p is None else cells(_units(x), p, eps))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for d, _, home, visits in assigned(batch):
                for c in range(visits.shape[1]):
                    own = seen.setdefault((d, c), [0, 0])
                    own[0] += int((home == c).sum())
                    own[1] += int(visits[:, c].sum())
        if seen:
            yield pa.RecordBatch.from_pylist([{"dim": d, "cell": c, "homes": h, "visits": v} for (d, c), (h, v) in seen.items()], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("homes", pa.int64()), ("visits", pa.int64())]))

    totals = classes.mapInArrow(count, "dim int, cell int, homes long, visits long").groupBy("dim", "cell").agg(F.sum("homes").alias("h"), F.sum("visits").alias("v")).collect()
    blocks = spark.sparkContext.broadcast({(r["dim"], r["cell"]): (max(1, -(-r["h"] // block)), max(1, -(-(r["h"] + r["v"]) // block))) for r in totals})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            for d, rows, home, visits in assigned(batch):
                mix = (cid[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for c in range(visits.shape[1]):
                    nh, np_ = blocks.value[d, c]
                    own, guest = np.flatnonzero(home == c), np.flatnonzero(visits[:, c] | (home == c))
                    parts = [(own, (mix[own] % np.uint64(nh)).astype(np.int32), np.full(len(own), k, np.int32), True) for k in range(np_)]
                    parts += [(guest, np.full(len(guest), k, np.int32), (mix[guest] % np.uint64(np_)).astype(np.int32), False) for k in range(nh)]
                    for take, hb, pb, is_home in parts:
                        if len(take):
                            picked = batch.take(pa.array(rows[take]))
                            yield pa.RecordBatch.from_arrays([*(picked.column(k) for k in ("cid", "dim", "vector", "copies")), pa.array(np.full(len(take), c, np.int32)), pa.array(hb), pa.array(pb), pa.array(np.full(len(take), is_home)), pa.array(home[take] == c)], ["cid", "dim", "vector", "copies", "cell", "hb", "pb", "is_home", "same"])

    vector = classes.schema["vector"].dataType.simpleString()
    dealt = classes.select("cid", "dim", "vector", "copies").mapInArrow(deal, f"cid long, dim int, vector {vector}, copies long, cell int, hb int, pb int, is_home boolean, same boolean")

    def join(table: pa.Table) -> pa.Table:
        dim, flag = table.column("dim")[0].as_py(), table.column("is_home").to_numpy()
        sides = [table.filter(pa.array(flag)), table.filter(pa.array(~flag))]
        out = {"cid": [], "links": [], "label": []}
        if len(sides[0]) and len(sides[1]):
            x, y = (_units(_matrix(t.column("vector"), dim)) for t in sides)
            (a, b), (m, n) = ([t.column(c).to_numpy() for t in sides] for c in ("cid", "copies"))
            inside = sides[1].column("same").to_numpy()
            x32, y32, found = x.astype(np.float32), y.astype(np.float32), []
            for at in range(0, len(x), 1024):
                i, j = np.nonzero(x32[at : at + 1024] @ y32.T >= threshold - 1e-4)
                i += at
                i, j = (k[(b[j] < a[i]) | ~inside[j]] for k in (i, j))
                for s in range(0, len(i), 1 << 18):
                    u, v = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
                    ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
                    found.append((u[ok], v[ok]))
            i, j = (np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            if len(i):
                la, lb = _labels((i, j), (a, b))
                for ids, at, others, label in ((a, i, n[j], la), (b, j, m[i], lb)):
                    links = np.bincount(at, weights=others, minlength=len(ids)).astype(np.int64)
                    some = links > 0
                    out["cid"].append(ids[some])
                    out["links"].append(links[some])
                    out["label"].append(label[some])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return store.put(dealt.groupBy("dim", "cell", "hb", "pb").applyInArrow(join, "cid long, links long, label long"), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, cell_rows: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """One row a vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked if their cosine, in double precision, is at least
    ``threshold``; vectors of different lengths are not.  Null, empty and zero
    vectors and such with null or non-finite components link with nothing and
    keep their own id.  Equal vectors are joined once and counted as often as they
    are there; repeated rows with one id count as different vectors.  Null ids
    never name a component unless it has no other.  Other columns are ignored.
    """
    store = Store(vectors.sparkSession, "near-vectors")
    v = F.col("vector")
    sound = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = store.put(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("vector")).select(F.monotonically_increasing_id().alias("uid"), "_id", F.when(sound, v).alias("vector")), "rows")
    classes = store.put(rows.where("vector is not null").groupBy("vector").agg(F.min("uid").alias("cid"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "classes")
    partial = linked_classes(classes, store, threshold, cell_rows, block)
    roots = components(store, partial.select("cid", "label"), "cid", "label")
    links = partial.groupBy("cid").agg(F.sum("links").alias("links"))
    classed = classes.join(links, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    found = store.put(rows.join(classed, "vector", "left").select("_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "uid").alias("root")), "found")
    least = found.groupBy("root").agg(F.min("_id").alias("component_id"))
    return found.join(least, "root").select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
