"""Vector search, per-document results, budgets, reranking, hybrid assembly."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..functions.text import display_name


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, where: Column | None = None) -> DataFrame:
    """The k rows nearest to a query vector by cosine, nearest first, then by id.

    One pass over the filtered vectors; each task keeps k rows, so the driver
    merges k rows a task whatever the number of vectors.
    """
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("similarity", V.cosine(F.col(vector_col), V.literal(query))).orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_documents(vectors: DataFrame, query: list[float], k: int, id_col: str, doc_col: str, vector_col: str, threshold: float = 0.0, overfetch: int = 6) -> DataFrame:
    """The best row of each document among the k * overfetch nearest rows, then the first k of at least ``threshold`` (0: any)."""
    found = nearest(vectors, query, k * overfetch, id_col, vector_col)
    order = W.partitionBy(doc_col).orderBy(F.desc("similarity"), id_col)
    best = found.where(F.col(doc_col).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    best = best.where(F.col("similarity") >= threshold) if threshold else best
    return best.orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_for_all(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, block: int = 2048) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of every query row, itself left out.

    Both sides are dealt into blocks; each pair of blocks multiplies two matrices
    and keeps k rows a query, so no task holds more than two blocks.  Vectors that
    are null, empty or zero, or have null or non-finite components, are near to nothing.
    Vectors have one length.
    """
    sound = lambda v: F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    queries, vectors = (df.where(sound(F.col(vector_col))) for df in (queries, vectors))
    import numpy as np
    import pyarrow as pa

    n_q = max(1, -(-queries.count() // block))
    n_v = max(1, -(-vectors.count() // block))
    side = lambda df, parts, mine: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("is_query", F.lit(mine))
    q = side(queries, n_q, True).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))).select("id", "v", "is_query", F.col("b").alias("x"), F.col("o").alias("y"))
    v = side(vectors, n_v, False).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("id", "v", "is_query", F.col("o").alias("x"), F.col("b").alias("y"))

    def top(table: pa.Table) -> pa.Table:
        flag = table.column("is_query").to_numpy()
        sides = [table.filter(pa.array(flag)), table.filter(pa.array(~flag))]
        out = {"query_id": [], "id": [], "similarity": []}
        if len(sides[0]) and len(sides[1]):
            (a, b), (x, y) = ([t.column("id").to_numpy() for t in sides], [t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in sides])
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            s = unit(x) @ unit(y).T
            for i in range(len(a)):
                row = np.where(b == a[i], -np.inf, s[i])
                at = np.lexsort((b, -row))[:k]
                at = at[np.isfinite(row[at])]
                out["query_id"] += [a[i]] * len(at)
                out["id"] += b[at].tolist()
                out["similarity"] += row[at].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "similarity": pa.array(out["similarity"], pa.float64())})

    found = q.union(v).groupBy("x", "y").applyInArrow(top, "query_id long, id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group within a budget; the first row is always in."""
    w = W.partitionBy(*group).orderBy(*order)
    run = rows.withColumn("_n", F.row_number().over(w)).withColumn("running", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")


def budget_greedy(rows: DataFrame, group: list[str], key: str, rank: str, cost: str, budget: int) -> DataFrame:
    """Rows taken in the order of ``rank`` as long as they fit, passing over those that do not.

    A fold over each group's (rank, key, cost), which is as long as one result list.
    """
    items = F.array_sort(F.collect_list(F.struct(rank, key, F.col(cost).cast("long").alias("cost"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>").alias("taken"))
    fits = lambda a, x: a["used"] + x["cost"] <= budget
    step = lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.concat(a["taken"], F.array(x[key]))).otherwise(a["taken"]).alias("taken"))
    taken = rows.groupBy(*group).agg(F.aggregate(items, zero, step)["taken"].alias("_t")).select(*group, F.explode("_t").alias(key))
    return rows.join(taken, [*group, key], "left_semi")


def rerank(rows: DataFrame, group: list[str], score: str, ordinal: str, k: int, threshold: float | None = None) -> DataFrame:
    """The k best of each group by score, in their earlier order among equals; a lone row has score 1."""
    size = F.count("*").over(W.partitionBy(*group))
    scored = rows.withColumn("_size", size).withColumn(score, F.when(F.col("_size") == 1, 1.0).otherwise(F.col(score)))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), ordinal))).where(F.col("rank") <= k).drop("_size")
    return ranked if threshold is None else ranked.where(F.col(score) >= threshold)


def graph_branch(seeds: DataFrame, edges: DataFrame, node_docs: DataFrame) -> DataFrame:
    """(document_id, is_seed): documents of seed nodes and of their neighbours in either direction."""
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("node")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("node")))
    reached = seeds.select(F.col("id").alias("node"), F.lit(1).alias("s")).union(near.join(seeds.select("id"), "id", "left_semi").select("node", F.lit(0).alias("s")))
    return reached.groupBy("node").agg(F.max("s").alias("s")).join(node_docs, "node").groupBy("document_id").agg((F.max("s") == 1).alias("is_seed"))


def unembedded(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, text) of named nodes without a vector, called as they are shown."""
    return nodes.where("entity_name <> ''").join(known.select("id"), "id", "left_anti").select("id", display_name(F.col("entity_name")).alias("text"))


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list], batch: int = 100, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """The rows with the ``vector`` of their text, null where the model gave none or failed ``tries`` times.

    ``embed`` takes up to ``batch`` texts; after a failure a task waits ``pause`` seconds, twice as
    long each time.  Texts that are blank have no vector.
    """
    names = rows.columns

    def vectors(texts: list[str]) -> list:
        for k in range(tries):
            try:
                return embed(texts)
            except Exception:  # noqa: BLE001 a model's client may raise anything
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            own = part[text].fillna("")
            asked = [i for i, t in enumerate(own) if t.strip()]
            found: list = [None] * len(part)
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                for i, v in zip(some, vectors([own.iloc[i] for i in some]), strict=True):
                    found[i] = v
            yield part.assign(vector=found)[[*names, "vector"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{ddl}, vector array<double>")
