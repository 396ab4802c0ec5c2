"""The engine's main query: a text context for a question from vectors, graph and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from . import evaluation, retrieval


def assemble(vectors: DataFrame, documents: DataFrame, edges: DataFrame, node_vectors: DataFrame, node_docs: DataFrame, query: list[float], k: int = 10, threshold: float = 0.3, seeds: int = 5, seed_threshold: float = 0.5, graph_docs: int = 3, budget: int = 6000) -> DataFrame:
    """(ordinal, document_id, origin, similarity, title, content): what answers a query, best first.

    Rows are the best chunk of each near document; then, within ``budget``
    characters, the best chunks of documents that only the graph leads to, from
    nodes near the query and their neighbours.  ``vectors`` has (id, document_id,
    embedding, content), ``node_vectors`` (id, embedding).
    """
    found = retrieval.nearest_documents(vectors, query, k, "id", "document_id", "embedding", threshold).withColumn("origin", F.lit("vector"))
    start = retrieval.nearest(node_vectors, query, seeds, "id", "embedding").where(F.col("similarity") >= seed_threshold)
    reached = retrieval.graph_branch(start.select("id"), edges, node_docs).select("document_id").join(found.select("document_id"), "document_id", "left_anti")
    near = retrieval.nearest_documents(vectors.join(reached, "document_id", "left_semi"), query, graph_docs, "id", "document_id", "embedding")
    extra = retrieval.budget_prefix(near.withColumns({"_g": F.lit(1), "_cost": F.length("content")}), ["_g"], [F.desc("similarity"), F.col("id")], "_cost", budget).withColumn("origin", F.lit("graph"))
    columns = ["id", "document_id", "origin", "similarity", "content"]
    rows = found.select(*columns).union(extra.select(*columns)).join(documents.select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    order = W.partitionBy(F.lit(1)).orderBy(F.when(F.col("origin") == "vector", 0).otherwise(1), F.desc("similarity"), "id")  # k + graph_docs rows at most
    return rows.withColumn("ordinal", F.row_number().over(order)).select("ordinal", "document_id", "origin", "similarity", F.coalesce("title", F.lit("untitled")).alias("title"), "content")


def rendered(rows: DataFrame) -> DataFrame:
    """One row: the context as Markdown, and its sources by similarity."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("content"))
    body = F.array_sort(F.collect_list(F.struct("ordinal", part.alias("p"))))
    sources = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "document_id")))
    return rows.agg(F.array_join(F.transform(body, lambda x: x["p"]), "\n\n---\n\n").alias("context"), F.transform(sources, lambda x: x["document_id"]).alias("sources"))


def reranked(rows: DataFrame, scores: DataFrame | None, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """The chunks (id, rank, ...) with ``rerank_score``, best first, the first k that reach the threshold.

    ``scores`` has (id, score); a chunk without one has 0.  Without scores, the
    reranker having failed, chunks keep their order with scores just below 1; one
    chunk alone has 1.
    """
    size = F.count("*").over(W.partitionBy(F.lit(1)))  # the chunks of one query, a few
    fallback = 1.0 - F.col("rank") * 0.001
    scored = rows.withColumn("rerank_score", fallback) if scores is None else rows.join(scores.select("id", F.col("score").alias("rerank_score")), "id", "left")
    scored = scored.withColumn("rerank_score", F.when(size == 1, 1.0).otherwise(F.coalesce("rerank_score", F.lit(0.0))))
    return scored.orderBy(F.desc("rerank_score"), "rank").limit(k).where(F.col("rerank_score") >= threshold)


def with_parents(rows: DataFrame, documents: DataFrame, most: int = 32_000, budget: int = 96_000) -> DataFrame:
    """The chunks (document_id, rank, content, ...) with their whole documents for content, as far as these fit.

    In the order of rank, the first chunk of each document gives way to its
    document if that has at most ``most`` characters and what is left of the budget is enough; a
    document that does not fit is passed over, and later chunks of one that does go.
    """
    whole = documents.select(F.col("id").alias("document_id"), F.col("content").alias("_whole"))
    first = rows.groupBy("document_id").agg(F.min("rank").alias("rank")).join(whole, "document_id").where((F.length("_whole") <= most) & (F.trim("_whole") != ""))
    sized = first.select(F.lit(1).alias("_g"), "document_id", "rank", F.length("_whole").alias("_cost"))
    taken = retrieval.budget_greedy(sized, ["_g"], "document_id", "rank", "_cost", budget).select("document_id", F.lit(True).alias("_taken"), F.col("rank").alias("_first"))
    both = rows.join(taken, "document_id", "left").join(whole, "document_id", "left").where(F.col("_taken").isNull() | (F.col("rank") == F.col("_first")))
    return both.withColumns({"content": F.when(F.col("_taken"), F.col("_whole")).otherwise(F.col("content")), "is_document": F.coalesce("_taken", F.lit(False))}).drop("_taken", "_first", "_whole")


def hyde(query: Column, hypothetical: Column) -> Column:
    """The mean of a query's vector and that of a text that might answer it; the query's own where there is none."""
    return F.when(hypothetical.isNull() | (F.size(hypothetical) != F.size(query)), query).otherwise(V.mean(query, hypothetical))


def chunk_lines(rows: DataFrame) -> DataFrame:
    """One row: chunks by rank as Markdown, each below its document's title and place."""
    place = F.when(F.coalesce("section_path", F.lit("")) != "", F.concat(F.lit(" — "), "section_path")).otherwise("")
    part = F.concat(F.lit("### "), F.coalesce("title", F.lit("untitled")), place, F.lit("\n"), "content")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def evaluated(gold: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """query_id with the measures at k of every gold item (query_id, relevant, groups), from retrieved (query_id, document_id, rank).

    Documents of a group count as one; an item for which nothing was retrieved has measures of 0.
    """
    lists = retrieved.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("_r"))
    rows = gold.join(lists, "query_id", "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<bigint>")))
    several = F.size("groups") > 0
    rows = rows.withColumns({"retrieved": F.when(several, evaluation.reduced(F.col("_r"), F.col("groups"))).otherwise(F.array_distinct("_r")), "expected": F.when(several, evaluation.representatives(F.col("_r"), F.col("groups"))).otherwise(F.col("relevant"))})
    return evaluation.measures(rows, "retrieved", "expected", k).drop("_r", "relevant", "groups", "retrieved", "expected")
