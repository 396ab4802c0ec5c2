"""Queries of synchronisation, indexing and the assembly of contexts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import assembly, indexing, sync
from ..streaming.periodic import Periodic, run_all
from .base import cases, rows

_T = datetime.datetime
_PAGE = "id int, parent_id int, space string, last_modified timestamp, content_hash string, listed boolean, old string, retry boolean"
_PAGES = [
    (1, 0, "A", _T(2024, 5, 1), "h1", True, "h1", False), (2, 1, "A", _T(2024, 5, 9), "new", True, "h2", False), (3, 1, "A", _T(2024, 5, 1), "h3", False, None, False), (4, 2, "A", _T(2024, 5, 1), "h4", True, "h4", True),
    (5, 9, "B", _T(2024, 5, 9), "h5", True, "h5", False), (6, 2, "A", _T(2024, 5, 9), None, True, "h6", False), (7, 1, "A", _T(2024, 5, 1), "h7", True, "h7", False),
]


def _synced(scope, watermark="2024-05-08 00:00", complete=True, **more):
    def run(df):
        stored = df.where("old is not null").select("id", F.col("old").alias("content_hash"))
        return sync.synced(scope, df, df.where("listed").select("id"), stored, df.where("retry").select("id"), watermark, complete=complete, **more)

    return run


_SPACE = [(1, "skipped"), (2, "updated"), (3, "created"), (4, "unchanged"), (6, "errors"), (7, "skipped")]
rows("str02_synced_space", _PAGE, _PAGES, "id, class", [*_SPACE, (5, "removed")], _synced("space", space="A"))
rows("str02_incomplete_listing", _PAGE, _PAGES, "id, class", _SPACE, _synced("space", complete=False, space="A"))
rows("str04_unknown_watermark", _PAGE, _PAGES, "id, class", [(1, "unchanged"), (2, "updated"), (3, "created"), (4, "unchanged"), (6, "errors"), (7, "unchanged"), (5, "removed")], _synced("space", watermark="garbage", space="A"))
rows("str03_synced_subtree", _PAGE, _PAGES, "id, class", [(2, "updated"), (4, "unchanged"), (6, "errors"), (1, "removed"), (5, "removed"), (7, "removed")], _synced("subtree", root=2))
rows("str17_synced_page", _PAGE, _PAGES, "id, class", [(2, "updated"), (1, "removed"), (4, "removed"), (5, "removed"), (6, "removed"), (7, "removed")], _synced("page", root=2))
rows("str01_dispatched_scopes", _PAGE, _PAGES, "scope, n", [("page", 1), ("subtree", 3), ("space", 6)], lambda df: sync.scope_pages("page", df, root=2).select(F.lit("page").alias("scope")).union(sync.scope_pages("subtree", df, root=2).select(F.lit("subtree"))).union(sync.scope_pages("space", df, space="A").select(F.lit("space"))).groupBy("scope").agg(F.count("*").alias("n")))
rows("src16_modified_subtree", _PAGE, _PAGES, "id", [(1,), (2,), (6,)], lambda df: sync.scope_pages("subtree", df, root=1, modified_since="2024-05-05"))
rows("src17_walked_subtree", _PAGE, _PAGES, "id, parent_id, depth", [(2, 1, 1), (3, 1, 1), (7, 1, 1), (4, 2, 2), (6, 2, 2)], lambda df: sync.subtree(df, 1))
rows("src18_child_pages", _PAGE, _PAGES, "id", [(2,), (3,), (7,)], lambda df: df.where("parent_id = 1"))
cases("str04_complete_listings", "x int, y int, z int", [(10, 100, None), (10, 100, 10), (9, 100, 10), (100, 100, None), (11, 100, 10)], "complete", [True, True, False, False, True], lambda x, y, z: dict(complete=sync.listing_complete(x, y, z)))
rows("str05_isolated_errors", "id int, error string, created boolean, changed boolean", [(1, None, True, True), (2, "boom", None, None), (3, None, False, False)], "id, class", [(1, "created"), (2, "errors"), (3, "unchanged")], lambda df: df.select("id", sync.import_class(F.col("created"), F.col("changed"), F.col("error")).alias("class")))
cases("str06_import_classes", "x boolean, y boolean, z string", [(True, True, None), (False, True, None), (False, False, None), (True, True, "e")], "class", ["created", "updated", "unchanged", "errors"], lambda x, y, z: {"class": sync.import_class(x, y, z)})
rows("str07_processing_queue", "id int, bucket string", [(1, "created"), (2, "updated"), (1, "failed"), (3, "failed"), (3, "degraded"), (4, "degraded")], "id, bucket", [(1, "created"), (2, "updated"), (3, "failed"), (4, "degraded")], lambda df: sync.processing_queue([(b, df.where(F.col("bucket") == b)) for b in ("created", "updated", "failed", "degraded")], "id"))
rows("set05_processing_queue", "id int, bucket string", [(5, "failed"), (5, "updated"), (6, "failed")], "id, bucket", [(5, "updated"), (6, "failed")], lambda df: sync.processing_queue([(b, df.where(F.col("bucket") == b)) for b in ("created", "updated", "failed")], "id"))
rows("str04_carried_retries", "page_id string, error string, kind string", [("a", "e1", "error"), ("b", None, "retry"), ("c", None, "retry"), ("c", None, "attempted"), ("", "x", "error")], "page_id, error", [("a", "e1"), ("b", "carried over (이번 열거에 미포함)")], lambda df: sync.next_retries(df.where("kind = 'error'"), df.where("kind = 'retry'"), df.where("kind = 'attempted'"), False))
rows("agg35_sync_totals", "target int, id int, class string", [(1, 1, "created"), (1, 2, "skipped"), (1, 3, "removed"), (1, 4, "errors")], "target, total", [(1, 3)], lambda df: sync.results(df, ["target"]))
rows("agg36_sync_results", "target int, id int, class string", [(1, 2, "created"), (1, 1, "created"), (1, 3, "removed"), (2, 4, "updated")], "target, created, updated, removed", [(1, [1, 2], [], [3]), (2, [], [4], [])], lambda df: sync.results(df, ["target"]))
_FILE = "repo string, path string, old string, new string, status string"
_FILES = [("r", "a", "1", "1", "completed"), ("r", "b", "1", "2", "completed"), ("r", "c", None, "1", None), ("r", "d", "1", None, "completed"), ("r", "e", "1", "1", "failed")]


def _repository(df):
    side = lambda c: df.where(F.col(c).isNotNull()).select("repo", "path", F.col(c).alias("content_hash"))
    return sync.repository(side("old"), side("new"))


rows("str10_synced_repository", _FILE, _FILES, "path, change_type", [("a", "unchanged"), ("b", "changed"), ("c", "created"), ("d", "removed"), ("e", "unchanged")], _repository)
rows("str12_files_to_index", _FILE, _FILES, "path", [("b",), ("c",), ("e",)], lambda df: sync.to_index(_repository(df), df.where("status is not null").select("repo", "path", "status")))
_STATE = "id long, status string, storage_method string, llm_degraded boolean"
_STATES = [(1, "changed", "chunk", True), (2, "completed", "graph", False), (3, "pending", None, False)]
rows("str14_started_reprocessing", _STATE, _STATES, "id, status", [(1, "processing"), (2, "completed"), (3, "processing")], lambda df: sync.started(df, df.where("status <> 'completed'")))
rows("str15_finished_reprocessing", _STATE, _STATES, "id, status, storage_method, llm_degraded", [(1, "completed", "hybrid", False), (2, "completed", "graph", False), (3, "failed", None, False)], lambda df: sync.finished(df, df.sparkSession.createDataFrame([(1, "hybrid", None, None), (3, "chunk", "boom", True)], "id long, method string, error string, degraded boolean")))
rows("str16_deleted_derived_data", "document_id long, chunk int", [(1, 0), (1, 1), (2, 0)], "document_id, chunk", [(2, 0)], lambda df: df.join(df.sparkSession.createDataFrame([(1,)], "document_id long"), "document_id", "left_anti"))
rows("str18_chat_events", "pos int, kind string, text string", [(0, "delta", "Hel"), (1, "delta", "lo"), (2, "sources", "[1]"), (3, "done", None)], "pos, line", [(0, '{"type":"delta","text":"Hel"}'), (1, '{"type":"delta","text":"lo"}'), (2, '{"type":"sources","text":"[1]"}'), (3, '{"type":"done"}')], lambda df: df.select("pos", F.to_json(F.struct(F.col("kind").alias("type"), "text")).alias("line")))


def _ran(df):
    def run(target):
        if target == 2:
            raise ValueError("no server")
        return target * 10

    return df.sparkSession.createDataFrame(run_all([r.id for r in df.collect()], run), "id int, result int, error string")


for _name in ("str08_all_targets", "str11_all_repositories"):
    rows(_name, "id int", [(1,), (2,), (3,)], "id, result, error", [(1, 10, None), (2, None, "ValueError: no server"), (3, 30, None)], _ran)


def _cycles(df):
    import time

    seen: list[int] = []

    def cycle():
        seen.append(len(seen))
        if len(seen) == 1:
            raise ValueError("first")

    periodic = Periodic(cycle, 0.01)
    periodic.start()
    for _ in range(500):
        if periodic.runs >= 3:
            break
        time.sleep(0.01)
    periodic.stop()
    after = periodic.runs
    time.sleep(0.05)
    return df.select(F.lit(periodic.runs >= 3).alias("ran"), F.lit(periodic.runs == after).alias("stopped"), F.array(*map(F.lit, periodic.errors)).alias("errors"))


for _name in ("str09_periodic_cycles", "str22_cycle_after_failure"):
    rows(_name, "id int", [(1,)], "ran, stopped, errors", [(True, True, ["ValueError: first"])], _cycles)

def _locked(df):
    """A run that is asked for while one is running is refused, and one after it is not."""
    import threading

    begun, go = threading.Event(), threading.Event()

    def cycle():
        begun.set()
        go.wait(10)

    periodic = Periodic(cycle, 60.0)
    first = threading.Thread(target=periodic.once)
    first.start()
    begun.wait(10)
    refused = not periodic.once()
    go.set()
    first.join()
    return df.select(F.lit(refused).alias("refused"), F.lit(periodic.once()).alias("after"), F.lit(periodic.runs).alias("runs"))


for _name in ("str19_one_run_at_a_time", "str20_runs_counted", "udf35_locked_target"):
    rows(_name, "id int", [(1,)], "refused, after, runs", [(True, True, 2)], _locked)


def _reconfigured(df):
    import time

    periodic = Periodic(lambda: None, 60.0, delay=60.0)
    periodic.start()
    periodic.delay = 0.0
    periodic.reconfigure(0.01)
    for _ in range(500):
        if periodic.runs >= 2:
            break
        time.sleep(0.01)
    periodic.reconfigure(0)
    runs = periodic.runs
    time.sleep(0.05)
    return df.select(F.lit(runs >= 2).alias("faster"), F.lit(periodic.runs == runs).alias("off"))


rows("str21_reconfigured_cycles", "id int", [(1,)], "faster, off", [(True, True)], _reconfigured)

# ---------------------------------------------------------------- indexing

_DOCUMENT = "id long, source_type string, title string, original_content string, raw_content string"
_DOCUMENTS = [
    (1, "confluence_mcp", "Page", "ignored", '<h1>Top</h1><p>call GET /v1/x</p><ac:link><ri:page ri:content-title="Home"/></ac:link>'),
    (2, "git_code", "a.py", "import os\ndef f(): pass\n", None), (3, "upload", "Notes", "# A\ntext", None), (4, "upload", "Blank", " ", None),
]
rows("exp36_indexed_chunks", _DOCUMENT, _DOCUMENTS, "document_id, chunk_index, section_path, meta_text", [(1, 0, "Top", "Page\nTop"), (2, 0, "a.py > f", "a.py\nf\ndef f()"), (3, 0, "A", "Notes\nA")], indexing.chunks)
rows("exp36_indexed_views", _DOCUMENT, _DOCUMENTS[1:3], "document_id, view, text", [(2, "body", "# File: a.py\n# function: def f()\n\ndef f(): pass\n"), (2, "meta", "a.py\nf\ndef f()"), (3, "body", "# Atext"), (3, "meta", "Notes\nA"), (3, "question", "Why A?")], lambda df: indexing.views(indexing.chunks(df), indexing.chunks(df).where("document_id = 3").select("chunk_id", F.array(F.lit("Why A?")).alias("questions"))))
rows("exp36_indexed_vectors", _DOCUMENT, _DOCUMENTS[2:3], "document_id, view, length", [(3, "body", 7.0), (3, "meta", 7.0)], lambda df: indexing.vectors(indexing.views(indexing.chunks(df)), lambda texts: [[float(len(t))] for t in texts]).withColumn("length", F.get("vector", F.lit(0))))
rows("exp36_indexed_relations", _DOCUMENT, _DOCUMENTS, "document_id, source, target, relation_type", [(1, "Page", "Home", "references"), (1, "Page", "GET /v1/x", "documents"), (2, "a.py", "os", "imports")], indexing.relations)
rows("str24_outcomes", _DOCUMENT, _DOCUMENTS, "id, method", [(1, "hybrid"), (2, "hybrid"), (3, "chunk"), (4, "chunk")], lambda df: indexing.outcomes(df, indexing.chunks(df), indexing.relations(df)))

# ---------------------------------------------------------------- contexts

_CHUNK = "id string, document_id long, rank int, content string, similarity double, title string, section_path string"
_CHUNKS = [("a", 1, 0, "alpha", 0.9, "One", "S"), ("b", 2, 1, "beta", 0.8, "Two", ""), ("c", 1, 2, "gamma", 0.7, "One", "T"), ("d", 3, 3, "delta", 0.6, None, None)]


def _scores(df, *pairs):
    return df.sparkSession.createDataFrame(pairs, "id string, score double")


def _wholes(df):
    return df.sparkSession.createDataFrame([(1, "x" * 30), (2, "y" * 50), (3, "z" * 20)], "id long, content string")


rows("udf03_reranked_chunks", _CHUNK, _CHUNKS, "id, rerank_score", [("c", 0.9), ("a", 0.5)], lambda df: assembly.reranked(df, _scores(df, ("a", 0.5), ("b", 0.1), ("c", 0.9)), 3, 0.3))
rows("top03_failed_reranker", _CHUNK, _CHUNKS, "id, rerank_score", [("a", 1.0), ("b", 0.999)], lambda df: assembly.reranked(df, None, 2))
rows("top03_single_chunk", _CHUNK, _CHUNKS[:1], "id, rerank_score", [("a", 1.0)], lambda df: assembly.reranked(df, _scores(df, ("a", 0.01))))
rows("win04_parent_documents", _CHUNK, _CHUNKS, "id, length, is_document", [("a", 30, True), ("b", 4, False), ("d", 20, True)], lambda df: assembly.with_parents(df, _wholes(df), 40, 60).withColumn("length", F.length("content")))
rows("win04_parents_within_budget", _CHUNK, _CHUNKS, "id, length, is_document", [("a", 30, True), ("b", 4, False), ("d", 20, True)], lambda df: assembly.with_parents(df, _wholes(df), 100, 55).withColumn("length", F.length("content")))
rows("udf02_context_with_sources", _CHUNK, _CHUNKS[:2], "context, sources", [("## One\n\nalpha\n\n---\n\n## Two\n\nbeta", [1, 2])], lambda df: assembly.rendered(df.withColumn("ordinal", F.col("rank"))))
rows("udf05_chunk_texts", _CHUNK, _CHUNKS, "text", [("### One — S\nalpha\n\n### Two\nbeta\n\n### One — T\ngamma\n\n### untitled\ndelta",)], assembly.chunk_lines)
rows("udf06_graph_chunk_texts", _CHUNK, _CHUNKS[3:], "text", [("### untitled\ndelta",)], assembly.chunk_lines)
cases("udf14_expanded_queries", "x array<double>, y array<double>", [([1.0, 3.0], [3.0, 1.0]), ([1.0, 3.0], None), ([1.0], [2.0, 2.0])], "vector", [[2.0, 2.0], [1.0, 3.0], [1.0]], lambda x, y, z: dict(vector=assembly.hyde(x, y)))
rows("udf04_embedded_queries", "id int, text string", [(1, "abc"), (2, " "), (3, None)], "id, n", [(1, 3.0), (2, None), (3, None)], lambda df: _embedded(df).select("id", F.get("vector", F.lit(0)).alias("n")))
for _name in ("udf07_embedding_in_batches", "udf08_local_embedding", "udf49_embedded_texts", "udf23_embedded_once"):
    rows(_name, "id int, text string", [(1, "ab"), (2, "abcd"), (3, "ab")], "id, n", [(1, 2.0), (2, 4.0), (3, 2.0)], lambda df: _embedded(df).select("id", F.get("vector", F.lit(0)).alias("n")))
_GOLD = "query_id int, relevant array<long>, groups array<array<long>>, retrieved array<long>"
_GOLDS = [(1, [1, 2], [], [1, 9, 2]), (2, [3, 5], [[3, 5]], [5, 7, 3]), (3, [4], [], [])]


def _evaluated(df):
    found = df.select("query_id", F.posexplode("retrieved").alias("rank", "document_id"))
    return assembly.evaluated(df.drop("retrieved"), found, 3)


rows("udf25_evaluated_items", _GOLD, _GOLDS, "query_id, recall_3, mrr", [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 0.0)], _evaluated)
rows("udf26_evaluated_sets", _GOLD, _GOLDS, "n, recall, mrr", [(3, 0.666667, 0.666667)], lambda df: _evaluated(df).agg(F.count("*").alias("n"), F.round(F.avg("recall_3"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")))


def _embedded(df):
    from ..operators import retrieval

    return retrieval.embedded(df, "text", lambda texts: [[float(len(t))] for t in texts], batch=2)
