"""Queries of lookups, changes of tables, and joins between them.

Driver tables stand in: documents for documents, conversations for chunks, part
for nodes, lineitem for links, edges and memberships, supplier for sync targets,
orders for lineage and events for histories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, tables
from .base import query, rows, table


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("document_id")).distinct()


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("entity_name"), F.col("p_brand").alias("entity_type"))


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("nth"), F.col("l_partkey").alias("src"), (F.col("l_partkey") + 7).alias("dst"), F.col("l_suppkey").alias("document_id"), F.col("l_returnflag").alias("relation_type"))


def _members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target_id"), F.col("l_orderkey").alias("page_id")).distinct()


def _pages(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_id"), F.lit("page").alias("source_type"), F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("completed").alias("status"), (F.col("o_orderstatus") == "F").alias("degraded"))


_L = "(SELECT DISTINCT l_partkey AS node_id, l_suppkey AS document_id FROM lineitem)"
_M = "(SELECT DISTINCT l_suppkey AS target_id, l_orderkey AS page_id FROM lineitem)"

# ---------------------------------------------------------------- lookups


@query("src02_document", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def document(spark, d):
    return tables.lookup(table(spark, d, "documents"), doc_id=17).select("doc_id", "lang", "source")


@query("src03_document_by_source", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'")
def document_by_source(spark, d):
    return tables.lookup(table(spark, d, "documents"), source="src3", lang="en").select("doc_id", "source", "lang")


@query("src04_chunks_of_document", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn")
def chunks_of_document(spark, d):
    return tables.lookup(table(spark, d, "conversations"), conv_id=3).orderBy("turn").select("conv_id", "turn", "role")


@query("src05_all_nodes", "SELECT p_partkey AS id, p_name AS entity_name, p_brand AS entity_type FROM part")
def all_nodes(spark, d):
    return tables.filtered(_nodes(spark, d), entity_type="")


@query("src06_edges_of_document", "SELECT l_orderkey AS edge_id, l_linenumber AS nth, l_partkey AS src, l_partkey + 7 AS dst FROM lineitem WHERE l_suppkey = 5")
def edges_of_document(spark, d):
    return tables.lookup(_edges(spark, d), document_id=5).select("edge_id", "nth", "src", "dst")


@query("src07_links_by_node", f"SELECT node_id, list_sort(list(document_id)) AS document_ids FROM {_L} GROUP BY node_id")
def links_by_node(spark, d):
    return _links(spark, d).groupBy("node_id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


@query("src13_deleted_files", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 = 0")
def deleted_files(spark, d):
    parts = table(spark, d, "part").select("p_partkey")
    return tables.removed(parts.where("p_partkey % 5 <> 0"), parts.where("p_partkey % 7 <> 0"), ["p_partkey"])


@query("src15_modified_since", "SELECT event_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-20 00:00:00'")
def modified_since(spark, d):
    return tables.lookup(table(spark, d, "events"), event_type="view").where("ts >= timestamp'2024-01-20 00:00:00'").select("event_id")


@query("src28_counts", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def counts(spark, d):
    return tables.lookup(table(spark, d, "events"), event_type="view").agg(F.count("*").alias("n"))


@query("src29_subtree_counts", "WITH RECURSIVE t AS (SELECT p_partkey AS id FROM part WHERE p_partkey > 1 AND p_partkey // 3 = 1 UNION ALL SELECT p_partkey FROM part JOIN t ON p_partkey // 3 = t.id WHERE p_partkey > 1) SELECT count(*) AS n FROM t")
def subtree_counts(spark, d):
    from ..operators import sync

    pages = table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent_id"))
    return sync.subtree(pages, 1).agg(F.count("*").alias("n"))


@query("src37_contributed_pages", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def contributed(spark, d):
    return tables.lookup(table(spark, d, "orders"), o_custkey=7).select("o_orderkey")


@query("src39_membership", f"SELECT page_id FROM {_M} WHERE target_id = 7")
def membership(spark, d):
    return tables.ids_of(_members(spark, d), "page_id", target_id=7)


@query("src40_retries", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'R'")
def retries(spark, d):
    return tables.ids_of(table(spark, d, "lineitem"), "l_orderkey", l_suppkey=3, l_returnflag="R")


@query("src41_documents_of_node", f"SELECT document_id FROM {_L} WHERE node_id = 11 ORDER BY 1")
def documents_of_node(spark, d):
    return tables.ids_of(_links(spark, d), "document_id", node_id=11).orderBy("document_id")


@query("src42_sync_target", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 4")
def sync_target(spark, d):
    return tables.lookup(table(spark, d, "supplier"), s_suppkey=4).select("s_suppkey", "s_name")


rows("src43_described_nodes", "id int, name string, properties string", [(1, "A", '{"description": "x"}'), (2, "", '{"description": "y"}'), (3, "C", None), (4, "D", "broken"), (5, "E", '{"other": 1}')], "id, description", [(1, "x")], lambda df: df.where("name <> ''").withColumn("description", F.get_json_object("properties", "$.description")).where("description <> ''"))
rows("src38_space_info", "key string, name string", [("DEV", "Development"), ("OPS", "Operations")], "key, name", [("DEV", "Development")], lambda df: tables.lookup(df, key="DEV"))
rows("set03_deduped_ids", "pos int, id string", [(0, "b"), (1, "a"), (2, "b"), (3, None), (4, ""), (5, "c"), (6, "a")], "id, pos", [("b", 0), ("a", 1), ("c", 5)], lambda df: df.where("id <> ''").groupBy("id").agg(F.min("pos").alias("pos")))
rows("set06_document_ids", "document_id long, rank int", [(3, 0), (None, 1), (0, 2), (3, 3)], "document_id", [(3,), (0,)], lambda df: tables.ids_of(df, "document_id"))

# ---------------------------------------------------------------- changes


@query("snk01_created_documents", "SELECT doc_id AS id, lang AS source_type, 'stored' AS status, 3 AS version FROM documents UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY p_partkey), p_brand, 'pending', 1 FROM part")
def created_documents(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source_type"), F.lit("stored").alias("status"), F.lit(3).alias("version"))
    return tables.appended(old, table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("source_type")), "id", ["p_partkey"], status="pending", version=1)


@query("snk03_statuses", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'processing' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'hybrid' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def statuses(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("processing").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 10 == 0, "hybrid").alias("o_orderpriority"))
    return tables.patched(orders, changes, ["o_orderkey"])


rows("snk06_uploads", "source_id string, old string, new string", [("a.md", None, "x"), ("b.md", "y", "y"), ("c.md", "z", "changed"), ("d.md", "gone", None)], "source_id, change_type", [("a.md", "created"), ("b.md", "unchanged"), ("c.md", "changed"), ("d.md", "removed")], lambda df: documents.detect_changes(df.where("old is not null").select("source_id", T.content_hash(F.col("old")).alias("content_hash")), df.where("new is not null").select("source_id", T.content_hash(F.col("new")).alias("content_hash")), ["source_id"]))
rows("snk07_saved_documents", "id long, title string, old string, new string, version int", [(1, "T", "a", "a", 1), (2, "U", "a", "b", 4)], "id, title, content, version", [(1, "T", "a", 1), (2, "U", "b", 5)], lambda df: tables.bumped(df.select("id", "title", F.col("old").alias("content"), "version"), df.where(T.content_hash(F.col("old")) != T.content_hash(F.col("new"))).select("id", F.col("new").alias("content")), ["id"], "version"))
rows("snk08_stored_files", "repo string, path string, old string, new string", [("r1", "a.py", None, "x"), ("r2", "a.py", "x", "x"), ("r2", "b.py", "p", "q")], "repo, path, change_type", [("r1", "a.py", "created"), ("r2", "a.py", "unchanged"), ("r2", "b.py", "changed")], lambda df: documents.detect_changes(df.where("old is not null").select("repo", "path", T.content_hash(F.col("old")).alias("content_hash")), df.select("repo", "path", T.content_hash(F.col("new")).alias("content_hash")), ["repo", "path"]))


@query("snk09_removed_files", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def removed_files(spark, d):
    chunks = table(spark, d, "conversations").select("conv_id", "turn")
    gone = chunks.select(F.col("conv_id").alias("id")).where("id % 3 = 0").distinct()
    return documents.cascade(gone, {"chunks": (chunks, "conv_id")})["chunks"].select("conv_id", "turn")


@query("snk11_created_chunks", "SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id + 1000000, 0, text FROM documents")
def created_chunks(spark, d):
    new = table(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return tables.inserted(table(spark, d, "conversations").select("conv_id", "turn", "text"), new, ["conv_id", "turn"])


@query("snk12_deleted_chunks", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 5")
def deleted_chunks(spark, d):
    chunks = table(spark, d, "conversations").select("conv_id", "turn")
    return tables.removed(chunks, tables.lookup(chunks, conv_id=5), ["conv_id"])


@query("snk13_added_vectors", "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 3")
def added_vectors(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    return tables.inserted(old, old.where("label = 3").withColumn("vec_id", F.col("vec_id") + 1_000_000).union(old.where("label = 4")), ["vec_id"])


@query("snk14_deleted_vectors", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 4)")
def deleted_vectors(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    return tables.removed(old, old.where("label in (2, 4)"), ["label"])


@query("snk15_nodes_with_links", "SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS entity_name, n_regionkey AS document_id FROM nation")
def nodes_with_links(spark, d):
    new = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity_name"), F.lit("place").alias("entity_type"))
    old = _nodes(spark, d)
    made = tables.appended(old, new, "id", ["n_nationkey"]).join(old.select("id"), "id", "left_anti")
    return made.join(table(spark, d, "nation").select(F.col("n_name").alias("entity_name"), F.col("n_regionkey").alias("document_id")), "entity_name").select("id", "entity_name", "document_id")


@query("snk46_nodes_without_links", "SELECT count(*) AS n, max(p_partkey) + 25 AS last FROM (SELECT p_partkey FROM part UNION ALL SELECT NULL FROM nation)")
def nodes_without_links(spark, d):
    new = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity_name"))
    return tables.appended(_nodes(spark, d), new, "id", ["n_nationkey"], entity_type="place").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("snk16_created_edges", "SELECT l_partkey AS src, l_partkey + 7 AS dst, l_returnflag AS relation_type, l_suppkey AS document_id FROM lineitem WHERE l_partkey + 7 IN (SELECT p_partkey FROM part) GROUP BY ALL")
def created_edges(spark, d):
    from ..operators import graph

    return graph.sound_edges(_edges(spark, d).select("src", "dst", "relation_type", "document_id"), _nodes(spark, d))


@query("snk17_added_links", f"SELECT node_id, document_id FROM {_L} UNION SELECT p_partkey, 1 FROM part")
def added_links(spark, d):
    return tables.inserted(_links(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.lit(1).cast("long").alias("document_id")), ["node_id", "document_id"])


@query("snk18_node_properties", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE p_type END AS p_type FROM part")
def node_properties(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    return tables.patched(parts, table(spark, d, "part").where("p_size > 25").select("p_partkey", F.lit("large").alias("p_type")), ["p_partkey"])


_GONE = "(SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (3, 5))"


def _after_cascade(spark, d):
    gone = table(spark, d, "supplier").where("s_suppkey in (3, 5)").select(F.col("s_suppkey").alias("id"))
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    return tables.with_cascade({"links": _links(spark, d), "nodes": _nodes(spark, d), "edges": _edges(spark, d), "chunks": chunks}, gone, {"chunks": "document_id"}, "links", "nodes", "edges")


_ORPHANS = f"(SELECT node_id FROM {_L} GROUP BY node_id HAVING bool_and(document_id IN (3, 5)))"


@query("snk20_deleted_graph", f"SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN {_ORPHANS}")
def deleted_graph(spark, d):
    return _after_cascade(spark, d)["nodes"].select("id")


@query("snk21_deleted_edges", f"SELECT l_orderkey AS edge_id, l_linenumber AS nth FROM lineitem WHERE l_suppkey NOT IN (3, 5) AND l_partkey NOT IN {_ORPHANS} AND l_partkey + 7 NOT IN {_ORPHANS}")
def deleted_edges(spark, d):
    return _after_cascade(spark, d)["edges"].select("edge_id", "nth")


@query("snk21_cascaded_chunks", "SELECT conv_id AS document_id, turn FROM conversations WHERE conv_id NOT IN (3, 5)")
def cascaded_chunks(spark, d):
    return _after_cascade(spark, d)["chunks"]


rows("snk23_sync_targets", "old boolean, scope string, space string, page string, name string", [(True, "space", "A", None, "old"), (True, "page", "A", "1", "p"), (False, "space", "A", "", "new"), (False, "subtree", "B", "9", "s")], "scope, space, page, name", [("space", "A", None, "new"), ("page", "A", "1", "p"), ("subtree", "B", "9", "s")], lambda df: tables.upserted(df.where("old").drop("old"), df.where("not old").drop("old"), {"scope": F.col("scope"), "space": F.col("space"), "page": F.coalesce("page", F.lit(""))}, ["name"]))
rows("snk25_membership_batch", "old boolean, target int, page string, parent string, depth int", [(True, 1, "a", "root", 2), (True, 1, "b", None, 1), (False, 1, "a", None, None), (False, 1, None, None, 1), (False, 1, "c", "a", 3)], "target, page, parent, depth", [(1, "a", None, None), (1, "b", None, 1), (1, "c", "a", 3)], lambda df: tables.upserted(df.where("old").drop("old"), df.where("not old and page <> ''").drop("old"), {"target": F.col("target"), "page": F.col("page")}, ["parent", "depth"]))
rows("snk26_replaced_retries", "old boolean, target int, page string, error string, at int", [(True, 1, "a", "e0", 0), (True, 2, "a", "e1", 0), (False, 1, "b", "first", 1), (False, 1, "b", "last", 2)], "target, page, error", [(2, "a", "e1"), (1, "b", "last")], lambda df: tables.replaced(df.where("old").drop("old"), df.where("not old").drop("old"), ["target", "page"], ["target"], F.col("at")))


@query("snk26_replace_retries", "SELECT user_id AS target_id, event_type AS page_id, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1, 2")
def replace_retries(spark, d):
    """One retry a page of each target: the last row wins."""
    new = table(spark, d, "events").select(F.col("user_id").alias("target_id"), F.col("event_type").alias("page_id"), F.col("event_id").alias("last_event"), "ts")
    return tables.replaced(new.where("ts < timestamp'2024-01-10'"), new, ["target_id", "page_id"], ["target_id"], F.struct("ts", "last_event")).drop("ts")


_DROPPED = f"(SELECT * FROM {_M} WHERE target_id = 7 AND page_id % 2 = 0)"


def _dropped(spark, d):
    return _members(spark, d).where("target_id = 7 and page_id % 2 = 0")


@query("snk27_removed_memberships", f"SELECT page_id AS id FROM {_DROPPED} WHERE page_id NOT IN (SELECT page_id FROM {_M} WHERE target_id <> 7)")
def removed_memberships(spark, d):
    return tables.orphaned_by(_members(spark, d), _pages(spark, d), _dropped(spark, d), "page")


@query("snk28_deleted_target", f"SELECT page_id AS id FROM {_M} WHERE target_id = 7 AND page_id NOT IN (SELECT page_id FROM {_M} WHERE target_id <> 7)")
def deleted_target(spark, d):
    return tables.orphaned_by(_members(spark, d), _pages(spark, d), tables.lookup(_members(spark, d), target_id=7), "page")


@query("snk27_left_memberships", f"SELECT target_id, page_id FROM {_M} WHERE NOT (target_id = 7 AND page_id % 2 = 0)")
def left_memberships(spark, d):
    return tables.removed(_members(spark, d), _dropped(spark, d), ["target_id", "page_id"])


rows("snk29_degraded_flags", "id int, degraded boolean, detail string, set boolean, units int", [(1, False, None, True, 3), (2, True, '{"units":1}', False, None), (3, True, "x", None, None)], "id, degraded, detail", [(1, True, '{"units":3}'), (2, False, None), (3, True, "x")], lambda df: tables.patched(df.select("id", "degraded", "detail"), df.where("set is not null").select("id", F.col("set").alias("degraded"), F.when(F.col("set"), F.to_json(F.struct("units"))).alias("detail")), ["id"], ("detail",)))
rows("snk30_histories", "id long, document_id long, action string, status string", [(4, 1, "created", "completed")], "id, document_id, action, status", [(4, 1, "created", "completed"), (5, 2, "updated", "started")], lambda df: tables.appended(df, df.sparkSession.createDataFrame([(2, "updated")], "document_id long, action string"), "id", ["document_id"], status="started"))
rows("snk31_closed_histories", "id long, status string, error string, done string, problem string", [(1, "started", None, "completed", None), (2, "started", None, "failed", "boom"), (3, "started", None, None, None)], "id, status, error", [(1, "completed", None), (2, "failed", "boom"), (3, "started", None)], lambda df: tables.patched(df.select("id", "status", "error"), df.where("done is not null").select("id", F.col("done").alias("status"), F.col("problem").alias("error")), ["id"]))


@query("snk32_merge_log", "SELECT p_partkey AS source_document_id, p_name AS raw_entity_name, CASE WHEN p_partkey = first_id THEN 'new' WHEN p_name = first_name THEN 'exact' ELSE 'normalized' END AS merge_method FROM (SELECT *, min(p_partkey) OVER w AS first_id, arg_min(p_name, p_partkey) OVER w AS first_name FROM part WINDOW w AS (PARTITION BY regexp_replace(lower(p_name), '[\\s_-]+', '', 'g')))")
def merge_log(spark, d):
    from ..operators import graph

    mentions = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.lit(0).alias("ordinal"), F.col("p_name").alias("entity_name"), F.lit("thing").alias("entity_type"), F.lit(None).cast("string").alias("description"))
    return graph.merge_log(mentions).select(F.col("document_id").alias("source_document_id"), F.col("entity_name").alias("raw_entity_name"), "merge_method")


rows("snk33_watermarks", "id int, watermark string, new string", [(1, None, "2024-05-01 10:00"), (2, "2024-01-01 00:00", None)], "id, watermark", [(1, "2024-05-01 10:00"), (2, "2024-01-01 00:00")], lambda df: tables.patched(df.select("id", "watermark"), df.select("id", F.col("new").alias("watermark")), ["id"]))
rows("snk34_lineage", "doc_id long, source_doc_id long, file_path string", [(1, 2, "a"), (1, 3, "b")], "doc_id, source_doc_id, file_path", [(1, 2, "a"), (1, 3, "b"), (4, 2, "c")], lambda df: tables.inserted(df, df.sparkSession.createDataFrame([(1, 2, "again"), (4, 2, "c")], df.schema), ["doc_id", "source_doc_id"]))
rows("snk35_evolved_schema", "id int", [(1,), (2,)], "id, version, detail", [(1, None, None), (2, None, None)], lambda df: documents.evolve(df, {"version": "int", "detail": "string"}))
rows("snk36_backfilled_names", "id int, entity_name string, normalized_name string", [(1, "Auth Service", ""), (2, "X", "kept"), (3, "A-b", None)], "id, normalized_name", [(1, "authservice"), (2, "kept"), (3, "ab")], lambda df: df.withColumn("normalized_name", F.when(F.coalesce("normalized_name", F.lit("")) == "", T.normalized_name(F.col("entity_name"))).otherwise(F.col("normalized_name"))))
rows("snk37_csv_rows", "id string, ids array<int>, score double", [("a", [1, 2], 0.5), ("b", [], None)], "id, ids, score", [("a", "1,2", "0.5"), ("b", "", "")], lambda df: documents.sheet(df))
rows("snk40_event_lines", "kind string, text string", [("delta", 'a"b'), ("done", None)], "line", [('{"type":"delta","text":"a\\"b"}',), ('{"type":"done"}',)], lambda df: df.select(F.to_json(F.struct(F.col("kind").alias("type"), "text")).alias("line")))


@query("snk41_deleted_nodes", "SELECT l_orderkey AS edge_id, l_linenumber AS nth FROM lineitem WHERE l_partkey NOT IN (7, 14) AND l_partkey + 7 NOT IN (7, 14)")
def deleted_nodes(spark, d):
    gone = _nodes(spark, d).where("id in (7, 14)")
    return tables.removed(tables.removed(_edges(spark, d), gone, {"src": "id"}), gone, {"dst": "id"}).select("edge_id", "nth")


rows("snk42_source_versions", "id int, source_version int, version int, new int", [(1, 3, 7, 4), (2, 5, 7, None)], "id, source_version, version", [(1, 4, 7), (2, 5, 7)], lambda df: tables.patched(df.select("id", "source_version", "version"), df.select("id", F.col("new").alias("source_version")), ["id"]))


@query("snk43_deleted_lineage", "SELECT o_custkey AS doc_id, o_orderkey AS source_doc_id FROM orders WHERE o_custkey <> 7")
def deleted_lineage(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source_doc_id"))
    return tables.removed(edges, tables.lookup(edges, doc_id=7), ["doc_id"])


@query("snk44_unlinked_nodes", f"SELECT node_id, document_id FROM {_L} WHERE NOT (node_id = 11 AND document_id IN (SELECT document_id FROM {_L} WHERE node_id = 11 ORDER BY 1 LIMIT 1))")
def unlinked_nodes(spark, d):
    links = _links(spark, d)
    return tables.removed(links, tables.lookup(links, node_id=11).orderBy("document_id").limit(1), ["node_id", "document_id"])


rows("snk45_sync_results", "id int, last_result_json string, created int, updated int", [(1, None, 2, 3), (2, "old", None, None)], "id, last_result_json", [(1, '{"created":2,"updated":3}'), (2, "old")], lambda df: tables.patched(df.select("id", "last_result_json"), df.where("created is not null").select("id", F.to_json(F.struct("created", "updated")).alias("last_result_json")), ["id"]))

# ---------------------------------------------------------------- joins


@query("join01_nodes_of_document", "SELECT DISTINCT p_partkey AS id, p_name AS entity_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey = 9")
def nodes_of_document(spark, d):
    return tables.nodes_of(_nodes(spark, d), _links(spark, d), 9).select("id", "entity_name")


@query("join02_orphan_nodes", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey > 50)")
def orphan_nodes(spark, d):
    return tables.orphan_nodes(_nodes(spark, d), _links(spark, d).where("document_id > 50")).select("id")


rows("join03_merged_groups", "canonical_node_id long, raw_entity_name string, source_document_id long, merge_method string, gone boolean", [(1, "Auth", 1, "new", False), (1, "auth", 2, "normalized", False), (2, "Solo", 1, "new", False), (3, "X", 1, "new", True), (3, "x", 1, "normalized", True), (4, "Y", 1, "new", False), (4, "Y", 3, "exact", False)], "canonical_node_id, entity_name, entity_type, variant_names, document_ids, methods, log_count, is_deleted", [
    (1, "n1", "t", ["Auth", "auth"], [1, 2], ["new", "normalized"], 2, False), (3, "(삭제된 노드)", "other", ["X", "x"], [1], ["new", "normalized"], 2, True), (4, "n4", "t", ["Y"], [1, 3], ["exact", "new"], 2, False),
], lambda df: tables.merge_log_groups(df, df.where("not gone").select(F.col("canonical_node_id").alias("id"), F.concat(F.lit("n"), F.col("canonical_node_id").cast("string")).alias("entity_name"), F.lit("t").alias("entity_type")).distinct(), deleted=True))
rows("grf18_merges", "canonical_node_id long, raw_entity_name string, source_document_id long, merge_method string", [(1, "A", 1, "new"), (1, "a", 2, "normalized"), (9, "B", 1, "new"), (9, "b", 2, "normalized")], "canonical_node_id, log_count", [(1, 2)], lambda df: tables.merge_log_groups(df, df.where("canonical_node_id = 1").select(F.col("canonical_node_id").alias("id"), F.lit("A").alias("entity_name"), F.lit("t").alias("entity_type")).distinct()))


@query("join04_lineage", "SELECT o_custkey AS of_id, o_orderkey AS id, o_orderstatus AS title FROM orders")
def lineage(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source_doc_id"))
    return tables.lineage(docs, edges, "doc_id", "source_doc_id").select("of_id", "id", "title")


@query("join05_reverse_lineage", "SELECT o_orderkey AS of_id, c_custkey AS id, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def reverse_lineage(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source_doc_id"))
    return tables.lineage(docs, edges, "source_doc_id", "doc_id").select("of_id", "id", "title")


@query("join06_failed_members", "SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 4 AND o_orderpriority = '1-URGENT'")
def failed_members(spark, d):
    return tables.members_in(_pages(spark, d), _members(spark, d), 4, "page", F.col("status") == "failed")


@query("join07_degraded_members", "SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 4 AND o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F'")
def degraded_members(spark, d):
    return tables.members_in(_pages(spark, d), _members(spark, d), 4, "page", F.col("degraded") & (F.col("status") == "completed"))


@query("join09_node_of_entity", "SELECT p_brand, min(p_partkey) AS id FROM part WHERE regexp_replace(lower(p_name), '[\\s_-]+', '', 'g') LIKE '%e%' GROUP BY p_brand")
def node_of_entity(spark, d):
    named = table(spark, d, "part").withColumn("key", T.normalized_name(F.col("p_name"))).where("key like '%e%'")
    return named.groupBy("p_brand").agg(F.min("p_partkey").alias("id"))


rows("join16_source_code", "id long, source_type string, title string, content string, source_doc_id long", [(1, "code_doc", "doc", "d", 3), (1, "code_doc", "doc", "d", 4), (2, "code_summary", "sum", "s", 3), (3, "git_code", "a.py", "x", None), (4, "git_code", "b.py", "y", None), (5, "git_code", "c.py", "z", None), (6, "upload", "u", "u", 5)], "id, title, content", [(3, "a.py", "x"), (4, "b.py", "y")], lambda df: tables.code_of(df.drop("source_doc_id").distinct(), df.select(F.col("id").alias("doc_id"), "source_doc_id")))
rows("join17_chunk_views", "id string, section_path string, question string", [("a", "P > Q", "why"), ("a", "P > Q", "how"), ("b", "", None), ("c", None, "")], "id, meta_text, questions", [("a", "Title\nP > Q", ["how", "why"]), ("b", "Title", []), ("c", "Title", [])], lambda df: tables.chunk_views(df.select("id", "section_path").distinct(), df.select(F.col("id").alias("chunk_id"), "question"), T.meta_view(F.lit("Title"), F.col("section_path"))))
rows("join18_node_details", "node long, document_id long, title string", [(1, 10, "Doc"), (1, 11, None), (2, 12, "Other")], "document_id, title", [(10, "Doc"), (11, "(문서 11)")], lambda df: tables.lookup(df, node=1).withColumn("title", F.coalesce("title", F.format_string("(문서 %d)", "document_id"))))
rows("join19_source_texts", "item int, document_id long, anchor string, chunk_id string, relevant array<long>", [(1, 1, "second  part", None, [9]), (2, 1, "nowhere", "c1", [9]), (3, 1, None, None, []), (4, None, "x", None, [2]), (5, None, None, None, [])], "item, content, method", [
    (1, "second part here", "anchor"), (2, "second part here", "chunk_id"), (3, "first part", "fallback_first_chunk"), (4, "other", "fallback_doc_first_chunk"), (5, "", "empty"),
], lambda df: tables.source_texts(df, df.sparkSession.createDataFrame([(1, "c0", 0, "first part"), (1, "c1", 1, "second part here"), (2, "d0", 0, "other")], "document_id long, chunk_id string, chunk_index int, content string")))


@query("join21_graph_of_document", "SELECT 'node' AS kind, l_partkey AS id FROM lineitem WHERE l_suppkey = 9 GROUP BY 2 UNION ALL SELECT 'edge', l_orderkey FROM lineitem WHERE l_suppkey = 9")
def graph_of_document(spark, d):
    nodes = tables.nodes_of(_nodes(spark, d), _links(spark, d), 9).select(F.lit("node").alias("kind"), "id")
    return nodes.union(tables.lookup(_edges(spark, d), document_id=9).select(F.lit("edge"), "edge_id"))


rows("join22_embedded_texts", "item int, texts array<string>", [(1, ["a", "b"]), (2, ["b", ""]), (3, [])], "item, text, length", [(1, "a", 1), (1, "b", 1), (2, "b", 1)], lambda df: documents.embedded_once(df.select("item", F.explode("texts").alias("text")), "text", lambda texts: texts.withColumn("length", F.length("text"))))
rows("top07_merge_log", "id long, canonical_node_id long, source_document_id long", [(3, 1, 5), (1, 1, 5), (2, 1, 6), (4, 2, 5)], "id", [(1,), (3,)], lambda df: tables.filtered(df, canonical_node_id=1, source_document_id=5).orderBy("id"))
rows("top11_synced_documents", "id int, repo string, product string, updated int", [(1, "r", "a", 5), (2, "r", "a", 9), (3, "r", "b", 7), (4, "q", "a", 1)], "repo, product, n, newest", [("r", "a", 2, 2), ("r", "b", 1, 3), ("q", "a", 1, 4)], lambda df: df.groupBy("repo", "product").agg(F.count("*").alias("n"), F.max_by("id", F.struct("updated", "id")).alias("newest")))
rows("agg21_changed_products", "path string, product string", [("a", "vpc"), ("b", "vpc"), ("c", "billing")], "product", [("vpc",), ("billing",)], lambda df: tables.ids_of(df, "product"))
rows("agg22_directory_groups", "path string", [("a/b/1",), ("a/b/2",), ("a/b/3",), ("a/c/1",), ("a/2",), ("x",), ("q/z/1",)], "directory, n, paths", [("a/b", 3, ["a/b/1", "a/b/2", "a/b/3"]), ("a", 1, ["a/c/1"]), (".", 2, ["a/2", "x"]), ("q", 1, ["q/z/1"])], lambda df: tables.directory_groups(df, "path"))
