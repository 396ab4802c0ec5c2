"""Registry of the core engine: name -> (query, equivalent DuckDB SQL or None).

Names start with the number of the operator in the survey's inventory.  The
driver's tables stand in for the engine's own: embeddings for chunk vectors (label
for document), part for entity mentions, lineitem for edges and memberships.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, documents, evaluation, goldset, graph, parsing, retrieval, sync
from .base import QUERIES, query, table


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return [float(x) for x in row[0]]


_QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_QUERY})"

# ---------------------------------------------------------------- documents


@query("fn08_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("set03_exact_duplicates", "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return documents.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


_CHANGES = """
WITH s AS (SELECT doc_id, sha256(coalesce(text, '')) AS old_hash FROM documents WHERE doc_id % 11 <> 0),
i AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' edited' ELSE '' END) AS new_hash FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, old_hash, new_hash,
       CASE WHEN s.doc_id IS NULL THEN 'created' WHEN i.doc_id IS NULL THEN 'removed' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS change_type
FROM s FULL JOIN i ON s.doc_id = i.doc_id
"""


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    edited = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, " edited").otherwise(""))
    stored = docs.where("doc_id % 11 <> 0").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return stored, docs.where("doc_id % 13 <> 0").select("doc_id", edited.alias("original_content"))


@query("snk05_change_detection", _CHANGES)
def change_detection(spark, d):
    stored, incoming = _snapshots(spark, d)
    return documents.detect_changes(stored, incoming.select("doc_id", T.content_hash(F.col("original_content")).alias("content_hash")), ["doc_id"])


@query("snk02_upsert", f"""
WITH c AS ({_CHANGES})
SELECT doc_id, CASE WHEN change_type IN ('created', 'changed') THEN new_hash ELSE old_hash END AS content_hash,
       CASE change_type WHEN 'created' THEN 1 WHEN 'changed' THEN 2 ELSE 1 END AS version,
       CASE change_type WHEN 'created' THEN 'pending' WHEN 'changed' THEN 'changed' ELSE 'completed' END AS status
FROM c
""")
def upsert(spark, d):
    stored, incoming = _snapshots(spark, d)
    return documents.upsert(stored.withColumns({"version": F.lit(1), "status": F.lit("completed")}), incoming, ["doc_id"])


@query("src01_listing_with_counts", """
SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items,
       (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_returned
FROM orders WHERE o_orderstatus = 'O'
""")
def listing(spark, d):
    counts = {"n_items": F.count("*"), "n_returned": F.count(F.when(F.col("l_returnflag") == "R", 1))}
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")
    return documents.listing(orders, table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "o_orderkey", "l_orderkey", counts)


@query("agg01_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NOT NULL) AS n_valued, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_valued"), F.count_distinct("user_id").alias("n_users"))


@query("agg02_source_groups", "SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS n_source FROM documents GROUP BY source, lang")
def source_groups(spark, d):
    return documents.source_groups(table(spark, d, "documents"), "source", "lang")


@query("set02_stale_prune", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1995-01-01')")
def stale_prune(spark, d):
    live = table(spark, d, "lineitem").where("l_shipdate >= timestamp'1995-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return documents.without(table(spark, d, "orders").select("o_orderkey"), live, ["o_orderkey"])


@query("join08_orphan_refcount", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_owners FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey % 5 <> 0)")
def orphan_refcount(spark, d):
    return documents.orphans(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", F.col("l_suppkey") % 5 != 0)


@query("snk22_relational_division", "SELECT l_orderkey, count(*) AS n_sources FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 2 = 0)")
def relational_division(spark, d):
    return documents.derived_only_from(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_partkey") % 2 == 0)


@query("snk04_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return documents.cascade(gone, {"items": (table(spark, d, "lineitem"), "l_orderkey")})["items"].select("l_orderkey", "l_linenumber")


@query("flt12_pending", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS turn FROM orders WHERE o_orderstatus IN ('O', 'P')")
def pending(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("turn"))


@query("flt25_storage_method", "SELECT doc_id, CASE WHEN n_chars > 1000 AND doc_id % 2 = 0 THEN 'hybrid' WHEN doc_id % 2 = 0 THEN 'graph' ELSE 'chunk' END AS method FROM documents")
def storage_method(spark, d):
    return table(spark, d, "documents").select("doc_id", documents.storage_method(F.col("n_chars") > 1000, F.col("doc_id") % 2 == 0).alias("method"))


# ---------------------------------------------------------------- text functions


@query("fn01_normalised_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[\\s_-]+', '', 'g') AS normalized_name FROM part")
def normalised(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalized_name(F.col("p_name")).alias("normalized_name"))


@query("fn03_alnum_names", "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS name FROM part")
def alnum(spark, d):
    return table(spark, d, "part").select("p_partkey", T.alnum_name(F.col("p_type")).alias("name"))


@query("fn05_short_names", """
SELECT p_partkey, p_brand || '.' || p_type AS display, split_part(p_brand || '.' || p_type, '.', -1) AS short FROM part
""")
def short_names(spark, d):
    fqn = F.concat(F.lit("file::"), F.col("p_brand"), F.lit("."), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.display_name(fqn).alias("display"), T.short_name(fqn).alias("short"))


@query("fn10_stable_seed", "SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65, 8), lambda i: ('0x' || substr(sha256(source || doc_id), i, 8))::BIGINT)), lambda a, x: (a * 4967296 + x) % 10000000) + 42 AS seed FROM documents")
def seeds(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_seed(F.concat("source", F.col("doc_id").cast("string")), 42).alias("seed"))


@query("fn20_text_anchor", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS anchor FROM documents")
def anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_anchor(F.col("text")).alias("anchor"))


@query("fn22_patterns", """
SELECT event_id, list_distinct(regexp_extract_all(t, '\\b([A-Z][A-Z0-9]{1,9}-\\d+)\\b', 1)) AS tickets FROM (SELECT event_id, 'AB-' || user_id || ' and AB-' || user_id || ' x-1' AS t FROM events)
""")
def patterns(spark, d):
    t = F.concat(F.lit("AB-"), F.col("user_id"), F.lit(" and AB-"), F.col("user_id"), F.lit(" x-1"))
    return table(spark, d, "events").select("event_id", T.ticket_keys(t).alias("tickets"))


_COMMON = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)


@query("fn29_identifiers", f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'), lambda x: lower(x) NOT IN ({_COMMON})))) AS ids FROM documents")
def identifier_lists(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.identifiers(F.col("text"))).alias("ids"))


@query("fn31_repo_labels", "SELECT page_id, split_part(rtrim(url, '/'), '/', -1) AS label FROM pages WHERE url NOT LIKE '%.git'")
def repo_labels(spark, d):
    return table(spark, d, "pages").where("url not like '%.git'").select("page_id", T.repo_label(F.col("url")).alias("label"))


@query("fn41_meta_view", "SELECT doc_id, source || chr(10) || lang AS view, concat_ws(' > ', source, lang, doc_id::VARCHAR) AS breadcrumb FROM documents")
def meta_views(spark, d):
    return table(spark, d, "documents").select("doc_id", T.meta_view(F.col("source"), F.col("lang")).alias("view"), T.breadcrumb(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("breadcrumb"))


@query("flt06_plural_variants", """
SELECT DISTINCT w, list_sort(list_distinct(list_filter([lower(w), lower(w) || 's', CASE WHEN lower(w) LIKE '%y' THEN CASE WHEN NOT regexp_matches(lower(w), '[aeou]y$') THEN regexp_replace(lower(w), 'y$', '') || 'ies' END
  WHEN regexp_matches(lower(w), '(s|x|z|ch|sh)$') THEN lower(w) || 'es' END], lambda x: x IS NOT NULL))) AS variants
FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT unnest(['policy', 'key', 'box', 'Bus', 'search', 'iy', 'day'])) WHERE w <> ''
""")
def plurals(spark, d):
    more = spark.createDataFrame([(w,) for w in ("policy", "key", "box", "Bus", "search", "iy", "day")], "w string")
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).union(more).where("w <> ''").distinct()
    return words.select("w", F.array_sort(T.plural_variants(F.col("w"))).alias("variants"))


@query("flt03_glob", "SELECT page_id, url LIKE '%example.com/en/%' OR regexp_matches(url, '^https://[^m].*html$') AS matches FROM pages")
def globs(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", (T.glob_match(url, ["*example.com/en/*"]) | url.rlike("^https://[^m].*html$")).alias("matches"))


@query("src20_json_props", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- graph


def _mentions(spark, d):
    size = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    return table(spark, d, "part").select((F.col("p_partkey") % 97).alias("document_id"), F.col("p_partkey").alias("ordinal"), F.concat_ws("-", F.element_at(F.split("p_name", " "), 1), F.col("p_size").cast("string")).alias("entity_name"), F.when(F.col("p_size") < 10, "struct").otherwise("class").alias("entity_type"), size.alias("description"))


_MENTIONS = """m AS (SELECT p_partkey % 97 AS document_id, p_partkey AS ordinal, split_part(p_name, ' ', 1) || '-' || p_size AS entity_name, 'class' AS entity_type,
  CASE WHEN p_size % 3 = 0 THEN p_type END AS description, regexp_replace(lower(split_part(p_name, ' ', 1) || p_size), '[\\s_-]+', '', 'g') AS normalized_name FROM part)"""
_MERGED = """SELECT normalized_name, entity_type, arg_min(entity_name, document_id * 1000000000 + ordinal) AS entity_name, min(document_id) AS document_id,
  arg_min(description, document_id * 1000000000 + ordinal) FILTER (description IS NOT NULL) AS description,
  count(DISTINCT document_id) AS n_documents, count(DISTINCT entity_name) AS n_variants, count(*) AS n_mentions FROM m GROUP BY normalized_name, entity_type"""


@query("grf01_entity_merge", f"WITH {_MENTIONS} {_MERGED}")
def entity_merge(spark, d):
    return graph.merge_entities(_mentions(spark, d))


@query("agg03_merge_groups", f"WITH {_MENTIONS} SELECT * FROM ({_MERGED}) WHERE greatest(n_variants, n_documents) >= 3")
def merge_groups(spark, d):
    return graph.merge_groups(_mentions(spark, d), 3)


@query("flt23_canonical_relations", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN l_suppkey ELSE l_partkey END AS source, CASE WHEN l_linenumber = 2 THEN l_partkey ELSE l_suppkey END AS target,
       CASE l_linenumber WHEN 1 THEN 'contains' WHEN 2 THEN 'documents' WHEN 3 THEN 'depends_on' ELSE 'owns' END AS relation_type FROM lineitem
""")
def canonical_relations(spark, d):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "has_part").when(n == 2, "documented_in").when(n == 3, "uses").otherwise("owns")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("relation_type"))
    return graph.canonical_relations(rows)


def _edges(spark, d):
    """Parts and suppliers as nodes: suppliers have negative ids."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem)"


@query("join10_induced_edges", f"WITH {_EDGES} SELECT src, dst FROM e WHERE src % 3 = 0 AND dst % 2 = 0")
def induced_edges(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.col("src").alias("id")).where("id % 3 = 0").union(edges.select(F.col("dst").alias("id")).where("id % 2 = 0"))
    return graph.induced(edges, nodes)


@query("src08_sound_edges", f"WITH {_EDGES} SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 25) AND dst IN (SELECT -s_suppkey - 1 FROM supplier WHERE s_acctbal > 0)")
def sound_edges(spark, d):
    nodes = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")).union(table(spark, d, "supplier").where("s_acctbal > 0").select((-F.col("s_suppkey") - 1).alias("id")))
    return graph.sound_edges(_edges(spark, d), nodes)


_NATIONS = """n AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation UNION ALL SELECT 1000 + s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 = 0),
b AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n)"""


def _nation_edges(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    b = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1000).alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return a.union(b)


_REACH = f"""WITH RECURSIVE {_NATIONS}, t AS (SELECT 0::BIGINT AS id, 0 AS hop UNION SELECT b.dst, hop + 1 FROM t JOIN b ON b.src = t.id WHERE hop < DEPTH)
SELECT id, min(hop)::INT AS hop FROM t GROUP BY id"""


@query("grf06_bfs_hops", _REACH.replace("DEPTH", "3"))
def bfs_hops(spark, d):
    return graph.hops(_nation_edges(spark, d), spark.range(1), 3)


@query("grf09_component", f"SELECT * FROM ({_REACH.replace("DEPTH", "5")}) ORDER BY hop, id LIMIT 40")
def component(spark, d):
    return graph.component(_nation_edges(spark, d), spark.range(1), 40, 5)


@query("top04_degree", f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 50")
def degree(spark, d):
    return graph.top_by_degree(_edges(spark, d), 50)


@query("join13_disjoint_seeds", """
WITH p AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS document_id FROM lineitem),
e AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM (SELECT DISTINCT node FROM p) a JOIN (SELECT DISTINCT node FROM p) b ON b.node = a.node + 7),
s AS (SELECT DISTINCT src, dst FROM e JOIN p x ON x.node = src JOIN p y ON y.node = dst AND y.document_id = x.document_id),
m AS (SELECT node, min(document_id) AS doc FROM p GROUP BY node)
SELECT e.src, e.dst, a.doc AS src_doc, b.doc AS dst_doc FROM e ANTI JOIN s ON s.src = e.src AND s.dst = e.dst JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst
""")
def disjoint_seeds(spark, d):
    docs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("document_id")).distinct()
    nodes = docs.select("node").distinct()
    edges = nodes.select(F.col("node").alias("src"), (F.col("node") + 7).alias("dst")).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.disjoint_seeds(edges, docs, None).select("src", "dst", "src_doc", "dst_doc")


@query("agg04_schema_summary", """
SELECT entity_type, count(*) AS n, list_aggregate(list_sort(list(entity_name ORDER BY entity_name))[1:5], 'string_agg', ', ') AS names
FROM (SELECT DISTINCT p_brand AS entity_type, p_name || p_partkey AS entity_name FROM part) GROUP BY entity_type
""")
def schema_summary(spark, d):
    return graph.schema_summary(table(spark, d, "part").select(F.col("p_brand").alias("entity_type"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("entity_name")), 5)


# ---------------------------------------------------------------- retrieval


@query("top01_knn", f"SELECT vec_id, label, round({_COS}, 6) AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn(spark, d):
    found = retrieval.nearest(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", "embedding", F.col("vec_id") != 0)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("win01_knn_dedup", f"""
WITH f AS (SELECT vec_id, label, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 60),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM f)
SELECT vec_id, label, round(s, 6) AS similarity FROM b WHERE n = 1 AND s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10
""")
def knn_dedup(spark, d):
    found = retrieval.nearest_documents(table(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", "label", "embedding", 0.1)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("src30_vectors_of_document", "SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id % 2 = 1")
def vectors_of_document(spark, d):
    return table(spark, d, "embeddings").where("label = 3 and vec_id % 2 = 1").select("vec_id", "label")


@query("fn13_hyde_mean", "SELECT e.vec_id, round(list_cosine_similarity(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE + q.embedding[i]::DOUBLE) / 2), q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def hyde_mean(spark, d):
    q = V.literal(_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.cosine(V.mean(F.col("embedding"), q), q), 6).alias("similarity"))


@query("win03_budget_prefix", """
SELECT source, doc_id, running::BIGINT AS running FROM (SELECT source, doc_id, sum(n_chars) OVER w AS running, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
WHERE running <= 6000 OR n = 1
""")
def budget_prefix(spark, d):
    return retrieval.budget_prefix(table(spark, d, "documents"), ["source"], [F.col("doc_id")], "n_chars", 6000).select("source", "doc_id", "running")


@query("win04_budget_greedy", """
WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
t AS (SELECT source, doc_id, n, n_chars <= 6000 AS taken, CASE WHEN n_chars <= 6000 THEN n_chars ELSE 0 END AS used FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.doc_id, r.n, t.used + r.n_chars <= 6000, CASE WHEN t.used + r.n_chars <= 6000 THEN t.used + r.n_chars ELSE t.used END FROM t JOIN r ON r.source = t.source AND r.n = t.n + 1)
SELECT source, doc_id FROM t WHERE taken
""")
def budget_greedy(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.col("doc_id").alias("place"))
    return retrieval.budget_greedy(docs, ["source"], "doc_id", "place", "n_chars", 6000).select("source", "doc_id")


@query("top03_rerank", "SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def rerank(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") % 7).cast("double").alias("score"))
    return retrieval.rerank(rows, ["label"], "score", "vec_id", 5).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("grf10_graph_seed_search", f"""
WITH s AS (SELECT vec_id FROM embeddings WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, vec_id LIMIT 5),
e AS (SELECT vec_id AS src, vec_id + 1 AS dst FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)),
r AS (SELECT vec_id AS node, 1 AS seed FROM s UNION ALL SELECT dst, 0 FROM e WHERE src IN (FROM s) UNION ALL SELECT src, 0 FROM e WHERE dst IN (FROM s))
SELECT label AS document_id, max(seed) = 1 AS is_seed FROM r JOIN embeddings ON node = vec_id GROUP BY label
""")
def graph_seed_search(spark, d):
    vectors = table(spark, d, "embeddings")
    seeds = retrieval.nearest(vectors, _vector(spark, d), 5, "vec_id", "embedding").where("similarity >= 0.2").select(F.col("vec_id").alias("id"))
    edges = vectors.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst")).join(vectors.select(F.col("vec_id").alias("dst")), "dst", "left_semi")
    return retrieval.graph_branch(seeds, edges, vectors.select(F.col("vec_id").alias("node"), F.col("label").alias("document_id")))


# ---------------------------------------------------------------- evaluation


_K = 5
_NEIGHBOURS = """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query_id, q.label AS wanted, e.vec_id AS id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
      FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
k AS (SELECT * FROM p WHERE rank <= 5)"""


def _neighbours(spark, d, k=_K):
    vectors = table(spark, d, "embeddings")
    found = retrieval.nearest_for_all(vectors.where("vec_id % 50 = 0"), vectors, k, "vec_id", "embedding")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    wanted = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    return found.join(labels, "id").join(wanted, "query_id")


@query("top08_nearest_for_all", f"{_NEIGHBOURS} SELECT query_id, id, rank::INT AS rank FROM k")
def nearest_for_all(spark, d):
    return _neighbours(spark, d).select("query_id", "id", "rank")


def _results(spark, d):
    lists = _neighbours(spark, d).groupBy("query_id", "wanted").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("long").alias("l")))), lambda x: x["l"]).alias("retrieved"))
    return lists.select("query_id", "retrieved", F.array(F.col("wanted").cast("long")).alias("relevant"))


@query("win05_ir_metrics", f"""{_NEIGHBOURS},
h AS (SELECT query_id, count(*) FILTER (label = wanted) AS hits, min(rank) FILTER (label = wanted) AS first, sum(CASE WHEN label = wanted THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM k GROUP BY query_id)
SELECT query_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_5, hits / 5.0::DOUBLE AS precision_5, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_5,
       round(coalesce(1.0 / first, 0)::DOUBLE, 9) AS mrr, round(dcg::DOUBLE, 9) AS ndcg_5 FROM h
""")
def ir_metrics(spark, d):
    got = evaluation.measures(_results(spark, d), "retrieved", "relevant", _K)
    return got.select("query_id", "recall_5", "precision_5", "hit_5", F.round("mrr", 9).alias("mrr"), F.round("ndcg_5", 9).alias("ndcg_5"))


@query("agg06_metric_summary", f"""{_NEIGHBOURS},
h AS (SELECT query_id, count(*) FILTER (label = wanted) / 5.0 AS precision_5, coalesce(1.0 / min(rank) FILTER (label = wanted), 0) AS mrr FROM k GROUP BY query_id),
v AS (SELECT 'precision_5' AS metric, precision_5::DOUBLE AS value FROM h UNION ALL SELECT 'mrr', mrr::DOUBLE FROM h)
SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS greatest, count(value) AS n FROM v GROUP BY metric
""")
def metric_summary(spark, d):
    values = evaluation.long_form(evaluation.measures(_results(spark, d), "retrieved", "relevant", _K), ["query_id"], ["precision_5", "mrr"])
    got = evaluation.summary(values, ["metric"])
    return got.select("metric", *(F.round(c, 6).alias(c) for c in ("mean", "std", "least", "greatest")), "n")


@query("win10_equivalence", """
SELECT o_orderkey, list_distinct(list_transform(r, lambda x: CASE WHEN x IN (1, 2, 3) THEN coalesce(list_filter(r, lambda y: y IN (1, 2, 3))[1], 1) ELSE x END)).list_sort() AS retrieved, [coalesce(list_filter(r, lambda y: y IN (1, 2, 3))[1], 1), 9] AS relevant
FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber::BIGINT ORDER BY l_extendedprice, l_linenumber) AS r FROM lineitem GROUP BY l_orderkey)
""")
def equivalence(spark, d):
    from ..functions.ranking import representatives

    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", F.col("l_linenumber").cast("long").alias("n")))), lambda x: x["n"]).alias("r"))
    got, wanted = representatives(F.col("r"), F.array(F.array(*(F.lit(x).cast("long") for x in (1, 2, 3))), F.array(F.lit(9).cast("long"))))
    return lists.select("o_orderkey", F.array_sort(got).alias("retrieved"), wanted.alias("relevant"))


def _runs(spark, d):
    items = table(spark, d, "lineitem")
    run = lambda c: items.groupBy("l_orderkey").agg(F.sum(F.round(F.col(c) * 100).cast("long")).cast("double").alias("value")).select("l_orderkey", F.lit("m").alias("metric"), "value")
    return run("l_discount"), run("l_tax")


_RUNS = "a AS (SELECT l_orderkey, sum(round(l_discount * 100)::BIGINT)::DOUBLE AS x, sum(round(l_tax * 100)::BIGINT)::DOUBLE AS y FROM lineitem GROUP BY l_orderkey)"


@query("join11_paired_difference", f"WITH {_RUNS} SELECT l_orderkey, 'm' AS metric, y - x AS diff FROM a")
def paired_difference(spark, d):
    return evaluation.paired(*_runs(spark, d), "l_orderkey")


@query("join12_hit_changes", f"WITH {_RUNS} SELECT l_orderkey, CASE WHEN x > 0 AND y > 0 THEN 'kept' WHEN y > 0 THEN 'new' WHEN x > 0 THEN 'lost' ELSE 'missed' END AS change FROM a")
def hit_changes(spark, d):
    return evaluation.hit_changes(*_runs(spark, d), "l_orderkey")


@query("win02_signed_ranks", f"""WITH {_RUNS}, d AS (SELECT y - x AS diff FROM a WHERE y <> x),
r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS rank FROM d)
SELECT 'm' AS metric, count(*) AS n, sum(rank) FILTER (diff > 0)::DOUBLE AS w_plus,
       round(((sum(rank) FILTER (diff > 0) - count(*)::DOUBLE * (count(*) + 1) / 4) / sqrt(count(*)::DOUBLE * (count(*) + 1) * (2 * count(*) + 1) / 24))::DOUBLE, 6) AS z FROM r
""")
def signed_ranks(spark, d):
    diffs = evaluation.paired(*_runs(spark, d), "l_orderkey")
    return evaluation.signed_ranks(diffs, ["metric"]).withColumn("z", F.round("z", 6))


@query("agg13_threshold_sweep", """
SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (s >= t / 100.0 AND p) AS tp, count(*) FILTER (s >= t / 100.0 AND NOT p) AS fp, count(*) FILTER (s < t / 100.0 AND p) AS fn, count(*) FILTER (s < t / 100.0 AND NOT p) AS tn
FROM (SELECT l_discount * 10 AS s, l_returnflag = 'R' AS p FROM lineitem), (SELECT unnest([5, 25, 55, 95]) AS t) GROUP BY t
""")
def threshold_sweep(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return evaluation.threshold_sweep(pairs, "s", F.col("p"), [0.05, 0.25, 0.55, 0.95]).select("threshold", "tp", "fp", "fn", "tn")


@query("agg15_median_score", "SELECT user_id, round_even(median(value), 0)::BIGINT AS median, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id")
def median_score(spark, d):
    return evaluation.median_score(table(spark, d, "events").where("value is not null"), ["user_id"], "value")


# ---------------------------------------------------------------- gold sets


@query("win11_round_robin", "SELECT doc_id, lang, turn::INT AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def round_robin(spark, d):
    return goldset.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("agg18_frequent_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([A-Za-z]+)', 1)) AS word FROM documents) GROUP BY word HAVING count(*) >= 8 ORDER BY n DESC, word LIMIT 500")
def frequent_words(spark, d):
    return goldset.frequent_words(table(spark, d, "documents"), "text", 8, 500)


@query("flt11_candidates", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND trim(text) <> '' AND length(text) BETWEEN 200 AND 4000")
def candidates(spark, d):
    return goldset.candidates(table(spark, d, "documents"), "text", "lang", ["en", "de"], 200, 4000).select("doc_id", "lang")


@query("flt14_identifier_leak", f"""
WITH p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS s FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')
SELECT conv_id, turn, list_has_any(list_filter(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]{{3,}}'), lambda x: lower(x) NOT IN ({_COMMON})), regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+')) AS leaks FROM p
""")
def identifier_leak(spark, d):
    turns = table(spark, d, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s"))
    return users.join(replies, ["conv_id", "turn"]).select("conv_id", "turn", goldset.identifier_leak(F.col("q"), F.col("s")).alias("leaks"))


@query("flt20_gate", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN doc_id % 5 = 0 THEN 'pointing' END AS reason FROM documents")
def gate(spark, d):
    docs = table(spark, d, "documents").withColumn("q", F.concat(F.lit("what is "), F.when(F.col("doc_id") % 5 == 0, "this module").otherwise("this")))
    return goldset.gate(docs, [("short", F.col("n_chars") >= 300), ("language", F.col("lang") == "en"), ("pointing", ~goldset.points_at_text(F.col("q")))]).select("doc_id", "reason")


# ---------------------------------------------------------------- sync


@query("fn44_lower_bound", "SELECT event_id, strftime(date_trunc('minute', ts) - INTERVAL 1440 MINUTE, '%Y-%m-%d %H:%M') AS since FROM events")
def lower_bound(spark, d):
    return table(spark, d, "events").select("event_id", sync.lower_bound(sync.watermark_text(F.col("ts")), 1440).alias("since"))


@query("set01_fetch_plan", """
WITH c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0), p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0),
g AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'), r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0),
a AS (SELECT id FROM c UNION SELECT id FROM p)
SELECT id, reason FROM (SELECT id, CASE WHEN id IN (FROM c) AND id NOT IN (FROM p) THEN 'new' WHEN id IN (FROM c) AND id IN (FROM g) THEN 'changed'
  WHEN id IN (FROM c) AND id IN (FROM r) THEN 'retry' WHEN id NOT IN (FROM c) THEN 'removed' END AS reason FROM a) WHERE reason IS NOT NULL
""")
def fetch_plan(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    changed = table(spark, d, "lineitem").where("l_shipdate >= timestamp'1998-01-01'").select(F.col("l_orderkey").alias("id"))
    return sync.fetch_plan(orders.where("id % 4 <> 0"), orders.where("id % 3 <> 0"), changed, orders.where("id % 17 = 0"), "id")


@query("top06_audit_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def audit_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return sync.last_of(rows, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("snk24_membership_upsert", "SELECT l_suppkey AS target_id, l_partkey AS page_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS depth FROM lineitem GROUP BY 1, 2")
def membership_upsert(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target_id"), F.col("l_partkey").alias("page_id"), "l_returnflag")
    old = items.where("l_returnflag <> 'R'").select("target_id", "page_id", F.lit(0).alias("depth")).distinct()
    new = items.where("l_returnflag = 'R'").select("target_id", "page_id", F.lit(1).alias("depth")).distinct()
    return sync.upsert_membership(old, new, ["target_id", "page_id"])


@query("src16_subtree", """
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 3 AS parent_id FROM part WHERE p_partkey > 0), t AS (SELECT id, parent_id, 1 AS depth FROM p WHERE parent_id = 1 AND id <> 1
  UNION ALL SELECT p.id, p.parent_id, depth + 1 FROM p JOIN t ON p.parent_id = t.id WHERE depth < 6)
SELECT id, parent_id, depth FROM t
""")
def subtree(spark, d):
    pages = table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent_id"))
    return sync.subtree(pages, 1, 6)


# ---------------------------------------------------------------- expansion


@query("exp06_char_windows", """
SELECT doc_id, i::INT AS chunk_index, substr(text, (i * 400 + 1)::BIGINT, 500) AS content, length(substr(text, (i * 400 + 1)::BIGINT, 500))::INT AS token_count
FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)
""")
def char_windows(spark, d):
    return chunking.windows(table(spark, d, "documents"), "doc_id", "text", 500, 100)


@query("exp22_visible_text", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", parsing.visible_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- lookups, listings, maintenance


@query("src12_changed_files", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM (SELECT p_partkey AS id, p_size AS h FROM part WHERE p_partkey % 10 <> 0) a FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 8 <> 0) b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.h <> b.h
""")
def changed_files(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("content_hash"))
    now = parts.where("id % 8 <> 0").withColumn("content_hash", F.when(F.col("id") % 9 == 0, F.col("content_hash") + 1).otherwise(F.col("content_hash")))
    return documents.detect_changes(parts.where("id % 10 <> 0"), now, ["id"]).where("change_type <> 'unchanged'").select("id", "change_type")


@query("top05_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_first(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderdate")


@query("snk19_graph_cleanup", """
WITH l AS (SELECT DISTINCT l_orderkey AS node_id, l_suppkey AS document_id FROM lineitem)
SELECT DISTINCT node_id FROM l WHERE document_id IN (3, 5) AND node_id NOT IN (SELECT node_id FROM l WHERE document_id NOT IN (3, 5))
""")
def graph_cleanup(spark, d):
    """Nodes of deleted documents that no other document links to."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("document_id"))
    return documents.orphans(links, "document_id", "node_id", F.col("document_id").isin(3, 5)).select("node_id")


@query("join15_calibration_pairs", """
WITH n AS (SELECT p_partkey AS id, p_brand AS t, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS s FROM part)
SELECT a.id AS "left", b.id AS "right", CASE WHEN a.t <> b.t THEN 'type_drift' WHEN a.s = b.s THEN 'positive' ELSE 'alias' END AS kind FROM n a JOIN n b ON a.id < b.id AND a.s <> '' AND b.s <> ''
  AND (a.s = b.s OR a.t = b.t AND (contains(a.s, b.s) OR contains(b.s, a.s) OR length(a.s) >= 4 AND length(b.s) >= 4 AND substr(a.s, 1, 4) = substr(b.s, 1, 4)))
""")
def calibration_pairs(spark, d):
    from ..operators import matching

    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("entity_name"))
    return matching.alias_pairs(nodes)


@query("udf01_assembled_context")
def assembled_context(spark, d):
    from ..operators import assembly

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), "embedding", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"))
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    edges = vectors.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return assembly.assemble(vectors, docs, edges, vectors.select("id", "embedding"), vectors.select(F.col("id").alias("node"), "document_id"), _vector(spark, d), k=5, threshold=0.1)


# ---------------------------------------------------------------- extraction


_PRINT = """
WITH h AS (SELECT sha256({row}) AS h FROM {table}),
s AS (SELECT count(*) AS n_rows, """ + ", ".join(f"coalesce(sum(('0x' || substr(h, {at}, 8))::BIGINT), 0)::VARCHAR AS s{k}" for k, at in enumerate(range(1, 65, 8))) + """ FROM h)
SELECT sha256(concat_ws(',', n_rows::VARCHAR, s0, s1, s2, s3, s4, s5, s6, s7)) AS fingerprint, n_rows FROM s
"""



@query("agg25_fingerprint", _PRINT.format(row="p_partkey::VARCHAR || chr(31) || p_name || chr(31) || p_brand", table="part"))
def graph_fingerprint(spark, d):
    return graph.fingerprint(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand"])


@query("agg30_edge_fingerprint", _PRINT.format(row="l_partkey::VARCHAR || chr(31) || l_suppkey || chr(31) || l_returnflag", table="lineitem"))
def edge_fingerprint(spark, d):
    return graph.fingerprint(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("agg28_combined_fingerprint", f"SELECT a.fingerprint AS vectors, b.fingerprint AS corpus, sha256(a.fingerprint || ',' || b.fingerprint) AS fingerprint FROM ({_PRINT.format(row='vec_id::VARCHAR', table='embeddings')}) a, ({_PRINT.format(row='doc_id::VARCHAR', table='documents')}) b")
def combined_fingerprint(spark, d):
    return graph.combined(vectors=graph.fingerprint(table(spark, d, "embeddings"), ["vec_id"]), corpus=graph.fingerprint(table(spark, d, "documents"), ["doc_id"]))


@query("agg26_vector_fingerprint", _PRINT.format(row="vec_id::VARCHAR || chr(31) || label", table="embeddings"))
def vector_fingerprint(spark, d):
    return graph.fingerprint(table(spark, d, "embeddings"), ["vec_id", "label"])


@query("agg27_corpus_fingerprint", _PRINT.format(row="doc_id::VARCHAR || chr(31) || sha256(text)", table="documents"))
def corpus_fingerprint(spark, d):
    return graph.fingerprint(table(spark, d, "documents").withColumn("content_hash", T.content_hash(F.col("text"))), ["doc_id", "content_hash"])


# ---------------------------------------------------------------- more text functions


@query("fn21_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_type")).alias("slug"))


@query("fn58_block_flags", "SELECT p_partkey, p_size % 3 = 0 AS has_table, p_size % 3 = 1 AS has_code, 'intro ' || p_name AS lead FROM part")
def block_flags(spark, d):
    size = F.col("p_size") % 3
    body = F.when(size == 0, "| a | b |\n|---|---|\n| 1 | 2 |").when(size == 1, "```\nx = 1\n```").otherwise("plain | text")
    text = F.concat(F.lit("intro "), F.col("p_name"), F.lit("\n\n# Head\n"), body)
    return table(spark, d, "part").select("p_partkey", T.has_table(text).alias("has_table"), T.has_code_block(text).alias("has_code"), T.lead_paragraph(text).alias("lead"))


@query("fn45_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders")
def numbers(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("None")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.number(text).alias("value"))


@query("flt22_entity_types", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'concept' ELSE 'team' END AS entity_type FROM part")
def entity_types(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("struct", "policy", "team"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", graph.canonical(kind, graph.ENTITY_ALIASES).alias("entity_type"))


@query("top02_entity_search", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings WHERE {_COS} >= 0.25 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def entity_search(spark, d):
    found = retrieval.nearest(table(spark, d, "embeddings"), _vector(spark, d), 5, "vec_id", "embedding").where("similarity >= 0.25")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


from . import evaluate, graphs, models, scalars, storage, syncs, texts  # noqa: E402, F401
