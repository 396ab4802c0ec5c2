"""Queries of graphs: seeds, neighbourhoods, texts, schemas, matching, what models find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction, graph, matching, retrieval
from .base import query, rows, table

_NODE = "id long, entity_name string, entity_type string, description string"
_NODES = [(1, "Auth Service", "system", "checks tokens"), (2, "f.py::auth-service", "function", None), (3, "f.py::K.AuthService", "method", ""), (4, "Store", "system", None), (5, "Team X", "team", None), (6, "Lone", "", None)]
_EDGES = [(1, 2, 1, "calls", ""), (2, 3, 2, "contains", ""), (3, 4, 1, "calls", "reads"), (4, 4, 5, "owned_by", "")]


def _edges(df):
    return df.sparkSession.createDataFrame(_EDGES, "edge_id int, src long, dst long, relation_type string, label string")


def _from(df, *ids):
    return df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, rank int")


class _Flaky:
    """Fails twice, then gives a vector for each text."""

    def __init__(self) -> None:
        self.left = 2

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.left:
            self.left -= 1
            raise OSError("busy")
        return [[1.0] for _ in texts]


rows("set04_resolved_seeds", _NODE, _NODES, "id, tier", [(1, 0), (2, 1), (3, 2)], lambda df: graph.resolved(df, "AUTH_service"))
rows("grf07_neighbours", _NODE, _NODES, "id", [(1,), (2,), (3,), (4,)], lambda df: graph.hops(_edges(df), graph.seeds(df, "auth service"), 1))
rows("grf07_fallback_seeds", _NODE, _NODES, "id", [(4,), (5,)], lambda df: graph.seeds(df, "unknown", df.select("id", (F.col("id") / 10 + 0.2).alias("similarity")).where("id < 6"), 0.55, 3))
rows("grf08_neighbours_of_node", _NODE, _NODES, "id, hop", [(4, 0), (1, 1), (5, 1)], lambda df: graph.hops(_edges(df), _from(df, 4), 1))
rows("grf09_component_of_name", _NODE, _NODES, "id, hop, is_seed", [(5, 0, True), (4, 1, False), (1, 2, False), (2, 3, False)], lambda df: graph.explored(df, _edges(df), graph.seeds(df, "team x"), 4)[0])
rows("grf17_explored_edges", _NODE, _NODES, "src, dst, relation_type", [(4, 1, "calls"), (4, 5, "owned_by")], lambda df: graph.explored(df, _edges(df), graph.seeds(df, "team x"), 3)[1])
rows("set07_searched_nodes", _NODE, _NODES, "id, is_seed", [(4, True), (1, False), (5, False)], lambda df: graph.searched(df, _edges(df), df.select(F.col("id").alias("node_id"), F.col("id").alias("document_id")), _from(df, 4))[0])
rows("set07_searched_documents", _NODE, _NODES, "document_id", [(0,), (1,)], lambda df: graph.searched(df, _edges(df), df.select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("document_id")), _from(df, 4))[2])
rows("grf11_entity_refs", _NODE, _NODES, "name, type, description", [
    ("Auth Service", "system", "checks tokens"), ("f.py::auth-service", "function", "function 유형의 'f.py::auth-service' 은(는) Auth Service 에 대해 calls, f.py::K.AuthService 가(이) contains 관계를 가진다."),
    ("f.py::K.AuthService", "method", "method 유형의 'f.py::K.AuthService' 은(는) f.py::auth-service 에 대해 contains 관계를 가진다."), ("Store", "system", "system 유형의 'Store' 은(는) Auth Service 에 대해 calls, Team X 에 대해 owned_by 관계를 가진다."),
    ("Team X", "team", "team 유형의 'Team X' 은(는) Store 가(이) owned_by 관계를 가진다."), ("Lone", "", "이 entity 는 'Lone' 이며 그래프 노드로 등록되어 있다."),
], lambda df: graph.entity_refs(df.withColumn("pos", F.col("id")), _edges(df)))
rows("grf12_relation_refs", _NODE, _NODES, "source, target, relation_type, description", [("f.py::auth-service", "Auth Service", "calls", "f.py::auth-service calls Auth Service"), ("f.py::K.AuthService", "f.py::auth-service", "contains", "f.py::K.AuthService contains f.py::auth-service"), ("Store", "Auth Service", "calls", "reads"), ("Store", "Team X", "owned_by", "Store owned_by Team X")], lambda df: graph.relation_refs(df, _edges(df)))
rows("grf13_context_text", _NODE, _NODES, "text", [("## 관련 그래프 컨텍스트\n\n**엔티티:**\n- Store (system) *\n- Auth Service (system) — checks tokens\n- Team X (team)\n\n**관계:**\n- Store --[calls]--> Auth Service (reads)\n- Store --[owned_by]--> Team X",)], lambda df: graph.context_text(*graph.searched(df, _edges(df), df.select(F.col("id").alias("node_id"), F.col("id").alias("document_id")), _from(df, 4))[:2]))
rows("grf15_schema_text", _NODE, _NODES[:5], "text", [("# 지식 그래프 구조 (노드: 5개, 엣지: 4개)\n\n## 엔티티 유형별 목록\n- **system** (2개): Auth Service (외 1개)\n- **function** (1개): f.py::auth-service\n- **method** (1개): f.py::K.AuthService\n- **team** (1개): Team X\n\n## 관계 유형\n- calls: 2건\n- contains: 1건\n- owned_by: 1건\n\n## 관계 예시\n- f.py::auth-service --[calls]--> Auth Service\n- f.py::K.AuthService --[contains]--> f.py::auth-service",)], lambda df: graph.schema_text(df, _edges(df), 1, 2))
rows("grf15_empty_schema_text", _NODE, [], "text", [("그래프가 비어 있습니다.",)], lambda df: graph.schema_text(df, _edges(df).limit(0)))
rows("agg29_near_schema", _NODE, _NODES, "entity_type, n, names", [("system", 2, ["Auth Service", "Store"]), ("team", 1, ["Team X"])], lambda df: graph.near_schema(df, _edges(df), _from(df, 4), 1)[0])
rows("grf16_near_schema_relations", _NODE, _NODES, "relation_type, n", [("calls", 1), ("contains", 1)], lambda df: graph.near_schema(df, _edges(df), _from(df, 3), 2)[1])
rows("grf26_node_payloads", _NODE, _NODES[:1], "payload", [('{"id":1,"label":"Auth Service","type":"system","description":"checks tokens"}',)], lambda df: df.select(F.to_json(F.struct("id", F.col("entity_name").alias("label"), F.col("entity_type").alias("type"), "description")).alias("payload")))
rows("grf29_edge_payloads", _NODE, _NODES[:1], "payload", [('{"source":4,"target":1,"type":"calls","label":"reads"}',)], lambda df: _edges(df).where("edge_id = 3").select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation_type").alias("type"), "label")).alias("payload")))
rows("grf14_missing_vectors", _NODE, _NODES, "id, text", [(2, "auth-service"), (3, "K.AuthService"), (5, "Team X"), (6, "Lone")], lambda df: retrieval.unembedded(df, df.where("id in (1, 4)")))
rows("grf27_embedded_batches", _NODE, _NODES, "id, n, failed", [(2, 12, False), (3, 13, False), (5, None, True), (6, 4, False)], lambda df: retrieval.embedded(retrieval.unembedded(df, df.where("id in (1, 4)")), "text", lambda texts: [[0.0] * len(t) if t != "Team X" else None for t in texts]).select("id", F.size("vector").alias("n"), F.col("vector").isNull().alias("failed")).withColumn("n", F.when(F.col("n") >= 0, F.col("n"))))
rows("grf28_retried_batches", _NODE, _NODES[:2], "id, n", [(1, 1), (2, 1)], lambda df: retrieval.embedded(df.withColumn("text", F.col("entity_name")), "text", _Flaky(), pause=0.0).select("id", F.size("vector").alias("n")))
rows("grf30_merge_log", "document_id long, ordinal int, entity_name string, entity_type string, description string", [(1, 0, "Auth", "struct", None), (2, 0, "Auth", "class", None), (2, 1, "AUTH", "class", None), (3, 0, "Other", "class", None)], "document_id, ordinal, merge_method", [(1, 0, "new"), (2, 0, "exact"), (2, 1, "normalized"), (3, 0, "new")], graph.merge_log)
rows("join14_candidate_subgraphs", _NODE, _NODES, "id, document_ids, primary_document_id, n_edges", [(1, [1, 11], 1, 2), (4, [4, 14], 4, 2)], lambda df: graph.candidate_subgraphs(df, _edges(df), df.select(F.col("id").alias("node_id"), F.explode(F.array("id", F.col("id") + 10)).alias("document_id"), F.when(F.col("id") == 2, "other").otherwise("page").alias("source_type")), ["page"], 2).withColumn("n_edges", F.size("edges")))


# ---------------------------------------------------------------- matching

_GOLD = "query_id int, gold string, type string, aliases array<string>, vector array<double>"
_GOLDS = [(1, "Auth Service", "system", ["Login"], [1.0, 0.0]), (1, "Token-Store", "system", [], None), (1, "Team", "team", [], [0.0, 1.0]), (1, "Gone", "x", [], [-1.0, 0.0]), (2, "A", "t", ["", "Bee"], None), (2, "lower", "t", [], None)]


def _retrieved(df):
    found = [(1, "login", "system", [0.0, 0.0], 0), (1, "token store", "system", None, 1), (1, "Group", "other", [0.1, 1.0], 2), (2, "bee", "t", None, 0), (2, " LOWER ", "t", None, 1), (2, "lower", "other", None, 2)]
    return df.sparkSession.createDataFrame(found, "query_id int, name string, type string, vector array<double>, rank int")


rows("grf22_tiered_entities", _GOLD, _GOLDS, "query_id, gold, tier, rank, score", [(1, "Auth Service", "alias", 0, 1.0), (1, "Token-Store", "normalize", 1, 0.9), (1, "Team", "embedding", 2, 0.995037), (1, "Gone", "none", None, 0.0), (2, "A", "alias", 0, 1.0), (2, "lower", "exact", 1, 1.0)], lambda df: matching.tiered(df, _retrieved(df)).withColumn("score", F.round("score", 6)))
rows("grf22_strict_entities", _GOLD, _GOLDS, "query_id, gold, tier", [(1, "Auth Service", "none"), (1, "Token-Store", "none"), (1, "Team", "none"), (1, "Gone", "none"), (2, "A", "none"), (2, "lower", "exact")], lambda df: matching.tiered(df, _retrieved(df), strict=True))
rows("grf23_entity_reports", _GOLD, _GOLDS, "query_id, matched, surface, indices, least_score", [(1, ["auth service", "token-store", "team"], ["auth service", "token-store"], [0, 1, 2], 0.9), (2, ["a", "lower"], ["a", "lower"], [0, 1], 1.0)], lambda df: matching.report(matching.tiered(df, _retrieved(df)), F.lower("gold")))
rows("agg08_tier_totals", _GOLD, _GOLDS, "tier, n", [("alias", 2), ("normalize", 1), ("embedding", 1), ("exact", 1), ("none", 1)], lambda df: matching.tier_counts(matching.tiered(df, _retrieved(df))))
_RELATION = "query_id int, source string, target string, type string, vector array<double>"
_RELATIONS = [(1, "A", "B", "calls", [1.0, 0.0]), (1, "A", "C", "owns", [0.0, 1.0]), (1, "B", "A", "calls", None)]


def _found_relations(df):
    return df.sparkSession.createDataFrame([(1, "a ", "b", "calls", None, 0), (1, "A", "c", "has", [0.0, 2.0], 1), (1, "A", "C", "uses", [1.0, 1.0], 2), (1, "B", "A", "uses", [1.0, 0.0], 3)], _RELATION + ", rank int")


rows("grf24_tiered_relations", _RELATION, _RELATIONS, "source, target, tier, rank, score", [("A", "B", "exact", 0, 1.0), ("A", "C", "embedding", 1, 1.0), ("B", "A", "none", None, 0.0)], lambda df: matching.tiered_relations(df, _found_relations(df)))
rows("grf25_relation_reports", _RELATION, _RELATIONS, "query_id, matched, surface, mean_score", [(1, ["a-b-calls", "a-c-owns"], ["a-b-calls"], 1.0)], lambda df: matching.report(matching.tiered_relations(df, _found_relations(df)), F.concat_ws("-", F.lower("source"), F.lower("target"), "type")))

# ---------------------------------------------------------------- what models find in units

_ANSWER = '```json\n{"entities": [{"name": "Auth Service", "type": "system", "description": "d"}, {"name": "auth service", "type": "system"}, {"name": "X", "type": "odd"}, {"name": ""}], "relations": [{"source": "AUTH SERVICE", "target": "Team X", "type": "owned_by", "label": "l"}, {"source": "Auth Service", "target": "Team X", "type": "invented"}, {"source": "Auth Service", "target": "Nobody", "type": "calls"}]}\n```'
_MORE = '{"entities": [{"name": "Team X", "type": "team"}, {"name": "AUTH service", "type": "system", "description": "later"}]}'
_UNITS = "doc long, unit int, answer string"
rows("grf19_model_entities", _UNITS, [(1, 0, _ANSWER), (1, 1, _MORE), (1, 2, "no json"), (2, 0, _MORE)], "doc, name, entity_type, description", [(1, "Auth Service", "system", "d"), (1, "Team X", "team", ""), (2, "Team X", "team", ""), (2, "AUTH service", "system", "later")], lambda df: extraction.model_entities(df, "doc", "unit", "answer"))
rows("grf20_model_relations", _UNITS, [(1, 0, _ANSWER), (1, 1, _MORE)], "doc, source, target, relation_type, label", [(1, "Auth Service", "Team X", "owned_by", "l")], lambda df: extraction.model_relations(df, "doc", "unit", "answer"))
rows("grf21_canonical_names", "doc long, unit int, name string", [(1, 0, "Auth Service"), (1, 1, "AUTH SERVICE"), (1, 2, "Other"), (2, 0, "auth service")], "doc, unit, canonical", [(1, 0, "Auth Service"), (1, 1, "Auth Service"), (1, 2, "Other"), (2, 0, "auth service")], lambda df: extraction.canonical_names(df, "doc", "unit", "name"))


@query("top04_full_graph", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY n DESC, id LIMIT 30) SELECT src, dst FROM e WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def full_graph(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.induced(edges, graph.top_by_degree(edges, 30)).select("src", "dst")
