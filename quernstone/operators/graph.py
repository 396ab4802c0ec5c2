"""Entity graph: vocabulary, merge, neighbourhoods, components, schema, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.graphtext import ENTITY_ALIASES, RELATION_ALIASES, edge_line
from ..functions.text import normalized_name, scoped_name, short_name
from ..sources.shared import checkpointed

#: Relations whose alias changes direction.
SWAPPED = ("documented_in",)


def canonical(column: Column, aliases: dict[str, str]) -> Column:
    out = column
    for k, v in aliases.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def canonical_relations(relations: DataFrame, aliases: dict[str, str] | None = None, swapped: tuple[str, ...] = SWAPPED) -> DataFrame:
    """(source, target, relation_type, ...) with aliases resolved and the ends of swapped relations exchanged."""
    swap = F.col("relation_type").isin(*swapped)
    return relations.withColumns({
        "source": F.when(swap, F.col("target")).otherwise(F.col("source")),
        "target": F.when(swap, F.col("source")).otherwise(F.col("target")),
        "relation_type": canonical(F.col("relation_type"), RELATION_ALIASES if aliases is None else aliases),
    })


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Nodes from mentions (document_id, ordinal, entity_name, entity_type, description).

    Mentions merge on normalised name and canonical type; a name that normalises to
    nothing stays itself.  The first mention by document and ordinal gives the
    spelling, the first with a description the description.
    """
    norm = normalized_name(F.col("entity_name"))
    rows = mentions.withColumn("entity_type", canonical(F.col("entity_type"), ENTITY_ALIASES)).withColumn("normalized_name", F.when(norm == "", F.col("entity_name")).otherwise(norm))
    at = F.struct("document_id", "ordinal")
    described = F.when(F.trim("description") != "", F.struct("document_id", "ordinal", "description"))
    return rows.groupBy("normalized_name", "entity_type").agg(
        F.min_by("entity_name", at).alias("entity_name"), F.min("document_id").alias("document_id"), F.min(described)["description"].alias("description"),
        F.count_distinct("document_id").alias("n_documents"), F.count_distinct("entity_name").alias("n_variants"), F.count("*").alias("n_mentions"),
    )


def merge_log(mentions: DataFrame) -> DataFrame:
    """The mentions with their key and ``merge_method``: new for the first of a node, exact if spelt as that one, else normalized."""
    norm = normalized_name(F.col("entity_name"))
    rows = mentions.withColumn("entity_type", canonical(F.col("entity_type"), ENTITY_ALIASES)).withColumn("normalized_name", F.when(norm == "", F.col("entity_name")).otherwise(norm))
    first = rows.groupBy("normalized_name", "entity_type").agg(F.min(F.struct("document_id", "ordinal", "entity_name")).alias("_first"))
    at = (F.col("document_id") == F.col("_first.document_id")) & (F.col("ordinal") == F.col("_first.ordinal"))
    method = F.when(at, "new").when(F.col("entity_name") == F.col("_first.entity_name"), "exact").otherwise("normalized")
    return rows.join(first, ["normalized_name", "entity_type"]).withColumn("merge_method", method).drop("_first")


def merge_groups(mentions: DataFrame, min_variants: int = 2) -> DataFrame:
    """Nodes with several spellings or documents, most first."""
    return merge_entities(mentions).where(F.greatest("n_variants", "n_documents") >= min_variants)


def sound_edges(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Edges both of whose ends exist, one of each (src, dst, relation_type, document_id)."""
    ids = nodes.select(node_id)
    out = edges.join(ids.select(F.col(node_id).alias("src")), "src", "left_semi").join(ids.select(F.col(node_id).alias("dst")), "dst", "left_semi")
    return out.dropDuplicates([c for c in ("src", "dst", "relation_type", "document_id") if c in edges.columns])


def induced(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(node_id).distinct()
    return edges.join(ids.select(F.col(node_id).alias("src")), "src", "left_semi").join(ids.select(F.col(node_id).alias("dst")), "dst", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(edges: DataFrame, sources: DataFrame, depth: int, node_id: str = "id") -> DataFrame:
    """(id, hop): nodes within ``depth`` steps in either direction.

    Each step joins the frontier alone, leaves out what was seen and is
    checkpointed; the walk ends early where nothing new is reached.
    """
    near = both_ways(edges)
    front = seen = checkpointed(sources.select(F.col(node_id).alias("id")).distinct().withColumn("hop", F.lit(0)))
    for step in range(1, depth + 1):
        reached = near.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = checkpointed(reached.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def component(edges: DataFrame, sources: DataFrame, max_nodes: int = 500, max_depth: int = 20, node_id: str = "id") -> DataFrame:
    """The first ``max_nodes`` nodes, by hop and id, that sources reach."""
    return hops(edges, sources, max_depth, node_id).orderBy("hop", "id").limit(max_nodes)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_by_degree(edges: DataFrame, k: int = 300) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def disjoint_seeds(edges: DataFrame, node_docs: DataFrame, k: int | None) -> DataFrame:
    """Edges whose ends share no document: (src, dst, src_doc, dst_doc) by the smallest document of each end, first k or, without a k, all."""
    docs = lambda c: node_docs.select(F.col("node").alias(c), "document_id")
    pairs = edges.select("src", "dst").distinct()
    shared = pairs.join(docs("src"), "src").join(docs("dst"), ["dst", "document_id"]).select("src", "dst").distinct()
    least = lambda c: node_docs.groupBy(F.col("node").alias(c)).agg(F.min("document_id").alias(f"{c}_doc"))
    seeds = pairs.join(shared, ["src", "dst"], "left_anti").join(least("src"), "src").join(least("dst"), "dst")
    return seeds if k is None else seeds.orderBy("src", "dst").limit(k)


def schema_summary(nodes: DataFrame, names: int) -> DataFrame:
    """Entity types with counts and their first names."""
    order = W.partitionBy("entity_type").orderBy("entity_name")
    first = nodes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= names).groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("entity_name")), ", ").alias("names"))
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n")).join(first, "entity_type")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and a SHA-256 over the sums of their hashes, whatever their order.

    The hash of each row is cut into parts of 32 bits; sums of these and their
    number are combined in every task, so no task holds more than a row.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    parts = [F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(38,0)")) for at in range(1, 65, 8)]
    sums = rows.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *(F.coalesce(p, F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i, p in enumerate(parts)))
    return sums.select(F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *(f"s{i}" for i in range(8))), 256).alias("fingerprint"), "n_rows")


def combined(**prints: DataFrame) -> DataFrame:
    """One row with a column for each fingerprint and a SHA-256 over all."""
    out = None
    for name, df in prints.items():
        own = df.select(F.col("fingerprint").alias(name))
        out = own if out is None else out.join(own)
    return out.withColumn("fingerprint", F.sha2(F.concat_ws(",", *prints), 256))


def resolved(nodes: DataFrame, name: str, most: int = 10) -> DataFrame:
    """(id, tier) of the nodes that a name may mean: whole names first, then scoped, then short ones; at most so many."""
    key = normalized_name(F.lit(name))
    own = lambda c: normalized_name(c) == key
    whole = F.col("entity_name")
    tier = F.when(own(whole), 0).when(own(scoped_name(whole)), 1).when(own(short_name(whole)), 2)
    return nodes.where(key != "").select("id", tier.alias("tier")).where("tier is not null").orderBy("tier", "id").limit(most)


def seeds(nodes: DataFrame, name: str, near: DataFrame | None = None, threshold: float = 0.5, k: int = 3, most: int = 10) -> DataFrame:
    """(id) of the nodes that a name means, or, if none does, of the ``k`` nearest of (id, similarity)."""
    found = resolved(nodes, name, most).select("id")
    if near is None or not found.isEmpty():
        return found
    return near.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(k).select("id")


def explored(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_nodes: int = 500, max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop and is_seed, edges between them) that can be reached from the start."""
    reached = component(edges, start, max_nodes, max_depth)
    return nodes.join(reached, "id").withColumn("is_seed", F.col("hop") == 0), induced(edges, reached)


def outgoing(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id) of what edges lead to from the start within ``depth`` steps, the start included."""
    seen = front = checkpointed(start.select("id").distinct())
    for _ in range(depth):
        front = checkpointed(edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def near_schema(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """((entity_type, n, names), (relation_type, n)) of what edges lead to from the start."""
    ids = outgoing(edges, start, depth)
    types = nodes.join(ids, "id", "left_semi").groupBy("entity_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("entity_name")).alias("names"))
    return types, induced(edges, ids).groupBy("relation_type").agg(F.count("*").alias("n"))


def _lines(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """One row: the lines of a short table, in order."""
    keyed = F.array_sort(F.collect_list(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), line.alias("line"))))
    return rows.agg(F.array_join(F.transform(keyed, lambda r: r["line"]), "\n").alias("text"))


def schema_text(nodes: DataFrame, edges: DataFrame, names: int = 10, examples: int = 10) -> DataFrame:
    """One row: the graph's types with their first names, its relations and examples, as text."""
    first = nodes.withColumn("_n", F.row_number().over(W.partitionBy("entity_type").orderBy("id"))).where(F.col("_n") <= names)
    listed = first.groupBy("entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "entity_name"))), lambda r: r["entity_name"]).alias("names"))
    types = nodes.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("id").alias("first")).join(listed, "entity_type")
    more = F.when(F.col("n") > F.size("names"), F.format_string(" (외 %d개)", F.col("n") - F.size("names"))).otherwise("")
    entity = F.concat(F.format_string("- **%s** (%d개): ", "entity_type", "n"), F.array_join("names", ", "), more)
    relation = edges.groupBy("relation_type").agg(F.count("*").alias("n"))
    ends = edges.orderBy("src", "dst", "relation_type").limit(examples).join(nodes.select(F.col("id").alias("src"), F.col("entity_name").alias("_s")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("entity_name").alias("_d")), "dst")
    head = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    parts = [
        _lines(types, [F.col("first")], entity).select(F.concat(F.lit("\n\n## 엔티티 유형별 목록\n"), "text").alias("a")),
        _lines(relation, [-F.col("n"), F.col("relation_type")], F.format_string("- %s: %d건", "relation_type", "n")).select(F.when(F.col("text") != "", F.concat(F.lit("\n\n## 관계 유형\n"), "text")).otherwise("").alias("b")),
        _lines(ends, [F.col("src"), F.col("dst"), F.col("relation_type")], edge_line(F.col("_s"), F.col("relation_type"), F.col("_d"))).select(F.when(F.col("text") != "", F.concat(F.lit("\n\n## 관계 예시\n"), "text")).otherwise("").alias("c")),
    ]
    for p in parts:
        head = head.join(p)
    return head.select(F.when(F.col("nodes") == 0, "그래프가 비어 있습니다.").otherwise(F.concat(F.format_string("# 지식 그래프 구조 (노드: %d개, 엣지: %d개)", "nodes", "edges"), "a", "b", "c")).alias("text"))


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = lambda c, n: nodes.select(F.col("id").alias(c), F.col("entity_name").alias(n))
    return edges.join(ends("src", "source"), "src").join(ends("dst", "target"), "dst")


def entity_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, description) of found nodes, the first by ``pos`` of each name and type; without a description one is made of up to three edges each way."""
    e = _named(edges, nodes)
    few = lambda key, other, phrase: e.groupBy(F.col(key).alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("edge_id", phrase(F.col(other)).alias("p")))), 1, 3).alias("l")).select("id", F.transform("l", lambda x: x["p"]).alias(f"_{key}"))
    outs = few("src", "target", lambda t: F.concat(t, F.lit(" 에 대해 "), F.col("relation_type")))
    ins = few("dst", "source", lambda t: F.concat(t, F.lit(" 가(이) "), F.col("relation_type")))
    none = F.array().cast("array<string>")
    rows = nodes.where("entity_name <> ''").join(outs, "id", "left").join(ins, "id", "left").withColumn("_p", F.concat(F.coalesce("_src", none), F.coalesce("_dst", none)))
    kind, name = F.coalesce("entity_type", F.lit("")), F.col("entity_name")
    hint = F.when(kind != "", F.concat(kind, F.lit(" 유형의 "))).otherwise("")
    made = F.when(F.size("_p") > 0, F.concat(hint, F.lit("'"), name, F.lit("' 은(는) "), F.array_join("_p", ", "), F.lit(" 관계를 가진다."))).otherwise(F.concat(F.lit("이 entity 는 "), hint, F.lit("'"), name, F.lit("' 이며 그래프 노드로 등록되어 있다.")))
    described = rows.withColumn("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(made))
    first = described.groupBy(F.lower("entity_name").alias("_k"), kind.alias("type")).agg(F.min(F.struct("pos", F.col("entity_name").alias("name"), "description")).alias("m"))
    return first.select("m.name", "type", "m.description")


def relation_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, relation_type, description) of edges between found nodes, the first of each; the label describes it, or else its own words."""
    e = _named(edges, nodes).where("source <> '' and target <> ''")
    text = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.concat_ws(" ", "source", "relation_type", "target"))
    first = e.groupBy(F.lower("source").alias("_s"), F.lower("target").alias("_t"), "relation_type").agg(F.min(F.struct("edge_id", "source", "target", text.alias("description"))).alias("m"))
    return first.select("m.source", "m.target", "relation_type", "m.description")


def context_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: found nodes by ``pos``, seeds with a star, and the edges between them, as text."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    node = F.concat(F.lit("- "), F.col("entity_name"), F.lit(" ("), F.col("entity_type"), F.lit(")"), F.when(F.col("is_seed"), " *").otherwise(""), F.when(there("description"), F.concat(F.lit(" — "), "description")).otherwise(""))
    edge = F.concat(edge_line(F.col("source"), F.col("relation_type"), F.col("target")), F.when(there("label"), F.concat(F.lit(" ("), "label", F.lit(")"))).otherwise(""))
    top = _lines(nodes, [F.col("pos")], node).select(F.col("text").alias("a"))
    low = _lines(_named(edges, nodes), [F.col("edge_id")], edge).select(F.when(F.col("text") != "", F.concat(F.lit("\n\n**관계:**\n"), "text")).otherwise("").alias("b"))
    return top.join(low).select(F.concat(F.lit("## 관련 그래프 컨텍스트\n\n**엔티티:**\n"), "a", "b").alias("text"))


def searched(nodes: DataFrame, edges: DataFrame, links: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with pos and is_seed, edges between them, document ids) of seeds (id, rank) and their neighbours: seeds first by rank, then the others by id."""
    ids = both_ways(edges).join(near.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    found = near.select("id", F.col("rank")).unionByName(ids.join(near, "id", "left_anti").select("id", F.lit(None).cast("int").alias("rank")))
    rows = nodes.join(found, "id").withColumns({"is_seed": F.col("rank").isNotNull(), "pos": F.struct(F.col("rank").isNull(), F.coalesce("rank", F.lit(0)), F.col("id"))}).drop("rank")
    return rows, induced(edges, rows), links.join(rows.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("document_id").distinct()


def candidate_subgraphs(nodes: DataFrame, edges: DataFrame, links: DataFrame, kinds: list[str] | None, least: int = 1) -> DataFrame:
    """(id, entity_name, entity_type, document_ids, primary_document_id, edges) of named nodes with documents, of allowed kinds if given, and at least so many neighbours.

    ``links`` has (node_id, document_id, source_type); edges are structs (source, relation, target) by name.
    """
    docs = links.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"), F.collect_set("source_type").alias("_kinds"))
    docs = docs if kinds is None else docs.where(F.arrays_overlap("_kinds", F.array(*map(F.lit, kinds))))
    named = _named(edges, nodes)
    row = F.struct("source", F.col("relation_type").alias("relation"), "target")
    ends = named.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e"), row.alias("r")).select("e.*", "r")
    around = ends.groupBy("id").agg(F.count_distinct("other").alias("_n"), F.array_sort(F.collect_set("r")).alias("edges")).where(F.col("_n") >= least)
    rows = nodes.where("entity_name <> ''").join(docs.drop("_kinds"), "id").join(around.drop("_n"), "id")
    return rows.select("id", "entity_name", "entity_type", "document_ids", F.array_min("document_ids").alias("primary_document_id"), "edges")
