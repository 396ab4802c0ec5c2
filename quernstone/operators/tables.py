"""Lookups and changes of stored tables, as rewrites of immutable snapshots.

Each change takes a table and a table of changes and returns the table after it;
nothing is done row by row.  A caller writes the result as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import checkpointed


def lookup(table: DataFrame, **equal: object) -> DataFrame:
    """The rows whose columns have the given values; None asks for null.  The filters reach the scan."""
    for column, value in equal.items():
        table = table.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
    return table


def filtered(table: DataFrame, **equal: object) -> DataFrame:
    """As ``lookup``, but an empty or missing value asks for nothing."""
    return lookup(table, **{k: v for k, v in equal.items() if v})


def ids_of(table: DataFrame, column: str, **equal: object) -> DataFrame:
    """The different values of a column of the rows looked up, nulls left out."""
    return lookup(table, **equal).where(F.col(column).isNotNull()).select(column).distinct()


def numbered(rows: DataFrame, keys: list[Column], column: str, after: int = 0) -> DataFrame:
    """The rows with numbers ``after`` + 1, 2, ... in the order of the keys: within range partitions, with the sizes of those before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = checkpointed(rows.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*keys))))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = local.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", before.alias("_before"))  # a row a partition
    return local.join(F.broadcast(offsets), "_p").withColumn(column, (F.col("_before") + F.col("_n") + after).cast("long")).drop("_p", "_n", "_before")


def appended(table: DataFrame, rows: DataFrame, id_col: str, keys: list[str], **defaults: object) -> DataFrame:
    """The table with new rows, whose ids go on after the greatest in the order of ``keys``; columns that they lack have defaults or are null."""
    greatest = table.agg(F.max(id_col)).first()[0] or 0
    new = numbered(rows, [F.col(k) for k in keys], id_col, greatest).withColumns({k: F.lit(v) for k, v in defaults.items() if k not in rows.columns})
    return table.unionByName(new, allowMissingColumns=True).select(*table.columns)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows whose keys it does not have yet, one of each."""
    new = rows.select(*table.columns).dropDuplicates(keys)
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))


def patched(table: DataFrame, changes: DataFrame, keys: list[str], nulls: tuple[str, ...] = ()) -> DataFrame:
    """The table with the columns of ``changes``, one row a key at most; a null changes nothing unless the column is in ``nulls``."""
    own = [c for c in changes.columns if c not in keys]
    both = table.join(changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in own), F.lit(True).alias("_changed")), keys, "left")
    value = lambda c: F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(F.col(f"_{c}"), F.col(c))
    return both.select(*((value(c) if c in own else F.col(c)).alias(c) for c in table.columns))


def bumped(table: DataFrame, changes: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """``patched``, and the counter of every changed row is one more."""
    hit = changes.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return patched(table, changes, keys).join(hit, keys, "left").withColumn(counter, F.col(counter) + F.coalesce("_hit", F.lit(0))).drop("_hit")


def removed(table: DataFrame, gone: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    """The table without the rows whose keys are in ``gone``; a dictionary says which column of the table is which of ``gone``."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    return table.join(gone.select(*(F.col(theirs).alias(own) for own, theirs in names.items())).distinct(), list(names), "left_anti")


def replaced(table: DataFrame, rows: DataFrame, keys: list[str], within: list[str], order: Column) -> DataFrame:
    """The table with all rows of the groups ``within`` given way to those of ``rows``; of equal keys the last by ``order`` stays."""
    rest = [c for c in table.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return removed(table, rows, within).unionByName(last.select(*table.columns))


def upserted(table: DataFrame, rows: DataFrame, keys: dict[str, Column], update: list[str]) -> DataFrame:
    """The table with rows inserted or, where a key is there, the columns ``update`` of theirs; ``keys`` may be expressions, equal where both are null."""
    names = list(keys)
    new = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys.values())})
    old = table.withColumns({f"_k{i}": k for i, k in enumerate(keys.values())})
    ks = [f"_k{i}" for i in range(len(names))]
    changed = old.join(new.select(*ks, *(F.col(c).alias(f"_{c}") for c in update), F.lit(True).alias("_hit")), ks, "left")
    kept = changed.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in table.columns))
    return kept.unionByName(new.join(old.select(*ks), ks, "left_anti").select(*rows.columns), allowMissingColumns=True).select(*table.columns)


# ---------------------------------------------------------------- documents, sources and nodes


def with_cascade(tables: dict[str, DataFrame], gone: DataFrame, owners: dict[str, str], links: str, nodes: str, edges: str) -> dict[str, DataFrame]:
    """All tables after documents (id) are deleted.

    ``owners`` names the column of each table that refers to a document.  Of the
    nodes that those documents are linked with, only such go as no other document
    is linked with, and with them the edges at either end.
    """
    own = {name: removed(tables[name], gone, {column: "id"}) for name, column in owners.items()}
    left = removed(tables[links], gone, {"document_id": "id"})
    touched = tables[links].join(gone.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("node_id").distinct()
    orphans = touched.join(left.select("node_id"), "node_id", "left_anti").select(F.col("node_id").alias("id"))
    live = removed(removed(tables[edges], orphans, {"src": "id"}), orphans, {"dst": "id"})
    return tables | own | {links: left, nodes: removed(tables[nodes], orphans, ["id"]), edges: removed(live, gone, {"document_id": "id"})}


def orphan_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that no document is linked with."""
    return nodes.join(links.select(F.col("node_id").alias("id")), "id", "left_anti")


def nodes_of(nodes: DataFrame, links: DataFrame, document_id: object) -> DataFrame:
    """The nodes that a document is linked with."""
    return nodes.join(lookup(links, document_id=document_id).select(F.col("node_id").alias("id")), "id", "left_semi")


def lineage(documents: DataFrame, sources: DataFrame, of: str, to: str) -> DataFrame:
    """Documents at the other end of the lineage edges: ``of`` is the end that is known, ``to`` the end that is joined."""
    return sources.select(F.col(of).alias("of_id"), F.col(to).alias("id")).join(documents, "id")


def members_in(documents: DataFrame, members: DataFrame, target_id: object, source_type: str, state: Column) -> DataFrame:
    """(id) of a target's member documents in a state."""
    pages = lookup(members, target_id=target_id).select(F.col("page_id").alias("source_id")).distinct()
    return documents.where((F.col("source_type") == source_type) & state).join(pages, "source_id", "left_semi").select("id")


def orphaned_by(members: DataFrame, documents: DataFrame, dropped: DataFrame, source_type: str) -> DataFrame:
    """(id) of documents whose pages no other target than that of the dropped memberships (target_id, page_id) owns."""
    others = members.join(dropped.select("target_id", "page_id"), ["target_id", "page_id"], "left_anti").select("page_id")
    pages = dropped.select("page_id").distinct().join(others, "page_id", "left_anti").select(F.col("page_id").alias("source_id"))
    return lookup(documents, source_type=source_type).join(pages, "source_id", "left_semi").select("id")


def merge_log_groups(log: DataFrame, nodes: DataFrame, least: int = 2, deleted: bool = False) -> DataFrame:
    """One row a merged node: its spellings, documents and methods, sorted, how many log rows it has, and whether it is gone; most spellings first."""
    sets = {"variant_names": "raw_entity_name", "document_ids": "source_document_id", "methods": "merge_method"}
    known = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c))))
    groups = log.groupBy("canonical_node_id").agg(*(known(c).alias(k) for k, c in sets.items()), F.count("*").alias("log_count"))
    groups = groups.where(F.greatest(F.size("variant_names"), F.size("document_ids")) >= least)
    named = nodes.select(F.col("id").alias("canonical_node_id"), "entity_name", "entity_type")
    rows = groups.join(named, "canonical_node_id", "left").withColumn("is_deleted", F.col("entity_name").isNull())
    rows = rows.withColumns({"entity_name": F.coalesce("entity_name", F.lit("(삭제된 노드)")), "entity_type": F.coalesce("entity_type", F.lit("other"))})
    return (rows if deleted else rows.where("not is_deleted")).orderBy(F.desc(F.size("variant_names")), F.desc(F.size("document_ids")), "canonical_node_id")


def code_of(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, title, content) of the source files that documents about code come from, each once."""
    about = documents.where(F.col("source_type").isin("code_doc", "code_summary")).select(F.col("id").alias("doc_id"))
    wanted = sources.join(about, "doc_id", "left_semi").select(F.col("source_doc_id").alias("id")).distinct()
    return lookup(documents, source_type="git_code").join(wanted, "id", "left_semi").select("id", "title", "content")


def chunk_views(chunks: DataFrame, questions: DataFrame, meta_text: Column) -> DataFrame:
    """Chunks with the text of their second view and their questions, none being an empty list."""
    asked = questions.where("chunk_id <> '' and question <> ''").groupBy(F.col("chunk_id").alias("id")).agg(F.array_sort(F.collect_list("question")).alias("questions"))
    return chunks.join(asked, "id", "left").withColumns({"meta_text": meta_text, "questions": F.coalesce("questions", F.array().cast("array<string>"))})


def source_texts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, content, method): the chunk that an item was made from, found by its anchor, else its id, else as the first of its document or of the first relevant one.

    ``items`` has (item, document_id, anchor, chunk_id, relevant), ``chunks`` (document_id, chunk_id, chunk_index, content).
    """
    from ..functions.text import collapsed

    named = chunks.select(F.col("document_id").alias("_d"), F.col("chunk_id").alias("_c"), "chunk_index", "content")
    own = items.select("item", "document_id", "anchor", "chunk_id").join(named, F.col("document_id") == F.col("_d"))
    by_anchor = (F.coalesce("anchor", F.lit("")) != "") & collapsed(F.col("content")).startswith(collapsed(F.col("anchor")))
    tier = F.when(by_anchor, 0).when(F.col("chunk_id") == F.col("_c"), 1).otherwise(2)
    first = items.select("item", F.get("relevant", F.lit(0)).alias("_r")).join(named, F.col("_r") == F.col("_d"))
    found = own.select("item", tier.alias("tier"), "chunk_index", "content").unionByName(first.select("item", F.lit(3).alias("tier"), "chunk_index", "content"))
    best = found.groupBy("item").agg(F.min(F.struct("tier", "chunk_index", "content")).alias("m"))
    names = F.array(*map(F.lit, ("anchor", "chunk_id", "fallback_first_chunk", "fallback_doc_first_chunk")))
    return items.select("item").join(best, "item", "left").select("item", F.coalesce("m.content", F.lit("")).alias("content"), F.coalesce(F.get(names, F.col("m.tier")), F.lit("empty")).alias("method"))


def directory_groups(files: DataFrame, path: str, least: int = 3) -> DataFrame:
    """(directory, n, paths): files by their directory; directories with fewer than ``least`` files join their parent's group."""
    parent = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(".")
    rows = files.select(F.col(path).alias("path"), parent(F.col(path)).alias("dir"))
    sizes = rows.groupBy("dir").agg(F.count("*").alias("n"))
    placed = rows.join(sizes, "dir").select("path", F.when(F.col("n") < least, parent(F.col("dir"))).otherwise(F.col("dir")).alias("directory"))
    return placed.groupBy("directory").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
