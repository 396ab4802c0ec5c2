"""Documents, chunks and lineage: change detection, listings, cascades, purges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, repo_label


def detect_changes(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """keys, both hashes and ``change_type``: created, changed, unchanged or removed, by a full join on the keys.

    Hashes are compared, not texts; null keys of either side never meet.
    """
    old = stored.select(*keys, F.col(hash_col).alias("old_hash"), F.lit(True).alias("_old"))
    new = incoming.select(*keys, F.col(hash_col).alias("new_hash"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return old.join(new, keys, "full").select(*keys, "old_hash", "new_hash", kind.alias("change_type"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The document table after an import: version and status move only where the content hash does.

    Rows of ``incoming`` carry ``original_content`` and optional ``raw_content`` and
    ``source_version``, which replace stored ones where not null.
    """
    new = incoming.select(*keys, *(F.col(c).alias(f"_{c}") for c in incoming.columns if c not in keys), content_hash(F.col("original_content")).alias("_hash"))
    both = stored.join(new, keys, "full")
    there, came = F.col("content_hash").isNotNull(), F.col("_hash").isNotNull()
    changed = came & (~there | (F.col("content_hash") != F.col("_hash")))
    take = lambda c: F.when(changed, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) if f"_{c}" in new.columns else F.col(c)
    out = {c: take(c) for c in stored.columns if c not in keys}
    out["content_hash"] = F.when(changed, F.col("_hash")).otherwise(F.col("content_hash"))
    out["version"] = F.when(~there, 1).when(changed, F.col("version") + 1).otherwise(F.col("version"))
    out["status"] = F.when(~there, "pending").when(changed, "changed").otherwise(F.col("status"))
    if "source_version" in stored.columns and "_source_version" in new.columns:
        out["source_version"] = F.coalesce("_source_version", "source_version")
    return both.select(*keys, *(v.alias(k) for k, v in out.items()))


def listing(parents: DataFrame, children: DataFrame, key: str, child_key: str, counts: dict[str, Column]) -> DataFrame:
    """Parents with figures over their children, 0 where they have none; children are summed up before the join."""
    figures = children.groupBy(F.col(child_key).alias(key)).agg(*(v.alias(k) for k, v in counts.items()))
    return parents.join(figures, key, "left").withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in counts})


def without(table: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return table.join(gone.select(*on).distinct(), on, "left_anti")


def cascade(document_ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table (with its document column) after the documents are deleted."""
    return {name: df.join(document_ids.select(F.col("id").alias(col)).distinct(), col, "left_anti") for name, (df, col) in tables.items()}


def orphans(members: DataFrame, owner: str, member: str, dropped_owner: Column) -> DataFrame:
    """Members all of whose owners are dropped."""
    return members.groupBy(member).agg(F.bool_and(dropped_owner).alias("_all"), F.count_distinct(owner).alias("n_owners")).where("_all").drop("_all")


def derived_only_from(lineage: DataFrame, derived: str, source: str, deleted: Column) -> DataFrame:
    """Derived ids whose sources, at least one, are all deleted: relational division by a minimum over each group."""
    return lineage.groupBy(derived).agg(F.bool_and(deleted).alias("_all"), F.count("*").alias("n_sources")).where("_all").drop("_all")


def source_groups(docs: DataFrame, source: str, group: str) -> DataFrame:
    """Counts by source and subgroup and each source's total."""
    parts = docs.groupBy(source, group).agg(F.count("*").alias("n"))
    totals = docs.groupBy(source).agg(F.count("*").alias("n_source"))
    return parts.join(totals, source)


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content_hash, n, first_id) of texts that more than one document has."""
    return docs.groupBy(content_hash(F.col(text_col)).alias("content_hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def evolve(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with missing columns added as nulls of the given types."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def storage_method(has_chunks: Column, has_graph: Column) -> Column:
    return F.when(has_chunks & has_graph, "hybrid").when(has_graph, "graph").otherwise("chunk")


#: Sources of code and of pages, and what their unnamed groups are called.
CODE_SOURCES, PAGE_SOURCES = ("git_code", "code_doc", "code_summary", "code_file_summary"), ("confluence", "confluence_mcp")


def subgroup(source_type: Column, url: Column, author: Column, space: Column) -> Column:
    """The group of a document within its source: repository or space; null for other sources."""
    known = lambda c: F.when(c != "", c)
    code = F.coalesce(known(repo_label(url)), known(author), F.lit("(저장소 미상)"))
    return F.when(source_type.isin(*CODE_SOURCES), code).when(source_type.isin(*PAGE_SOURCES), F.coalesce(known(space), F.lit("(스페이스 미상)")))


def sheet(rows: DataFrame) -> DataFrame:
    """The rows as text for a sheet: lists with commas, nulls empty."""
    kind = dict(rows.dtypes)
    return rows.select(*(F.coalesce(F.array_join(F.col(c).cast("array<string>"), ",") if kind[c].startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))


def embedded_once(rows: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with what ``embed`` adds to their texts, each different text being sent once; blank texts are left out."""
    asked = rows.where(F.trim(text) != "")
    return asked.join(embed(asked.select(text).distinct()), text)
