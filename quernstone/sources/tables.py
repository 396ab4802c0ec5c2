"""Schemas of the engine's tables, and readers of files, gold sets and result sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excluded

#: Each table as DDL; ``evolve`` in operators.documents adds columns that older files lack.
SCHEMAS = {
    "documents": "id long, source_type string, source_id string, title string, original_content string, raw_content string, content_hash string, storage_method string, status string, llm_degraded boolean, llm_degraded_detail string, version int, source_version int, url string, author string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, document_id long, chunk_index int, content string, token_count int, section_path string, section_anchor string, embed_text string, section_index int",
    "vectors": "id string, embedding array<float>, document string, meta struct<document_id: long, chunk_index: int, title: string, section_path: string, section_anchor: string, logical_chunk_id: string, view: string, question_text: string>",
    "graph_nodes": "id long, document_id long, entity_name string, entity_type string, properties map<string, string>, normalized_name string",
    "graph_edges": "id long, document_id long, source_node_id long, target_node_id long, relation_type string, properties map<string, string>",
    "graph_node_documents": "node_id long, document_id long",
    "graph_merge_log": "canonical_node_id long, raw_entity_name string, raw_entity_type string, source_document_id long, merge_method string, similarity_score double, created_at timestamp",
    "processing_history": "id long, document_id long, action string, status string, prev_storage_method string, new_storage_method string, error_message string, started_at timestamp, completed_at timestamp",
    "document_sources": "doc_id long, source_doc_id long, file_path string",
    "sync_targets": "id long, scope string, space_key string, page_id string, name string, last_watermark string, last_sync_at timestamp, last_result_json string, created_at timestamp",
    "sync_membership": "target_id long, page_id string, space_key string, parent_page_id string, depth int, last_seen_at timestamp",
    "sync_fetch_retries": "target_id long, page_id string, attempts int, last_error string, updated_at timestamp",
    "gold_items": "id string, query string, relevant_doc_ids array<long>, relevant_doc_groups array<array<long>>, difficulty string, mode string, notes string",
}
#: Endings that uploads may have.
UPLOADS = ("md", "txt", "html")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its schema; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def text_files(spark: SparkSession, path: str, endings: tuple[str, ...] = UPLOADS, limit_kb: int | None = None) -> DataFrame:
    """(source_id, path, content, content_hash) of text files below a folder; such as are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folders = F.split("path", "/")
    rows = files.where(ending.isin(*endings) & ~excluded(F.col("path")))
    rows = rows if limit_kb is None else rows.where(F.col("length") <= limit_kb * 1024)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select(F.element_at(folders, -1).alias("source_id"), "path", text.alias("content")).where("content is not null").withColumn("content_hash", F.sha2("content", 256))


def result_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of results by query in long form (id, metric, value); what is no number is left out."""
    rows = spark.read.csv(path, header=True)
    values = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in rows.columns if c != "id"]
    return rows.select("id", F.explode(F.array(*values)).alias("m")).select("id", "m.*").where("value is not null")


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Gold items of JSON lines; optional fields may be missing."""
    return spark.read.schema(SCHEMAS["gold_items"]).json(path)


def product_scopes(configs: DataFrame, config: str) -> DataFrame:
    """(name, display_name, paths, exclude) of the products of repositories' settings in JSON."""
    spec = F.from_json(F.get_json_object(config, "$.products"), "map<string, struct<display_name: string, paths: array<string>, exclude: array<string>>>")
    none = F.array().cast("array<string>")
    return configs.select(F.explode(spec).alias("name", "s")).select("name", F.coalesce("s.display_name", "name").alias("display_name"), F.coalesce("s.paths", none).alias("paths"), F.coalesce("s.exclude", none).alias("exclude"))


def repositories(configs: DataFrame, config: str) -> DataFrame:
    """(url, branch) of the repositories of settings in JSON; one without an address is left out, a branch without a name is main."""
    spec = F.from_json(F.get_json_object(config, "$.repositories"), "array<struct<url: string, branch: string>>")
    return configs.select(F.explode(spec).alias("r")).where("r.url <> ''").select("r.url", F.coalesce("r.branch", F.lit("main")).alias("branch"))
