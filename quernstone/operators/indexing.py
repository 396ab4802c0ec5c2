"""From documents to what is searched: chunks, vectors of several views, entities and relations.

All documents of a table are indexed by one job a result; models are functions
from texts to vectors or answers and run in batches within tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, extraction, pages, parsing, retrieval, units
from .documents import storage_method

PAGES = ("confluence", "confluence_mcp")


def chunks(documents: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(document_id, chunk_id, chunk_index, section_path, content, token_count, meta_text) of (id, source_type, title, original_content, raw_content).

    Source files give a chunk a symbol, pages with their source one a section, packed, and
    all others their Markdown; a chunk's second view is its title and place, or its symbol.
    """
    named = documents.select("id", "title", F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("original_content", F.lit("")).alias("content"), F.coalesce("raw_content", F.lit("")).alias("raw"))
    code = parsing.code_chunk_rows(named.where("source_type = 'git_code'").withColumn("key", F.concat_ws("\x1f", F.col("id").cast("string"), "title")), "key", "content")
    code = code.select(F.element_at(F.split("key", "\x1f"), 1).cast("long").alias("document_id"), "chunk_index", F.regexp_replace("section_path", "^[^\x1f]*\x1f", "").alias("section_path"), F.regexp_replace("content", "(?m)^# File: [^\x1f\n]*\x1f", "# File: ").alias("content"), F.regexp_replace("embed_text", "^[^\x1f]*\x1f", "").alias("meta_text"))
    is_page = F.col("source_type").isin(*PAGES) & (F.trim("raw") != "")
    paged = chunking.chunked(named.where(is_page).select("id", "raw"), "id", "raw", lambda t: chunking.chunk_sections(pages.document(t), size, overlap))
    plain = chunking.chunked(named.where(~is_page & (F.col("source_type") != "git_code")).select("id", "content"), "id", "content", lambda t: chunking.chunk_text(t, size, overlap))
    text = paged.select(F.col("id").alias("document_id"), "chunk_index", "section_path", "content").unionByName(plain.select(F.col("id").alias("document_id"), "chunk_index", "section_path", "content"))
    text = text.join(named.select(F.col("id").alias("document_id"), "title"), "document_id").withColumn("meta_text", T.meta_view(F.col("title"), F.col("section_path"))).drop("title")
    rows = code.unionByName(text)
    key = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    return rows.withColumns({"chunk_id": key, "token_count": T.count_tokens(F.col("content"))})


def views(chunk_rows: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(id, chunk_id, document_id, view, text, content): a row for the body of each chunk, one for its second view if it has any, and one for each question."""
    both = F.array(F.struct(F.lit("body").alias("view"), F.col("content").alias("text")), F.struct(F.lit("meta").alias("view"), F.col("meta_text").alias("text")))
    rows = chunk_rows.select("chunk_id", "document_id", "content", F.explode(both).alias("v")).select("chunk_id", "document_id", "v.view", "v.text", "content", F.col("v.view").alias("_suffix"))
    if questions is not None:
        asked = questions.select("chunk_id", F.posexplode("questions").alias("_n", "text")).join(chunk_rows.select("chunk_id", "document_id", "content"), "chunk_id")
        rows = rows.unionByName(asked.select("chunk_id", "document_id", F.lit("question").alias("view"), "text", "content", F.concat(F.lit("q"), F.col("_n").cast("string")).alias("_suffix")))
    return rows.where("text <> ''").select(F.concat("chunk_id", F.lit("#"), "_suffix").alias("id"), "chunk_id", "document_id", "view", "text", "content")


def vectors(view_rows: DataFrame, embed: Callable[[list[str]], list]) -> DataFrame:
    """The views with their ``vector``; rows for which the model gave none are left out."""
    return retrieval.embedded(view_rows, "text", embed).where("vector is not null")


def relations(documents: DataFrame) -> DataFrame:
    """(document_id, source, target, relation_type, label) of links and texts of pages, and of symbols of source files."""
    named = documents.select("id", "title", "source_type", "original_content", "raw_content")
    page = named.where(F.col("source_type").isin(*PAGES) & (F.trim("raw_content") != ""))
    found = pages.extracted(page, "id", "raw_content").join(page.select("id", "title"), "id")
    links = found.select("id", F.col("title").alias("source"), F.posexplode("outbound_links").alias("ordinal", "x")).select("id", "source", "ordinal", "x.kind", F.col("x.target_title").alias("target"), "x.target_id", "x.in_section")
    unit_rows = units.extraction_units(found.select("id", "title", "plain_text"), "id", "title", "plain_text").join(page.select("id", "title"), "id")
    body = extraction.body_relations(unit_rows, "id", "title", "body", label_col="section_path", unit_col="ordinal")
    code = parsing.code_relations(named.where("source_type = 'git_code'").withColumn("key", F.col("title")), "key", "original_content").join(named.where("source_type = 'git_code'").select("id", F.col("title").alias("key")), "key")
    columns = ["source", "target", "relation_type", "label"]
    return extraction.link_relations(links, "id").select("id", *columns).unionByName(body.select("id", *columns)).unionByName(code.select("id", *columns)).withColumnRenamed("id", "document_id")


def outcomes(documents: DataFrame, chunk_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """(id, method) of each document: hybrid, graph or chunk, by what indexing found."""
    there = lambda df, name: df.select(F.col("document_id").alias("id")).distinct().withColumn(name, F.lit(True))
    rows = documents.select("id").join(there(chunk_rows, "c"), "id", "left").join(there(relation_rows, "g"), "id", "left")
    return rows.select("id", storage_method(F.coalesce("c", F.lit(False)), F.coalesce("g", F.lit(False))).alias("method"))
