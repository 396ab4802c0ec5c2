"""Entities and relations read from texts, links and source files without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import graphtext as G
from ..functions import text as T


def _related(rows: DataFrame, doc_col: str, title: Column, found: Column, kind: str, relation: str, label: Column, order: int) -> DataFrame:
    named = rows.where(title != "").select(doc_col, title.alias("source"), label.alias("label"), F.col("_unit"), F.posexplode(found).alias("ordinal", "target"))
    return named.select(doc_col, "source", "target", F.lit(kind).alias("entity_type"), F.lit(relation).alias("relation_type"), "label", F.struct("_unit", F.lit(order).alias("o"), "ordinal").alias("ordinal"))


def body_relations(docs: DataFrame, doc_col: str, title_col: str, text_col: str, bold: bool = False, headers: bool = False, label_col: str | None = None, unit_col: str | None = None) -> DataFrame:
    """(document, source, target, entity_type, relation_type, label): API endpoints, tickets outside of code and, if asked for, bold terms and table headers of texts.

    Rows are the units of documents, in the order of ``unit_col``; ``label_col``, a
    unit's place, labels the first relation to each target.  Documents without a title
    have none.
    """
    title, body, prose = F.col(title_col), F.col(text_col), T.without_code(F.col(text_col))
    rows = docs.withColumn("_unit", F.lit(0) if unit_col is None else F.col(unit_col))
    label = F.lit("") if label_col is None else F.coalesce(F.col(label_col), F.lit(""))
    kinds = [(T.api_endpoints(body), "api", "documents"), (T.ticket_keys(prose), "ticket", "mentions_ticket")]
    kinds = ([(T.bold_terms(prose), "concept", "mentions")] if bold else []) + kinds[:1] + ([(T.table_headers(body), "concept", "has_attribute")] if headers else []) + kinds[1:]
    return first_spelling(reduce(DataFrame.union, (_related(rows, doc_col, title, found, kind, relation, label, k) for k, (found, kind, relation) in enumerate(kinds))), doc_col)


def link_relations(links: DataFrame, doc_col: str) -> DataFrame:
    """Relations of (document, source, ordinal, kind, target, target_id[, in_section]) links: pages are referenced, people and tickets mentioned, files attached.

    A page without a title is called by its id; other kinds of links are passed
    over.  The first link to each target labels the relation with its section.
    """
    kind = F.col("kind")
    pick = lambda k: F.coalesce(*(F.when(kind == name, v[k]) for name, v in G.LINKS.items()))
    name = G.link_target(kind, F.trim("target"), F.col("target_id"))
    label = G.link_label(F.col("in_section")) if "in_section" in links.columns else F.lit("")
    rows = links.where(G.link_kept(kind) & (F.coalesce("source", F.lit("")) != "")).select(doc_col, "source", name.alias("target"), pick(0).alias("entity_type"), pick(1).alias("relation_type"), label.alias("label"), "ordinal")
    return first_spelling(rows.where("target <> ''"), doc_col)


def first_spelling(relations: DataFrame, doc_col: str) -> DataFrame:
    """One relation of each kind to a target of a document, whatever its case; the first spelling and label stay."""
    key = [doc_col, F.lower("source").alias("_s"), F.lower("target").alias("_t"), "entity_type", "relation_type"]
    first = relations.groupBy(*key).agg(F.min(F.struct("ordinal", "source", "target", "label")).alias("m"))
    return first.select(doc_col, "m.source", "m.target", "entity_type", "relation_type", "m.label")


def _listed(rows: DataFrame, doc: str, unit: str, answer: str, what: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc, _at, fields): the objects of a list in the answers; a field is the first of its names that is there."""
    items = A.items(A.at(F.try_parse_json(A.answered_json(F.col(answer))), f"$.{what}"))
    found = rows.select(doc, F.col(unit).alias("_u"), F.posexplode(items).alias("_p", "x")).where(A.is_object(F.col("x")))
    text = lambda names: F.trim(F.coalesce(*(A.string_at(F.col("x"), f"$.{n}") for n in names), F.lit("")))
    return found.select(doc, F.struct("_u", "_p").alias("_at"), *(text(names).alias(k) for k, names in fields.items()))


def model_entities(rows: DataFrame, doc: str, unit: str, answer: str) -> DataFrame:
    """(doc, name, entity_type, description) of the entities in a model's answers for units, the first of each name and type; types that no model may name are left out."""
    allowed = [e.name for e in G.found_by(G.ENTITY_TYPES, "llm_body")]
    found = _listed(rows, doc, unit, answer, "entities", {"name": ("name",), "entity_type": ("type", "entity_type"), "description": ("description",)})
    sound = found.where((F.col("name") != "") & F.col("entity_type").isin(allowed))
    first = sound.groupBy(doc, F.lower("name").alias("_k"), "entity_type").agg(F.min(F.struct("_at", "name", "description")).alias("m"))
    return first.select(doc, "m.name", "entity_type", "m.description")


def model_relations(rows: DataFrame, doc: str, unit: str, answer: str) -> DataFrame:
    """(doc, source, target, relation_type, label) of the relations in a model's answers, between entities that it found in the document, under their names, the first of each."""
    allowed = [e.name for e in G.found_by(G.RELATION_TYPES, "llm_body")]
    found = _listed(rows, doc, unit, answer, "relations", {"source": ("source",), "target": ("target",), "relation_type": ("type", "relation_type"), "label": ("label", "description")})
    sound = found.where(F.col("relation_type").isin(allowed))
    names = model_entities(rows, doc, unit, answer).groupBy(doc, F.lower("name").alias("_k")).agg(F.min("name").alias("_n"))
    end = lambda c: names.select(doc, F.col("_k").alias(f"_{c}"), F.col("_n").alias(f"_{c}_name"))
    both = sound.withColumns({"_source": F.lower("source"), "_target": F.lower("target")}).join(end("source"), [doc, "_source"]).join(end("target"), [doc, "_target"])
    first = both.groupBy(doc, "_source", "_target", "relation_type").agg(F.min(F.struct("_at", F.col("_source_name").alias("source"), F.col("_target_name").alias("target"), "label")).alias("m"))
    return first.select(doc, "m.source", "m.target", "relation_type", "m.label")


def canonical_names(rows: DataFrame, doc: str, order: str, name: str) -> DataFrame:
    """The rows with ``canonical``: how a document first spelt the name, whatever its case."""
    first = rows.groupBy(doc, F.lower(name).alias("_k")).agg(F.min_by(name, order).alias("canonical"))
    return rows.withColumn("_k", F.lower(name)).join(first, [doc, "_k"]).drop("_k")
