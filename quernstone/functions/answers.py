"""Column functions over what models and servers answer: JSON in prose, scores, questions, page fields.

Fields are read from VARIANT values; only the repair of broken JSON, which no
built-in does, is a pandas UDF.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SPACES, without_thought


def closed_json(text: str | None) -> str | None:
    """JSON cut off somewhere, closed after its last complete bracket; null if that gives none either."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    except RecursionError:
        return None
    whole = text[: max(text.rfind("}"), text.rfind("]")) + 1]
    # strings first, so that only brackets outside of them are left
    bare = re.sub(r"\\\\.|\"(?:\\\\.|[^\"\\\\])*(?:\"|$)", "", whole, flags=re.S)
    open_: list[str] = []
    for sign in re.findall(r"[\[\]{}]", bare):
        if sign in "[{":
            open_.append("]" if sign == "[" else "}")
        elif open_:
            open_.pop()
    try:
        return json.dumps(json.loads(whole + "".join(reversed(open_))), ensure_ascii=False) if whole else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(closed_json, na_action="ignore")


def json_part(text: Column) -> Column:
    """The JSON text in an answer: what is fenced first, else from the first bracket to the last; null without any."""
    bare = without_thought(text)
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(bare.rlike(r"(?s)```(?:json)?\s*.*?```"), F.trim(fenced)).when(braces != "", braces)


def answered_json(text: Column) -> Column:
    """The JSON value of an answer as text, repaired if it was cut off; null if there is none."""
    part = json_part(text)
    return F.when(F.try_parse_json(part).isNotNull(), part).otherwise(repaired(part))


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return kind_of(value) == "STRING"


def is_number(value: Column) -> Column:
    return kind_of(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def is_list(value: Column) -> Column:
    return kind_of(value).startswith("ARRAY")


def is_object(value: Column) -> Column:
    return kind_of(value).startswith("OBJECT")


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def truthy(value: Column, path: str) -> Column:
    """The string there, if it is neither missing nor empty."""
    found = string_at(value, path)
    return F.when(found != "", found)


def items(value: Column) -> Column:
    """The elements of a list; null if it is none."""
    return F.when(is_list(value), F.try_variant_get(value, "$", "array<variant>"))


# ---------------------------------------------------------------- scores of a reranker


def indexed_scores(found: Column, n: Column) -> Column:
    """Scores of items that name their index, 0 where none does; the last of several counts."""
    score = lambda x: F.coalesce(F.try_variant_get(x, "$.relevance_score", "double"), F.try_variant_get(x, "$.score", "double"))
    index = lambda x: F.when(kind_of(at(x, "$.index")) == "BIGINT", F.try_variant_get(x, "$.index", "int"))
    good = F.filter(F.transform(found, lambda x: F.struct(index(x).alias("i"), score(x).alias("s"))), lambda x: x["i"].isNotNull() & x["s"].isNotNull())
    own = lambda i: F.filter(good, lambda x: x["i"] == i)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(own(i), F.lit(-1))["s"], F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def ordered_scores(found: Column, n: Column) -> Column:
    """Scores in the order of the documents, cut or filled up with 0."""
    known = F.transform(found, lambda x: F.try_variant_get(x, "$", "double"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(known, i + 1), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def rerank_scores(answer: Column, n: Column) -> Column:
    """A score for each of n documents from a reranker's answer in any of its forms; null if it has none of them."""
    v = F.try_parse_json(answer)
    results, scores, whole = items(at(v, "$.results")), items(at(v, "$.scores")), items(v)
    return F.when(is_object(v) & at(v, "$.results").isNotNull(), indexed_scores(results, n)).when(is_object(v) & scores.isNotNull(), ordered_scores(scores, n)).when((F.size(whole) > 0) & is_object(F.try_element_at(whole, F.lit(1))), indexed_scores(whole, n)).when(whole.isNotNull(), ordered_scores(whole, n))


# ---------------------------------------------------------------- generated questions


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}+|{SPACES}+$", "")


def questions(answer: Column) -> Column:
    """Structs (query, difficulty) of a list of questions in an answer; blank ones go, other difficulties than easy, medium and hard are empty."""
    found = F.filter(F.coalesce(items(F.try_parse_json(answered_json(answer))), F.array().cast("array<variant>")), is_object)
    level = lambda x: F.lower(_stripped(string_at(x, "$.difficulty")))
    rows = F.transform(found, lambda x: F.struct(_stripped(F.coalesce(truthy(x, "$.q"), truthy(x, "$.query"))).alias("query"), F.when(level(x).isin("easy", "medium", "hard"), level(x)).otherwise("").alias("difficulty")))
    return F.filter(rows, lambda x: x["query"] != "")


def graph_questions(answer: Column) -> Column:
    """As ``questions``, with evidence, aliases (strings that are not blank) and, if it has both ends and a type, the relation."""
    found = F.filter(F.coalesce(items(F.try_parse_json(answered_json(answer))), F.array().cast("array<variant>")), is_object)
    level = lambda x: F.lower(_stripped(string_at(x, "$.difficulty")))
    alias = lambda x: F.filter(F.transform(F.filter(F.coalesce(items(at(x, "$.entity_aliases")), F.array().cast("array<variant>")), is_string), lambda a: _stripped(string_at(a, "$"))), lambda a: a != "")
    part = lambda x, k: _stripped(string_at(x, f"$.relation.{k}"))
    relation = lambda x: F.when((part(x, "source_name") != "") & (part(x, "target_name") != "") & (part(x, "relation_type") != ""), F.struct(*(part(x, k).alias(k) for k in ("source_name", "target_name", "relation_type")), part(x, "relation_description").alias("description")))
    rows = F.transform(found, lambda x: F.struct(
        _stripped(F.coalesce(truthy(x, "$.q"), truthy(x, "$.query"))).alias("query"), F.when(level(x).isin("easy", "medium", "hard"), level(x)).otherwise("").alias("difficulty"),
        _stripped(string_at(x, "$.evidence_description")).alias("evidence"), alias(x).alias("aliases"), relation(x).alias("relation"),
    ))
    return F.filter(rows, lambda x: x["query"] != "")


def judged_score(answer: Column) -> Column:
    """The score of a judge's answer, from 0 to 5; -1 if there is none."""
    score = at(F.try_parse_json(answered_json(answer)), "$.score")
    whole = F.try_variant_get(score, "$", "double").cast("int")
    return F.coalesce(F.when(is_number(score), F.greatest(F.lit(0), F.least(F.lit(5), whole))), F.lit(-1))


#: What servers say when a prompt is too long.
TOO_LONG = (
    "context_length_exceeded", "maximum context length", "context length", "context window", "reduce the length", "longer than the maximum", "maximum model length", "decrease the input",
)


def prompt_too_long(error: Column) -> Column:
    return F.lower(error).rlike("|".join(TOO_LONG))


# ---------------------------------------------------------------- pages of a server


def enveloped(answer: Column) -> Column:
    """The listed objects of an answer, a list or an object with one; null if it has none."""
    v = F.try_parse_json(answer)
    lists = [x for key in ("results", "children", "pages", "page", "items") for x in (items(at(v, f"$.{key}")), items(at(v, f"$.{key}.results")))]
    return F.coalesce(items(v), *lists)


def total_size(answer: Column) -> Column:
    """How many there are in all, by the first of three keys that is a whole number; else null."""
    v = F.try_parse_json(answer)
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "long") for k in ("totalSize", "total", "_totalSize")))


def page_content(page: Column) -> Column:
    """The text of a page by the first of its fields that is not blank, else by the forms of its body; empty without any."""
    v = F.try_parse_json(page)
    flat = lambda k: F.when(is_string(at(v, f"$.{k}")) & (_stripped(string_at(v, f"$.{k}")) != ""), _stripped(string_at(v, f"$.{k}")))
    form = lambda k: F.coalesce(truthy(v, f"$.body.{k}.value"), F.when(is_string(at(v, f"$.body.{k}")) & (_stripped(string_at(v, f"$.body.{k}")) != ""), string_at(v, f"$.body.{k}")))
    return F.coalesce(*(flat(k) for k in ("markdown", "content", "body", "value", "text")), *(form(k) for k in ("storage", "view", "export_view")), F.lit(""))


def page_title(page: Column, page_id: Column) -> Column:
    v = F.try_parse_json(page)
    return F.coalesce(truthy(v, "$.title"), truthy(v, "$.name"), F.concat(F.lit("Confluence Page "), page_id))


def page_version(page: Column) -> Column:
    """The number of a page's version, a whole number or digits; else null."""
    v = F.try_parse_json(page)
    version = at(v, "$.version")
    own = F.when(is_object(version), at(version, "$.number")).otherwise(version)
    whole = (kind_of(own) == "BIGINT") | (is_string(own) & string_at(own, "$").rlike(r"^\d+$"))
    return F.when(whole, F.try_variant_get(own, "$", "int"))


def page_breadcrumb(page: Column) -> Column:
    """Space, ancestors and title of a page, or its id."""
    v = F.try_parse_json(page)
    up = F.transform(F.coalesce(items(at(v, "$.ancestors")), F.array().cast("array<variant>")), lambda a: F.coalesce(truthy(a, "$.title"), truthy(a, "$.name")))
    parts = F.concat(F.array(F.coalesce(truthy(v, "$.space.name"), truthy(v, "$.space.key"))), up, F.array(F.coalesce(truthy(v, "$.title"), truthy(v, "$.name"))))
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, " / ")).otherwise(F.coalesce(truthy(v, "$.id"), F.lit("")))


def is_page_query(text: Column) -> Column:
    """Whether a text is a query of the page server's language and not plain words."""
    return text.rlike(PAGE_QUERY)


#: Fixed pattern: operators of the page server's query language.
PAGE_QUERY = r"(?iU)[~=!<>]|\b(AND|OR|NOT|IN|ORDER\s+BY)\b"


def quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def page_query(text: Column) -> Column:
    """A query as it stands, or a search for pages with plain words; blank text stays empty."""
    bare = _stripped(text)
    return F.when((bare == "") | is_page_query(bare), bare).otherwise(F.concat(F.lit('type = "page" AND text ~ "'), quoted(bare), F.lit('"')))


def space_query(space: Column) -> Column:
    return F.concat(F.lit('space = "'), quoted(space), F.lit('" AND type = "page"'))


def subtree_query(page_id: Column) -> Column:
    return F.concat(F.lit('ancestor = "'), quoted(page_id), F.lit('" AND type = "page"'))


def since(query: Column, modified: Column) -> Column:
    return F.when(F.coalesce(modified, F.lit("")) == "", query).otherwise(F.concat(query, F.lit(' AND lastModified >= "'), quoted(modified), F.lit('"')))
