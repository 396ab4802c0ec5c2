"""Models as functions of a column: prompts, answers in batches, and the steps that ask and read them.

A model is any function from a list of prompts to a list of answers; it runs within
tasks, is tried again after a failure, and a prompt that it fails for has a null answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import graphtext as G
from ..functions import text as T
from . import goldset
from .arrow import mapped

Model = Callable[[list[str]], list]


def asked(rows: DataFrame, prompt: str, model: Model, column: str = "answer", batch: int = 32, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """The rows with the model's answer to each prompt; null prompts are not asked."""
    return asked_each(rows, {column: (prompt, model)}, batch, tries, pause)


def asked_each(rows: DataFrame, asks: dict[str, tuple[str, Model]], batch: int = 32, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """The rows with a column of answers for each (prompt, model), all from one Python worker of a task."""

    def answered(model: Model, prompts: list[str]) -> list:
        for k in range(tries):
            try:
                return model(prompts)
            except Exception:  # noqa: BLE001 a model's client may raise anything
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return [None] * len(prompts)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = list(part.columns)
        for prompt, model in asks.values():
            prompts = part.column(prompt).to_pylist()
            at = [i for i, p in enumerate(prompts) if p is not None]
            found: list = [None] * len(prompts)
            for s in range(0, len(at), batch):
                some = at[s : s + batch]
                for i, x in zip(some, answered(model, [prompts[i] for i in some]), strict=True):
                    found[i] = x
            out.append(pa.array(found, pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[*part.schema.names, *asks])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{c}` string" for c in asks)])
    return mapped(rows, list(dict.fromkeys(p for p, _ in asks.values())), ddl, run)


def filled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` given way to columns; nulls are empty."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


#: Prompts of the engine's own; pass others where a model needs them.
HYPOTHETICAL = "다음 질문에 답하는 문서의 한 단락을 써라.\n\n질문: {query}"
QUESTIONS = '다음 글로 답할 수 있는 질문 {n}개를 JSON 배열 [{"q": "...", "difficulty": "easy"}] 로만 답하라.\n\n{content}'
GRAPH_QUESTIONS = "다음 엔티티와 관계로 답할 수 있는 질문 {n}개를 JSON 배열로만 답하라.\n\n{snippet}\n\n{excerpt}"
PAIR_QUESTIONS = "서로 다른 문서에 있는 두 엔티티를 모두 알아야 답할 수 있는 질문 {n}개를 JSON 배열로만 답하라.\n\n{snippet}"
SECTION_QUESTIONS = '문서 "{title}" 의 각 구역에 대한 질문을 JSON {"sections": [{"section_index": 0, "questions": ["..."]}]} 로만 답하라.\n\n{sections}'
ANSWERABLE = "질문: {question}\n\n문맥:\n{content}\n\n이 문맥만으로 답할 수 있는가? yes 또는 no 로만 답하라."
UNIQUE = "질문: {question}\n\n문맥:\n{content}\n\n이 문맥이 유일한 출처인가? yes 또는 no 로만 답하라."
GRADE = '질문: {query}\n\n정답 문맥:\n{source}\n\n검색된 문맥:\n{context}\n\n0 부터 5 까지 점수를 JSON {"score": 0} 로만 답하라.'
UNIT = '다음 글의 엔티티와 관계를 JSON {"entities": [], "relations": []} 로만 답하라.\n\n문서: {title}\n\n{content}'


def hypothetical(queries: DataFrame, model: Model, template: str = HYPOTHETICAL) -> DataFrame:
    """(query_id, query, text): a text that might answer each query; null where the model gave none."""
    found = asked(queries.withColumn("_p", filled(template, query=F.col("query"))), "_p", model)
    return found.select("query_id", "query", F.when(F.trim("answer") != "", F.trim(T.without_thought(F.col("answer")))).alias("text"))


def _each(found: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each of ``_q``, as ``pos`` and ``q``.  Spark would ask first if an inner explode has any, and so repair each answer in two workers."""
    return found.select(*columns, F.posexplode_outer("_q").alias("pos", "q")).where("q is not null")


def questions(rows: DataFrame, model: Model, n: int, template: str = QUESTIONS) -> DataFrame:
    """The rows (content, ...) with one question a row: ``question`` and ``difficulty``, in the order of ``pos``."""
    found = asked(rows.withColumn("_p", filled(template, n=F.lit(n), content=F.col("content"))), "_p", model)
    return _each(found.withColumn("_q", A.questions(F.col("answer"))), rows.columns).select(*rows.columns, "pos", F.col("q.query").alias("question"), F.col("q.difficulty").alias("difficulty"))


def graph_questions(rows: DataFrame, model: Model, n: int, template: str = GRAPH_QUESTIONS, excerpt: int = 2000) -> DataFrame:
    """The rows (snippet, document, ...) with one question a row, its evidence, aliases and relation."""
    prompt = filled(template, n=F.lit(n), snippet=F.col("snippet"), excerpt=T.shrunk(F.coalesce("document", F.lit("(문서 원문 없음)")), excerpt)["text"])
    found = asked(rows.withColumn("_p", prompt), "_p", model).withColumn("_q", A.graph_questions(F.col("answer")))
    return _each(found, rows.columns).select(*rows.columns, "pos", F.col("q.query").alias("question"), "q.difficulty", "q.evidence", "q.aliases", "q.relation")


def section_questions(sections: DataFrame, doc: str, title: str, model: Model, budget: int = 200_000, most: int = 50, template: str = SECTION_QUESTIONS) -> DataFrame:
    """(doc, section, question) of the sections (doc, title, index, text): asked in batches within a budget of tokens, merged by document.

    A section that is too large alone is cut to the budget; a batch whose answer cannot be read gives none.
    """
    sized = sections.withColumn("text", T.first_tokens(F.col("text"), budget)).withColumn("_cost", T.count_tokens(F.col("text")))
    grouped = goldset.batches(sized, doc, "index", "_cost", budget).groupBy(doc, title, "batch").agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("_s"))
    prompt = filled(template, title=F.col(title), sections=G.payload_text(F.col("_s")))
    answers = asked(grouped.withColumns({"_p": prompt, "_i": F.transform("_s", lambda s: s["index"])}).select(doc, "_p", "_i"), "_p", model)
    listed = A.items(A.at(F.try_parse_json(A.answered_json(F.col("answer"))), "$.sections"))
    rows = answers.select(doc, "_i", F.explode(listed).alias("x")).where(A.is_object(F.col("x")))
    rows = rows.select(doc, "_i", F.try_variant_get("x", "$.section_index", "int").alias("section"), F.posexplode(A.items(A.at(F.col("x"), "$.questions"))).alias("pos", "q"))
    good = rows.where(F.array_contains("_i", F.col("section")) & A.is_string(F.col("q"))).select(doc, "section", "pos", A.string_at(F.col("q"), "$").alias("text"))
    return goldset.merged_questions(good, doc, ["section", "pos"], "text", most).select(doc, "section", "question")


def judged(rows: DataFrame, judge: Model) -> DataFrame:
    """The rows (question, content, distractors, ...) with ``reason``: why a question is no good, null if it is.

    The judge says if the content answers the question, if it alone does, and if any distractor does too.
    """
    prompts = F.transform(F.coalesce("distractors", F.array().cast("array<string>")), lambda d: F.replace(F.replace(F.lit(ANSWERABLE), F.lit("{question}"), F.col("question")), F.lit("{content}"), d))
    one = lambda template: filled(template, question=F.col("question"), content=F.col("content"))
    base = rows.withColumns({"_pa": one(ANSWERABLE), "_pu": one(UNIQUE), "_pd": F.when(F.size(prompts) > 0, F.to_json(prompts))})
    # the distractors of a row are asked as one list, whose answers come back in order
    lists = lambda found: ["\x1f".join("" if x is None else x for x in judge(_read(p))) for p in found]
    joined = asked_each(base, {"_a": ("_pa", judge), "_u": ("_pu", judge), "_d": ("_pd", lists)})
    generic = F.exists(F.split(F.coalesce("_d", F.lit("")), "\x1f"), lambda x: F.coalesce(T.yes_no(x), F.lit(False)))
    reason = goldset.question_fault(F.col("question"), F.col("content"), T.yes_no(F.col("_a")), T.yes_no(F.col("_u")), generic)
    return joined.withColumn("reason", reason).select(*rows.columns, "reason")


def _read(prompts: str) -> list[str]:
    import json

    return json.loads(prompts)


def graded(rows: DataFrame, judge: Model, samples: int = 1) -> DataFrame:
    """(item, score) of the rows (item, query, source, context): one row a sample, -1 where the answer cannot be read."""
    prompt = filled(GRADE, query=F.col("query"), source=T.first_tokens(F.col("source"), 4000), context=T.first_tokens(F.col("context"), 6000))
    drawn = rows.select("item", prompt.alias("_p"), F.explode(F.sequence(F.lit(1), F.lit(max(1, samples)))).alias("sample"))
    return asked(drawn, "_p", judge).select("item", A.judged_score(F.col("answer")).alias("score"))


def unit_answers(units: DataFrame, title: str, content: str, model: Model, template: str = UNIT) -> DataFrame:
    """The units with the JSON that a model finds in each, null where it cannot be read."""
    found = asked(units.withColumn("_p", filled(template, title=F.col(title), content=F.col(content))), "_p", model)
    return found.withColumn("answer", A.answered_json(F.col("answer"))).drop("_p")


def chunk_gold_set(chunks: DataFrame, generate: Model, judge: Model, n: int = 2) -> DataFrame:
    """(id, query, relevant_doc_ids, difficulty) of the chunks (order, document_id, content, distractors): generated questions that pass all gates, numbered in order."""
    passed = judged(questions(chunks, generate, n), judge).where("reason is null")
    return _numbered(passed, F.array("document_id"), ["order", "pos"])


def graph_gold_set(subgraphs: DataFrame, generate: Model, judge: Model, n: int = 2) -> DataFrame:
    """As ``chunk_gold_set`` for subgraphs (order, name, document_ids, snippet, document, distractors); fewer than five distractors are not asked about."""
    made = graph_questions(subgraphs, generate, n).withColumn("content", F.col("snippet"))
    made = made.withColumn("distractors", F.when(F.size("distractors") >= 5, F.col("distractors")))
    return _numbered(judged(made, judge).where("reason is null"), F.array_sort("document_ids"), ["order", "pos"])


def pair_gold_set(pairs: DataFrame, generate: Model, judge: Model, n: int = 2) -> DataFrame:
    """As ``graph_gold_set`` for pairs of entities (order, src_doc, dst_doc, snippet, distractors) of different documents."""
    made = questions(pairs.withColumn("content", F.col("snippet")), generate, n, PAIR_QUESTIONS.replace("{snippet}", "{content}"))
    return _numbered(judged(made, judge).where("reason is null"), F.array_sort(F.array_distinct(F.array("src_doc", "dst_doc"))), ["order", "pos"])


def _numbered(rows: DataFrame, docs: Column, keys: list[str]) -> DataFrame:
    from .tables import numbered

    return numbered(rows, [F.col(k) for k in keys], "_number").select(F.format_string("q%04d", F.col("_number")).alias("id"), F.col("question").alias("query"), docs.alias("relevant_doc_ids"), "difficulty")


def imported(answers: DataFrame) -> DataFrame:
    """(page_id, title, version, content, breadcrumb, content_hash) of a page server's answers (page_id, answer), content as Markdown."""
    from .pages import markdown

    rows = answers.select("page_id", A.page_title(F.col("answer"), F.col("page_id")).alias("title"), A.page_version(F.col("answer")).alias("version"), A.page_content(F.col("answer")).alias("html"), A.page_breadcrumb(F.col("answer")).alias("breadcrumb"))
    return rows.drop("html").join(markdown(rows.select("page_id", "html").withColumnRenamed("html", "raw"), "page_id", "raw").select("page_id", F.col("markdown").alias("content")), "page_id").withColumn("content_hash", T.content_hash(F.col("content")))
