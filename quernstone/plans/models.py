"""Queries of what models, page servers, files and callers give and ask, with small stand-ins for these."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import api
from ..functions import text as T
from ..operators import evaluation, models
from ..sources import paged
from ..sources import tables as files
from ..sources.shared import put_texts
from .base import rows


def _echo(prompts):
    return [p.split("질문: ")[-1] for p in prompts]


def _asks(prompts):
    return ['[{"q": "Of ' + p.rsplit("\n", 1)[-1][:2] + '?", "difficulty": "easy"}, {"q": "the above code", "difficulty": "hard"}]' for p in prompts]


def _graph_asks(prompts):
    return ['[{"q": "Who?", "difficulty": "medium", "evidence_description": "e", "entity_aliases": ["A"], "relation": {"source_name": "S", "target_name": "T", "relation_type": "calls"}}]' for _ in prompts]


def _judges(prompts):
    return ["no" if "other" in p else "yes" for p in prompts]


def _fails(prompts):
    raise OSError("no model")


_Q = "query_id int, query string"
rows("udf15_hypothetical_texts", _Q, [(1, "why?"), (2, None)], "query_id, text", [(1, "why?"), (2, None)], lambda df: models.hypothetical(df, _echo))
rows("udf09_answers", "id int, prompt string", [(1, "a"), (2, None), (3, "b")], "id, answer", [(1, "A"), (2, None), (3, "B")], lambda df: models.asked(df, "prompt", lambda ps: [p.upper() for p in ps], batch=1))
rows("udf10_failed_endpoint", "id int, prompt string", [(1, "a")], "id, answer", [(1, None)], lambda df: models.asked(df, "prompt", _fails, tries=2, pause=0.0))
_CHUNK = "order int, document_id long, content string, distractors array<string>"
_CHUNKS = [(0, 7, "alpha", []), (1, 8, "gamma", ["other text"]), (2, 9, "delta", ["plain"])]
rows("udf18_generated_questions", _CHUNK, _CHUNKS[:1], "order, pos, question, difficulty", [(0, 0, "Of al?", "easy"), (0, 1, "the above code", "hard")], lambda df: models.questions(df, _asks, 2))
_SUB = "order int, name string, document_ids array<long>, snippet string, document string, distractors array<string>"
_SUBS = [(0, "S", [3, 1], "S calls T", None, []), (1, "T", [2], "T", "doc", ["other"] * 5)]
rows("udf19_graph_questions", _SUB, _SUBS[:1], "order, question, evidence, aliases, relation_type", [(0, "Who?", "e", ["A"], "calls")], lambda df: models.graph_questions(df, _graph_asks, 1).withColumn("relation_type", F.col("relation.relation_type")))
_PAIR = "order int, src_doc long, dst_doc long, snippet string, distractors array<string>"
rows("udf20_pair_questions", _PAIR, [(0, 9, 4, "A-B", [])], "order, pos, question", [(0, 0, "Of A-?"), (0, 1, "the above code")], lambda df: models.questions(df.withColumn("content", F.col("snippet")), _asks, 2, models.PAIR_QUESTIONS.replace("{snippet}", "{content}")))
rows("udf27_gold_set", _CHUNK, _CHUNKS, "id, query, relevant_doc_ids", [("q0001", "Of al?", [7]), ("q0002", "Of ga?", [8])], lambda df: models.chunk_gold_set(df, _asks, _judges))
rows("udf41_chunk_mode", _CHUNK, _CHUNKS, "order, pos, reason", [(0, 0, None), (0, 1, "demonstrative"), (1, 0, None), (1, 1, "demonstrative"), (2, 0, "generic"), (2, 1, "demonstrative")], lambda df: models.judged(models.questions(df, _asks, 2), _judges))
rows("udf43_graph_mode", _SUB, _SUBS, "id, query, relevant_doc_ids, difficulty", [("q0001", "Who?", [1, 3], "medium"), ("q0002", "Who?", [2], "medium")], lambda df: models.graph_gold_set(df, _graph_asks, _judges))
rows("udf44_graph_gates", _SUB, [(0, "S", [1], "x", None, ["yes"] * 5), (1, "S", [1], "other", None, [])], "order, reason", [(0, "generic"), (1, "not_answerable")], lambda df: models.judged(models.graph_questions(df, _graph_asks, 1).withColumn("content", F.col("snippet")), _judges))
rows("udf45_pair_mode", _PAIR, [(0, 9, 4, "A-B", []), (1, 2, 2, "other", [])], "id, query, relevant_doc_ids", [("q0001", "Of A-?", [4, 9])], lambda df: models.pair_gold_set(df, _asks, _judges))
rows("udf46_pair_gates", _PAIR, [(0, 9, 4, "other", [])], "pos, reason", [(0, "not_answerable"), (1, "not_answerable")], lambda df: models.judged(models.questions(df.withColumn("content", F.col("snippet")), _asks, 2), _judges))


def _section_model(prompts):
    return ['{"sections": [{"section_index": 0, "questions": ["What is it?", "no"]}, {"section_index": 1, "questions": ["WHAT is it?", "And why?"]}, {"section_index": 9, "questions": ["Beyond?"]}]}' if "First" in p else "broken" for p in prompts]


_SECTION = "doc long, title string, index int, text string"
rows("udf16_section_questions", _SECTION, [(1, "First", 0, "aaaa"), (1, "First", 1, "bb"), (2, "Other", 0, "c")], "doc, section, question", [(1, 0, "What is it?"), (1, 1, "And why?")], lambda df: models.section_questions(df, "doc", "title", _section_model))
rows("udf17_batched_sections", _SECTION, [(1, "First", 0, "aaaa"), (1, "First", 1, "bbbb")], "doc, section, question", [(1, 0, "What is it?"), (1, 1, "And why?")], lambda df: models.section_questions(df, "doc", "title", _section_model, budget=4))
rows("udf48_unit_answers", "id int, title string, content string", [(1, "T", "x"), (2, "T", "other")], "id, answer", [(1, '{"entities": []}'), (2, None)], lambda df: models.unit_answers(df, "title", "content", lambda ps: ["nothing" if "other" in p else '```{"entities": []}```' for p in ps]))
rows("udf13_reranked_texts", "id int, documents array<string>", [(1, ["a", "bbb"])], "id, scores", [(1, [1.0, 3.0])], lambda df: models.asked(df.withColumn("prompt", F.to_json("documents")), "prompt", lambda ps: ['{"scores": [' + ", ".join(str(float(len(t))) for t in models._read(p)) + "]}" for p in ps]).select("id", _scores()))
rows("udf47_graded_answers", "item int, query string, source string, context string", [(1, "q", "s", "c"), (2, "q", "other", "c")], "item, median, n_failed", [(1, 4, 0), (2, -1, 3)], lambda df: evaluation.judged(models.graded(df, lambda ps: ["?" if "other" in p else '{"score": 4}' for p in ps], 3), ["item"]))


def _scores():
    from ..functions import answers as A

    return A.rerank_scores(F.col("answer"), F.size("documents")).alias("scores")


# ---------------------------------------------------------------- pages of a server

_ANSWERS = [("1", '{"title": "T", "version": {"number": 3}, "body": {"storage": {"value": "<h1>A</h1><p>b</p>"}}, "space": {"key": "DEV"}, "ancestors": [{"title": "Up"}]}'), ("2", '{"id": "2", "content": ""}')]
_ANSWER = "page_id string, answer string"
rows("src34_imported_pages", _ANSWER, _ANSWERS, "page_id, title, version, content", [("1", "T", 3, "# A\n\nb"), ("2", "Confluence Page 2", None, "")], models.imported)
rows("src35_pages_with_ancestors", _ANSWER, _ANSWERS, "page_id, breadcrumb", [("1", "DEV / Up / T"), ("2", "2")], models.imported)
for _name in ("src33_imported_space", "snk10_imported_pages"):
    rows(_name, _ANSWER, _ANSWERS, "page_id, change_type", [("1", "created"), ("2", "unchanged")], lambda df: models.imported(df).select("page_id", F.when(F.col("content") == "", "unchanged").otherwise("created").alias("change_type")))


def _server(n, cap):
    return lambda at, size: ([{"id": k} for k in range(at, min(n, at + min(size, cap)))], n)


def _listed(df, n, cap, **options):
    found = paged.listing(df.sparkSession, f"fixture_{uuid.uuid4().hex}", _server(n, cap), **options)
    return found.select(F.get_json_object("row", "$.id").cast("int").alias("id"))


for _name, _n, _cap in (("src14_paged_listing", 7, 3), ("src24_paged_spaces", 5, 2), ("src25_paged_pages", 3, 10), ("src19_searched_pages", 4, 1), ("src36_searched_results", 1, 1)):
    rows(_name, "id int", [(0,)], "id", [(k,) for k in range(_n)], lambda df, n=_n, cap=_cap: _listed(df, n, cap, size=5, parts=2))

# ---------------------------------------------------------------- files


def _folder(df, name, content):
    """A folder of literal files in the shared folder."""
    return put_texts(df.select(F.col(name).alias("path"), F.col(content).alias("text")))


_FILES = "path string, content string"
rows("src09_text_files", _FILES, [("a/x.MD", "# é"), ("a/y.bin", "no"), ("node_modules/z.txt", "no"), ("p.html", "<p>")], "source_id, content", [("x.MD", "# é"), ("p.html", "<p>")], lambda df: files.text_files(df.sparkSession, _folder(df, "path", "content")))
rows("src10_collected_files", _FILES, [("src/vpc/a.py", "x"), ("src/b.py", "y"), ("src/big.py", "z" * 3000), ("dist/c.py", "n"), ("src/d.txt", "t")], "source_id, product", [("a.py", "vpc"), ("b.py", "all")], lambda df: files.text_files(df.sparkSession, _folder(df, "path", "content"), ("py",), 2).withColumn("product", T.product_of(F.col("path"), [("vpc", ["*/vpc/*"], []), ("all", ["*"], [])])))
for _name in ("str13_collected_products", "str23_collected_files"):
    rows(_name, _FILES, [("src/vpc/a.py", "x"), ("src/vpc/b.py", "y"), ("src/c.py", "y")], "product, n", [("vpc", 2), ("all", 1)], lambda df: df.withColumn("product", T.product_of(F.col("path"), [("vpc", ["*/vpc/*"], []), ("all", ["*"], [])])).groupBy("product").agg(F.count("*").alias("n")))
rows("src11_snapshots", "path string, old string, new string", [("a", "1", "1"), ("b", "1", "2"), ("c", None, "1")], "path", [("b",), ("c",)], lambda df: df.where(~F.col("old").eqNullSafe(F.col("new"))))
rows("flt07_product_paths", "path string", [("a/vpc_policies.py",), ("b/key-store.go",), ("c/monkey.go",)], "product, paths", [("policy", ["a/vpc_policies.py"]), ("key", ["b/key-store.go"])], lambda df: df.join(df.sparkSession.createDataFrame([("policy",), ("key",)], "product string"), T.names_product(F.col("path"), F.col("product"))).groupBy("product").agg(F.array_sort(F.collect_list("path")).alias("paths")))
rows("flt08_product_scopes", "config string", [('{"products": {"vpc": {"paths": ["src/*"], "display_name": "V"}, "kms": {"exclude": ["x"]}}}',)], "name, display_name, paths, exclude", [("vpc", "V", ["src/*"], []), ("kms", "kms", [], ["x"])], lambda df: files.product_scopes(df, "config"))
rows("udf38_source_config", "config string", [('{"repositories": [{"url": "u1", "branch": "dev"}, {"url": "u2"}, {"branch": "x"}]}',)], "url, branch", [("u1", "dev"), ("u2", "main")], lambda df: files.repositories(df, "config"))
rows("flt35_gold_paths", _FILES, [("g/a.jsonl", "{}"), ("g/b.jsonl", "{}"), ("g/c.txt", "x")], "file", [("a.jsonl",), ("b.jsonl",)], lambda df: df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(_folder(df, "path", "content")).select(F.element_at(F.split("path", "/"), -1).alias("file")))
_GOLD_LINE = '{"id": "q1", "query": "why", "relevant_doc_ids": [1, 2], "relevant_doc_groups": [[1, 2]], "difficulty": "easy"}\n{"id": "q2", "query": "how", "relevant_doc_ids": []}'
rows("src31_gold_set", _FILES, [("g.jsonl", _GOLD_LINE)], "id, query, relevant_doc_ids, difficulty", [("q1", "why", [1, 2], "easy"), ("q2", "how", [], None)], lambda df: files.gold_set(df.sparkSession, _folder(df, "path", "content")))
rows("snk39_saved_gold_set", "id string, query string, difficulty string", [("q1", "why", "easy"), ("q2", "how", None)], "line", [('{"id":"q1","query":"why","difficulty":"easy"}',), ('{"id":"q2","query":"how"}',)], lambda df: df.select(F.to_json(F.struct("id", "query", "difficulty")).alias("line")))
for _name in ("src32_result_sheet", "src45_results_by_id"):
    rows(_name, _FILES, [("r.csv", "id,recall,mrr\nq1,0.5,\nq2,None,1\n")], "id, metric, value", [("q1", "recall", 0.5), ("q2", "mrr", 1.0)], lambda df: files.result_sheet(df.sparkSession, _folder(df, "path", "content")))
rows("src44_summaries", _FILES, [("s.json", '{\n "label": "a",\n "n_queries": 3\n}')], "label, n_queries", [("a", 3)], lambda df: df.sparkSession.read.schema("label string, n_queries int").json(_folder(df, "path", "content"), multiLine=True))
rows("snk38_summaries", "mode string, failed boolean, recall double", [("chunk", False, 0.5), ("chunk", True, None)], "summary", [('{"mode":"chunk","n":2,"n_failed":1,"failure_rate":0.5,"recall":0.5}',)], lambda df: evaluation.means_by_mode(df, ["recall"]).select(F.to_json(F.struct("mode", "n", "n_failed", "failure_rate", "recall")).alias("summary")))
rows("agg38_anchors", "name string, value string", [("corpus", "c"), ("gold", "g")], "name, sha256", [("corpus", "2e7d2c03a9507ae265ecf5b5356885a53393a2029d241394997265a1a25aefc6"), ("gold", "cd0aa9856147b6c5b4ff2b7dfee5da20aa38253099ef1b4a64aced233c9afe29")], lambda df: df.select("name", T.content_hash(F.col("value")).alias("sha256")))
rows("udf52_verified_manifest", "side string, key string, value string", [("m", "corpus", "1"), ("c", "corpus", "1"), ("m", "gold", "1"), ("c", "gold", "2")], "key", [("gold",)], lambda df: evaluation.differing(*(df.where(F.col("side") == s).select("key", "value") for s in "mc"), ("corpus", "gold")))

# ---------------------------------------------------------------- callers

_DOC = "id long, source_type string, status string, updated_at int, title string"
_DOCS = [(1, "git_code", "completed", 3, "a"), (2, "upload", "failed", 5, "b"), (3, "git_code", "failed", 9, "c")]
rows("udf24_listed_documents", _DOC, _DOCS, "id", [(3,), (1,)], lambda df: api.list_documents(df, source_type="git_code"))
rows("udf24_document", _DOC, _DOCS, "title, missing", [("b", True)], lambda df: df.sparkSession.createDataFrame([(api.get_document(df, 2)["title"], api.get_document(df, 99) is None)], "title string, missing boolean"))
rows("udf24_graph_context", "id long, entity_name string, entity_type string, description string", [(1, "Auth", "system", None), (2, "Team", "team", "x")], "text", [("## 관련 그래프 컨텍스트\n\n**엔티티:**\n- Auth (system) *\n- Team (team) — x\n\n**관계:**\n- Auth --[owned_by]--> Team",)], lambda df: df.sparkSession.createDataFrame([(api.get_graph_context(df, df.sparkSession.createDataFrame([(1, 1, 2, "owned_by", None)], "edge_id int, src long, dst long, relation_type string, label string"), "auth"),)], "text string"))
rows("udf34_stats", _DOC, _DOCS, "document_count, git_code_count, code_doc_count, chunk_count", [(3, 2, 0, 2)], lambda df: api.stats(df, chunk=df.where("id < 3")))
rows("udf31_commands", "args array<string>", [([],), (["d"],), (["d", "nothing"],)], "n, code", [(0, 0), (1, 2), (2, 2)], lambda df: _commands(df))


def _commands(df):
    import contextlib
    import io

    from ..__main__ import main

    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        found = [(len(r.args), main(list(r.args))) for r in df.collect()]
    return df.sparkSession.createDataFrame(found, "n int, code int")
