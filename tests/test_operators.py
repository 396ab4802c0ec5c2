import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import ranking as R
from quernstone.functions import vectors as V
from quernstone.operators import chunking, documents, evaluation, goldset, graph, parsing, retrieval, sync


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ids(*x):
    return F.array(*(F.lit(k) for k in x)) if x else F.array().cast("array<int>")


def test_ranking_literals(spark):
    assert one(spark, R.recall_at_k(ids(1, 99), ids(1, 2), 2)) == 0.5
    assert one(spark, R.precision_at_k(ids(1, 2, 3), ids(1), 3)) == pytest.approx(1 / 3)
    assert one(spark, R.reciprocal_rank(ids(99, 5, 1), ids(5))) == 0.5
    assert one(spark, R.ndcg_at_k(ids("A", "B", "C"), ids("A", "C"), 3)) == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert one(spark, R.recall_at_k(ids(1), ids(), 3)) == one(spark, R.ndcg_at_k(ids(1), ids(), 3)) == 0
    got, want = R.representatives(ids(5, 3, 8), F.array(ids(3, 5), ids(9, 7)))
    assert one(spark, got) == [5, 8] and one(spark, want) == [5, 9]


def test_cosine(spark):
    assert one(spark, V.cosine(V.literal([1, 0]), V.literal([1, 1]))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.cosine(V.literal([0, 0]), V.literal([1, 1]))) == one(spark, V.cosine(V.literal([1]), V.literal([1, 1]))) == 0


def test_summary_and_statistics(spark):
    values = spark.createDataFrame([("r", 0.6), ("r", 0.5), ("r", 0.7), ("s", 0.1)], "metric string, value double")
    got = {r.metric: r for r in evaluation.summary(values, ["metric"]).collect()}
    assert got["r"].mean == pytest.approx(0.6) and got["r"].std == pytest.approx(0.1) and got["s"].std == 0 and got["r"].n == 3
    diffs = spark.createDataFrame([("m", x) for x in (1.0, -1.0, 2.0, 0.0, 3.0)], "metric string, diff double")
    r = evaluation.signed_ranks(diffs, ["metric"]).first()
    assert (r.n, r.w_plus) == (4, 8.5)
    t = evaluation.signed_rank_test(diffs.union(spark.createDataFrame([("zeros", 0.0)], diffs.schema)), ["metric"])
    got = {x.metric: (x.n, round(x.p, 6)) for x in t.collect()}
    assert got == {"m": (4, round(2 * (1 - 0.5 * (1 + math.erf(abs(r.z) / math.sqrt(2)))), 6)), "zeros": (0, 1.0)}
    many = spark.createDataFrame([("m", k, float(k % 10)) for k in range(500)], "metric string, k int, value double")
    b = evaluation.bootstrap_mean(many, ["metric"], "k", resamples=100).first()
    assert b.low < b.mean == 4.5 < b.high and b.high - b.low < 1
    assert evaluation.resampled([1.0, 1.0])["low"] == 1.0 and evaluation.resampled([])["n"] == 0
    rng, values = random.Random(42), [0.1, 0.5, 0.7]
    means = sorted(sum(values[rng.randrange(3)] for _ in range(3)) / 3 for _ in range(1000))
    found = evaluation.resampled(values)
    assert (found["low"], found["high"]) == (means[25], means[975])


def test_upsert_versions(spark):
    stored = spark.createDataFrame([("m", "1", "old", documents_hash("old"), 3, "completed", 1), ("m", "2", "same", documents_hash("same"), 1, "completed", 1)], "source_type string, source_id string, original_content string, content_hash string, version int, status string, source_version int")
    new = spark.createDataFrame([("m", "1", "new", 2), ("m", "2", "same", 9), ("m", "3", "born", None)], "source_type string, source_id string, original_content string, source_version int")
    got = {r.source_id: r for r in documents.upsert(stored, new, ["source_type", "source_id"]).collect()}
    assert (got["1"].version, got["1"].status, got["1"].original_content) == (4, "changed", "new")
    assert (got["2"].version, got["2"].status, got["2"].source_version) == (1, "completed", 9)
    assert (got["3"].version, got["3"].status) == (1, "pending")


def documents_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_graph(spark):
    mentions = spark.createDataFrame([(1, 0, "Auth Service", "struct", ""), (2, 0, "auth-service", "class", "logs in"), (3, 0, "--", "class", None), (3, 1, "__", "class", None)], "document_id int, ordinal int, entity_name string, entity_type string, description string")
    got = {(r.entity_name, r.entity_type): r for r in graph.merge_entities(mentions).collect()}
    assert set(got) == {("Auth Service", "class"), ("--", "class"), ("__", "class")} and got["Auth Service", "class"].description == "logs in"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 3), (7, 8)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.hop for r in graph.hops(edges, start, 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert [r.id for r in graph.component(edges, start, 4).collect()] == [1, 2, 3, 4]
    same = [graph.fingerprint(edges.repartition(n), ["src", "dst"]).first()[0] for n in (1, 3)]
    assert same[0] == same[1] != graph.fingerprint(edges.limit(4), ["src", "dst"]).first()[0]


def test_budgets_and_neighbours(spark):
    rows = spark.createDataFrame([("q", k, k, c) for k, c in enumerate([50, 70, 30, 40])], "q string, id int, place int, cost int")
    assert sorted(r.id for r in retrieval.budget_greedy(rows, ["q"], "id", "place", "cost", 100).collect()) == [0, 2]
    assert sorted(r.id for r in retrieval.budget_prefix(rows, ["q"], [F.col("place")], "cost", 30).collect()) == [0]
    vectors = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(40)], "id long, v array<double>")
    got = retrieval.nearest_for_all(vectors.where("id < 5"), vectors, 3, "id", "v", block=7).collect()
    for q in range(5):
        want = sorted((k for k in range(40) if k != q), key=lambda k: (-math.cos(k - q), k))[:3]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_sync(spark):
    assert one(spark, sync.lower_bound(F.lit("2024-01-02 00:10"), 30)) == "2024-01-01 23:40"
    assert one(spark, sync.lower_bound(F.lit("garbage"), 30)) is None and one(spark, sync.lower_bound(F.lit("2024-01-02 00:10"), -5)) == "2024-01-02 00:10"
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "id int")
    plan = sync.fetch_plan(keys(1, 2, 3), keys(2, 3, 4), keys(2), keys(3, 4), "id").collect()
    assert {r.id: r.reason for r in plan} == {1: "new", 2: "changed", 3: "retry", 4: "removed"}
    pages = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9)], "id int, parent_id int")
    assert {r.id: r.depth for r in sync.subtree(pages, 0).collect()} == {1: 1, 2: 2, 3: 3}
    looped = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2), (4, 3), (1, 4), (0, 4)], "id int, parent_id int")
    assert sorted((r.id, r.parent_id, r.depth) for r in sync.subtree(looped, 0).collect()) == [(1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 2, 3)]
    assert sync.subtree(looped, 99).collect() == []


def test_chunks():
    text = "# Project\nintro\n## Architecture\nx\n### Backend\ny\n## Deployment\n```\n# no heading\n```"
    assert [" > ".join(x.path) for x in chunking.sections(text)] == ["Project", "Project > Architecture", "Project > Architecture > Backend", "Project > Deployment", "no heading"]
    assert chunking.blocks("a\nb\n\n| x | y |\n|---|---|\nc\n```\nd\n\ne\n```") == [("a\nb", False), ("| x | y |\n|---|---|", True), ("c", False), ("```\nd\n\ne\n```", True)]
    out = chunking.packed([("a" * 100, False)], 30, 10)
    assert [c.tokens for c in out] == [30, 30, 30, 30, 20] and out[0].content == "a" * 30
    with pytest.raises(ValueError):
        chunking.packed([], 10, 10)


def test_parsers():
    source = "import os\nfrom .a import b\nclass C:\n    def run(self, x): pass\ndef helper(): pass\n"
    code = parsing.python_code(source)
    assert [(x.kind, x.parent, x.name) for x in code.symbols] == [("method", "C", "run"), ("function", "", "helper")] and code.imports == ["os", "a"]
    assert [x.kind for x in parsing.file_code("def (", "x.py").symbols] == ["module"]
    assert [(x.kind, x.name) for x in parsing.brace_symbols("export class A {\n}\n", "typescript")] == [("class", "A")]
    assert [(x.kind, x.parent, x.name) for x in parsing.brace_symbols("func (s *S) Run(x int) {\n}\n", "go")] == [("method", "S", "Run")]


def test_gates(spark):
    asked = lambda q: one(spark, goldset.points_at_text(F.lit(q)))
    assert asked("What does this module say?") and asked("이 함수에서 무엇") and not asked("What does thismodule say?")
    assert one(spark, goldset.identifier_leak(F.lit("what is max_size"), F.lit("set max_size to 3"))) and not one(spark, goldset.identifier_leak(F.lit("what is size"), F.lit("set max_size to 3")))


def test_disjoint_seeds_over_all_parts(spark, tmp_path):
    from quernstone.plans import registry

    lines = [(p, (p * 31 + k * 17) % 90) for p in range(50, 140) for k in range(1 + p % 3)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    docs = {p: {o for q, o in lines if q == p} for p, _ in lines}
    want = {(p, p + 7, min(docs[p]), min(docs[p + 7])) for p in docs if p + 7 in docs and not docs[p] & docs[p + 7]}
    got = registry.QUERIES["join13_disjoint_seeds"][0](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and max(r.src for r in got) > 60


def test_bootstrap_of_any_size(spark, monkeypatch, tmp_path):
    from quernstone.plans import registry

    seen, own = [], evaluation.bootstrap_mean
    monkeypatch.setattr(evaluation, "bootstrap_mean", lambda values, by, row, resamples=1000, **k: seen.append(resamples) or own(values, by, row, resamples, **k))
    rows = [("a", k, float(k % 10)) for k in range(50)] + [("a", 99, None)]
    spark.createDataFrame(rows, "event_type string, event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    r = registry.QUERIES["agg09_interval_of_any_size"][0](spark, str(tmp_path)).first()
    assert seen == [1000] and r.n == 50 and r.low < r.mean < r.high
    again = spark.createDataFrame(rows, "event_type string, event_id long, value double").repartition(7)
    assert own(again, ["event_type"], "event_id").first() == r


def test_nearest_passes_over_unsound_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query_id, r.rank): r.id for r in retrieval.nearest_for_all(df, df, 1, "id", "v").collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (7, 1): 2}
    assert retrieval.nearest_for_all(df.where("id = 3"), df, 1, "id", "v").collect() == []


def test_models_are_tried_again_and_failures_are_null(spark):
    from quernstone.operators import models

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "id int, p string").coalesce(1)

    def model(prompts):
        if "boom" in prompts:
            raise OSError("busy")
        return [p * 2 for p in prompts]

    assert {r.id: r.answer for r in models.asked(df, "p", model, batch=1, tries=2, pause=0.0).collect()} == {1: "aa", 2: None, 3: None}
    assert models.asked(df.limit(0), "p", model).collect() == []


def test_judge_is_asked_by_one_worker_and_in_slices(spark):
    from quernstone.operators import models

    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a"), (None, None)], "id long, p string").coalesce(1)
    assert {tuple(r) for r in models.asked_each(df, {"x": ("p", lambda ps: [p.upper() for p in ps]), "y": ("p", lambda ps: ps)}).collect()} == {(big, "a", "A", "a"), (None, None, None, None)}

    def asks(prompts):
        return ['[{"q": "Which?", "difficulty": "easy"}]' for _ in prompts]

    def judge(prompts):
        with open("/proc/self/statm") as f:
            return [f"yes\n{f.read().split()[1]}"] * len(prompts)

    rows = spark.range(2).select("id", F.lit("alpha").alias("content"), F.array(F.lit("t")).alias("distractors"))
    made = models.judged(models.questions(rows, asks, 1), judge)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 2 and plan.count("ArrowEvalPython") == 1
    assert [r.reason for r in made.collect()] == ["generic"] * 2
    # answers of a MB each for prompts of 10 kB: those of a slice of prompts are held, not those of all
    many = spark.range(2000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("p"))

    def long(prompts):
        with open("/proc/self/statm") as f:
            return [f.read().split()[1] + " " * 300_000] * len(prompts)

    used = [int(r.n) for r in models.asked(many, "p", long).select(F.trim("answer").alias("n")).collect()]
    assert len(used) == 2000 and (max(used) - min(used)) * 4096 < 250 << 20
