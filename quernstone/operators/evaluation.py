"""Evaluation: measures by query, summaries over runs, paired statistics, threshold sweeps."""

from __future__ import annotations

import math
import random
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from ..functions import ranking as R
from ..sources.shared import checkpointed


def measures(results: DataFrame, retrieved: str, relevant: str, k: int) -> DataFrame:
    """results with recall, precision, hit, mrr and ndcg at k."""
    a, b = F.col(retrieved), F.col(relevant)
    return results.withColumns({f"recall_{k}": R.recall_at_k(a, b, k), f"precision_{k}": R.precision_at_k(a, b, k), f"hit_{k}": R.hit_at_k(a, b, k), "mrr": R.reciprocal_rank(a, b), f"ndcg_{k}": R.ndcg_at_k(a, b, k)})


def long_form(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value), nulls left out."""
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(*keys, "m.*").where("value is not null")


def summary(values: DataFrame, by: list[str]) -> DataFrame:
    """mean, sample deviation (0 for one value), least, greatest and number."""
    return values.groupBy(*by).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("value").alias("n"))


def paired(baseline: DataFrame, treatment: DataFrame, key: str) -> DataFrame:
    """(key, metric, diff) of two long forms, where both have a value."""
    a = baseline.select(key, "metric", F.col("value").alias("_a"))
    return treatment.join(a, [key, "metric"]).select(key, "metric", (F.col("value") - F.col("_a")).alias("diff"))


def hit_changes(baseline: DataFrame, treatment: DataFrame, key: str) -> DataFrame:
    """(key, change) of hits: new, lost, kept or missed."""
    both = baseline.select(key, F.col("value").alias("_a")).join(treatment.select(key, F.col("value").alias("_b")), key)
    a, b = F.col("_a") > 0, F.col("_b") > 0
    return both.select(key, F.when(a & b, "kept").when(b, "new").when(a, "lost").otherwise("missed").alias("change"))


def signed_ranks(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w_plus and z of the signed-rank statistic: zeros left out, mean ranks for ties, no correction for them.

    Equal sizes are counted first; ranks come from running sums within range
    partitions of the sizes and the sums of those before, so no group is sorted by one task.
    """
    sizes = diffs.where("diff <> 0").groupBy(*by, F.abs("diff").alias("size")).agg(F.count("*").alias("n"), F.sum((F.col("diff") > 0).cast("long")).alias("up"))
    parts = max(1, int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = W.partitionBy(*by, "_p")
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = checkpointed(sizes.repartitionByRange(parts, *by, "size").withColumn("_p", F.spark_partition_id()).withColumn("_here", zero(F.sum("n").over(own.orderBy("size").rowsBetween(W.unboundedPreceding, -1)))))
    totals = local.groupBy(*by, "_p").agg(F.sum("n").alias("_c"))
    offsets = totals.select(*by, "_p", zero(F.sum("_c").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    ranked = local.join(offsets, [*by, "_p"]).withColumn("rank", F.col("_before") + F.col("_here") + (F.col("n") + 1) / 2)
    got = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"))
    n = F.col("n").cast("double")
    return got.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """The standard normal distribution; built-ins have no error function."""
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), na_action="ignore")


def signed_rank_test(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w_plus, z and the two-sided p of the signed-rank statistic; groups of zeros alone have none of them but p = 1."""
    found = signed_ranks(diffs, by).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
    groups = diffs.select(*by).distinct()
    return groups.join(found, by, "left").select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("p", F.lit(1.0)).alias("p"))


#: Beginnings of the names of metrics that two runs are compared by, and settings in which they must agree.
METRICS = ("recall@", "precision@", "hit@", "ndcg@", "mrr", "graph_recall@", "graph_precision@", "graph_hit@", "graph_ndcg@", "graph_mrr", "judge_score", "elapsed_ms")
SETTINGS = (
    "gold_set_sha256", "embedding_model", "llm_model", "top_k", "max_chunks", "similarity_threshold", "rerank_enabled", "hyde_enabled", "judge_mode", "vector_store_sha256", "corpus_sha256",
    "graph_store_sha256",
)


def is_metric(name: Column) -> Column:
    return reduce(lambda a, b: a | b, (name.startswith(m) for m in METRICS))


def id_list(text: Column) -> Column:
    """Whole numbers of a list with commas; what is none is passed over."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(parts, lambda x: x.isNotNull())


def item_mode(cross_document: Column, has_documents: Column, has_graph: Column) -> Column:
    """What a gold item asks for: cross_doc, hybrid, graph or chunk."""
    return F.when(cross_document, "cross_doc").when(has_documents & has_graph, "hybrid").when(has_graph, "graph").otherwise("chunk")


def violated_requirements(judged: Column, own_judge: Column, allowed: Column, seed: Column, samples: Column, fingerprint: Column) -> Column:
    """What a run lacks for its absolute scores to count, as messages."""
    checks = [
        F.when(judged & own_judge & ~allowed, "self-evaluation Judge (분리된 Judge 필요)"),
        F.when(judged & seed.isNull(), "--judge-seed-base 미설정 (Judge 재현성 필요)"),
        F.when(judged & (samples < 3), F.concat(F.lit("--judge-n-samples >= 3 필요 (현재 "), samples.cast("string"), F.lit(")"))),
        F.when(F.coalesce(fingerprint, F.lit("")) == "", "인덱스 지문(vector_store_sha256) 비어 있음 (앵커링 불가)"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def differing(baseline: DataFrame, treatment: DataFrame, keys: tuple[str, ...] = SETTINGS) -> DataFrame:
    """(key, baseline, treatment) of the settings, tables (key, value), in which two runs differ; a missing one is null."""
    wanted = baseline.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    side = lambda df, name: df.select("key", F.col("value").alias(name))
    both = wanted.join(side(baseline, "baseline"), "key", "left").join(side(treatment, "treatment"), "key", "left")
    return both.where(~F.col("baseline").eqNullSafe(F.col("treatment")))


def bootstrap_mean(values: DataFrame, by: list[str], row: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of each group, from ``resamples`` Poisson resamples.

    Every row is in a resample as often as a Poisson number drawn from the hash of
    its id ``row`` says, so resamples are sums of rows, groups may have any size, and the
    result is the same however rows are dealt out.
    """
    keyed = values.where("value is not null").select(*by, "value", F.col(row).alias("_row"))
    drawn = keyed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "_row", "_b"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    bounds, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        bounds.append(total)
        p /= k + 1
    times = sum(((u > b).cast("int") for b in bounds), F.lit(0))
    means = drawn.withColumn("_t", times).groupBy(*by, "_b").agg((F.sum(F.col("value") * F.col("_t")) / F.sum("_t")).alias("m"))
    order = F.array_sort(F.collect_list("m"))
    at = lambda q: F.element_at(order, F.least(F.greatest((q * F.size(order)).cast("int") + 1, F.lit(1)), F.size(order)))
    return means.groupBy(*by).agg(at(F.lit(alpha / 2)).alias("low"), at(F.lit(1 - alpha / 2)).alias("high")).join(values.groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n")), by)


def resampled(values: list[float], resamples: int = 1000, alpha: float = 0.05, seed: int = 42, effect: float = 0.0) -> dict[str, float]:
    """Mean, deviation, percentile interval of the mean, and how often it exceeds 0 and ``effect``, of one list by resampling with replacement."""
    n = len(values)
    if not n:
        return dict.fromkeys(("mean", "std", "low", "high", "p_improve", "p_effect", "cohen_d"), 0.0) | {"n": 0}
    rng, mean = random.Random(seed), math.fsum(values) / n
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    std = math.sqrt(math.fsum((x - mean) ** 2 for x in values) / (n - 1)) if n > 1 else 0.0
    low, high = max(0, int(alpha / 2 * resamples)), min(resamples - 1, int((1 - alpha / 2) * resamples))
    above = lambda x: sum(m > x for m in means) / resamples
    return {"mean": mean, "std": std, "low": means[low], "high": means[high], "p_improve": above(0.0), "p_effect": above(effect), "cohen_d": mean / std if std > 0 else 0.0, "n": n}


STATISTICS = "n long, mean double, std double, low double, high double, p_improve double, p_effect double, cohen_d double"


def bootstrap(values: DataFrame, by: list[str], order: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42, effect: float = 0.0) -> DataFrame:
    """by and the columns of ``STATISTICS`` of each group, whose values are resampled in the order of ``order``.

    A group is the results of one evaluation set, thousands of values at most;
    ``bootstrap_mean`` takes groups of any size.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = resampled(group.sort_values(order)["value"].astype(float).tolist(), resamples, alpha, seed, effect)
        return pd.DataFrame([{b: group[b].iloc[0] for b in by} | found])[[*by, *(c.split()[0] for c in STATISTICS.split(", "))]]

    names = ", ".join(f"`{b}` {values.schema[b].dataType.simpleString()}" for b in by)
    return values.where("value is not null").select(*by, order, "value").groupBy(*by).applyInPandas(run, f"{names}, {STATISTICS}")


def compared(baseline: DataFrame, treatment: DataFrame, key: str, settings: tuple[DataFrame, DataFrame] | None = None, effect: float = 0.0) -> DataFrame:
    """metric, the statistics of the paired differences and the p of their signed ranks; no rows if the runs' settings differ."""
    diffs = paired(baseline, treatment, key)
    if settings is not None and not differing(*settings).isEmpty():
        diffs = diffs.limit(0)
    found = bootstrap(diffs.withColumnRenamed("diff", "value"), ["metric"], key, effect=effect)
    return found.join(signed_rank_test(diffs, ["metric"]).select("metric", "p"), "metric")


def means_by_mode(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """mode, n, how many failed, the share of these, and the mean of each metric over the rows that have it."""
    failed = F.sum(F.coalesce(F.col("failed"), F.lit(False)).cast("int"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), failed.alias("n_failed"), (failed / F.count("*")).alias("failure_rate"), *(F.avg(m).alias(m) for m in metrics))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the sweep with the greatest f1, of equal ones that with the least threshold."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def inconsistent(settings: DataFrame) -> DataFrame:
    """(key, n): settings (run, key, value) that have several values over the runs."""
    return settings.groupBy("key").agg(F.count_distinct(F.coalesce("value", F.lit("\x00"))).alias("n")).where("n > 1")


def judged(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, median (the mean of two middle scores rounded half to even), mean, std, least, greatest and number of scores of 0 or more; -1 if there is none."""
    good = F.when(F.col("score") >= 0, F.col("score"))
    scores = F.array_sort(F.collect_list(good))
    n = F.size(scores)
    middle = lambda k: F.get(scores, k.cast("int")).cast("double")
    half = F.floor(n / 2)
    median = F.when(n == 0, -1).when(n % 2 == 1, middle(half)).otherwise(F.bround((middle(half - 1) + middle(half)) / 2, 0)).cast("int")
    spread = lambda c: F.when(n > 1, c)
    return samples.groupBy(*by).agg(
        median.alias("median"), n.alias("n"), (F.count("*") - F.count(good)).alias("n_failed"), spread(F.avg(good)).alias("mean"), spread(F.stddev_samp(good)).alias("std"),
        spread(F.min(good)).cast("double").alias("least"), spread(F.max(good)).cast("double").alias("greatest"),
    )


def threshold_sweep(pairs: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 at each threshold, from one pass over the pairs.

    Each pair is put once where the thresholds it reaches end; running sums over the thresholds do the rest.
    """
    edges = sorted(thresholds)
    reached = sum(((F.col(score) >= t).cast("int") for t in edges), F.lit(0))
    bins = pairs.groupBy(reached.alias("_b")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    sides = bins.agg(*(F.sum(F.when(F.col("_b") > i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(len(edges)) for c in "pn"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = sides.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("tp"), F.col(f"n{i}").alias("fp"), (F.col("p") - F.col(f"p{i}")).alias("fn"), (F.col("n") - F.col(f"n{i}")).alias("tn")) for i, t in enumerate(edges)))).alias("r")).select("r.*")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return rows.withColumns({"precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn")), "f1": share(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def median_score(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median by group, the mean of two middle values rounded half to even."""
    return values.groupBy(*by).agg(F.bround(F.median(value), 0).cast("long").alias("median"), F.count("*").alias("n"))


def _placed(retrieved: Column, group: Column) -> Column:
    """The member of a group that was retrieved first, or else the smallest."""
    present = F.filter(retrieved, lambda d: F.array_contains(group, d))
    return F.coalesce(F.get(present, F.lit(0)), F.array_min(group))


def representatives(retrieved: Column, groups: Column) -> Column:
    """The documents that stand for groups of equivalent ones, sorted."""
    return F.array_sort(F.array_distinct(F.transform(groups, lambda g: _placed(retrieved, g))))


def reduced(retrieved: Column, groups: Column) -> Column:
    """The retrieved documents with members of a group as the one that stands for it, at its first place only."""
    of = lambda d: F.filter(groups, lambda g: F.array_contains(g, d))
    named = F.transform(retrieved, lambda d: F.coalesce(F.get(F.transform(F.slice(F.reverse(of(d)), 1, 1), lambda g: _placed(retrieved, g)), F.lit(0)), d))
    grouped = F.flatten(groups)
    return F.filter(named, lambda d, i: ~F.array_contains(grouped, d) | (F.array_position(named, d) == i + 1))


def colliding_roles(roles: DataFrame) -> DataFrame:
    """(left, right): roles that have the same model at the same place."""
    other = roles.select(F.col("role").alias("right"), "endpoint", "model")
    return roles.select(F.col("role").alias("left"), "endpoint", "model").join(other, ["endpoint", "model"]).where("left < right").select("left", "right")


def configured_roles(roles: DataFrame, system: str = "system") -> DataFrame:
    """(role, configured): whether each role has a model of its own, not the system's."""
    own = roles.where(F.col("role") == system).select("endpoint", "model", F.lit(True).alias("_same"))
    return roles.where(F.col("role") != system).join(own, ["endpoint", "model"], "left").select("role", F.col("_same").isNull().alias("configured"))


def role_models(roles: DataFrame, system: str = "system") -> DataFrame:
    """(role, endpoint, model) of each role: what was asked for, else its own setting, else the system's.

    ``roles`` has (role, endpoint, model, endpoint_override, model_override); empty is missing.
    """
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    base = roles.where(F.col("role") == system).select(F.col("endpoint").alias("_e"), F.col("model").alias("_m"))
    own = roles.where(F.col("role") != system).join(base)  # one row
    return own.select("role", F.coalesce(known("endpoint_override"), known("endpoint"), "_e").alias("endpoint"), F.coalesce(known("model_override"), known("model"), "_m").alias("model"))


def canonical_row(*columns: Column) -> Column:
    """Values as a JSON list without spare space; nulls are null."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    return F.concat(F.lit("["), F.concat_ws(",", *(F.when(c.isNull(), "null").otherwise(text(c)) for c in columns)), F.lit("]"))
