"""Ranking measures as column functions over arrays of retrieved and relevant ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(retrieved: Column, k: int) -> Column:
    return F.slice(retrieved, 1, k)


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 0 if none are relevant."""
    wanted = F.array_distinct(relevant)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(_top(retrieved, k), wanted)) / F.size(wanted))


def precision_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k, repeats counted, by k."""
    return F.size(F.filter(_top(retrieved, k), lambda x: F.array_contains(relevant, x))) / F.lit(float(k))


def hit_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.arrays_overlap(_top(retrieved, k), relevant).cast("double")


def first_rank(retrieved: Column, relevant: Column) -> Column:
    """Place of the first relevant id, 0 for none."""
    return F.array_position(F.transform(retrieved, lambda x: F.array_contains(relevant, x)), True)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    at = first_rank(retrieved, relevant)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def ndcg_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    got = add(F.transform(_top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0)))
    best = add(F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size(F.array_distinct(relevant)), F.lit(k)), F.lit(1)) - 1), gain))
    return F.when(F.size(relevant) == 0, 0.0).otherwise(got / best)


def representatives(retrieved: Column, groups: Column) -> tuple[Column, Column]:
    """(retrieved, relevant) with the members of each group of equivalents replaced by the first retrieved.

    A group none of whose members is retrieved is represented by its first member.
    Only the first occurrence of an id stays.
    """
    chosen = F.transform(groups, lambda g: F.coalesce(F.get(F.filter(retrieved, lambda x: F.array_contains(g, x)), F.lit(0)), F.get(g, F.lit(0))))
    mapped = F.transform(retrieved, lambda x: F.coalesce(F.get(F.filter(F.arrays_zip(groups.alias("g"), chosen.alias("c")), lambda p: F.array_contains(p["g"], x)), F.lit(0))["c"], x))
    return F.array_distinct(mapped), F.array_distinct(chosen)
