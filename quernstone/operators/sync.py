"""Incremental synchronisation: watermarks, fetch plans, membership, retries, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .documents import detect_changes

MINUTES = "yyyy-MM-dd HH:mm"


def watermark_text(ts: Column) -> Column:
    return F.date_format(ts, MINUTES)


def interval_minutes(text: Column) -> Column:
    """A positive number of minutes; null if the text is none."""
    n = text.try_cast("int")
    return F.when(n >= 1, n)


def merged_settings(base: Column, override: Column) -> Column:
    """A map of settings in which those of ``override`` win."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(base, override, lambda k, a, b: F.coalesce(b, a)))))


def lower_bound(watermark: Column, margin_minutes: int) -> Column:
    """The watermark less a margin for late changes; null if it cannot be read."""
    return watermark_text(F.try_to_timestamp(watermark, F.lit(MINUTES)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max(0, margin_minutes))))


def fetch_plan(current: DataFrame, previous: DataFrame, changed: DataFrame | None, retries: DataFrame | None, key: str, always: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """(key, reason): what to fetch of the pages that a target lists now, and what is removed.

    Fetched are pages that always are, new ones, changed ones and those that failed
    before; all, where it is not known what changed or what failed.  Pages that a
    target listed before and does not now are ``removed``, but only if the listing is complete: a
    listing cut short says nothing about pages that it lacks.  Sets are tagged and summed up in one pass.
    """
    everything = changed is None or retries is None
    tag = lambda df, t: df.select(key, F.lit(t).alias("_t"))
    every = tag(current, "current").union(tag(previous, "previous"))
    for t, df in (("changed", changed), ("retry", retries), ("always", always)):
        every = every if df is None else every.union(tag(df, t))
    has = lambda t: F.bool_or(F.col("_t") == t)
    flags = every.groupBy(key).agg(has("current").alias("c"), has("previous").alias("p"), has("changed").alias("g"), has("retry").alias("r"), has("always").alias("a"))
    here = F.col("c")
    reason = F.when(here & F.col("a"), "always").when(here & ~F.col("p"), "new").when(here & F.col("g"), "changed").when(here & F.col("r"), "retry").when(here & F.lit(everything), "unknown").when(~here & F.col("p") & F.lit(complete), "removed")
    return flags.select(key, reason.alias("reason")).where("reason is not null")


def listing_complete(listed: Column, most: Column, expected: Column) -> Column:
    """Whether a listing has everything: it stopped before its bound and has as many pages as the server counts, if it counts any."""
    return (listed < most) & (expected.isNull() | (listed >= expected))


def next_retries(errors: DataFrame, retries: DataFrame | None, attempted: DataFrame, complete: bool) -> DataFrame:
    """(page_id, error) to try again next time: what failed now, and after an incomplete listing what failed before and was not tried."""
    now = errors.where("page_id <> ''").groupBy("page_id").agg(F.last("error").alias("error"))
    if complete or retries is None:
        return now
    left = retries.select("page_id").join(attempted.select("page_id"), "page_id", "left_anti").join(now.select("page_id"), "page_id", "left_anti")
    return now.unionByName(left.distinct().withColumn("error", F.lit("carried over (이번 열거에 미포함)")))


def import_class(created: Column, changed: Column, error: Column) -> Column:
    """What an import did: errors, created, updated or unchanged."""
    return F.when(error.isNotNull(), "errors").when(created, "created").when(changed, "updated").otherwise("unchanged")


def results(imports: DataFrame, by: list[str]) -> DataFrame:
    """by, the ids of each class of (id, class), sorted, and the total of all but the removed."""
    kinds = ("created", "updated", "unchanged", "errors", "removed", "skipped")
    lists = [F.array_sort(F.collect_list(F.when(F.col("class") == k, F.col("id")))).alias(k) for k in kinds]
    return imports.groupBy(*by).agg(*lists, F.count_if(F.col("class") != "removed").alias("total"))


def processing_queue(buckets: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, bucket) of the documents of several lists, each under the first that has it."""
    tagged = [df.select(key, F.struct(F.lit(k).alias("n"), F.lit(name).alias("b")).alias("_t")) for k, (name, df) in enumerate(buckets)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(F.min("_t")["b"].alias("bucket"))


def scope_pages(scope: str, pages: DataFrame, space: str | None = None, root: object = None, modified_since: str | None = None) -> DataFrame:
    """(id) of the pages of a target: one page, a subtree with its root, or a space; for the last two those modified since, if a time is given."""
    recent = pages if modified_since is None else pages.where(F.col("last_modified") >= F.lit(modified_since).cast("timestamp"))
    if scope == "page":
        return pages.where(F.col("id") == F.lit(root)).select("id")
    if scope == "space":
        return recent.where(F.col("space") == F.lit(space)).select("id").distinct()
    if scope == "subtree":
        below = subtree(pages, root).select("id")
        own = below if modified_since is None else below.join(recent.select("id"), "id", "left_semi")
        return own.union(pages.where(F.col("id") == F.lit(root)).select("id")).distinct()
    raise ValueError(f"unknown scope {scope!r}")


def synced(scope: str, pages: DataFrame, previous: DataFrame, stored: DataFrame, retries: DataFrame | None, watermark: str | None, space: str | None = None, root: object = None, complete: bool = True, margin: int = 1440) -> DataFrame:
    """(id, class) of every page of a target after a run: created, updated, unchanged, errors, skipped or removed.

    ``pages`` has (id, parent_id, space, last_modified, content_hash), a null hash
    being a page that could not be fetched; ``stored`` has (id, content_hash).
    """
    current = scope_pages(scope, pages, space, root)
    since = pages.sparkSession.range(1).select(lower_bound(F.lit(watermark).cast("string"), margin)).first()[0] if watermark else None
    changed = None if since is None else scope_pages(scope, pages, space, root, since)
    always = None if scope == "space" else pages.where(F.col("id") == F.lit(root)).select("id")
    plan = fetch_plan(current, previous.select("id"), changed, retries, "id", always, complete)
    fetched = plan.where("reason <> 'removed'").join(pages.select("id", "content_hash"), "id").join(stored.select("id", F.col("content_hash").alias("_old"), F.lit(True).alias("_there")), "id", "left")
    kind = import_class(F.col("_there").isNull(), F.col("content_hash") != F.col("_old"), F.when(F.col("content_hash").isNull(), "failed"))
    skipped = current.join(plan.select("id"), "id", "left_anti").select("id", F.lit("skipped").alias("class"))
    return fetched.select("id", kind.alias("class")).unionByName(skipped).unionByName(plan.where("reason = 'removed'").select("id", F.lit("removed").alias("class")))


def started(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents, those that are indexed anew in processing."""
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return documents.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "processing").otherwise(F.col("status"))).drop("_hit")


def finished(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after indexing: completed with their method, or failed; an outcome is (id, method, error, degraded)."""
    both = documents.join(outcomes.select("id", F.col("method").alias("_m"), F.col("error").alias("_e"), F.col("degraded").alias("_d"), F.lit(True).alias("_hit")), "id", "left")
    status = F.when(F.col("_hit").isNull(), F.col("status")).when(F.col("_e").isNotNull(), "failed").otherwise("completed")
    ok = F.col("_hit").isNotNull() & F.col("_e").isNull()
    return both.withColumns({"status": status, "storage_method": F.when(ok, F.col("_m")).otherwise(F.col("storage_method")), "llm_degraded": F.when(ok, F.coalesce("_d", F.lit(False))).otherwise(F.col("llm_degraded"))}).drop("_m", "_e", "_d", "_hit")


def repository(previous: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, change_type) of snapshots of files (repo, path, content_hash), unchanged ones included."""
    return detect_changes(previous, files, ["repo", "path"]).select("repo", "path", "change_type")


def to_index(changes: DataFrame, states: DataFrame) -> DataFrame:
    """Files to index: what changed, and what is not completed."""
    left = states.where("status <> 'completed'").select("repo", "path")
    return changes.where("change_type in ('created', 'changed')").select("repo", "path").unionByName(left).distinct()


def upsert_membership(members: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace those of the same keys; rows without a page are skipped."""
    new = incoming.where(F.col(keys[-1]).isNotNull())
    return members.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def pruned(members: DataFrame, target: Column, current: DataFrame, key: str) -> DataFrame:
    """Members of a target that it no longer lists."""
    return members.where(target).join(current.select(key), key, "left_anti")


def last_of(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The latest row of each key, by a maximum of structs: combined before the shuffle, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def next_watermark(started: Column, complete: Column, retry_state_known: Column, previous: Column) -> Column:
    """The start of the run if everything was listed and retries are safe, else the watermark before."""
    return F.when(complete & retry_state_known, watermark_text(started)).otherwise(previous)


def subtree(pages: DataFrame, root: object, max_depth: int = 20) -> DataFrame:
    """(id, parent_id, depth) of what is below a page, with the least depth of each and the smallest parent there.

    Level by level: only pages not seen before go on, so a page with several
    parents is walked once and a cycle ends, however many pages there are.
    """
    edges = pages.select("id", "parent_id").where(F.col("id") != F.lit(root))
    front = checkpointed(edges.where(F.col("parent_id") == F.lit(root)).select("id", "parent_id").distinct().groupBy("id").agg(F.min("parent_id").alias("parent_id")).withColumn("depth", F.lit(1)))
    seen, depth = front, 1
    while depth < max_depth and not front.isEmpty():
        depth += 1
        below = edges.join(front.select(F.col("id").alias("parent_id")), "parent_id").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
        front = checkpointed(below.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    return seen.select("id", "parent_id", "depth")
