"""Line dedup: a suffix array over line ids finds repeated runs of lines; later copies go.

Only DataFrame functions are used.

What is deleted: with documents in the order of their ids, a line goes if some
run of whole consecutive lines around it, of at least ``min_words`` words, also
begins at an earlier place.  Any such run consists of shortest runs of that many
words, counted forward from a line or backward from one, and whether two shortest
runs are equal depends on their lines alone.  So it is enough to find equal
shortest runs.  An interval of the suffix array whose suffixes share their first
l lines is named, for K <= l < 2K and K a power of two, by the ranks by K lines
of the suffixes at its first line and at the K-th line from its end.  Prefix
doubling gives these ranks; it goes on while longer shortest runs are left, and a
suffix whose K lines occur once takes no further part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import Store, join_hot, ranked

MIN_WORDS = 50


def words_of(line: Column) -> Column:
    """How many words, separated by spaces, a line has."""
    exact = F.size(F.filter(F.split(line, " "), lambda x: x != ""))
    spaced = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    return F.when(spaced, exact).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(uid, id, s, len): the shortest runs of ``min_words`` words from each line on and up to each line.

    Takes (uid, id, pos, g, before, words), where ``before`` counts the words of
    the stretch ``g`` before a line.  A line's run ends before the first line
    that has enough words between; sorting these marks among the lines finds it.
    """
    key, after = ["uid", "id", "g"], F.col("before") + F.col("words")
    marks = lambda *m: lines.select(*key, F.explode(F.array(*m)).alias("m")).select(*key, "m.*")
    mark = lambda value, pos, probe: F.struct(value.cast("long").alias("value"), pos.cast("long").alias("pos"), F.lit(probe).alias("probe"))
    pos, point = F.col("pos"), F.when(F.col("probe") == 0, F.col("pos"))
    # forward: the first line k > s with before(k) >= before(s) + min_words, or the end of the stretch
    down = W.partitionBy("uid", "g").orderBy(F.desc("value"), "probe", F.desc("pos"))
    forward = marks(mark(after, pos + 1, 0), mark(F.col("before") + min_words, pos, 1)).select(*key, "pos", "probe", F.last(point, ignorenulls=True).over(down).alias("k"))
    forward = forward.where("probe = 1 and k is not null").select("uid", "id", F.col("pos").alias("s"), (F.col("k") - F.col("pos")).alias("len"))
    # backward: the last line s with before(s) <= before(e + 1) - min_words
    up = W.partitionBy("uid", "g").orderBy("value", "probe", "pos")
    backward = marks(mark(F.col("before"), pos, 0), mark(after - min_words, pos, 1)).select(*key, "pos", "probe", F.last(point, ignorenulls=True).over(up).alias("k"))
    backward = backward.where("probe = 1 and k is not null").select("uid", "id", F.col("k").alias("s"), (F.col("pos") - F.col("k") + 1).alias("len"))
    return forward.union(backward).distinct()


def repeated_stretches(store: Store, lines: DataFrame, min_words: int) -> DataFrame:
    """The lines that can be in a repeated run: maximal stretches of lines that all occur twice, with enough words."""
    twice = store.put(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    in_order = W.partitionBy("uid").orderBy("pos")
    stretch = W.partitionBy("uid", "g")
    before = stretch.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = join_hot(lines, twice, ["h1", "h2"], "n").withColumn("g", F.col("pos") - F.row_number().over(in_order))
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("_all", F.sum("words").over(stretch))
    return rows.where(F.col("_all") >= min_words).drop("_all")


def later_copies(store: Store, rows: DataFrame, min_words: int) -> DataFrame:
    """(uid, s, len) of every shortest run that occurs at an earlier place too."""
    runs = store.put(shortest_runs(rows, min_words), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    named, depth = None, 1
    first = ranked(store, rows.groupBy("h1", "h2").agg(F.count("*").alias("n")), [F.col("h1"), F.col("h2")], "rank-1", F.col("n"), "r")
    ranks = store.put(join_hot(rows, first, ["h1", "h2"], "n").select("uid", "pos", "r"), "suffixes-1") if longest else None
    while depth <= longest:
        here = runs.where((F.col("len") >= depth) & (F.col("len") < 2 * depth))
        at = ranks.select("uid", F.col("pos").alias("s"), F.col("r").alias("r1"))
        tail = ranks.select("uid", F.col("pos").alias("_t"), F.col("r").alias("r2"))
        here = here.withColumn("_t", F.col("s") + F.col("len") - depth).join(at, ["uid", "s"]).join(tail, ["uid", "_t"]).select("uid", "id", "s", "len", "r1", "r2")
        here = store.put(here, f"named-{depth}")
        named = here if named is None else named.union(here)
        if 2 * depth > longest:
            break
        ahead = ranks.select("uid", (F.col("pos") - depth).alias("pos"), F.col("r").alias("r2"))
        pairs = store.put(ranks.join(ahead, ["uid", "pos"]).select("uid", "pos", F.col("r").alias("r1"), "r2"), f"pairs-{depth}")
        twice = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
        depth *= 2
        order = ranked(store, twice, [F.col("r1"), F.col("r2")], f"rank-{depth}", F.col("n"), "r")
        ranks = store.put(join_hot(pairs, order, ["r1", "r2"], "n").select("uid", "pos", "r"), f"suffixes-{depth}")
        store.drop(f"pairs-{depth // 2}", f"rank-{depth}")
    if named is None:
        return runs.select("uid", "s", "len")
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid"), F.col("s").alias("s"))
    interval = ["len", "r1", "r2"]
    earliest = named.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_hot(named, store.put(earliest, "earliest"), interval, "n").where((F.col("uid") != F.col("first.uid")) | (F.col("s") != F.col("first.s")))
    return copies.select("uid", "s", "len")


def merged(spans: DataFrame) -> DataFrame:
    """(uid, deleted): the union of a document's spans as an array of (first, last) lines."""
    in_order = W.partitionBy("uid").orderBy("s", "len")
    rows = spans.select("uid", "s", "len", (F.col("s") + F.col("len") - 1).alias("e"))
    rows = rows.withColumn("_new", (F.col("s") > F.coalesce(F.max("e").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("long"))
    rows = rows.withColumn("_i", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy("uid", "_i").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    return parts.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("deleted"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All documents and columns, with ``text_col`` without later copies of line runs, ``n_lines`` and ``n_deleted``.

    Lines end at line feeds and must agree in every byte; line ids are 128-bit
    hashes.  A document whose lines all go keeps an empty text.  Null texts stay
    null and have no line; an empty text is one empty line.  Of documents with one
    id any may count as the earlier, of repeated rows one keeps its lines; null
    ids come last.  Columns named n_lines and n_deleted are replaced.
    """
    store = Store(docs.sparkSession, "lines")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    base = store.put(docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*columns).alias("_doc")), "documents")
    text = F.col("_doc")[text_col]
    split = base.where(text.isNotNull()).select(F.col("_uid").alias("uid"), F.col("_doc")[id_col].alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = store.put(split.select("uid", "id", F.col("pos").cast("long").alias("pos"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words_of(F.col("line")).alias("words")), "lines")
    rows = store.put(repeated_stretches(store, lines, min_words), "rows")
    deleted = store.put(merged(later_copies(store, rows, min_words)).select(F.col("uid").alias("_uid"), "deleted"), "deleted")
    store.drop("lines", "rows", "runs", "twice", "earliest", *(f"{t}-{1 << k}" for k in range(40) for t in ("named", "suffixes", "rank")))
    store.release()
    parts = F.split(text, "\n")
    gone = lambda x, i: F.exists("deleted", lambda d: (i >= d["first"]) & (i <= d["last"]))
    out = base.join(deleted.hint("merge"), "_uid", "left")
    kept = F.when(F.col("deleted").isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~gone(x, i)), "\n"))
    n_deleted = F.coalesce(F.aggregate("deleted", F.lit(0).cast("long"), lambda a, d: a + d["last"] - d["first"] + 1), F.lit(0).cast("long"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return out.select(*(kept.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in columns), n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))
