"""ProbMinHash near-dedup: probability Jaccard of weighted word shingles, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store, components, join_hot, released, slices
from .shingles import mix, shingle_hashes

WIDTH = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS = 4
#: Bins of a class's shingle shares, added up in eights for a first look.
BINS = 1024
GROUP_CHARS = 2 << 20
BLOCK = 1024
#: Buckets of more than ``LARGE`` blocks are divided by shingles; of their buckets, those of up to ``LISTED`` members list their pairs.
LARGE, LISTED = 8, 256
#: Texts whose shingles are counted, and how many of the most frequent are put last.
SAMPLE, FREQUENT = 8192, 1 << 17
#: What rounding of shares in single precision may take from a bound.
SLACK = 1e-5
_STEP, _PICK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def signatures(shingles: np.ndarray, owner: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """A row of ``registers`` 32-bit marks for each text: which shingle came first there.

    A shingle that occurs w times in a text arrives there as a Poisson process of
    rate w, and each arrival goes to a random register; both come from the
    shingle's hash alone, so two texts agree in a register with a probability
    that is the probability Jaccard of their shingle counts.  A shingle stops as
    soon as its last arrival is later than all that the text's registers hold.
    """
    if registers & (registers - 1):
        raise ValueError("registers must be a power of two")
    bits = np.uint64(40)
    if texts >= 1 << 23:
        raise ValueError("too many texts at once")
    key = np.sort((owner.astype(np.uint64) << bits) | (shingles >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    rate = np.diff(np.concatenate([at, [len(key)]])).astype(np.float64)
    key = key[at]
    base, seed = (key >> bits).astype(np.int64) * registers, mix((key & np.uint64((1 << 40) - 1)) + _STEP)
    mark = (seed >> np.uint64(32)).astype(np.uint32)
    first, held = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint32)
    time, state = np.zeros(len(key)), seed
    while len(base):
        state = mix(state + _STEP)
        time = time - np.log(((state >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / rate
        slot = base + (mix(state ^ _PICK) & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        held[slot[won]] = mark[won]
        alive = time < first.reshape(texts, registers).max(axis=1)[base // registers]
        base, state, time, rate, mark = (x[alive] for x in (base, state, time, rate, mark))
    return held.reshape(texts, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum over j of max(p_j / p_i, q_j / q_i), exactly.

    ``a`` and ``b`` are sorted distinct shingles with their counts.  The larger of
    the two ratios is the first for all j with q_j / p_j <= q_i / p_i, so running
    sums in the order of q / p give each inner sum.
    """
    ids = np.union1d(a[0], b[0])
    p, q = (np.zeros(len(ids)) for _ in range(2))
    p[np.searchsorted(ids, a[0])] = a[1] / a[1].sum()
    q[np.searchsorted(ids, b[0])] = b[1] / b[1].sum()
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    upto, rest = np.searchsorted(ratio, ratio, side="right"), np.concatenate([[0], np.cumsum(q[::-1])])[::-1]
    sums, both = np.concatenate([[0], np.cumsum(p)]), (p > 0) & (q > 0)
    return float((1 / (sums[upto][both] / p[both] + rest[upto][both] / q[both])).sum())


def _signed(width: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(all_texts):
                end, size = at, 0
                while end < len(all_texts) and size < GROUP_CHARS:
                    size += len(all_texts[end])
                    end += 1
                texts = all_texts[at:end]
                shingles, owner, n, _ = shingle_hashes(texts, width)
                marks = signatures(shingles, owner, len(texts), registers)
                keys = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
                packed = [m.tobytes() if k else None for m, k in zip(marks, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["uid", "key", "marks"])
                at = end

    return run


def bucket_hashes(marks: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of each row of marks."""
    bands = marks.reshape(len(marks), -1, rows).astype(np.uint64)
    bucket = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        bucket = mix(bucket * _STEP + bands[:, :, k])
    return bucket.view(np.int64)


def _marks(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _banded(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                bucket = bucket_hashes(_marks(batch.column(1), np.uint32), rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bucket.shape[1])), pa.array(bucket.ravel())], ["cid", "bucket"])

    return run


def _verified(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (part for whole in batches for part in slices(whole, 2)):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fresh = [t for t in dict.fromkeys([*left, *right]) if t not in counted]
            shingles, owner, _, _ = shingle_hashes(fresh, width)
            cut = np.searchsorted(owner, np.arange(len(fresh) + 1))
            counted = {t: counted[t] for t in {*left, *right} if t in counted} | {t: np.unique(shingles[cut[k] : cut[k + 1]], return_counts=True) for k, t in enumerate(fresh)}
            ok = [probability_jaccard(counted[a], counted[b]) >= threshold - 1e-12 for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts are similar enough."""
    left, right = (texts.select(F.col("uid").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(lambda batches: released(_verified(width, threshold)(batches)), "a long, b long")


def folded(shingles: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text the shares of its shingles in ``BINS`` bins."""
    held = np.bincount(owner * BINS + (shingles & np.uint64(BINS - 1)).astype(np.int64), minlength=texts * BINS).reshape(texts, BINS)
    return (held / np.maximum(held.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _folded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                shingles, owner, _, _ = shingle_hashes(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.tobytes() for m in folded(shingles, owner, len(part))], pa.binary())], ["cid", "shares"])

    return run


def _common(shares: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Sums of the smaller shares: no less than the probability Jaccard, as its inner sums are 1 / p_i and 1 / q_i at least."""
    return np.minimum(shares, one).dot(np.ones(shares.shape[1], np.float32))


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of folded shares, which is no less than that of the shingles.

    1 / sum over j of max(p_j / x, q_j / y) is concave in (x, y) and grows in proportion with
    them, so it is as large at a sum as the sum of its values; and one bin's maximum is at most the sum of its shingles'.
    """
    i, j = np.flatnonzero(a), np.flatnonzero(b)
    return probability_jaccard((i, a[i].astype(np.float64)), (j, b[j].astype(np.float64)))


def _sized(rooted: DataFrame, verified: int) -> DataFrame:
    """The members of buckets in which different components are left to compare, with their largest one; the pairs of buckets of up to ``verified`` members are known."""
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    split = split.where(f"n > most and n > {verified}")
    return join_hot(rooted, split.withColumn("_n", F.col("n")), ["bucket"], "_n")


def _divided(store: Store, members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The members of buckets that hold different components, with the roots of these."""
    rooted = store.put(members.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root")), f"{name}-rooted")
    return _sized(rooted, 2)  # against the first member all are verified


def prefix(shingles: np.ndarray, share: np.ndarray, frequent: np.ndarray, times: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """(places of a text's rarest shingles, the share of the rest, which is below 3/4 of the threshold).

    The order, by how often ``frequent`` (sorted) says that a shingle occurs and then by hash, is the same for all texts.
    """
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    often = np.where(frequent[at] == shingles, times[at], 0) if len(frequent) else np.zeros(len(shingles), np.int64)
    order = np.lexsort([shingles, often])
    rest = np.maximum(1 - np.cumsum(share[order]), 0)
    n = int(np.argmax(rest < 0.75 * threshold)) + 1
    return order[:n], float(rest[n - 1])


def _counted(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different shingles of each text and their shares."""
    shingles, owner, _, _ = shingle_hashes(texts, width)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        own, n = np.unique(shingles[cut[k] : cut[k + 1]], return_counts=True)
        yield own, n / max(n.sum(), 1)


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a sample have, and how many have them; it decides the order of shingles alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            held = [own for own, _ in _counted(batch.column(1).to_pylist(), width)]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["shingle", "n"])

    sample = texts.orderBy(F.xxhash64("uid")).limit(SAMPLE)
    got = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values, n = (got.column(c).to_numpy() for c in ("shingle", "n"))
    values = values.view(np.uint64)
    order = np.argsort(values)
    return values[order], n[order]


def _refined(divided: DataFrame, texts: DataFrame, width: int, threshold: float, store: Store, name: str, block: int, nearest: bool) -> tuple[DataFrame, DataFrame | None]:
    """(The divided buckets, with finer ones in place of those of more than ``LARGE`` blocks; pairs that finer ones list).

    The members of all large buckets are dealt once to buckets by their rarest shingles, so
    a passage that most texts have costs rows in proportion to these, and no similar pair is lost: texts
    whose common share is t have a common shingle among those before the end of the shorter prefix,
    or else what they share is less than what one has after its prefix.  What they share is
    at most what their prefixes share and the larger rest.  Pairs of which all common buckets
    are listed are taken if that reaches the threshold; larger ones are compared in blocks.
    """
    small = divided.where(F.col("n") <= LARGE * block).withColumn("fine", F.lit(False))
    large = divided.where(F.col("n") > LARGE * block).select(F.col("cid").alias("uid"), "root").distinct()
    if large.isEmpty():
        return small, None
    own = store.put(texts.join(large, "uid").select("uid", "text", "root"), f"{name}-large")
    frequent, times = _frequent(own.select("uid", "text"), width)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            kept = []
            for shingles, share in _counted(batch.column(1).to_pylist(), width):
                at, rest = prefix(shingles, share, frequent, times, threshold)
                kept.append((shingles[at], share[at], np.full(len(at), rest)))
            n = [len(x[0]) for x in kept]
            again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), n))  # noqa: B023, E731
            bucket, share, rest = (np.concatenate(x) for x in zip(*kept, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), again(0), again(2), pa.array(share), pa.array(rest)], ["bucket", "cid", "root", "share", "rest"])

    fine = store.put(own.mapInArrow(lambda batches: released(dealt(batches)), "bucket long, cid long, root long, share double, rest double"), f"{name}-fine")
    fine = store.put(_sized(fine, 1), f"{name}-sized")
    listed = fine.where(F.col("n") <= LISTED)
    left, right = (listed.select("bucket", *(F.col(c).alias(f"{c}{k}") for c in ("cid", "root", "share", "rest"))) for k in "ab")
    met = left.join(right, "bucket").where("cida < cidb and roota != rootb").groupBy(F.col("cida").alias("a"), F.col("cidb").alias("b"))
    met = met.agg(F.sum(F.least("sharea", "shareb")).alias("s"), F.first(F.greatest("resta", "restb")).alias("rest")).where(F.col("s") + F.col("rest") >= threshold - SLACK)
    if nearest:
        met = store.put(met, f"{name}-met")
        met = met.select("a", "b", "s").union(met.select("b", "a", "s")).groupBy("a").agg(F.max_by("b", F.struct("s", "b")).alias("b"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    blocks = fine.where(F.col("n") > LISTED).drop("share", "rest").withColumn("fine", F.lit(True))
    return small.unionByName(blocks), pairs


def _across(divided: DataFrame, shares: DataFrame, threshold: float, band_rows: int, block: int, nearest: bool) -> DataFrame:
    """Pairs of one bucket but different components whose folded shares do not rule out the threshold.

    With ``nearest`` only the best partner of each class by its registers, else each pair once; buckets
    that were not refined give it in the first that it shares, unless that was refined, where it is found by its shingles.  The largest
    component of a bucket is compared only with the other members, in blocks, so neither a bucket's size nor its largest component's is limited.
    """
    rows = divided.join(shares, "cid")
    spot = lambda n: F.floor(F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(n / block), F.lit(1)))).cast("int")
    many = lambda n: F.sequence(F.lit(0), (F.greatest(F.ceil(n / block), F.lit(1)) - 1).cast("int"))
    rest, cols = F.col("n") - F.col("most"), ["bucket", "cid", "root", "main", "marks", "shares", "fine"]
    probes = rows.where("root != main").select(*cols, F.lit(True).alias("probe"), spot(rest).alias("x"), F.explode(many(F.col("n"))).alias("y"))
    against = rows.select(*cols, F.lit(False).alias("probe"), F.explode(many(rest)).alias("x"), spot(F.col("n")).alias("y"))
    least = threshold - SLACK

    def compare(table: pa.Table) -> pa.Table:
        flag = table.column("probe").to_numpy()
        p, q = table.filter(pa.array(flag)), table.filter(pa.array(~flag))
        a, b, s = [], [], []
        if len(p) and len(q):
            (pc, pr), (qc, qr) = (tuple(t.column(c).to_numpy() for c in ("cid", "root")) for t in (p, q))
            (ps, pm), (qs, qm) = ((_marks(t.column("shares"), np.float32), _marks(t.column("marks"), np.uint32)) for t in (p, q))
            pf, qf = (x.reshape(len(x), -1, 8).sum(axis=2) for x in (ps, qs))
            pb, qb = (bucket_hashes(x, band_rows) for x in (pm, qm))
            fine = p.column("fine")[0].as_py()
            here, main = p.column("bucket")[0].as_py(), p.column("main")[0].as_py()
            for k in range(len(pc)):
                near = np.flatnonzero((_common(qf, pf[k]) >= least) & (qr != pr[k]))
                near = near[_common(qs[near], ps[k]) >= least]
                if not len(near):
                    continue
                alike = (qm[near] == pm[k]).mean(axis=1)
                if nearest:
                    once = [alike.argmax()]
                elif fine:
                    once = (qr[near] == main) | (qc[near] > pc[k])
                else:
                    once = (pb[k][(qb[near] == pb[k]).argmax(axis=1)] == here) & ((qr[near] == main) | (qc[near] > pc[k]))
                near, alike = near[once], alike[once]
                may = np.asarray([bound(qs[i], ps[k]) >= least for i in near], bool)
                a.append(np.full(int(may.sum()), pc[k]))
                b.append(qc[near[may]])
                s.append(alike[may])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for c, v, t in (("a", a, pa.int64()), ("b", b, pa.int64()), ("s", s, pa.float64()))})

    pairs = probes.union(against).groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long, s double")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("s", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, registers: int = REGISTERS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """All documents and columns, with ``class_id`` (the smallest id of its near-duplicates) and ``kept``.

    Documents are linked if the probability Jaccard of their shingle counts is at
    least ``threshold``, and classes are what links connect.  128 registers in
    bands of 4 miss a pair at 0.8 with a probability of 5e-8.  Of each bucket all
    members are verified against its first; members of a bucket that are then in
    different components are compared with each other as well, so no candidate is
    left out, and large groups cost no pairs within a component.  A pair is left
    unverified only where a bound from folded shingle shares is below the threshold.  Large buckets that
    hold many components are first divided by rare shingles, which loses no pair either.  Before all of these are, the best partner of each is verified, which unites most of them.

    Equal texts are one class from the start, null being empty; texts without
    words are near only to equal ones, texts of fewer than ``width`` words have
    one shingle.  The row with the smallest id of a class is kept, one of them if
    rows repeat; null ids come last.  Columns named class_id and kept are replaced.
    """
    store = Store(docs.sparkSession, "near-duplicates")
    columns = [c for c in docs.columns if c not in ("class_id", "kept")]
    base = store.put(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*columns).alias("_doc")), "documents")
    texts = base.select("uid", F.coalesce(F.col("_doc")[text_col], F.lit("")).alias("text"))
    signed = store.put(texts.mapInArrow(lambda batches: released(_signed(width, registers)(batches)), "uid long, key binary, marks binary"), "signatures")
    keys = store.put(signed.select("uid", "key"), "keys")
    classes = store.put(keys.groupBy("key").agg(F.min("uid").alias("cid"), F.count("*").alias("n")), "classes")
    marks = store.put(signed.where("marks is not null").join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("cid"), "marks"), "marks")
    buckets = store.put(marks.mapInArrow(lambda batches: released(_banded(rows)(batches)), "cid long, bucket long"), "buckets")
    shared = buckets.groupBy("bucket").agg(F.min("cid").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = store.put(buckets.join(shared, "bucket"), "members")
    store.drop("buckets", "signatures")
    star = store.put(members.where("cid != head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct(), "star")
    # texts move once, to pick those that have a candidate; all comparisons are among these
    involved = star.select(F.col("a").alias("uid")).union(star.select("b")).distinct()
    texts = store.put(texts.join(involved.hint("merge"), "uid", "left_semi"), "texts")
    store.release()
    tried, links = star, store.put(_verify(star, texts, width, threshold), "links-0")
    roots = components(store, links, "a", "b", "roots-0")
    for nearest in (True, False):
        step = "nearest" if nearest else "rest"
        divided = store.put(_divided(store, members, roots, step), f"divided-{step}")
        refined, listed = _refined(divided, texts, width, threshold, store, step, block, nearest)
        refined = store.put(refined, f"refined-{step}")
        own = refined.select(F.col("cid").alias("uid")).distinct()
        shares = store.put(texts.join(own, "uid", "left_semi").mapInArrow(lambda batches: released(_folded(width)(batches)), "cid long, shares binary").join(marks, "cid"), f"shares-{step}")
        pairs = _across(refined, shares, threshold, rows, block, nearest)
        pairs = pairs if listed is None else pairs.union(listed).distinct()
        pairs = store.put(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{step}")
        more = store.put(_verify(pairs, texts, width, threshold), f"links-{step}")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(store, links, "a", "b", f"roots-{step}")
        tried = tried.union(pairs)
        store.drop(*(f"{step}-{t}" for t in ("rooted", "large", "fine", "sized", "met")), *(f"{t}-{step}" for t in ("divided", "refined", "shares")))
    named = store.put(classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("key", "n", F.coalesce("root", "cid").alias("root")), "named")
    classed = join_hot(keys, named, ["key"], "n").select("uid", "root")
    known = store.put(base.select("uid", F.col("_doc")[id_col].alias("id")).join(classed, "uid"), "known")
    least = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid"))).alias("head"), F.count("*").alias("_n"))
    decided = join_hot(known, store.put(least, "least"), ["root"], "_n").select("uid", F.col("head.id").alias("class_id"), (F.col("uid") == F.col("head.uid")).alias("kept"))
    decided = store.put(decided, "decided")
    store.drop("members", "marks", "texts", "keys", "known", "least", "named", "classes", "star", *(f"{t}-{s}" for t in ("links", "pairs") for s in ("0", "nearest", "rest")))
    store.release()
    return base.join(decided.hint("merge"), "uid").select(*(F.col("_doc")[c].alias(c) for c in columns), "class_id", "kept")
