"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import Store, released

CAPACITY = 2048
CACHE_UNITS = 400_000
_TWO_SPACES = re.compile(r"\s\s")


class ByteBpe:
    """Byte-level BPE ids of a text as little-endian unsigned 32-bit bytes.

    They are those that ``tokenizers`` gives with the JSON file of that name and
    ``add_special_tokens=False``: strings of the file's added tokens are cut out
    first, wherever they stand, and have their own ids.  A pre-token of this
    vocabulary never spans a single space between two non-spaces, so such
    stretches are cut there and the ids of each unit are kept in a bounded cache;
    all others are encoded at once, by the ranks of the same vocabulary.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on what is around them")
        self._added = {x["content"]: np.asarray([x["id"]], "<u4").tobytes() for x in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._units: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self._added):
            return b"".join(self._added.get(x) or self._stretch(x) for x in self._cut.split(text) if x)
        return self._stretch(text)

    def _stretch(self, text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return np.asarray(self._encode(text), "<u4").tobytes()
        units = text.split(" ")
        first = np.asarray(self._encode(units[0]), "<u4").tobytes()
        del units[0]
        found = self._units
        try:
            return first + b"".join([found[u] for u in units])
        except KeyError:
            if len(found) > CACHE_UNITS:
                found.clear()
            for u in set(units).difference(found):
                found[u] = np.asarray(self._encode(" " + u), "<u4").tobytes()
            return first + b"".join([found[u] for u in units])


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = length - (-(-length // capacity) - 1) * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """One row a piece: its document's ids are those of its text, then ``end_id``.

    ``_task`` and ``_nth`` number the pieces of one length within a task, for
    ``pack``; store the result before packing, as a recomputed scan may be dealt
    out differently.
    """
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64()), pa.field("_task", pa.int64()), pa.field("_nth", pa.int64())]
    ddl = "piece int, start long, length long, ids_crc32 long, _task long, _nth long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, task, seen = ByteBpe(vocabulary), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, out, blobs = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[start * 4 : (start + length) * 4]
                    row.append(i)
                    out.append((k, start, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        blobs.append(own)
            if row:
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, f.type) for c, f in zip(zip(*out), fields, strict=True))]
                names = [id_col, *(f.name for f in fields)]
                if keep_ids:
                    columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(id_col, text_col)
    return source.mapInArrow(lambda batches: released(run(batches)), f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, {ddl}")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: uses}) that use up ``counts[length]`` pieces of each length.

    A sequence is filled greedily, the longest piece that fits first.  Then its
    smallest piece gives way to the two unpacked pieces that fit the gap it
    leaves most tightly, if they fill more of it.  As nothing changes until a
    length runs out, each pattern is used as often as its lengths last: the work
    depends on the number of lengths, not of pieces.
    """
    left, patterns = counts.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        free, uses = left.copy(), {}

        def take(length: int, n: int = 1) -> None:
            free[length] -= n
            uses[length] = uses.get(length, 0) + n
            if not uses[length]:
                del uses[length]

        gap = capacity
        while gap and len(fits := np.flatnonzero(free[: gap + 1])):
            length = int(fits[-1])
            n = min(gap // length, int(free[length]))
            take(length, n)
            gap -= n * length
        while gap and sum(uses.values()) > 1:
            small = min(uses)
            room, lengths = gap + small, np.flatnonzero(free[: gap + small + 1])
            if not len(lengths):
                break
            at = np.searchsorted(lengths, room - lengths, side="right") - 1
            alone = (at >= 0) & (lengths[at] == lengths) & (free[lengths] < 2)
            at -= alone
            both = np.where(at >= 0, lengths + lengths[at], 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            take(small, -1)
            take(int(lengths[best]))
            take(int(lengths[at[best]]))
            gap = room - int(both[best])
        times = min(int(left[k]) // n for k, n in uses.items())
        for k, n in uses.items():
            left[k] -= n * times
        patterns.append((times, uses))
    return patterns


def intervals(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Which ranks of each length go to which sequences, sorted by length and first rank.

    A pattern has at most sqrt(2 * capacity) different lengths and each pattern
    uses up at least one length, so there are few rows whatever the input.
    """
    rows, used, sequence = [], {}, 0
    for times, uses in patterns:
        offset = 0
        for length in sorted(uses, reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, sequence, uses[length], offset))
            used[length] = first + times * uses[length]
            offset += length * uses[length]
        sequence += times
    return dict(zip(("length", "first", "sequence", "uses", "offset"), np.asarray(sorted(rows), np.int64).reshape(-1, 5).T, strict=True))


def pack(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored ``pieces``.

    Only counts by length, ``capacity`` numbers at most, come to the driver.  The
    rank of a piece among those of its length is its number in its task plus
    what earlier tasks have; ranks then say the sequence and the place.
    """
    spark = stored.sparkSession
    counts = stored.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        totals[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(intervals(best_two_fit(totals, capacity)))
    kept = [c for c in stored.columns if c not in ("_task", "_nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        starts = p["length"] << 48 | p["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(starts, length << 48 | rank, side="right") - 1
            nth, uses = rank - p["first"][at], p["uses"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(p["sequence"][at] + nth // uses), pa.array(p["offset"][at] + nth % uses * length)], [*kept, "sequence_id", "offset"])

    ranked = stored.join(offsets, ["_task", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_task", "_nth", "_before")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name in kept)
    return ranked.select(*kept, "_rank").mapInArrow(place, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """Packs whole documents: one row a piece with its place in a sequence.

    Null texts count as empty and give a piece of the end id alone; repeated rows
    and rows with null ids are packed like any other; an empty table gives no
    rows; other columns of ``docs`` are ignored.
    """
    store = Store(docs.sparkSession, "packing")
    return pack(store.put(pieces(docs, id_col, text_col, capacity, vocabulary=vocabulary, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ids as bytes, from pieces packed with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
