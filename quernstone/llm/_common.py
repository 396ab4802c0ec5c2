"""What several operators need: shared storage, stored intermediates, distributed row numbers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has none and runs on one machine, as in tests, a
    temporary folder is set; a cluster without one is an error, as a folder of
    the driver's own machine would not be there for executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Store:
    """Tables written to the shared folder during one call of an operator.

    A stored table cuts lineage: an executor lost later costs no recomputation
    of what was before it, and ids that were drawn when writing stay the same.
    An operator drops what nothing reads any more; the rest, which its result
    may still read, goes with ``discard`` or when the application ends.
    """

    _open: dict[str, Store] = {}

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        fs, path = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Store._open[self.base] = self

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @classmethod
    def opened(cls) -> set[str]:
        """The folders of all stores that are not discarded."""
        return set(cls._open)

    @classmethod
    def discard(cls, keep: set[str] = frozenset()) -> None:
        """Deletes all stores but those in ``keep``; call it once no result of theirs is read any more."""
        for base in set(cls._open) - keep:
            fs, path = cls._open.pop(base)._at("")
            fs.delete(path, True)

    def put(self, df: DataFrame, name: str, *by: str, append: bool = False) -> DataFrame:
        """Writes and rereads a table; ``by`` gives each value of a column a folder, ``name/column=value`` to ``drop``; ``append`` adds to what is there."""
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").partitionBy(*by).mode("append" if append else "error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs now, not at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ranked(store: Store, df: DataFrame, keys: list[Column], name: str, weight: Column | None = None, out: str = "rn") -> DataFrame:
    """Adds ``out``: 1 + the sum of ``weight`` (default 1) of the rows sorted before by ``keys``.

    A global row number without a single-task sort: rows are range partitioned
    and stored with a running sum inside each partition; partition totals, one
    row a partition, give the offsets.  Ties of all keys get successive numbers.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    running = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = store.put(
        df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).withColumn("_w", weight).withColumn("_local", F.coalesce(F.sum("_w").over(running), F.lit(0).cast("long"))),
        name,
    )
    before = W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = local.groupBy("_part").agg(F.sum("_w").alias("_w")).select("_part", F.coalesce(F.sum("_w").over(before), F.lit(0).cast("long")).alias("_offset"))
    return local.join(offsets, "_part").withColumn(out, F.col("_offset") + F.col("_local") + 1).drop("_part", "_w", "_local", "_offset")


def components(store: Store, edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node of its component.

    Rounds of contraction: every node points to its smallest neighbour, pointers
    are followed to their ends by doubling, and edges are redrawn between the ends.
    Minima are combined before each shuffle, each round at least halves the nodes
    that still have edges, and its tables are stored, so lineage stays short.
    Null ends are dropped.
    """
    pair = [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    live = store.put(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*pair).distinct(), f"{name}-0")
    roots, step = None, 0
    while not live.isEmpty():
        step += 1
        ends = live.select("u", "v").union(live.select("v", "u"))
        point = store.put(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), f"{name}-{step}-0")
        jump, moved = 0, True
        while moved:
            jump += 1
            ahead = point.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            further = store.put(point.join(ahead, "root", "left").select("node", F.coalesce("_to", "root").alias("root"), (F.col("_to") != F.col("root")).alias("_moved")), f"{name}-{step}-{jump}")
            moved = not further.where("_moved").isEmpty()
            point = further.drop("_moved")
        there = point.select(F.col("node").alias("u"), F.col("root").alias("_u"))
        back = point.select(F.col("node").alias("v"), F.col("root").alias("_v"))
        drawn = live.join(there, "u").join(back, "v").where("_u != _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()
        live = store.put(drawn, f"{name}-{step}-edges")
        if roots is None:
            roots = point
        else:
            roots = roots.join(point.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            roots = store.put(roots, f"{name}-{step}-roots")
    if roots is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of a text column, each of a row at least, so that what Python makes of one stays small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, after which memory that is free goes back to the system: idle Python workers stay small."""
    yield from rows
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, one row a key whose ``n`` says how many rows of ``left`` have it at most.

    Keys with more than a quarter of a partition's fair share are at most four
    times as many as partitions: they are broadcast, so their rows stay where
    they are, and all others are dealt by key.  ``left`` is read twice if there
    are any such, so it should be a stored table.  ``n`` is not in the result.
    """
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(1000, (right.agg(F.sum(n)).first()[0] or 0) // (4 * parts))
    hot = right.where(F.col(n) > most).drop(n)
    if hot.isEmpty():
        return left.join(right.drop(n), keys, how)
    few = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(n) <= most).drop(n), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(few)
