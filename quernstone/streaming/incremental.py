"""Incremental ingestion as a stream of snapshots that stops when all is read.

Late rows are read again by a margin, not dropped, so there is no event-time
watermark: each batch is compared with what is stored by content hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import detect_changes


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def ingest(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, key: str = "id", text: str = "content", order: str = "modified_at") -> None:
    """Reads new files below ``source`` and appends what they change to ``state`` (key, content_hash, change_type, batch).

    A batch that is run again after a failure replaces its own folder, so results
    are the same as if it had run once.
    """

    def write(batch: DataFrame, number: int) -> None:
        incoming = latest(batch, key, order).withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
        seen = stored(spark, state, key).where(F.col("batch") < number)
        now = latest(seen.select(key, "content_hash", "batch"), key, "batch").select(key, "content_hash")
        changes = detect_changes(now, incoming.select(key, "content_hash"), [key]).where("change_type in ('created', 'changed')")
        changes.select(key, F.col("new_hash").alias("content_hash"), "change_type").write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, state: str, key: str = "id") -> DataFrame:
    """All changes so far; none yet is an empty table."""
    schema = f"{key} string, content_hash string, change_type string, batch int"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(state) if there else spark.createDataFrame([], schema)
