"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to ``spark.checkpoint.dir``, so that plans of loops stay short and survive lost executors.

    Where the session names no folder and runs on one machine, as in tests, a
    temporary one is set; a cluster without one is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="quernstone-"))
    return df.checkpoint()


def put_texts(rows: DataFrame) -> str:
    """Writes small files (path, text) below a new folder next to the checkpoints, and says where."""
    spark = rows.sparkSession
    checkpointed(rows.limit(0))
    base = f"{spark.sparkContext.getCheckpointDir()}/texts-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    for row in rows.collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{row.path}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(path)
        out.write(bytearray(row.text.encode()))
        out.close()
    return base
