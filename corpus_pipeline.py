"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs.  All but the last return the columns
of documents.

In every stage nulls may stand in any column, texts may be empty or of any
length, rows and ids may repeat, columns may be more than those of documents and
clash with names that an operator makes (which stay as they came), and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import langid, lines, minhash, packing
from quernstone.llm._common import Store


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others in one that no operator names."""
    rest = [F.col(c) for c in docs.columns if c not in needed] or [F.lit(None).alias("none")]
    return docs.select(*needed, F.struct(*rest).alias("_others"))


def _whole(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return rows.select(*(F.col(c) if c in needed else F.col("_others")[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of at least a half; declared tags stay as they are.

    Null texts and texts without letters go, as their language is unknown; rows
    that repeat all stay or all go; of languages equally likely the first by alphabet counts.
    """
    needed = ("text", "lang", "source")
    return _whole(langid.identify_documents(_apart(docs, *needed)).where("kept"), docs, *needed)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of 50 words or more; a document that has nothing left goes.

    Documents are in the order of their ids, null ids last; of repeated rows one keeps
    its lines.  ``n_chars`` is counted anew where lines went.  Null texts stay.
    """
    needed = ("doc_id", "text", "n_chars")
    rows = lines.dedup_lines(_apart(docs, *needed)).where("n_deleted = 0 or n_deleted < n_lines")
    length = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _whole(rows.withColumn("n_chars", length), docs, *needed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id; of rows with one id one stays, null ids come last."""
    needed = ("doc_id", "text")
    return _whole(minhash.near_duplicates(_apart(docs, *needed)).where("kept"), docs, *needed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null text is an empty one, of one token."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Likelihoods, signatures and byte pairs are beyond SQL; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder, and the tables that it made on the way go."""
    store, docs = Store(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    opened = Store.opened()
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
        Store.discard(keep=opened)
    return STAGES[-1][1](spark, docs, sf_dir)
