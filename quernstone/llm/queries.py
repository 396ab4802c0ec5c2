"""Queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, katz, langid, lines, media, minhash, packing, pieces, tools, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shortest runs of 50 words by sums over pairs of lines of a document, their texts compared as they are.
OP3_SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d),
w AS (SELECT doc_id, pos, len(list_filter(string_split(ls[pos], ' '), lambda x: x <> '')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
p AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50),
r AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
t AS (SELECT r.doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS run FROM r JOIN d USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM t),
x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(s, e + 1)) AS pos FROM k WHERE nth > 1) GROUP BY doc_id)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda v, i: NOT list_contains(gone, i)), chr(10)), '') END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines,
       coalesce(len(gone), 0) AS n_deleted
FROM d LEFT JOIN x USING (doc_id)
"""


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations hold no tool calls, so each user turn is one and the reply its result; calls are ordered by what they come after."""
    rows = tools.format_calls(*tools.turns_as_calls(_table(spark, sf_dir, "conversations")), tools.REPLY)
    return rows.select(F.col("conv").alias("conv_id"), "call_id", "position", "status", "cyclic", "valid", "json")


#: A path graph: all that a call comes after lies in one direction, so steps that way give its place and its cycles.
OP4_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS result FROM conversations WHERE role = 'assistant'),
b AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn) AS turn, u.text, u.n, a.result,
             CASE WHEN u.turn IS NULL THEN 'orphan' WHEN a.turn IS NULL THEN 'pending' ELSE 'linked' END AS status,
             row_number() OVER (PARTITION BY coalesce(u.conv_id, a.conv_id) ORDER BY coalesce(u.turn, a.turn + 1)) AS rn
      FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn),
e AS (SELECT x.conv_id, x.turn, y.turn AS dep, y.turn - x.turn AS way FROM u x JOIN u y ON x.conv_id = y.conv_id
      AND ((y.turn = x.turn - 2 AND y.n <= 3 * x.n) OR (y.turn = x.turn + 2 AND 2 * y.n < x.n))),
m AS (SELECT x.conv_id, x.turn FROM e x JOIN e y ON x.conv_id = y.conv_id AND x.turn = y.dep AND x.dep = y.turn),
p AS (SELECT conv_id, turn, turn AS anc, way, 0 AS steps FROM u, (VALUES (-2), (2)) w(way)
      UNION ALL SELECT p.conv_id, p.turn, e.dep, p.way, p.steps + 1 FROM p JOIN e ON e.conv_id = p.conv_id AND e.turn = p.anc AND e.way = p.way),
c AS (SELECT DISTINCT p.conv_id, p.turn FROM p JOIN m ON m.conv_id = p.conv_id AND m.turn = p.anc),
g AS (SELECT p.conv_id, p.turn, max(b.rn + p.steps) AS place FROM p JOIN b ON b.conv_id = p.conv_id AND b.turn = p.anc GROUP BY ALL),
f AS (SELECT b.*, c.turn IS NOT NULL AS cyclic,
             row_number() OVER (PARTITION BY b.conv_id ORDER BY c.turn IS NOT NULL, CASE WHEN c.turn IS NULL THEN coalesce(g.place, b.rn) END, b.rn) AS position,
             CASE WHEN b.status = 'orphan' THEN NULL WHEN b.n >= 200 THEN b.n <= 400 ELSE b.n > 0 END AS valid
      FROM b LEFT JOIN c ON c.conv_id = b.conv_id AND c.turn = b.turn LEFT JOIN g ON g.conv_id = b.conv_id AND g.turn = b.turn)
SELECT conv_id, 'turn-' || turn AS call_id, position, status, cyclic, valid,
       '{"arguments":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END
       || ',"conversation":' || conv_id || CASE WHEN cyclic THEN ',"cyclic":true' ELSE '' END
       || CASE WHEN NOT valid THEN ',"errors":["$.text: too ' || CASE WHEN n > 0 THEN 'long' ELSE 'short' END || '"]' ELSE '' END
       || ',"id":"turn-' || turn || '","name":' || CASE WHEN status = 'orphan' THEN 'null' WHEN n >= 200 THEN '"summarise"' ELSE '"reply"' END
       || ',"position":' || position || ',"result":' || coalesce(to_json(result), 'null') || ',"status":"' || status || '"}' AS json
FROM f
"""


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_decoded(_table(spark, sf_dir, "documents"))


def op6_media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(_table(spark, sf_dir, "documents"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language and have a source as host; pages beside them have markup and addresses."""
    return langid.identify_documents_and_pages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


OP8_SQL = """
WITH r AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM r
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM h
"""

QUERIES = {
    "op1_katz": (op1_katz, None),
    "op2_near_vectors": (op2_near_vectors, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_tool_calls": (op4_tool_calls, OP4_SQL),
    "op5_merge_dropout": (op5_merge_dropout, None),
    "op6_media_documents": (op6_media_documents, None),
    "op7_best_two_fit": (op7_best_two_fit, None),
    "op8_warc_index": (op8_warc_index, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_probminhash": (op10_probminhash, None),
}
