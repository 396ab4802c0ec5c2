"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Store, join_hot, released, slices

#: Bound of the fit: about so many different texts of each language are read.
LABEL_TEXTS = 5_000
BUCKETS = 1 << 16
#: So many numbers of the table are taken up at once, and so many languages are counted side by side in a task.
CELLS, TOGETHER = 1 << 22, 64
#: Neighbouring letter triples say much the same, so a text counts as no more than this many.
EFFECTIVE_GRAMS = 100
HOST_STRENGTH, DOMAIN_STRENGTH, SUFFIX_STRENGTH = 20.0, 50.0, 50.0
GROUP_BYTES = 1 << 20
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, buckets, where each text's begin) for groups of texts.

    A gram is three bytes around a letter of the lower-cased text, all others
    counting as one sign; characters beyond ASCII are letters.
    """
    raws = [t.lower().encode() for t in texts]
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= GROUP_BYTES):
            size += len(raws[end]) + 2
            end += 1
        data = np.frombuffer(b"  " + b"  ".join(raws[at:end]) + b"  ", np.uint8)
        letter = _LETTER[data]
        data = np.where(letter, data, 32).astype(np.uint32)
        middle = np.flatnonzero(letter[1:-1])
        code = (data[middle] << 16) | (data[middle + 1] << 8) | data[middle + 2]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        starts = np.cumsum([0] + [len(r) + 2 for r in raws[at : end - 1]]) + 1
        yield at, end, bucket, np.searchsorted(middle, starts)
        at = end


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from each start to the next."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[np.append(starts[1:], len(values))] - total[starts]


@dataclass(frozen=True)
class TextModel:
    """log P(gram | language) in ``table[bucket, language]``; the last language is ``und``, with all grams alike."""

    labels: tuple[str, ...]
    table: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of grams, log likelihood of each language) of each text."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.labels)))
        step = max(1, CELLS // len(self.labels))
        for at, end, bucket, starts in grams(texts):
            n[at:end] = np.diff(np.append(starts, len(bucket)))
            text = np.repeat(np.arange(at, end), n[at:end])
            for k in range(0, len(bucket), step):
                own = text[k : k + step]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[first]] += sums(self.table[bucket[k : k + step]], first)
        return n, total


def normal_label(label: Column) -> Column:
    """The primary part of a language tag in lower case; null if there is none."""
    part = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]{2,8})(?=[-_\s]|$)", 1))
    return F.when(part != "", part)


def fit(labelled: DataFrame, text: Column, label: Column, label_texts: int = LABEL_TEXTS, smoothing: float = 0.5) -> TextModel:
    """Counts grams by language over a sample of about ``label_texts`` different whole texts of each.

    Every label that a text with letters has, however rare, is learnt.  The sample
    is chosen by hash, the same for the same rows.  What comes to the driver is
    bounded by languages times buckets, half a MB a language.
    """
    rows = labelled.select(text.alias("text"), normal_label(label).alias("label")).where("label is not null").where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    texts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    many = {x: int(label_texts / n * (1 << 30)) for x, n in texts.items() if n > label_texts}
    if many:
        bound = F.create_map(*(F.lit(v) for x in many.items() for v in x))[F.col("label")]
        rows = rows.where(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) < F.coalesce(bound, F.lit(1 << 30)))

    def packed(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["label", "bucket", "n"])
        seen.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, 0)):
            by: dict[str, list[str]] = {}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(t)
            for label, own_texts in by.items():
                if len(seen) >= TOGETHER and label not in seen:
                    yield from packed(seen)
                own = seen.setdefault(label, np.zeros(BUCKETS, np.int64))
                for _, _, bucket, _ in grams(own_texts):
                    own += np.bincount(bucket, minlength=BUCKETS)
        yield from packed(seen)

    counts = rows.distinct().mapInArrow(lambda batches: released(count(batches)), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    labels = tuple(sorted(texts))
    table = np.full((BUCKETS, len(labels) + 1), smoothing)
    got = counts.toPandas()
    if len(got):
        table[got["bucket"].to_numpy(), got["label"].map({x: k for k, x in enumerate(labels)}).to_numpy()] += got["n"].to_numpy()
    table[:, -1] = 1
    return TextModel((*labels, UNKNOWN), np.log(table / table.sum(axis=0)))


def _posterior(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def identify(rows: DataFrame, model: TextModel, text_col: str = "text", declared: Column | None = None, host: Column | None = None, keep: list[str] | None = None, certainty: float = 0.5) -> DataFrame:
    """The rows with ``language``, ``certainty`` (its posterior) and ``kept``.

    The posterior of a language is proportional to its prior on the host, which
    shrinks to that of the host's domain and this to that of all rows, times the
    likelihoods of the text, of the declared language and of the host's last part
    (a name without dots has none).  All but the first come from sums of text
    posteriors over groups of all rows, so a host or a tag counts as far as its
    texts bear it out; a row's own posterior is left out of the groups that it is in,
    as its text is evidence already.  A row is kept if its language is known and at
    least ``certainty`` sure; of languages that are equally likely the first by alphabet
    is named.  Null texts, and texts without letters, are unknown; missing hosts
    and tags say nothing; repeated rows count each; texts of any length are taken
    whole; an empty table gives no rows.  Columns of these names are replaced.
    """
    spark, labels = rows.sparkSession, model.labels
    none, ks = F.lit(None).cast("string"), range(len(model.labels))
    made = ["language", "certainty", "kept"]
    keep = [c for c in (rows.columns if keep is None else keep) if c not in made]
    send = spark.sparkContext.broadcast(model)  # languages times BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            n, total = send.value.score([t or "" for t in batch.column(0).to_pylist()])
            scaled = total * np.minimum(1, EFFECTIVE_GRAMS / np.maximum(n, 1))[:, None]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(0, scaled.size + 1, len(labels)), pa.int32()), pa.array(v.ravel())) for v in (scaled, _posterior(scaled))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), *arrays], [*names, "_n", "_score", "_p"])

    tag = normal_label(none if declared is None else declared)
    tag = F.when(tag.isin(*labels[:-1]), tag).when(tag.isNotNull(), F.lit("other"))  # those of no text with letters in the fit
    source = rows.select(F.col(text_col).alias("_text"), F.struct(*keep).alias("_row"), tag.alias("_tag"), F.lower(none if host is None else host).alias("_host"))
    names = source.columns[1:]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    store = Store(spark, "languages")
    scored = store.put(source.mapInArrow(lambda batches: released(score(batches)), f"{ddl}, _n long, _score array<double>, _p array<double>"), "scored")

    known = scored.where("_n > 0")
    added = lambda c: F.array(*(F.sum(F.col(c)[k]) for k in ks))
    numbers = lambda v: F.array(*map(F.lit, map(float, v)))
    mass = np.asarray([x or 0.0 for x in known.agg(added("_p").alias("p")).first()["p"]])
    prior = (mass + 1) / (mass + 1).sum()
    # P(tag | language): a table of languages by languages
    by_tag = {r["_tag"]: r["p"] for r in known.where("_tag is not null").groupBy("_tag").agg(added("_p").alias("p")).collect()}
    seen = np.sum([np.zeros(len(labels)), *map(np.asarray, by_tag.values())], axis=0)

    # posteriors of a row add up to 1, so those of a group to its rows
    parts = F.split("_host", r"\.")
    hosts = store.put(known.where("_host is not null").groupBy("_host").agg(added("_p").alias("_h"), F.count("*").alias("_n_h")), "host-sums")
    hosts = hosts.withColumn("_domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("_host"))).withColumn("_suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    sums_by = lambda c, p: hosts.where(F.col(c).isNotNull()).groupBy(c).agg(added("_h").alias(p), F.sum("_n_h").alias(f"_n{p}"))
    hosts = store.put(hosts.join(sums_by("_domain", "_d"), "_domain", "left").join(sums_by("_suffix", "_s"), "_suffix", "left").drop("_domain", "_suffix"), "hosts")

    zero = numbers(np.zeros(len(labels)))
    tags = F.broadcast(spark.createDataFrame(list(by_tag.items()), "_tag string, _t array<double>"))  # at most languages times languages
    joined = join_hot(scored, hosts.withColumn("_many", F.col("_n_h")), ["_host"], "_many", "left").join(tags, "_tag", "left")
    mine = F.col("_n") > 0
    others = lambda c: F.zip_with(c, "_p", lambda a, p: F.greatest(a - F.when(mine, p).otherwise(0.0), F.lit(0.0)))
    count = lambda c: F.col(c) - F.when(mine, 1).otherwise(0)
    domain = F.zip_with(others("_d"), numbers(prior), lambda d, p: (d + DOMAIN_STRENGTH * p) / (count("_n_d") + DOMAIN_STRENGTH))
    host_prior = F.zip_with(others("_h"), domain, lambda h, d: F.log((h + HOST_STRENGTH * d) / (count("_n_h") + HOST_STRENGTH)))
    share = count("_n_s") / float(max(mass.sum(), 1e-9))
    suffix = F.zip_with(others("_s"), numbers(mass), lambda s, m: F.log((s + SUFFIX_STRENGTH * share) / (m + SUFFIX_STRENGTH)))
    suffix = F.when(share > 0, suffix)  # no other row has it
    spoken = F.zip_with(others("_t"), numbers(seen), lambda t, m: F.log((t + 1) / (m + len(by_tag) + 1)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    evidence = plus(plus("_score", F.coalesce(host_prior, numbers(np.log(prior)))), plus(F.coalesce(suffix, zero), F.coalesce(spoken, zero)))
    joined = joined.withColumn("_all", evidence)
    best = F.array_max("_all")
    joined = joined.withColumn("_certainty", 1 / F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x - best)))
    language = F.when(F.col("_n") > 0, F.element_at(F.array(*map(F.lit, labels)), F.array_position("_all", best).cast("int"))).otherwise(UNKNOWN)
    return joined.select(*(F.col("_row")[c].alias(c) for c in keep), language.alias("language"), F.when(F.col("_n") > 0, F.col("_certainty")).alias("certainty")).withColumn("kept", F.coalesce((F.col("language") != UNKNOWN) & (F.col("certainty") >= certainty), F.lit(False)))


def identify_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``identify`` with a model fitted on the documents' own declared languages."""
    model = fit(docs, F.col(text_col), F.col(declared_col))
    return identify(docs, model, text_col, F.col(declared_col), F.col(host_col), keep)


def identify_documents_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, language, certainty, kept) of every document and every page; one of the ids is null.

    The model is fitted on both with what they declare.  Documents have a source
    for a host; pages have the language of their markup and a host with its domain
    and suffix.  The two are weighed apart, as their tags and hosts are of other kinds.
    """
    seen = page_evidence(pages)
    labelled = docs.select("text", "lang").unionAll(seen.select("visible", "declared"))
    model = fit(labelled, F.col("text"), F.col("lang"))
    of_docs = identify(docs, model, "text", F.col("lang"), F.col("source"), ["doc_id"])
    of_pages = identify(seen, model, "visible", F.col("declared"), F.col("host"), ["page_id"])
    return of_docs.unionByName(of_pages, allowMissingColumns=True).select("doc_id", "page_id", "language", "certainty", "kept")


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with ``visible`` text, ``declared`` language of the markup and ``host`` of the address."""
    html = F.col(html_col)
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&\w+;", " ")
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    host = F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.withColumns({"visible": visible, "declared": F.when(tag != "", tag), "host": F.when(host != "", host)})
