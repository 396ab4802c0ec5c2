"""Media columns: interleaved text and media sequences whose payloads are resolved by digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store, join_hot, slices

WIDTH = 64
TASK_DIGESTS = 200_000
#: Elements whose source is a media reference, and those whose content is no text.
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media", "embed": "media"}
SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "article", "section", "header", "footer", "nav", "figure", "blockquote", "pre", "br", "title"}
_DIGEST = re.compile(r"sha-?256[;:]([0-9a-fA-F]{64})")
ITEM = "position: int, kind: string, text: string, media_type: string, src: string, digest: string, caption: string"


class Sequencer(HTMLParser):
    """Ordered items of a page: text runs between block elements, and media references.

    The caption of a reference is the ``figcaption`` of its figure, wherever it
    stands there, else its ``alt`` text; a figcaption is not repeated as text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._skip = 0
        self._figures: list[list] = []
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in SKIPPED:
            self._skip += 1
        if tag in BLOCKS:
            self._flush()
        if tag == "figure":
            self._figures.append([len(self.items), 0, None])
        if tag == "figcaption":
            self._flush()
            self._caption = []
        if tag in MEDIA and a.get("src"):
            self._flush()
            found = _DIGEST.search(a["src"]) or _DIGEST.search(a.get("data-digest") or "")
            self.items.append({"kind": "media", "media_type": MEDIA[tag], "src": a["src"], "digest": found[1].lower() if found else None, "caption": a.get("alt") or None})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self._skip -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag in BLOCKS:
            self._flush()
        if tag == "figcaption":
            self._close_caption()
        if tag == "figure" and self._figures:
            self._close_figure()

    def _close_caption(self) -> None:
        if self._caption is None:
            return
        caption, self._caption = " ".join("".join(self._caption).split()), None
        if caption and self._figures:
            self._figures[-1][1:] = [len(self.items), caption]
        elif caption:
            self.items.append({"kind": "text", "text": caption})

    def _close_figure(self) -> None:
        """Gives the caption to the figure's media; without any it is a text where it stood."""
        start, at, caption = self._figures.pop()
        own = [x for x in self.items[start:] if x["kind"] == "media"]
        for x in own:
            x["caption"] = caption or x["caption"]
        if caption and not own:
            self.items.insert(at, {"kind": "text", "text": caption})

    def end(self) -> list[dict]:
        self._close_caption()
        self._flush()
        while self._figures:
            self._close_figure()
        return self.items

    def handle_data(self, data: str) -> None:
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = Sequencer()
    parser.feed(html or "")
    parser.close()
    return [{"position": k, "text": None, "media_type": None, "src": None, "digest": None, "caption": None} | x for k, x in enumerate(parser.end())]


def parse_sequences(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """One row a page: the columns ``keep`` and ``items``, its texts and media references in order.

    Each item is a struct of position, kind, text, media_type, src, digest and
    caption.  Null and empty pages, and such without text or media, have no items.
    """
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media_type", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            items = [sequence(html) for html in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(items, pa.list_(item))], [*keep, "items"])

    source = pages.select(F.col(html_col).alias("_html"), *keep)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{ddl}items array<struct<{ITEM}>>")


def to_media(payload: bytes) -> bytes:
    """A binary greymap of 8-bit samples, 64 to a row; the payload must fill its rows."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if (kind, depth) != (b"P5", b"255") or len(samples) != width * height:
        raise ValueError("not an 8-bit greymap")
    return samples


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def feature(payload: bytes) -> str:
    """64 bits in hex: which columns of the picture are brighter than its mean."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * WIDTH > sums.sum()).tobytes().hex()


def page_of(doc_id: object, text: str, digest: str) -> str:
    """A document as a page: a paragraph for each line, and in their midst the figure of its media, by digest."""
    lines = [f"<p>{escape(x)}</p>" for x in text.split("\n")]
    cut = (len(lines) + 1) // 2
    figure = f'<figure><img src="ni:///sha-256;{digest}" width="{WIDTH}"><figcaption>document {doc_id}</figcaption></figure>'
    return f"<article>{''.join(lines[:cut])}{figure}{''.join(lines[cut:])}</article>"


def document_pages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, html): each text as a page that refers to its media by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, pages = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                n.append(len(raw))
                pages.append(page_of(doc_id, text or "", hashlib.sha256(to_media(padded(raw))).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(pages, pa.string())], [id_col, "n_bytes", "html"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_bytes long, html string")


def document_payloads(docs: DataFrame, text_col: str) -> DataFrame:
    """(digest, media) of each text; a task keeps the media of a digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            digests, media = [], []
            for text in batch.column(0).to_pylist():
                own = to_media(padded((text or "").encode()))
                hashed = hashlib.sha256(own)
                if hashed.digest() not in seen:
                    digests.append(hashed.hexdigest())
                    media.append(own)
                    if len(seen) >= TASK_DIGESTS:
                        seen.clear()
                    seen.add(hashed.digest())
            if media:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return docs.select(text_col).mapInArrow(run, "digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """One row a digest with what its stored bytes, read back, say; damaged bytes are an error."""
    fields = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = hashlib.sha256(own).hexdigest()
                if found != digest:
                    raise ValueError(f"the media of {digest} are damaged")
                payload = from_media(own)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(own), found, feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields, strict=True)], schema=fields)

    got = media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return got.groupBy("digest").agg(*(F.first(c).alias(c) for c in fields.names[1:]))


def resolve(store: Store, sequences: DataFrame, payloads: DataFrame, name: str = "resolved") -> DataFrame:
    """Sequences whose items have ``payload``, the struct of the columns of ``payloads`` (one row a digest); null where none is known.

    References alone are dealt by digest, those of a digest that many share
    staying where they are, and return to the page and position that they came
    from; sequences move once, so leave out of ``items`` what is not needed.
    """
    sequences = store.put(sequences.withColumn("_page", F.monotonically_increasing_id()), f"{name}-sequences")
    refs = store.put(sequences.select("_page", F.explode(F.filter("items", lambda x: x["digest"].isNotNull())).alias("_x")).select("_page", "_x.position", "_x.digest"), f"{name}-references")
    columns = [c for c in payloads.columns if c != "digest"]
    wanted = refs.groupBy("digest").agg(F.count("*").alias("_n"))
    known = store.put(payloads.select("digest", F.struct(*columns).alias("payload")).join(wanted, "digest"), f"{name}-payloads")
    own = join_hot(refs, known, ["digest"], "_n").groupBy("_page").agg(F.map_from_entries(F.collect_list(F.struct("position", "payload"))).alias("_own"))
    both = sequences.join(own, "_page", "left")
    return both.withColumn("items", F.transform("items", lambda x: x.withField("payload", F.col("_own")[x["position"]]))).drop("_page", "_own")


def media_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its text stored as media, resolved through its page, read back and described.

    The page of a document has its lines as paragraphs around the figure of its
    media.  ``position`` is that of the media among the ``n_items`` items of the
    page, ``caption`` its caption, and ``texts_crc32`` the CRC-32 of those of the texts in
    order, the media's place being empty.

    Null texts count as empty, repeated rows stay, null ids stay null, an empty
    table gives no rows, texts of any length are taken whole, and other columns are
    ignored.  Payloads are written once and read once and never shuffled: only
    what describes them is joined.
    """
    store = Store(docs.sparkSession, "media")
    stored = store.put(document_payloads(docs, text_col), "payloads")
    facts = store.put(described(stored), "described")
    parsed = parse_sequences(document_pages(docs, id_col, text_col), "html", [id_col, "n_bytes"])
    narrow = F.transform("items", lambda x: F.struct(x["position"].alias("position"), F.crc32(x["text"]).alias("text_crc32"), x["digest"].alias("digest"), x["caption"].alias("caption")))
    found = resolve(store, parsed.select(id_col, "n_bytes", narrow.alias("items")), facts)
    own = F.filter("items", lambda x: x["digest"].isNotNull())[0]
    texts = F.crc32(F.array_join(F.transform("items", lambda x: F.coalesce(x["text_crc32"].cast("string"), F.lit(""))), ","))
    rows = found.select(id_col, "n_bytes", own.alias("_own"), F.size("items").cast("long").alias("n_items"), texts.alias("texts_crc32"))
    return rows.select(id_col, "n_bytes", "_own.payload.*", "_own.position", "_own.caption", "n_items", "texts_crc32")


def interleaved(sequences: DataFrame, *keep: str) -> DataFrame:
    """One row an item of the sequences, with the columns ``keep``."""
    return sequences.select(*keep, F.explode("items").alias("_x")).select(*keep, "_x.*")
