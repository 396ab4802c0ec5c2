"""WARC archives: written with an index first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store

LEAST_REVISIT = 1000
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = re.compile(r"<urn:page:(-?\d+)>")
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def _fs(uri: str):
    """(file system, path): any store that pyarrow can open, local folders included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) else f"file://{uri.removeprefix('file:')}")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def record(kind: str, page_id: int | None, url: str | None, digest_hex: str, payload_bytes: int, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has its response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; the digest of a payload is computed anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, at, to = fields["WARC-Type"], _URN.fullmatch(fields["WARC-Record-ID"]), _URN.fullmatch(fields.get("WARC-Refers-To", ""))
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != declared):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": int(at[1]) if at else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": declared, "record_type": kind, "refers_to": int(to[1]) if to else None, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes a record for each page under ``base`` and returns the index (file, offset, length, url, digest, ...).

    Of equal payloads of at least ``least_revisit`` bytes the one with the largest
    id is the response that the others revisit.  Each record is a gzip member of
    its own.  Store the returned index at once: computing it writes the files.
    File names are drawn for each attempt of a task, so files of a failed attempt
    are never in the index.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    heads = rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(base)
        store.create_dir(root, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            index = []
            for page_id, url, text, digest, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "revisit" if head is not None and head != page_id else "response"
                payload = text.encode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(kind, page_id, url, digest, len(payload), payload, head, date)) + packer.flush()
                if out is None or at + len(raw) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                index.append({"file": name, "offset": at, "length": len(raw), "url": url, "digest": digest, "page_id": page_id, "record_type": kind})
                at += len(raw)
            if index:
                yield pa.RecordBatch.from_pylist(index, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return rows.join(heads, "digest", "left").select("page_id", "url", "html", "digest", "head").mapInArrow(write, INDEX)


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length)]) of sorted rows: neighbours closer than ``gap`` become one read of at most ``most`` bytes or one record."""
    now: tuple | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= gap and offset + length - now[1] <= most:
            now = (file, now[1], max(now[2], offset + length), [*now[3], (offset, length)]) if len(now[3]) < 64 else _grow(now, offset, length)
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [(offset, length)])
    if now:
        yield now


def _grow(now: tuple, offset: int, length: int) -> tuple:
    now[3].append((offset, length))
    return now[0], now[1], max(now[2], offset + length), now[3]


def read_records(index: DataFrame, base: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` selects, from sorted and coalesced byte-range reads."""
    names = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(base)
        opened = handle = None
        for batch in batches:
            out, held = [], 0
            for file, start, end, parts in ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if file != opened:
                    if handle:
                        handle.close()
                    opened, handle = file, store.open_input_file(f"{root}/{file}")
                data = handle.read_at(end - start, start)
                for offset, length in parts:
                    found = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    held += found["payload_bytes"] if with_payload else 0
                    out.append(found)
                if out and held > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(names))
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(names))
        if handle:
            handle.close()

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    picked = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return picked.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Archives all pages in the shared folder, then reads every record back.

    Null html is an empty payload, a null url leaves the header out.  A page
    without id is a revisit if a copy has an id, else a response; rows that share
    both the largest id and the payload are all responses.  An empty table gives
    no rows; other columns are ignored.
    """
    store = Store(pages.sparkSession, "warc")
    index = store.put(write_archives(pages, f"{store.base}/archives", id_col, url_col, html_col, least_revisit), "index")
    return read_records(index, f"{store.base}/archives")
