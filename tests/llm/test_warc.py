import hashlib
import os

from quernstone.llm import warc
from quernstone.llm._common import Store

LONG, OTHER = "é" + "x" * 1200, "y" * 999
ROWS = [(1, "http://a/", LONG), (5, "http://b/", LONG), (3, None, LONG), (2, "http://c/ \r\nX: y", OTHER), (4, "http://c/", OTHER), (6, "u", None), (7, "u", ""), (None, "n", "only null " * 200), (8, "z", "head\r\n\r\nbody" * 100), (8, "z", "head\r\n\r\nbody" * 100), (9, "v", "z" * 1000)]


def brute(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        head = max(ids) if len(raw) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1 and ids else None
        revisit = head is not None and head != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d") for r in ROWS], "page_id long, url string, html string, digest string")
    got = warc.archive_and_read(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)


def test_selected_records_only(spark):
    store = Store(spark, "t")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i + 1)) for i in range(50)], "page_id long, url string, html string")
    index = store.put(warc.write_archives(pages, f"{store.base}/a"), "index")
    got = warc.read_records(index.where("page_id % 7 = 0"), f"{store.base}/a", with_payload=True).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {i: f"page {i} " * (i + 1) for i in range(0, 50, 7)}


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("b", 0, 7)]
    assert list(warc.ranges(rows, gap=0)) == [("a", 0, 20, [(0, 10), (10, 10)]), ("a", 100, 105, [(100, 5)]), ("b", 0, 7, [(0, 7)])]
    assert [x[1:3] for x in warc.ranges(rows, gap=100)] == [(0, 105), (0, 7)]
    assert [x[1:3] for x in warc.ranges(rows, gap=100, most=15)] == [(0, 10), (10, 20), (100, 105), (0, 7)]
    many = [("a", k * 10, 10) for k in range(200)]
    assert list(warc.ranges(many)) == [("a", 0, 2000, [(k * 10, 10) for k in range(200)])]


def test_damage_is_seen():
    raw = warc.record("response", 1, "u", hashlib.sha1(b"abc").hexdigest(), 3, b"abd", None, "2024-01-01T00:00:00Z")
    try:
        warc.parse(raw)
    except ValueError:
        return
    raise AssertionError(os.strerror(0))
