import hashlib
import zlib

from pyspark.sql import functions as F

from quernstone.llm import media
from quernstone.llm._common import Store

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>one <b>two</b> &amp; three
<img src="sha256:%s" alt="A"> after</p><figure><figcaption>Cap <i>x</i></figcaption><video src="v.mp4"></video></figure>
<script>no()</script><figure><figcaption>lonely</figcaption></figure><p>open <figure><img src="z.png">"""


def test_sequence_keeps_order_and_captions():
    d = "AB" * 32
    items = media.sequence(PAGE % d)
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [(x["kind"], x["text"] or x["src"], x["digest"], x["caption"]) for x in items] == [
        ("text", "T", None, None), ("text", "Head", None, None), ("text", "one two & three", None, None),
        ("media", f"sha256:{d}", d.lower(), "A"), ("text", "after", None, None), ("media", "v.mp4", None, "Cap x"),
        ("text", "lonely", None, None), ("text", "open", None, None), ("media", "z.png", None, None),
    ]
    assert media.sequence(None) == media.sequence("") == []


def test_digest_join(spark):
    d = "cd" * 32
    pages = spark.createDataFrame([(1, PAGE % d, "x"), (2, None, "y"), (None, PAGE % ("00" * 32), "z")], "page_id long, html string, digest string")
    sequences = media.parse_sequences(pages, "html", ["page_id"])
    payloads = spark.createDataFrame([(d, 7, "f")], "digest string, payload_bytes long, feature string")
    found = media.resolve(Store(spark, "test"), sequences, payloads)
    got = {r.page_id: r["items"] for r in found.collect()}
    assert got[2] == [] and [x.position for x in got[1]] == list(range(9))
    assert [x.payload and tuple(x.payload) for x in got[1] if x.kind == "media"] == [(7, "f"), None, None]
    assert [(x.caption, x.digest) for x in got[1]] == [(x["caption"], x["digest"]) for x in media.sequence(PAGE % d)]
    assert [x.payload for x in got[None]] == [None] * 9
    assert media.interleaved(found, "page_id").where("payload is not null").select("page_id", "position").collect() == [(1, 3)]
    assert media.resolve(Store(spark, "test"), sequences.limit(0), payloads).collect() == []


def test_a_digest_that_most_pages_share(spark):
    hot, rare = "ab" * 32, "cd" * 32
    page = '<p>%d</p><img src="sha256:' + hot + '"><p>x</p><img src="sha256:' + rare + '">'
    pages = spark.range(3000).select("id", F.format_string(page, "id").alias("html"))
    payloads = spark.createDataFrame([(hot, 1), (rare, 2)], "digest string, n long")
    found = media.resolve(Store(spark, "test"), media.parse_sequences(pages, "html", ["id"]), payloads)
    got = found.select("id", F.transform("items", lambda x: F.coalesce(x["text"], x["payload"]["n"].cast("string"))).alias("v")).collect()
    assert {r.id: r.v for r in got} == {k: [str(k), "1", "x", "2"] for k in range(3000)}


def plain_feature(payload):
    columns = [sum(payload[k::64]) for k in range(64)]
    bits = "".join("1" if 64 * c > sum(columns) else "0" for c in columns)
    return f"{int(bits, 2):016x}"


def test_documents(spark):
    texts = [None, "", "a", "x" * 64, "é" * 32, "tail\0", "long " * 300000, "a", "\n", "one\n  two <b>&amp; \n\nthree\r\nfour"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in [*enumerate(texts), (2, "again"), (None, "a")]], "doc_id long, text string, media string")
    got = media.media_documents(docs).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        form = b"P5\n64 %d\n255\n" % (len(pay) // 64) + pay
        lines = (r.text or "").split("\n")
        cut = (len(lines) + 1) // 2
        before, after = ([" ".join(x.split()) for x in part if x.split()] for part in (lines[:cut], lines[cut:]))
        crcs = ",".join([*(str(zlib.crc32(x.encode())) for x in before), "", *(str(zlib.crc32(x.encode())) for x in after)])
        want.append((r.doc_id, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(form), hashlib.sha256(form).hexdigest(), plain_feature(pay), len(before), f"document {r.doc_id}", len(before) + len(after) + 1, zlib.crc32(crcs.encode())))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert media.media_documents(docs.limit(0)).collect() == []
