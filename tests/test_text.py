from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import pages


def values(spark, rows, make):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("x")).alias("v")).collect()]


def test_names(spark):
    assert values(spark, [None, "", "  ", "  --  __  ", "Auth Service", "auth-service", "ＡＢＣ　x", "결제 시스템", "a.b"], T.normalized_name) == ["", "", "", "", "authservice", "authservice", "abcx", "결제시스템", "a.b"]
    assert values(spark, ["A. b-C"], T.match_name) == ["abc"] and values(spark, ["A. b-C!é"], T.alnum_name) == ["abcé"]
    assert values(spark, ["f.py::Class.run", "plain", "a::b::c.d"], T.short_name) == ["run", None, "d"]
    assert values(spark, ["f.py::Class.run", "plain"], T.display_name) == ["Class.run", "plain"]


def test_patterns(spark):
    assert values(spark, ["call GET /v1/users. then POST /v1/users, GET /v1/users"], T.api_endpoints) == [["GET /v1/users", "POST /v1/users"]]
    assert values(spark, ["AB-1 and X2-33, AB-1, ab-4"], T.ticket_keys) == [["AB-1", "X2-33"]]
    assert values(spark, ["use max_size and maxSize, plain words abc x1y2"], T.identifiers) == [["max_size", "maxSize", "plain", "words", "x1y2"]]
    assert values(spark, ["**Bold Term** and **bold term** and **x**"], T.bold_terms) == [["Bold Term"]]
    assert values(spark, ["a ```x``` b `c` d"], T.without_code) == ["a \n b   d"]
    assert values(spark, ["|a|b|\n|---|---|\n|1|2|", "a | b"], T.has_table) == [True, False]
    assert values(spark, ["lead\n# H\nbody", "# H"], T.lead_paragraph) == ["lead", ""]
    assert values(spark, ["Hello  World!", " 결제 API "], T.slug) == ["hello-world", "결제-api"]
    assert values(spark, ["https://x/y/repo.git", "https://x/y/repo/"], T.repo_label) == ["repo", "repo"]
    assert values(spark, ["src/A.PY", "x.unknown"], T.language_of) == ["python", ""]
    assert values(spark, ["Yes.", "no, since", "예", "아니요", "maybe", "<think>yes</think>\nfalse"], T.yes_no) == [True, False, True, False, None, False]
    assert values(spark, ["1.5", "", "none", None, "x"], T.number) == [1.5, None, None, None, None]
    assert values(spark, ["policy", "box", "day"], T.plural_variants) == [["policy", "policys", "policies"], ["box", "boxs", "boxes"], ["day", "days"]]


def test_seed_is_the_hash_modulo(spark):
    import hashlib

    texts = ["", "a", "결제"]
    assert values(spark, texts, lambda c: T.stable_seed(c, 42)) == [42 + int(hashlib.sha256(t.encode()).hexdigest(), 16) % 10_000_000 for t in texts]


def test_references_without_their_end_are_text():
    found = pages.extract('<h1>a&amp;&amp;&amp</h1><p>x &lt;y &ampz; &am <a href="/q?a=1&copy=2&amp;b=3">t&#39;s &#4</a></p><script>if (a && b) { "&amp" }</script>')
    assert [s["title"] for s in found["sections"]] == ["a&&&amp"] and found["plain_text"] == "# a&&&amp\n\nx <y &ampz; &am [t's &#4](/q?a=1&copy=2&b=3)"
    assert pages.html(pages.parse('<b t="&amp">&amp</b><script>a && "&amp"</script>')) == '<b t="&amp;amp">&amp;amp</b><script>a &amp;&amp; "&amp;amp"</script>'
