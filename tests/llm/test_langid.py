import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import langid

WORDS = {"en": "the and of that with from this house water".split(), "de": "der und nicht eine straße über haus wasser".split(), "fr": "le et pas une où été maison château eau".split()}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(WORDS))
        declared = lang if rng.random() < 0.9 else rng.choice(sorted(WORDS))
        rows.append((k, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))), declared, f"{lang}.site.{lang}" if k % 3 else "hub", lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")


def test_text_model_against_plain_counts():
    texts = ["Ab c.", "", "ééa 12", "abc " * 5]
    table = np.log(np.arange(1, 2 * langid.BUCKETS + 1, dtype=float).reshape(-1, 2))
    n, total = langid.TextModel(("x", "und"), table).score(texts)
    for k, text in enumerate(texts):
        raw = b"  " + bytes(b if langid._LETTER[b] else 32 for b in text.lower().encode()) + b"  "
        own = [raw[i : i + 3] for i in range(len(raw) - 2) if langid._LETTER[raw[i + 1]]]
        buckets = [(int.from_bytes(g, "big") * 0x9E3779B1 % (1 << 32)) >> 16 for g in own]
        assert n[k] == len(own) and np.allclose(total[k], table[buckets].sum(axis=0) if own else 0)


def test_held_out_accuracy_and_wrong_tags(spark):
    rows = corpus()
    model = langid.fit(frame(spark, rows), F.col("text"), F.col("lang"))
    assert model.labels == ("de", "en", "fr", "und")
    got = langid.identify(frame(spark, corpus(seed=77)), model, "text", F.col("lang"), F.col("source")).collect()
    assert sum(r.language == r.truth for r in got) / len(got) > 0.97 and all(r.kept for r in got)
    wrong = [r for r in got if r.lang != r.truth and len(r.text) > 60]
    assert wrong and sum(r.language == r.truth for r in wrong) / len(wrong) > 0.9


def test_host_prior_decides_without_text_evidence(spark):
    rows = corpus()
    model = langid.fit(frame(spark, rows), F.col("text"), F.col("lang"))
    asked = rows + [(900, "zq", None, "fr.site.fr", ""), (901, "zq", None, "de.site.de", "")]
    got = {r.doc_id: r for r in langid.identify(frame(spark, asked), model, "text", F.col("lang"), F.col("source")).collect()}
    assert got[901].language != "fr" and got[900].language != "de"


def test_unknown_language_is_rejected(spark):
    model = langid.fit(frame(spark, corpus()), F.col("text"), F.col("lang"), smoothing=0.001)
    rows = [(1, "qxz jkw vvq xqz zzk " * 30, "en", "hub", ""), (2, "the and of that with " * 3, "en", "hub", "")]
    got = {r.doc_id: (r.language, r.kept) for r in langid.identify(frame(spark, rows), model, "text", F.col("lang"), F.col("source")).collect()}
    assert got == {1: ("und", False), 2: ("en", True)}


def test_edges(spark):
    rows = corpus() + [(1000, None, "en", "hub", ""), (1001, "", None, None, ""), (1002, "123 !!", "xx-YY", "a.b", ""), (None, "the and of that with", "EN-us", "hub", ""), (5, "der und nicht eine", "de", "hub", "")]
    df = frame(spark, rows).withColumn("kept", F.lit("old"))
    got = langid.identify_documents(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[k].language, by[k].kept, by[k].certainty) for k in (1000, 1001, 1002)] == [("und", False, None)] * 3
    assert by[None].language == "en" and by[None].kept
    assert langid.identify_documents(frame(spark, [])).collect() == []


def test_pages(spark):
    html = '<html lang="%s"><head><style>p{}</style></head><body><script>der()</script><p>%s</p></body></html>'
    rows = [(k, f"https://u@{h}:80/x", html % (d, t)) for k, (_, t, d, h, _) in enumerate(corpus(60, 5))]
    pages = langid.page_evidence(spark.createDataFrame([*rows, (99, None, None)], "page_id long, url string, html string"))
    first = pages.where("page_id = 1").first()
    assert first.host == corpus(60, 5)[1][3] and "der()" not in first.visible and first.declared == corpus(60, 5)[1][2]
    model = langid.fit(frame(spark, corpus()), F.col("text"), F.col("lang"))
    got = langid.identify(pages, model, "visible", F.col("declared"), F.col("host"), ["page_id"]).collect()
    truth = {k: r[4] for k, r in enumerate(corpus(60, 5))}
    assert len(got) == 61 and sum(r.language == truth.get(r.page_id) for r in got) >= 58


def test_rare_and_many_languages_are_learnt(spark):
    many = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(70)]
    rows = spark.range(60_000).select(F.concat(F.lit("the house "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    georgian = ["\u10d3\u10d0 \u10d0\u10e0\u10d8\u10e1 \u10e0\u10dd\u10db \u10e1\u10d0\u10ee\u10da\u10d8 \u10ec\u10e7\u10d0\u10da\u10d8 " * 5]
    few = [*((x, f"{x} {x}{x} words") for x in many), *(("ka", t) for t in georgian)]
    docs = rows.unionByName(spark.createDataFrame(few, "lang string, text string"))
    model = langid.fit(docs, F.col("text"), F.col("lang"))
    assert model.labels == (*sorted({"en", "ka", *many}), "und")
    got = langid.identify(spark.createDataFrame([(1, georgian[0], "ka"), (2, "the house the house", "en")], "id long, text string, lang string"), model, declared=F.col("lang")).collect()
    assert {(r.id, r.language, r.kept) for r in got} == {(1, "ka", True), (2, "en", True)}


def test_fit_reads_so_many_texts_of_each_language(spark):
    docs = spark.range(4000).select(F.concat(F.lit("abc "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 20, "de").otherwise("en").alias("lang"))
    docs = docs.union(docs.where("lang = 'de'"))
    table = np.exp(langid.fit(docs, F.col("text"), F.col("lang"), 200).table)
    seen = [round((c.max() / c.min() - 1) / 2) for c in table.T[:2]]
    assert seen[0] == 20 and 120 < seen[1] < 300


def test_score_in_slices(monkeypatch):
    table = np.log(np.arange(1, 3 * langid.BUCKETS + 1, dtype=float).reshape(-1, 3))
    model, texts = langid.TextModel(("x", "y", "und"), table), ["", "some words", "", "x " * 40, "more", ""]
    n, whole = model.score(texts)
    monkeypatch.setattr(langid, "CELLS", 21)
    assert np.allclose(model.score(texts)[1], whole) and n.tolist() == model.score(texts)[0].tolist()


def test_query_weighs_suffix_and_domain_of_pages(spark, tmp_path):
    from quernstone.llm.queries import op9_language_id

    html = '<html lang="%s"><body><p>%s</p></body></html>'
    rows = corpus(120, 9)
    pages = [(k, f"http://{t}{k}.shop{k % 5}.{t}/x", html % (d, x)) for k, (_, x, d, _, t) in enumerate(rows)]
    pages += [(900, "http://new.unseen.fr/", "<p>zq</p>"), (901, "http://new.unseen.de/", "<p>zq</p>"), (902, "http://new.unseen.de/", '<html lang="ka"><p>\u10d3\u10d0 \u10d0\u10e0\u10d8\u10e1 \u10e0\u10dd\u10db</p></html>')]
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op9_language_id(spark, str(tmp_path)).collect()
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert sorted(r.doc_id for r in got if r.page_id is None) == list(range(240)) and len(got) == 240 + len(pages)
    assert sum(by[k].language == r[4] for k, r in enumerate(rows)) > 115
    assert (by[900].language, by[901].language, by[902].language) == ("fr", "de", "ka")


def plain_posteriors(rows, model):
    """(id, language, certainty) of (id, text, tag, host) rows, one after the other, by the rule."""
    labels, total = model.labels, 0.0
    n, score = model.score([t or "" for _, t, _, _ in rows])
    score = score * np.minimum(1, langid.EFFECTIVE_GRAMS / np.maximum(n, 1))[:, None]
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    known = n > 0
    zero = np.zeros(len(labels))
    mass = p[known].sum(axis=0)
    total, prior = mass.sum(), (mass + 1) / (mass + 1).sum()
    keys = []
    for _, _, tag, host in rows:
        tag = None if tag is None else tag.lower().split("-")[0]
        tag = tag if tag is None or tag in labels[:-1] else "other"
        parts = host.lower().split(".") if host else []
        keys.append({"tag": tag, "host": host.lower() if host else None, "domain": ".".join(parts[-2:]) or None, "suffix": parts[-1] if len(parts) > 1 else None})
    def group(k, kind):
        """(sum of posteriors, number) of the other known rows of the same kind."""
        own = [i for i in range(len(rows)) if known[i] and i != k and keys[i][kind] == keys[k][kind]]
        return p[own].sum(axis=0) if own else zero, len(own)

    tags = {keys[i]["tag"] for i in range(len(rows)) if known[i] and keys[i]["tag"] is not None}
    tagged = p[[i for i in range(len(rows)) if known[i] and keys[i]["tag"] is not None]].sum(axis=0)
    out = []
    for k, row in enumerate(rows):
        if not known[k]:
            out.append((row[0], "und", None))
            continue
        given = np.log(prior)
        if keys[k]["host"]:
            (d, nd), (h, nh) = group(k, "domain"), group(k, "host")
            domain = (d + langid.DOMAIN_STRENGTH * prior) / (nd + langid.DOMAIN_STRENGTH)
            given = np.log((h + langid.HOST_STRENGTH * domain) / (nh + langid.HOST_STRENGTH))
        if keys[k]["suffix"]:
            s, ns = group(k, "suffix")
            if ns:
                given = given + np.log((s + langid.SUFFIX_STRENGTH * ns / total) / (mass + langid.SUFFIX_STRENGTH))
        if keys[k]["tag"] is not None:
            t, _ = group(k, "tag")
            given = given + np.log((t + 1) / (tagged + len(tags) + 1))
        own = score[k] + given
        own = np.exp(own - own.max())
        out.append((row[0], labels[int(own.argmax())], own.max() / own.sum()))
    return out


def test_posteriors_against_plain(spark):
    rows = [(k, t, d, h) for k, t, d, h, _ in corpus(90, 4)]
    rng = random.Random(6)
    hosts = ["a.shop.fr", "b.shop.fr", "c.news.de", "hub", None, "x.co", "A.Shop.fr", "only.one.zz"]
    rows = [(k, t[: rng.randint(2, 30)], rng.choice([d, None, "fr-CA", "xx"]), rng.choice(hosts)) for k, t, d, _ in rows]
    rows += [(900, None, "en", "hub"), (901, "12", "de", "a.shop.fr"), (902, "the", None, "hub"), (902, "the", None, "hub")]
    model = langid.fit(frame(spark, corpus()), F.col("text"), F.col("lang"))
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string")
    got = sorted((r.id, r.language, r.certainty) for r in langid.identify(df, model, "text", F.col("lang"), F.col("host")).collect() if r.id < 900)
    want = sorted(plain_posteriors(rows, model))
    assert [(a[0], a[1]) for a in got] == [(a[0], a[1]) for a in want if a[0] < 900]
    assert np.allclose([a[2] for a in got], [a[2] for a in want if a[0] < 900])
    alone = {r.id: (r.language, r.certainty) for r in langid.identify(df, model, "text", F.col("lang"), F.col("host")).collect() if r.id >= 900}
    assert alone[900] == alone[901] == ("und", None) and alone[902][0] == "en"


def test_ties_name_the_first_language(spark):
    table = np.log(np.full((langid.BUCKETS, 3), 1 / langid.BUCKETS))
    got = langid.identify(spark.createDataFrame([(1, "abc")], "id long, text string"), langid.TextModel(("aa", "bb", "und"), table)).collect()
    assert [(r.language, round(r.certainty, 6), r.kept) for r in got] == [("aa", 0.333333, False)]
