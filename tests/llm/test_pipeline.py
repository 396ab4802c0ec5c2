import random

import corpus_pipeline as pipeline
import test_lines
import test_minhash
from pyspark.sql import functions as F

WORDS = {"en": "the and of that with from this house water light people never".split(), "fr": "le et pas une où été maison château eau lumière jamais gens".split()}


def documents():
    rng = random.Random(6)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(n))
    docs = [[k, text("en" if k % 3 else "fr", 120), "en" if k % 3 else "fr"] for k in range(40)]
    passage = text("en", 60)
    docs[5][1] = docs[5][1] + "\n" + passage
    docs[9][1] = passage + "\n" + docs[9][1]
    docs.append([50, docs[5][1], "en"])  # an exact copy
    near = docs[7][1].split()
    near[60] = "changed"
    docs.append([51, " ".join(near), "en"])
    docs += [[52, "", "en"], [53, None, None], [54, "12345 !!!", "en"]]
    return [(i, t, lang, f"src{i % 4}", len(t) if t is not None else None) for i, t, lang in docs]


def test_stages(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40))
    assert set(kept["language_id"]) == clean | {50, 51}
    assert set(kept["line_dedup"]) == clean | {51}
    by = kept["line_dedup"]
    assert by[9].text == rows[9][1].split("\n")[1] and by[9].n_chars == len(by[9].text) and by[5].text == rows[5][1]
    assert all(by[k].text == rows[k][1] and by[k].n_chars == rows[k][4] for k in clean - {9})
    assert set(kept["near_dedup"]) == clean
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == clean and max(r.offset + r.length for r in packed) <= 2048


def test_run(spark, tmp_path):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(range(40))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, class_id string, n_lines string, language string, _n int"


def test_stages_against_plain_versions(spark):
    """Lines and near-duplicates by brute force over what each stage was given, with clashing columns, repeated rows and null ids."""
    rng = random.Random(11)
    base = [r for r in documents() if r[0] < 30]
    rows = [(*r, "k", "c", "n", "l", k) for k, r in enumerate(base)]
    passage = " ".join(rng.choices(WORDS["en"], k=70))
    rows += [(60, passage + "\nfirst " + base[1][1], "en", "a.b.com", 1, None, None, None, None, 1), (61, "second " + base[2][1] + "\n" + passage, "en", "a.b.com", 1, None, None, None, None, 2)]
    rows += [rows[3], (None, base[4][1] + " indeed", "en", None, None, "k", "c", "n", "l", 3), (62, passage, "en", None, None, "k", "c", "n", "l", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)

    kept = pipeline.language_id(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.collect()))
    lined = pipeline.line_dedup(spark, docs, "").collect()
    plain = [(i, t) for i, t, n, gone in test_lines.brute([(r[0], r[1]) for r in rows], 50) if not gone or gone < n]
    assert sorted(((r.doc_id, r.text) for r in lined), key=str) == sorted(plain, key=str)
    assert all((r.kept, r.class_id, r.n_lines, r.language) in {("k", "c", "n", "l"), (None,) * 4} for r in lined)
    near = pipeline.near_dedup(spark, spark.createDataFrame(lined, SCHEMA), "").collect()
    classes = test_minhash.brute([(r.doc_id, r.text) for r in lined], 0.8)
    assert len(near) == len({c for _, c in classes}) and {r.doc_id for r in near} == {c for _, c in classes}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.collect() == []
    assert pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_stages_drop_no_clean_rows(spark):
    docs = spark.createDataFrame([(k, f"{k} " + " ".join(WORDS["en"][j % 11] + str((k * 31 + j * 7) % 97) for j in range(80)), "en", "s", 1) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").agg(F.count("*")).first()[0] == 60
