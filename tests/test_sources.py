import pytest
import math

from pyspark.sql import functions as F

from quernstone.operators import assembly, matching, pages
from quernstone.sources import paged, tables
from quernstone.streaming import incremental


def test_paging_rule():
    def server(n, cap, total):
        return lambda at, size: (list(range(at, min(n, at + min(size, cap)))), n if total else None)

    assert list(paged.pages(server(25, 10, True), 20, 100)) == list(range(25))
    assert list(paged.pages(server(25, 100, False), 10, 100)) == list(range(25))
    assert list(paged.pages(server(25, 100, True), 10, 12, partial=True)) == list(range(12))
    assert list(paged.pages(server(25, 100, False), 10, 25)) == list(range(25))
    for total in (True, False):
        with pytest.raises(paged.CutOff):
            list(paged.pages(server(25, 100, total), 10, 12))
    assert list(paged.pages(server(0, 10, True), 10, 12)) == []


def test_paged_source(spark):
    rows = paged.listing(spark, "fixture_listing", lambda at, size: ([{"id": k} for k in range(at, min(37, at + size))], 37), size=5, parts=3)
    assert sorted(r.id for r in rows.select(F.get_json_object("row", "$.id").cast("int").alias("id")).collect()) == list(range(37))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.MD").write_text("# é")
    (tmp_path / "a" / "y.bin").write_text("no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "node_modules" / "z.txt").write_text("no")
    got = tables.text_files(spark, str(tmp_path)).collect()
    assert [(r.source_id, r.content) for r in got] == [("x.MD", "# é")]
    (tmp_path / "r.csv").write_text("id,recall,mrr\nq1,0.5,\nq2,None,1\n")
    assert sorted(tuple(r) for r in tables.result_sheet(spark, str(tmp_path / "r.csv")).collect()) == [("q1", "recall", 0.5), ("q2", "mrr", 1.0)]
    assert tables.empty(spark, "documents").columns[0] == "id"


def test_stream_of_snapshots(spark, tmp_path):
    src, state, cp = (str(tmp_path / x) for x in ("src", "state", "cp"))
    schema = "id string, content string, modified_at int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)])
    incremental.ingest(spark, src, schema, state, cp)
    write([("a", "2", 3), ("b", "9", 3), ("c", "1", 3)])
    incremental.ingest(spark, src, schema, state, cp)
    got = sorted((r.batch, r.id, r.change_type) for r in incremental.stored(spark, state).collect())
    assert got == [(0, "a", "created"), (0, "b", "created"), (1, "b", "changed"), (1, "c", "created")]


def test_tiers(spark):
    e = spark.createDataFrame([(1, "Auth", "class", ["login"], [1.0, 0.0]), (1, "Pay Hub", "class", None, [0.0, 1.0]), (1, "Bill", "class", None, [0.6, 0.8]), (1, "Gone", "class", None, [-1.0, 0.0])], "query_id int, gold string, type string, aliases array<string>, vector array<double>")
    r = spark.createDataFrame([(1, "Login", "class", [0.5, 0.5], 1), (1, "pay-hub", "class", [0.0, 1.0], 2), (1, "other", "team", [0.9, 0.1], 3)], "query_id int, name string, type string, vector array<double>, rank int")
    got = {x.gold: (x.tier, x.name) for x in matching.tiered(e, r).collect()}
    assert got == {"Auth": ("alias", "Login"), "Pay Hub": ("normalize", "pay-hub"), "Bill": ("embedding", "Login"), "Gone": ("none", None)}
    nodes = spark.createDataFrame([(1, "t", "auth service"), (2, "t", "Auth-Service"), (3, "t", "authority"), (4, "u", "auth service")], "id int, entity_type string, entity_name string")
    assert sorted(tuple(x) for x in matching.alias_pairs(nodes).collect()) == [(1, 2, "positive"), (1, 3, "alias"), (1, 4, "type_drift"), (2, 3, "alias"), (2, 4, "type_drift")]


def test_assembled_context(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    vectors = spark.createDataFrame([(k, k // 2, at(0.1 * k), f"text {k}") for k in range(20)] + [(99, 50, at(3.0), "by graph")], "id int, document_id int, embedding array<double>, content string")
    docs = spark.createDataFrame([(k, f"T{k}") for k in (0, 1, 50)], "id int, title string")
    edges = spark.createDataFrame([(7, 8)], "src int, dst int")
    nodes = spark.createDataFrame([(7, at(0.0)), (8, at(2.0))], "id int, embedding array<double>")
    links = spark.createDataFrame([(7, 0), (8, 50)], "node int, document_id int")
    rows = assembly.assemble(vectors, docs, edges, nodes, links, at(0.0), k=3)
    assert [(r.ordinal, r.document_id, r.origin) for r in rows.orderBy("ordinal").collect()] == [(1, 0, "vector"), (2, 1, "vector"), (3, 2, "vector"), (4, 50, "graph")]
    out = assembly.rendered(rows).first()
    assert out.context.startswith("## T0\n\ntext 0\n\n---\n\n## T1") and out.sources == [0, 1, 2, 50]


def test_alias_pairs_against_all_with_all(spark):
    names = ["api", "Payment API", "payment", "paym", "pay", "auth service", "Auth-Service", "authority", "auto", "a", "ab", "aba", "---"]
    nodes = [(k, "tu"[k % 3 == 0], n) for k, n in enumerate(names * 2)]
    norm = {k: "".join(c for c in n.lower() if c.isalnum()) for k, _, n in nodes}
    want = set()
    for i, t, _ in nodes:
        for j, u, _ in nodes:
            a, b = norm[i], norm[j]
            if i < j and a and b:
                if a == b:
                    want.add((i, j, "positive" if t == u else "type_drift"))
                elif t == u and (a in b or b in a or (a[:4] == b[:4] and min(len(a), len(b)) >= 4)):
                    want.add((i, j, "alias"))
    got = [tuple(r) for r in matching.alias_pairs(spark.createDataFrame(nodes, "id int, entity_type string, entity_name string")).collect()]
    assert len(got) == len(want) and set(got) == want and {k for *_, k in want} == {"positive", "alias", "type_drift"}


def test_alias_pairs_of_one_group_are_made_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 3)
    nodes = [(k, "t", "hot bolt") for k in range(20)] + [(k, "t", f"hot b{k}") for k in range(20, 30)] + [(30, "u", "Hot-Bolt"), (31, None, "hotbolt"), (32, None, "hotbowl"), (33, "t", "olt"), (34, "t", "OLT"), (34, "t", "hot bolt")]
    df = spark.createDataFrame(nodes, "id int, entity_type string, entity_name string")
    norm = ["".join(c for c in n.lower() if c.isalnum()) for _, _, n in nodes]
    want = []
    for (i, t, _), a in zip(nodes, norm, strict=True):
        for (j, u, _), b in zip(nodes, norm, strict=True):
            if i < j and a == b:
                want.append((i, j, "type_drift" if t and u and t != u else "positive"))
            elif i < j and t and t == u and (a in b or b in a or a[:4] == b[:4] and min(len(a), len(b)) >= 4):
                want.append((i, j, "alias"))
    got = matching.alias_pairs(df).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert len({r.task for r in got if r.kind == "positive" and r.right < 20}) > 3 and len({r.task for r in got if r.right == 33}) > 3


def test_pages_are_held_in_slices(spark):
    def make(text):
        with open("/proc/self/statm") as f:
            return {"markdown": f.read().split()[1], "html": text * 30}

    df = spark.range(2000).coalesce(1).select("id", F.repeat(F.lit("x"), 10_000).alias("raw"))
    used = [int(r.markdown) for r in pages._mapped(df, "id", "raw", "html string, markdown string", make).select("markdown").collect()]
    assert len(used) == 2000 and (max(used) - min(used)) * 4096 < 200 << 20
