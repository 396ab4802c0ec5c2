from pyspark.sql import functions as F

from quernstone.operators import extraction, goldset, units
from quernstone.operators.chunking import Document, Tokens, packed, sections

SIZES = units.UnitSizes(target=100, most=150, least=40, overlap=10, lead=20)


def made(text, sizes=SIZES):
    return units.units(Document(text, [s for s in sections(text) if s.title]), sizes)


def test_small_tree_is_one_unit():
    got = made("lead\n# A\none\n## B\ntwo\n## C\nthree")
    assert [(u.path, u.sections, u.primary, u.body, u.parts) for u in got] == [(("A",), (0, 1, 2), 0, "# A\n\none\n\n## B\n\ntwo\n\n## C\n\nthree", 1)]


def test_large_tree_splits_and_short_own_text_moves_down():
    got = made("# A\nshort\n## B\n" + "b" * 80 + "\n## C\n" + "c" * 60)
    assert [(u.path, u.sections, u.primary) for u in got] == [(("A", "B"), (0, 1), 1), (("A", "C"), (2,), 2)] and got[0].body.startswith("# A\n\nshort\n\n## B")
    long = made("# A\n" + "x" * 60 + "\n## B\n" + ("y" * 70 + "\n\n") * 5)
    assert long[0].sections == (0,) and [u.part for u in long[1:]] == list(range(long[1].parts)) and long[1].parts > 1
    assert all(b.body.startswith(a.body[-10:] + "\n\n") for a, b in zip(long[1:], long[2:], strict=False))
    assert made("") == [] and [u.body for u in made("plain text")] == ["plain text"]


def test_units_frame(spark):
    docs = spark.createDataFrame([(42, "T", "intro words here and more\n# A\none\n## B\ntwo"), (43, None, None)], "id int, title string, text string")
    got = units.extraction_units(docs, "id", "title", "text", SIZES).collect()
    assert [(r.unit_id, r.section_ids) for r in got] == [("42:0000", ["42:0", "42:1"])]
    assert got[0].content.startswith("# 문서: T\n\n## 위치: A\n\n## 문서 요약\nintro words here and...\n\n---\n\n# A")


def test_chunks_with_a_vocabulary():
    words = Tokens(lambda t: t.split(" ") if t else [], " ".join)
    got = packed([("a b c", False), ("d e", False), ("f g h i j k", False)], 4, 1, words)
    assert [(c.content, c.tokens) for c in got] == [("a b c", 3), ("c d e", 3), ("f g h i", 4), ("i j k", 3), ("e", 1)]


def test_relations(spark):
    docs = spark.createDataFrame([(1, "Pay", "see GET /v1/pay, AB-1 and ab AB-1, **Key Term**")], "id int, title string, text string")
    got = {(r.target, r.entity_type, r.relation_type) for r in extraction.body_relations(docs, "id", "title", "text", bold=True).collect()}
    assert got == {("GET /v1/pay", "api", "documents"), ("AB-1", "ticket", "mentions_ticket"), ("Key Term", "concept", "mentions")}
    links = spark.createDataFrame([(1, "P", 0, "page", "Home", None), (1, "P", 1, "page", "HOME", None), (1, "P", 2, "page", " ", "77"), (1, "P", 3, "url", "x", None), (1, "P", 4, "user", None, "kim")], "id int, source string, ordinal int, kind string, target string, target_id string")
    assert {(r.target, r.relation_type) for r in extraction.link_relations(links, "id").collect()} == {("Home", "references"), ("page:77", "references"), ("kim", "mentions_user")}



def test_hangul(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    text = F.lit("결제한도서비스는 중요하다 결제팀이 관리하고 결제팀은 바쁘다")
    assert "결제한도서비스" in row(goldset.hangul_stems(text)) and "결제팀" not in row(goldset.hangul_stems(text))
    assert row(goldset.hangul_leak(F.lit("결제한도서비스란?"), text)) and not row(goldset.hangul_leak(F.lit("무엇인가?"), text))
