"""Gold sets: leakage gates, candidate selection, stratified sampling, corpus stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import identifiers, match_name, match_names, words

#: Fixed pattern: phrases that point at a text the reader cannot see.
POINTING = (
    r"(?iU)(?:이|위|아래|다음|해당|본)\s*(?:클래스|메서드|메소드|함수|코드|모듈|타입|구조체|인터페이스|객체|스니펫|예제|예시|구현|로직|엔티티|노드|관계)|(?:위|아래)에\s*있는|"
    r"\bthis\s+(?:class|method|function|code|module|type|struct|interface|object|snippet|example|implementation|entity|node|relation|edge)\b|"
    r"\bthe\s+(?:above|below|following|preceding)\s+(?:class|method|function|code|module|snippet|example|entity|node|relation|edge)\b"
)
#: Common Hangul words, which give nothing away.
COMMON_HANGUL = (
    "사용자", "관리자", "개발자", "시스템", "데이터", "서비스", "프로젝트", "이용자", "고객사", "회사명", "팀원들", "구성원", "담당자", "참가자", "사용법", "기능을", "기능이", "기능에", "기능의",
    "정보를", "정보가", "정보의", "정보는", "방법을", "방법이", "방법의", "내용을", "내용이", "내용의", "관련된", "다음은", "이전의", "현재의", "최근의", "사용자가", "사용자는", "사용자의",
    "사용자에게", "관리자가", "관리자는", "관리자의", "프로세스", "비즈니스", "데이터베이스", "데이터셋", "데이터를", "애플리케이션", "인터페이스", "프레임워크", "라이브러리", "서비스가", "서비스는",
    "서비스의", "서비스를", "시스템이", "시스템은", "시스템의", "시스템을", "기능에서", "기능으로", "다음과같이", "예를들면", "예를들어",
)


def identifier_leak(question: Column, source: Column, min_len: int = 4) -> Column:
    """Whether an identifier of the source stands in the question as a whole word, in the same case."""
    return F.arrays_overlap(words(question), identifiers(source, min_len))


def points_at_text(question: Column) -> Column:
    return question.rlike(POINTING)


def candidates(docs: DataFrame, text: str, kind: str, kinds: list[str] | None, least: int, most: int) -> DataFrame:
    """Documents of allowed kinds with a text of a length within bounds and not blank."""
    rows = docs.where((F.trim(text) != "") & F.length(text).between(least, most))
    return rows if kinds is None else rows.where(F.col(kind).isin(kinds))


def round_robin(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows when groups take turns, each in its order; parts of a group are cut to n before they meet."""
    here = F.row_number().over(W.partitionBy(F.spark_partition_id(), by).orderBy(order))
    few = rows.withColumn("_here", here).where(F.col("_here") <= n).drop("_here")
    turn = F.row_number().over(W.partitionBy(by).orderBy(order))
    return few.withColumn("turn", turn).orderBy("turn", by).limit(n)


def frequent_words(docs: DataFrame, text: str, least: int, most: int, pattern: str = r"([A-Za-z]+)") -> DataFrame:
    """(word, n) of words that occur at least ``least`` times, the ``most`` most frequent."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def gate(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``reason``: the name of the first check that is not true, null if all are."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks))
    return rows.withColumn("reason", reason)


#: Hangul particles that may end a word.
PARTICLES = "은|는|이|가|을|를|에|에서|에게|한테|으로|로|와|과|의|도|만|까지|부터|보다|마저|조차"


def without_particle(word: Column, least: int = 2) -> Column:
    """A word without one particle at its end, unless less than ``least`` syllables are left."""
    bare = F.regexp_replace(word, f"({PARTICLES})$", "")
    return F.when(F.length(bare) >= least, bare).otherwise(word)


def all_stems(text: Column) -> Column:
    """Stems of three syllables or more of the Hangul words of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[가-힣]{3,}"), 0), lambda w: without_particle(w)), lambda s: F.length(s) >= 3)


def hangul_stems(text: Column, most: int = 1, stop: list[str] | None = None) -> Column:
    """Stems that occur at most ``most`` times and are neither common nor among ``stop``."""
    stems = F.filter(all_stems(text), lambda s: ~s.isin(*COMMON_HANGUL, *(stop or ())))
    return F.filter(F.array_distinct(stems), lambda s: F.size(F.filter(stems, lambda x: x == s)) <= most)


def hangul_leak(question: Column, source: Column, stop: list[str] | None = None) -> Column:
    """Whether a rare stem of the source is part of the question."""
    return F.exists(hangul_stems(source, 1, stop), lambda s: question.contains(s))


def _leaks(text: Column, source: Column, stop: list[str] | None) -> Column:
    return identifier_leak(text, source) | hangul_leak(text, source, stop)


def alias_leak(alias: Column, entity: Column, source: Column, stop: list[str] | None = None) -> Column:
    """Whether an alias gives the source away: a blank one does, one that is the entity's name but for spelling does not."""
    bare = F.trim(alias)
    return F.when(bare == "", True).when(match_name(bare) == match_name(entity), False).otherwise(_leaks(bare, source, stop))


def sound_aliases(aliases: Column, entity: Column, source: Column, stop: list[str] | None = None) -> Column:
    """The aliases that give nothing away; how many were dropped is the difference in size."""
    # names without their spelling come from a UDF, which must stand outside of the fold over the list
    rows = F.arrays_zip(aliases.alias("a"), match_names(aliases).alias("k"), F.array_repeat(match_name(entity), F.size(aliases)).alias("e"))
    return F.transform(F.filter(rows, lambda r: (F.trim(r["a"]) != "") & ((r["k"] == r["e"]) | ~_leaks(F.trim(r["a"]), source, stop))), lambda r: r["a"])


def sound_evidence(evidence: Column, source: Column, stop: list[str] | None = None) -> Column:
    """The evidence, empty if it gives the source away."""
    leaks = identifier_leak(evidence, source) | hangul_leak(evidence, source, stop)
    return F.when((F.trim(evidence) != "") & leaks, "").otherwise(evidence)


def frequent_stems(docs: DataFrame, text: str, least: int = 5, most: int = 500) -> DataFrame:
    """(stem, n) of Hangul stems that occur at least ``least`` times, the ``most`` most frequent."""
    stems = docs.select(F.explode(all_stems(F.col(text))).alias("stem"))
    return stems.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "stem").limit(most)


def question_fault(question: Column, source: Column, answerable: Column, unique_source: Column, generic: Column, stop: list[str] | None = None) -> Column:
    """Why a question is no good, null if it is: the first of the gates that it fails, a judge's answer that cannot be read being one."""
    return (
        F.when(answerable.isNull(), "parse_error").when(~answerable, "not_answerable").when(identifier_leak(question, source), "leakage").when(hangul_leak(question, source, stop), "korean_leakage")
        .when(points_at_text(question), "demonstrative").when(unique_source.isNull(), "parse_error").when(~unique_source, "non_unique_source").when(F.coalesce(generic, F.lit(False)), "generic")
    )


def kept(reason: Column, equivalents: Column) -> Column:
    """Whether a question stays: it passed, or only its source is not unique and others with the answer are known."""
    return reason.isNull() | ((reason == "non_unique_source") & (F.size(equivalents) > 0))


def gated_units(units: DataFrame, doc: str, order: str, least: int = 200, most: int | None = None) -> DataFrame:
    """Units for a model: long enough, first parts only, at most so many of a document."""
    rows = units.where((F.col("tokens") >= least) & ((F.col("parts") <= 1) | (F.col("part") == 0)))
    return rows if most is None else rows.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def merged_questions(rows: DataFrame, doc: str, order: list[str], text: str, most: int = 50) -> DataFrame:
    """Questions of four characters or more, the first of each of a document whatever its case, at most so many of a document."""
    asked = rows.withColumn("question", F.trim(text)).where(F.length("question") >= 4)
    first = asked.groupBy(doc, F.lower("question").alias("_q")).agg(F.min(F.struct(*order, "question")).alias("m")).select(doc, "m.*")
    return first.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def batches(rows: DataFrame, doc: str, order: str, cost: str, budget: int) -> DataFrame:
    """Adds ``batch``: sections in order, a new one where the next would not fit; what is too large alone is a batch of its own.

    A fold over each document's (order, cost) pairs.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    zero = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["b"] < 0) | (x["c"] > budget) | (a["used"] + x["c"] > budget)
        batch = F.when(fresh, a["b"] + 1).otherwise(a["b"])
        used = F.when(x["c"] > budget, F.lit(budget + 1).cast("long")).when(fresh, x["c"]).otherwise(a["used"] + x["c"])
        return F.struct(batch.alias("b"), used.alias("used"), F.concat(a["out"], F.array(batch)).alias("out"))

    folded = rows.groupBy(doc).agg(items.alias("_i")).select(doc, F.explode(F.arrays_zip(F.transform("_i", lambda x: x["o"]).alias("o"), F.aggregate("_i", zero, step)["out"].alias("b"))).alias("z"))
    return rows.join(folded.select(doc, F.col("z.o").alias(order), F.col("z.b").alias("batch")), [doc, order])


def equivalent_candidates(found: DataFrame, doc: str, similarity: str, order: list[str], source: object, most: int = 3, least: float = 0.6) -> DataFrame:
    """The best row of each document but the source's own that is similar enough, the most similar documents first."""
    rows = found.where(F.col(doc).isNotNull() & (F.col(doc) != F.lit(source)) & (F.col(similarity) >= least))
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy(F.desc(similarity), *order))).where("_n = 1").drop("_n")
    return best.orderBy(F.desc(similarity), doc).limit(most)


def graph_items(rows: DataFrame) -> DataFrame:
    """Gold items of graph questions: the documents of an entity, as one group if they are several, and what names and explains it without giving the source away."""
    docs = F.array_sort(F.array_distinct("docs"))
    none = F.array().cast("array<array<bigint>>")
    return rows.select("query", "name", docs.alias("relevant_doc_ids"), F.when(F.size(docs) > 1, F.array(docs)).otherwise(none).alias("groups"), sound_aliases(F.col("aliases"), F.col("name"), F.col("source")).alias("aliases"), sound_evidence(F.col("evidence"), F.col("source")).alias("evidence"))


def cross_document_items(rows: DataFrame) -> DataFrame:
    """Gold items of questions over two documents, each of which is a group of its own."""
    return rows.select("query", F.array_sort(F.array_distinct(F.array("src", "dst"))).alias("relevant_doc_ids"), F.array(F.array("src"), F.array("dst")).alias("groups"))
