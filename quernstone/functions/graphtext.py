"""Column functions that name and describe entities and relations, and the vocabulary they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    description: str
    source: str


#: Types of entities and of relations, what they mean, and who finds them.
ENTITY_TYPES = (
    Entry("document", "Confluence 문서/페이지", "link_graph + body"),
    Entry("person", "사용자/담당자 (ri:user 또는 LLM 추출)", "link_graph + llm_body"),
    Entry("ticket", "Jira 이슈 (PROJ-123 등)", "link_graph + body"),
    Entry("attachment", "Confluence 첨부 파일", "link_graph"),
    Entry("api", "HTTP/RPC 엔드포인트 (예: POST /v1/payments)", "body + llm_body"),
    Entry("concept", "추상 개념/표준/용어/정책/규칙 (예: OAuth2, 보안 정책)", "body + llm_body"),
    Entry("system", "독립적으로 배포/운영되는 서비스·애플리케이션 (예: Auth Service). 시스템 내부 부품은 module 을 사용", "llm_body"),
    Entry("module", "시스템 내부 컴포넌트 또는 코드 파일/패키지 — 독립 서비스가 아닌 것 (예: Token Validator, user_service.py)", "llm_body + ast_code"),
    Entry("team", "팀/조직", "llm_body"),
    Entry("function", "함수 심볼 (git_code 추출)", "ast_code"),
    Entry("class", "클래스/구조체 심볼 (Go struct 포함, git_code 추출)", "ast_code"),
    Entry("method", "클래스/구조체에 속한 메서드 심볼 (git_code 추출)", "ast_code"),
    Entry("interface", "Go/TypeScript/Java 인터페이스 (git_code 추출)", "ast_code"),
)
RELATION_TYPES = (
    Entry("references", "문서가 다른 페이지를 참조 (Confluence link)", "link_graph"),
    Entry("has_attachment", "문서에 첨부 파일이 있음", "link_graph"),
    Entry("mentions", "문서가 개념/사람/티켓 등 엔티티를 언급 (@mention, 본문 언급 — 대상 의미는 타깃 entity_type 이 담당)", "link_graph + body"),
    Entry("documents", "A(문서)가 B(API/개념 등)를 명세/문서화", "body + llm_body"),
    Entry("depends_on", "A 가 B 에 의존하거나 B 를 사용 (런타임/빌드 의존성, 도구/라이브러리)", "llm_body"),
    Entry("implements", "A 가 B 표준/인터페이스를 구현", "llm_body"),
    Entry("calls", "A 가 B 를 호출 (동기/비동기)", "llm_body"),
    Entry("owned_by", "A 의 소유자가 B (팀/사람)", "llm_body"),
    Entry("supersedes", "A 가 B 를 대체/폐기 처리", "llm_body"),
    Entry("provides", "A 가 B 를 제공 (서비스/기능)", "llm_body"),
    Entry("contains", "A 가 B 를 구성 요소/속성/멤버로 포함 (시스템→부품, 엔티티→속성, 클래스→메서드)", "body + llm_body + ast_code"),
    Entry("imports", "모듈이 다른 모듈을 import", "ast_code"),
)
INTENTS = (
    ("의존 관계 / depends / 무엇이 필요한가", ("depends_on", "calls", "contains")),
    ("소유자 / 담당자 / 팀", ("owned_by", "mentions")),
    ("표준/구현/인터페이스", ("implements", "provides")),
    ("폐기/대체/마이그레이션", ("supersedes",)),
    ("API / 엔드포인트", ("documents", "calls", "provides")),
    ("관련 이슈 / 티켓", ("mentions",)),
    ("문서 간 참조 / 관련 문서", ("references", "documents", "mentions")),
)
#: Aliases of types; the last relation changes direction.
ENTITY_ALIASES = {"struct": "class", "policy": "concept"}
RELATION_ALIASES = {"has_part": "contains", "has_attribute": "contains", "uses": "depends_on", "mentions_user": "mentions", "mentions_ticket": "mentions", "documented_in": "documents"}
#: For each kind of link the type of what it points at, its relation and its description.
LINKS = {
    "page": ("document", "references", ""),
    "user": ("person", "mentions_user", "Confluence user"),
    "jira": ("ticket", "mentions_ticket", "Jira issue"),
    "attachment": ("attachment", "has_attachment", "Attached file"),
}
#: Fixed value: a relation without a name.
RELATED = "관련"


def found_by(entries: tuple[Entry, ...], source: str) -> tuple[Entry, ...]:
    return tuple(e for e in entries if source in e.source)


def known_names(entries: tuple[Entry, ...], aliases: dict[str, str]) -> set[str]:
    return {e.name for e in entries} | set(aliases)


def bullets(names: list[str], entries: tuple[Entry, ...]) -> str:
    """A line for each name, with what it means if that is known."""
    meaning = {e.name: e.description for e in entries}
    return "\n".join(f"- **{n}**: {meaning[n]}" if meaning.get(n) else f"- {n}" for n in names)


def intent_lines() -> str:
    return "\n".join(f"- {intent} → {', '.join(names)}" for intent, names in INTENTS)


def symbol_name(path: Column, parent: Column, name: Column) -> Column:
    """file::Parent.name, or file::name without a parent."""
    return F.concat(path, F.lit("::"), F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."))).otherwise(""), name)


def link_kept(kind: Column) -> Column:
    return kind.isin(*LINKS)


def link_target(kind: Column, title: Column, target_id: Column) -> Column:
    """The name of what a link points at: a page's title, or page and its id; else the id; empty if neither is known."""
    known = lambda c: F.when(c != "", c)
    page = F.coalesce(known(title), F.concat(F.lit("page:"), known(target_id)), F.lit(""))
    return F.when(kind == "page", page).otherwise(F.coalesce(target_id, F.lit("")))


def link_description(kind: Column, space: Column) -> Column:
    out = F.lit("")
    for k, (_, _, text) in LINKS.items():
        out = F.when(kind == k, text).otherwise(out)
    return F.when((kind == "page") & (F.coalesce(space, F.lit("")) != ""), F.concat(F.lit("Confluence page in space "), space)).otherwise(out)


def link_label(section: Column) -> Column:
    return F.array_join(F.coalesce(section, F.array().cast("array<string>")), " / ")


def entity_key(name: Column, kind: Column) -> Column:
    return F.struct(F.lower(F.trim(name)).alias("name"), kind.alias("type"))


def relation_key(source: Column, target: Column, kind: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.struct(low(source).alias("source"), low(target).alias("target"), F.trim(F.coalesce(kind, F.lit(""))).alias("type"))


def edge_line(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(source, F.lit("?")), F.lit(" --["), F.coalesce(kind, F.lit(RELATED)), F.lit("]--> "), F.coalesce(target, F.lit("?")))


def edge_lines(edges: Column) -> Column:
    """A line an edge, structs (source, relation, target), by these; a remark if there is none."""
    lines = F.transform(F.array_sort(edges), lambda e: edge_line(e["source"], e["relation"], e["target"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(관계 없음)")


def subgraph_text(name: Column, kind: Column, description: Column, edges: Column, most: int = 8000) -> Column:
    """An entity with its description and edges, at most so many characters."""
    head = F.concat(F.lit("엔티티: "), name, F.lit(" ("), kind, F.lit(")"))
    described = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("설명: "), description))
    return F.substring(F.concat_ws("\n", head, described, F.when(F.size(edges) > 0, F.concat(F.lit("주변 관계:\n"), edge_lines(edges)))), 1, most)


def pair_text(source: Column, source_type: Column, relation: Column, target: Column, target_type: Column) -> Column:
    """Two entities of different documents and their relation."""
    named = lambda c: F.when(c != "", c)
    entity = lambda which, n, t: F.concat(F.lit(f"엔티티 {which}: "), n, F.lit(" ("), t, F.lit(")"))
    bond = F.concat(F.lit("관계: "), source, F.lit(" --["), F.coalesce(named(relation), F.lit(RELATED)), F.lit("]--> "), target)
    return F.concat_ws("\n", entity("A", source, source_type), entity("B", target, target_type), bond)


def section_text(level: Column, title: Column, body: Column) -> Column:
    """Heading and body of a section; a section without a title is its body."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), title))
    bare = F.trim(F.coalesce(body, F.lit("")))
    return F.concat_ws("\n\n", head, F.when(bare != "", bare))


def document_body(sections: Column, plain: Column) -> Column:
    """All sections, structs (level, title, body), as one text; the plain text without sections."""
    return F.when(F.size(sections) > 0, F.array_join(F.transform(sections, lambda s: section_text(s["level"], s["title"], s["body"])), "\n\n")).otherwise(plain)


def section_payload(sections: Column, plain: Column) -> Column:
    """Structs (index, text) of the sections, or of the plain text with index -1, if that is not blank."""
    own = F.transform(sections, lambda s, i: F.struct(i.alias("index"), section_text(s["level"], s["title"], s["body"]).alias("text")))
    bare = F.trim(F.coalesce(plain, F.lit("")))
    return F.when(F.size(sections) > 0, own).when(bare != "", F.array(F.struct(F.lit(-1).alias("index"), bare.alias("text")))).otherwise(F.array().cast("array<struct<index: int, text: string>>"))


def payload_text(payload: Column) -> Column:
    """The sections of a payload below marks with their indexes."""
    return F.array_join(F.transform(payload, lambda s: F.concat(F.lit("--- section_index="), s["index"].cast("string"), F.lit(" ---\n"), s["text"])), "\n\n")


def unit_header(title: Column, path: Column, part: Column, parts: Column, lead: Column) -> Column:
    """What stands above a unit's text: document, place, part and the document's lead, as far as there are any."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(
        "\n\n",
        F.when(there(title), F.concat(F.lit("# 문서: "), title)),
        F.when(F.size(path) > 0, F.concat(F.lit("## 위치: "), F.array_join(path, " > "))),
        F.when(parts > 1, F.concat(F.lit("## 부분: "), (part + 1).cast("string"), F.lit("/"), parts.cast("string"))),
        F.when(there(lead), F.concat(F.lit("## 문서 요약\n"), lead)),
    )
