"""Extraction units: a document's heading tree cut into pieces of a size that suits graph extraction.

A subtree that fits the target is one unit.  A larger one gives its own text as
a unit, in overlapping parts if that is too long, and its children's units after
it; own text that is too short goes to the head of the first unit below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from .chunking import _SEPARATOR, HEADING, Document, Section, Tokens, blocks, sections


@dataclass(frozen=True)
class UnitSizes:
    target: int = 1500
    most: int = 2400
    least: int = 400
    overlap: int = 200
    lead: int = 200


@dataclass
class Node:
    index: int
    section: Section
    own: str
    size: int
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    def total(self) -> int:
        return sum(n.size for n in self.walk())


@dataclass(frozen=True)
class Unit:
    sections: tuple[int, ...]
    primary: int
    path: tuple[str, ...]
    body: str
    part: int = 0
    parts: int = 1

    def below(self, node: Node) -> Unit:
        """The unit with a node's own text before its own."""
        return replace(self, sections=(node.index, *self.sections), body=f"{node.own}\n\n{self.body}")


def tree(parts: list[Section], tokens: Tokens) -> list[Node]:
    """The top sections, each with those of deeper levels that follow it below it."""
    top: list[Node] = []
    path: list[Node] = []
    for k, s in enumerate(parts):
        own = s.text(1) if s.title else s.body.strip()
        path = [n for n in path if n.section.level < s.level]
        node = Node(k, s, own, tokens.count(own))
        (path[-1].children if path else top).append(node)
        path.append(node)
    return top


def parts_of(text: str, sizes: UnitSizes, tokens: Tokens) -> list[str]:
    """A long text at the bounds of its blocks: about ``target`` tokens each, and before each the tail of the one before."""
    groups: list[list[str]] = []
    used = 0
    for content, _ in blocks(text):
        n = tokens.count(content)
        if not groups or used + n > sizes.target:
            groups.append([])
            used = 0
        groups[-1].append(content)
        used += n
    out: list[str] = []
    for group in groups:
        tail = tokens.encode(out[-1]) if out and sizes.overlap > 0 else tokens.encode("")
        before = tokens.decode(tail[max(0, len(tail) - sizes.overlap) :])
        out.append("\n\n".join([*([before] if before else []), *group]))
    return out


def split(node: Node, sizes: UnitSizes, tokens: Tokens) -> list[Unit]:
    own = parts_of(node.own, sizes, tokens)
    return [Unit((node.index,), node.index, node.section.path, x, k, len(own)) for k, x in enumerate(own)]


def collected(node: Node, sizes: UnitSizes, tokens: Tokens) -> list[Unit]:
    """The units of a subtree in order."""
    if node.total() <= sizes.target:
        every = list(node.walk())
        return [Unit(tuple(n.index for n in every), node.index, node.section.path, "\n\n".join(n.own for n in every if n.own))]
    below = [u for child in node.children for u in collected(child, sizes, tokens)]
    if node.size > sizes.most:
        return split(node, sizes, tokens) + below
    if 0 < node.size < sizes.least and below:
        return [below[0].below(node), *below[1:]]
    return ([Unit((node.index,), node.index, node.section.path, node.own)] if node.size else []) + below


def units(doc: Document, sizes: UnitSizes | None = None, tokens: Tokens | None = None) -> list[Unit]:
    """The units of a document; a plain text is one section without a path."""
    sizes, tokens = sizes or UnitSizes(), tokens or Tokens()
    if doc.sections:
        return [u for node in tree(doc.sections, tokens) for u in collected(node, sizes, tokens)]
    body = doc.plain.strip()
    if not body:
        return []
    node = Node(0, Section(0, "", (), body), body, tokens.count(body))
    return [Unit((0,), 0, (), body)] if node.size <= sizes.most else split(node, sizes, tokens)


def lead_of(plain: str, sizes: UnitSizes, tokens: Tokens) -> str:
    """What stands before the first heading, cut to its first tokens with dots after them."""
    m = HEADING.search(plain)
    own = tokens.encode((plain[: m.start()] if m else plain).strip())
    return tokens.decode(own) if len(own) <= sizes.lead else tokens.decode(own[: sizes.lead]).rstrip() + "..."


def header(title: str, unit: Unit, lead: str) -> str:
    """What stands above a unit's text: document, place, part and the document's lead."""
    lines = [
        f"# 문서: {title}" if title else "",
        f"## 위치: {' > '.join(unit.path)}" if unit.path else "",
        f"## 부분: {unit.part + 1}/{unit.parts}" if unit.parts > 1 else "",
        f"## 문서 요약\n{lead}" if lead else "",
    ]
    return "\n\n".join(x for x in lines if x)


UNITS = "unit_id string, ordinal int, section_path string, section_ids array<string>, primary_section_id string, breadcrumb string, body string, content string, token_count int, has_table boolean, has_code_block boolean, split_part int, split_total int"
_COLUMNS = [c.split(" ")[0] for c in UNITS.replace("array<string>", "array").split(", ")]


def unit_rows(doc_id: object, title: str, doc: Document, sizes: UnitSizes | None = None, tokens: Tokens | None = None) -> list[tuple]:
    sizes, tokens = sizes or UnitSizes(), tokens or Tokens()
    lead = lead_of(doc.plain, sizes, tokens)
    rows = []
    for k, u in enumerate(units(doc, sizes, tokens)):
        above = header(title, u, lead)
        content = f"{above}\n\n---\n\n{u.body}" if above else u.body
        table = any(_SEPARATOR.match(x) for x in u.body.split("\n"))
        rows.append((doc_id, f"{doc_id}:{k:04d}", k, " > ".join(u.path), [f"{doc_id}:{i}" for i in u.sections], f"{doc_id}:{u.primary}", above, u.body, content, tokens.count(content), table, "```" in u.body, u.part, u.parts))
    return rows


def extraction_units(docs: DataFrame, id_col: str, title_col: str, text_col: str, sizes: UnitSizes | None = None) -> DataFrame:
    """One row a unit of Markdown documents, with the columns of ``UNITS``; blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, title, text in zip(batch[id_col], batch[title_col], batch[text_col], strict=True):
                text = text or ""
                found = [s for s in sections(text) if s.title]
                rows += unit_rows(doc, title or "", Document(text, found), sizes)
            yield pd.DataFrame(rows, columns=[id_col, *_COLUMNS])

    source = docs.select(id_col, title_col, text_col)
    return source.mapInPandas(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, {UNITS}")
