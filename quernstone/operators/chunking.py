"""Chunks of documents: fixed windows, heading sections, greedy packing with overlap.

A token is a character, unless a vocabulary is given: ``Tokens`` says how a text
becomes a sequence of them and back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR

#: Fixed patterns: heading lines, and the row below a table's header.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_SEPARATOR = re.compile(SEPARATOR)


@dataclass(frozen=True)
class Tokens:
    encode: Callable[[str], Sequence] = str
    decode: Callable[[Sequence], str] = str

    def count(self, text: str) -> int:
        return len(self.encode(text))


@dataclass(frozen=True)
class Section:
    """A part of a document below a heading; ``body`` is what the heading stands above."""

    level: int
    title: str
    path: tuple[str, ...]
    body: str
    anchor: str = ""

    def text(self, least: int = 0) -> str:
        """Heading line and body; a level below ``least`` is raised to it."""
        head = f"{'#' * max(self.level, least)} {self.title}" if self.title or self.level else ""
        return "\n\n".join(x for x in (head, self.body.strip()) if x)


@dataclass(frozen=True)
class Chunk:
    content: str
    tokens: int
    path: str = ""
    anchor: str = ""
    section: int | None = None


@dataclass
class Document:
    """What is known of a document: its sections, or its plain text alone."""

    plain: str = ""
    sections: list[Section] = field(default_factory=list)


def windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """(id, chunk_index, content, token_count) of windows of characters, each ``size - overlap`` after the last."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - overlap) / step), F.lit(1)).cast("int")
    rows = docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select(id_col, "chunk_index", F.substring(F.col(text_col), F.col("chunk_index") * step + 1, F.lit(size)).alias("content")).withColumn("token_count", F.length("content"))


def sections(text: str) -> list[Section]:
    """The sections of a Markdown text in order; what stands before the first heading is one of level 0 without a path."""
    marks = list(HEADING.finditer(text))
    ends = [*(m.start() for m in marks[1:]), *([len(text)] if marks else [])]
    lead = text[: marks[0].start()].strip() if marks else text
    out = [Section(0, "", (), lead)] if lead or not marks else []
    above: list[tuple[int, str]] = []
    for m, end in zip(marks, ends, strict=True):
        level, title = len(m[1]), m[2].strip()
        above = [*(x for x in above if x[0] < level), (level, title)]
        out.append(Section(level, title, tuple(t for _, t in above), text[m.end() : end].strip()))
    return out


def blocks(text: str) -> list[tuple[str, bool]]:
    """(block, atomic): fences and tables whole, else paragraphs."""
    lines, at = text.split("\n"), 0
    out: list[tuple[str, bool]] = []
    loose: list[str] = []

    def paragraphs() -> None:
        out.extend((p.strip(), False) for p in "\n".join(loose).split("\n\n") if p.strip())
        loose.clear()

    while at < len(lines):
        end = at
        if lines[at].lstrip().startswith("```"):
            closing = (k for k in range(at + 1, len(lines)) if lines[k].lstrip().startswith("```"))
            end = next(closing, len(lines) - 1) + 1
        elif "|" in lines[at] and at + 1 < len(lines) and _SEPARATOR.match(lines[at + 1]):
            end = at + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
        if end > at:
            paragraphs()
            out.append(("\n".join(lines[at:end]), True))
            at = end
        else:
            loose.append(lines[at])
            at += 1
    paragraphs()
    return out


def packed(parts: list[tuple[str, bool]], size: int, overlap: int, tokens: Tokens | None = None) -> list[Chunk]:
    """Blocks in chunks of ``size`` tokens: one that does not fit closes the chunk, whose tail of ``overlap`` tokens begins the next.

    Blocks are joined by their tokens, with nothing between.  A block larger than
    ``size`` is a chunk of its own, whole if it is atomic, else in windows; the tail
    of the chunk before it goes on to the block after it, or stands alone.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    tokens = tokens or Tokens()
    out: list[Chunk] = []
    held = tokens.encode("")
    for content, atomic in parts:
        own = tokens.encode(content)
        if len(held) and len(held) + len(own) > size:
            out.append(Chunk(tokens.decode(held).strip(), len(held)))
            held = held[len(held) - overlap :] if len(held) > overlap else held
            held = held if overlap else held[:0]
        if len(own) <= size:
            held = held + own
        elif atomic:
            out.append(Chunk(content.strip(), len(own)))
        else:
            for start in range(0, len(own), size - overlap):
                window = own[start : start + size]
                out.append(Chunk(tokens.decode(window).strip(), len(window)))
    last = tokens.decode(held).strip()
    return [*out, Chunk(last, len(held))] if last else out


def _placed(chunks: list[Chunk], section: Section, number: int | None, path: str) -> list[Chunk]:
    return [Chunk(c.content, c.tokens, path, section.anchor, number) for c in chunks]


def chunk_text(text: str, size: int = 512, overlap: int = 50, tokens: Tokens | None = None) -> list[Chunk]:
    """Chunks of a Markdown text, section by section; each section begins with its heading."""
    if not text.strip():
        return []
    return [c for s in sections(text) for c in _placed(packed(blocks(s.text()), size, overlap, tokens), s, None, " > ".join(s.path))]


def chunk_sections(doc: Document, size: int = 512, overlap: int = 50, tokens: Tokens | None = None) -> list[Chunk]:
    """Chunks of a document's sections with their anchors and numbers; of its plain text if it has none."""
    if not doc.sections:
        return chunk_text(doc.plain, size, overlap, tokens)
    return [c for k, s in enumerate(doc.sections) for c in _placed(packed(blocks(s.text()), size, overlap, tokens), s, k, " > ".join(s.path) or s.title)]


def chunk_whole(doc: Document, most: int = 8000, tokens: Tokens | None = None) -> list[Chunk]:
    """One chunk if a document has at most so many tokens, else one a section, and larger sections packed."""
    tokens, overlap = tokens or Tokens(), min(most // 10, 200)
    if not doc.sections:
        return chunk_plain(doc.plain, most, tokens)
    texts = [s.text(1) for s in doc.sections]
    whole = "\n\n".join(texts)
    if tokens.count(whole) <= most:
        return [Chunk(whole, tokens.count(whole))]
    out: list[Chunk] = []
    for k, (s, text) in enumerate(zip(doc.sections, texts, strict=True)):
        n = tokens.count(text)
        out += _placed([Chunk(text, n)] if n <= most else packed(blocks(text), most, overlap, tokens), s, k, " > ".join(s.path) or s.title)
    return out


def chunk_plain(text: str, most: int = 8000, tokens: Tokens | None = None) -> list[Chunk]:
    """A plain text as one chunk, or as those of its Markdown if it has more tokens."""
    tokens, bare = tokens or Tokens(), text.strip()
    n = tokens.count(bare)
    return [] if not bare else [Chunk(bare, n)] if n <= most else chunk_text(bare, most, min(most // 10, 200), tokens)


CHUNKS = "chunk_index int, section_path string, section_anchor string, section_index int, content string, token_count int"


def chunked(docs: DataFrame, id_col: str, text_col: str, make: Callable[[str], list[Chunk]]) -> DataFrame:
    """(id, chunk_index, section_path, section_anchor, section_index, content, token_count) of what ``make`` gives for each text; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, k, c.path, c.anchor, c.section, c.content, c.tokens) for doc, text in zip(batch[id_col], batch[text_col], strict=True) for k, c in enumerate(make(text or ""))]
            out = pd.DataFrame(rows, columns=[id_col, "chunk_index", "section_path", "section_anchor", "section_index", "content", "token_count"])
            yield out.astype({"section_index": "Int32"})

    source = docs.select(id_col, text_col)
    return source.mapInPandas(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, {CHUNKS}")


def markdown_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, section_path, content, token_count) of heading sections in packed chunks."""
    return chunked(docs, id_col, text_col, lambda text: chunk_text(text, size, overlap)).drop("section_anchor", "section_index")


def chunk_id(document_id: str, index: str):
    """A stable id of a chunk."""
    return F.sha2(F.concat_ws("|", F.col(document_id).cast("string"), F.col(index).cast("string")), 256)
