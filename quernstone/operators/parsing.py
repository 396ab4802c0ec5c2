"""Parsers: headings, links and text of pages; symbols and imports of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    """Targets of links in order."""
    return F.regexp_extract_all(html, F.lit(r"<a\b[^>]*?\bhref=\"([^\"]*)\""), 1)


def headings(html: Column) -> Column:
    """Structs (level, title) of heading elements in order, without inner tags."""
    pattern = r"(?s)<h([1-6])[^>]*>(.*?)</h\1>"
    level, title = (F.regexp_extract_all(html, F.lit(pattern), k) for k in (1, 2))
    return F.zip_with(level, title, lambda a, b: F.struct(a.cast("int").alias("level"), F.trim(F.regexp_replace(b, "<[^>]+>", "")).alias("title")))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


# ---------------------------------------------------------------- source files


@dataclass(frozen=True)
class Symbol:
    kind: str
    name: str
    signature: str
    body: str
    first: int
    last: int
    comment: str = ""
    parent: str = ""
    parent_signature: str = ""


@dataclass
class Code:
    """The symbols of a file, its imported modules, and what is imported from each (None: the module itself)."""

    language: str = "unknown"
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    named: list[tuple[str, str | None]] = field(default_factory=list)


#: Languages by ending; beginnings of definitions, methods and imports in languages with braces; words that name nothing.
ENDINGS = {".py": "python", ".go": "go", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
_MODIFIERS = r"(?:public|private|protected|static|final|synchronized|\s)*"
DEFINITIONS = {
    "go": [(r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", "function"), (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface")],
    "java": [(r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum)\s+(\w+)", "class"), (rf"^\s*{_MODIFIERS}[\w<>\[\],\s]+\s+(\w+)\s*\(", "function")],
    "typescript": [(r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^(?:export\s+)?interface\s+(\w+)", "interface")],
    "javascript": [(r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^(?:export\s+)?class\s+(\w+)", "class")],
}
METHODS = {
    "java": rf"^\s*{_MODIFIERS}[\w<>\[\],\s]+\s+(\w+)\s*\(",
    "typescript": r"^\s*(?:public|private|protected|static|readonly|\s)*(?:async\s+)?(\w+)\s*\(",
    "javascript": r"^\s*(?:static\s+)?(?:async\s+)?(\w+)\s*\(",
}
IMPORTS = {
    "java": r"(?m)^\s*import\s+([\w.]+)\s*;",
    "typescript": r"from\s+['\"]([^'\"]+)['\"]",
    "javascript": r"(?:from\s+['\"]([^'\"]+)['\"]|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\))",
}
RECEIVER = r"^func\s+\(\s*\w+\s+\*?(\w+)\s*\)\s+(\w+)\s*\("
RESERVED = (
    "if", "for", "while", "switch", "case", "default", "return", "throw", "new", "try", "catch", "finally", "do", "synchronized", "class", "interface", "enum", "extends", "implements",
    "package", "import", "instanceof", "this", "super", "void",
)
NO_METHODS = ("class", "interface", "enum", "return", "if", "for", "while", "switch", "try", "catch", "throw", "new")


def function_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def class_signature(node: ast.ClassDef) -> str:
    parts = [*map(ast.unparse, node.bases), *(f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords)]
    return f"class {node.name}" + (f"({', '.join(parts)})" if parts else "")


def first_line(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> int:
    """The line of the first decorator, or else of the definition."""
    return min([node.lineno, *(d.lineno for d in node.decorator_list[:1])])


def _enumerated(names: list[str], most: int, more: str) -> str:
    return ", ".join(names[:most]) + (more.format(len(names) - most) if len(names) > most else "")


def python_code(source: str) -> Code:
    """Module text and constants, functions, methods, and classes that have no methods, of a Python file."""
    module, lines, out = ast.parse(source), source.splitlines(keepends=True), Code("python")
    cut = lambda a, b: "".join(lines[a - 1 : b])
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def add(kind: str, node: ast.AST, name: str, signature: str, comment: str, first: int, **above: str) -> None:
        out.symbols.append(Symbol(kind, name, signature, cut(first, node.end_lineno), first, node.end_lineno, comment, **above))

    if text := ast.get_docstring(module):
        add("module", module.body[0], "__module__", "module docstring", text, module.body[0].lineno)
    constants = [n for n in module.body if (isinstance(n, ast.Assign) and all(isinstance(t, ast.Name) for t in n.targets)) or (isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name))]
    if constants:
        names = [t.id for n in constants for t in (n.targets if isinstance(n, ast.Assign) else [n.target])]
        add("module", constants[-1], "__constants__", "module constants: " + _enumerated(names, 10, ", ... (+{})"), ", ".join(names), constants[0].lineno)
    for node in module.body:
        if isinstance(node, functions):
            add("function", node, node.name, function_signature(node), ast.get_docstring(node) or "", first_line(node))
        elif isinstance(node, ast.ClassDef):
            own = [n for n in node.body if isinstance(n, functions)]
            for n in own:
                add("method", n, n.name, function_signature(n), ast.get_docstring(n) or "", first_line(n), parent=node.name, parent_signature=class_signature(node))
            if not own:
                add("class", node, node.name, class_signature(node), ast.get_docstring(node) or "", first_line(node))
        elif isinstance(node, ast.Import):
            out.named += [(a.name, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.named += [(node.module, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.named += [("." * node.level, a.name) for a in node.names]
    # a module is imported once for a statement that names it, relative names each
    for node in module.body:
        if isinstance(node, ast.Import):
            out.imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.imports += [node.module] if node.module else ["." * node.level + a.name for a in node.names]
    return out


_BRACES = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)|[{}]", re.S)


def closing_brace(source: str, opening: int) -> int:
    """The place after the brace that closes the one at ``opening``, strings passed over; the end if there is none."""
    depth = 0
    for m in _BRACES.finditer(source, opening):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and not depth:
            return m.end()
    return len(source)


def comment_above(lines: list[str], at: int) -> str:
    """The comment lines directly above a line, without their signs."""
    out = []
    for line in map(str.strip, reversed(lines[:at])):
        if line.startswith(("//", "#")):
            out.append(line.lstrip("/#").strip())
        elif line.startswith(("*", "/*")):
            out.append(line.lstrip("/*").rstrip("*/").strip())
        else:
            break
    return "\n".join(reversed(out))


def _defined(source: str, patterns: list[tuple[str, str]], reserved: tuple[str, ...]) -> Iterator[tuple[re.Match, str, int, str]]:
    """(match, kind, line number from 0, text up to its closing brace) of the definitions of a text, none within another."""
    start, over = 0, 0
    for number, line in enumerate(source.splitlines(keepends=True)):
        if start >= over:
            for pattern, kind in patterns:
                m = re.match(pattern, line.strip())
                if not m or m[m.lastindex] in reserved:
                    continue
                opening = source.find("{", start)
                if opening >= 0:
                    end = closing_brace(source, opening)
                    yield m, kind, number, source[start:end]
                    tail = source.find("\n", end)
                    over = len(source) if tail < 0 else tail + 1
                    break
        start += len(line)


def _head(text: str) -> str:
    return text.split("{", 1)[0].strip()


def brace_symbols(source: str, language: str) -> list[Symbol]:
    """Functions, types and methods of a language with braces; of classes with methods only these."""
    lines, out = source.splitlines(keepends=True), []
    patterns = [(RECEIVER, "method"), *DEFINITIONS[language]] if language == "go" else DEFINITIONS[language]
    for m, kind, at, text in _defined(source, patterns, RESERVED):
        last, comment = at + 1 + text.count("\n"), comment_above(lines, at)
        if m.lastindex == 2:
            out.append(Symbol("method", m[2], _head(text), text, at + 1, last, comment, m[1], f"type {m[1]}"))
            continue
        inner = class_methods(text, language, m[1], at) if kind == "class" and language in METHODS else []
        out += inner or [Symbol(kind, m[1], _head(text), text, at + 1, last, comment)]
    return out


def class_methods(text: str, language: str, name: str, offset: int = 0) -> list[Symbol]:
    """The methods of a class, given from its head to its closing brace; ``offset`` lines stand before it."""
    opening = text.find("{")
    inner = text[opening + 1 :]
    lines, before = inner.splitlines(keepends=True), text[: opening + 1].count("\n")
    found = _defined(inner, [(METHODS[language], "method")], NO_METHODS)
    return [Symbol("method", m[1], _head(body), body, offset + before + at + 1, offset + before + at + 1 + body.count("\n"), comment_above(lines, at), name, _head(text)) for m, _, at, body in found if not m.string.startswith(("//", "/*"))]


def brace_imports(source: str, language: str) -> list[str]:
    """Imported modules in order, each once."""
    if language == "go":
        single = re.findall(r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", source)
        inner = re.findall(r"(?ms)^\s*import\s*\(([^)]*)\)", source)
        return list(dict.fromkeys([*single, *(x for b in inner for x in re.findall(r"(?:[\w.]+\s+)?\"([^\"]+)\"", b))]))
    return list(dict.fromkeys(next(g for g in m.groups() if g) for m in re.finditer(IMPORTS[language], source)))


def file_code(source: str, path: str) -> Code:
    """What a file defines and imports; one that has no known language or does not parse is one symbol as a whole, a blank one none."""
    ending = re.search(r"[^/](\.[^./]*)$", path)
    language = ENDINGS.get(ending[1].lower(), "unknown") if ending else "unknown"
    if not source.strip():
        return Code(language)
    try:
        if language == "python":
            return python_code(source)
        if language in DEFINITIONS:
            return Code(language, brace_symbols(source, language), brace_imports(source, language))
    except (SyntaxError, ValueError, RecursionError):
        pass
    base = path.rsplit("/", 1)[-1]
    return Code(language, [Symbol("module", re.sub(r"(?<=.)\.[^.]*$", "", base), base, source, 1, source.count("\n") + 1)])


def code_chunks(code: Code, title: str) -> list[tuple[str, str, str]]:
    """(section path, content, text for embedding) of each symbol."""
    out = []
    for s in code.symbols:
        above = [s.parent_signature] if s.parent else []
        content = "\n".join(f"# {x}" for x in [f"File: {title}", *above, f"{s.kind}: {s.signature}"]) + "\n\n" + s.body
        names = [s.parent, s.name] if s.parent else [s.name]
        out.append((" > ".join([title, *names]), content, "\n".join([title, *names, s.signature, *([s.comment] if s.comment else [])])))
    return out


def code_graph(code: Code, title: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str, str]]]:
    """(entities (name, type, description), relations (source, target, type, label)) of a file."""
    full = lambda s: f"{title}::{s.parent}.{s.name}" if s.parent else f"{title}::{s.name}"
    entities = {title: (title, "module", f"{code.language} file, {len(code.symbols)} symbols")}
    for name in code.imports:
        entities.setdefault(name, (name, "module", ""))
    for s in code.symbols:
        entities.setdefault(full(s), (full(s), s.kind, s.signature))
    for s in code.symbols:
        if s.parent:
            entities.setdefault(f"{title}::{s.parent}", (f"{title}::{s.parent}", "class", s.parent_signature or f"class {s.parent}"))
    wanted: dict[str, list[str]] = {}
    for module, name in code.named or [(x, None) for x in code.imports]:
        if module != title:
            wanted.setdefault(module, []).extend([name] if name else [])
    relations = [(title, module, "imports", _enumerated(names, 20, ", ... (+{})")) for module, names in wanted.items()]
    return list(entities.values()), [*relations, *((f"{title}::{s.parent}", full(s), "contains", "") for s in code.symbols if s.parent)]


SYMBOLS = "kind string, name string, signature string, body string, line int, last_line int, comment string, parent string, parent_signature string"


def _per_file(files: DataFrame, path_col: str, text_col: str, ddl: str, make: Callable[[Code, str], list[tuple]]) -> DataFrame:
    columns = [path_col, *(c.split()[0] for c in ddl.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, text in zip(batch[path_col], batch[text_col], strict=True) for row in make(file_code(text or "", path or ""), path or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(path_col, text_col).mapInPandas(run, f"{path_col} string, {ddl}")


def code_symbols(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """One row a symbol of each file, with the columns of ``SYMBOLS``."""
    return _per_file(files, path_col, text_col, SYMBOLS, lambda code, _: [(s.kind, s.name, s.signature, s.body, s.first, s.last, s.comment, s.parent, s.parent_signature) for s in code.symbols])


def code_imports(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, module) of each import."""
    return _per_file(files, path_col, text_col, "module string", lambda code, _: [(m,) for m in code.imports])


def code_chunk_rows(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, chunk_index, section_path, content, embed_text) of each symbol."""
    return _per_file(files, path_col, text_col, "chunk_index int, section_path string, content string, embed_text string", lambda code, path: [(k, *c) for k, c in enumerate(code_chunks(code, path))])


def code_relations(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, source, target, relation_type, label) of each file."""
    return _per_file(files, path_col, text_col, "source string, target string, relation_type string, label string", lambda code, path: code_graph(code, path)[1])


def code_entities(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, name, entity_type, description) of each file."""
    return _per_file(files, path_col, text_col, "name string, entity_type string, description string", lambda code, path: code_graph(code, path)[0])
