"""Pages in storage format or HTML: sections, links, code, tables and mentions, and Markdown.

A page is read into a tree once; macros of the storage format are rewritten to
plain elements before it becomes Markdown.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import mapped
from .chunking import Document, Section

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr", "ri:page", "ri:user", "ri:attachment", "ri:url", "ri:space"}
#: Macros and the signs of panels.
PANELS = {"info": "ℹ️", "warning": "⚠️", "note": "📝", "tip": "💡", "panel": ""}
CODE_MACROS = {"code", "noformat"}
DROPPED_MACROS = {"toc", "toc-zone", "children", "recently-updated"}


class Node:
    """An element with its children, elements and strings."""

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, children: list | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []
        for child in children or []:
            self.add(child)

    def add(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def all(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.all()

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.all() if n.tag in tags)

    def first(self, *tags: str) -> Node | None:
        """The first element of the first tag that there is one of."""
        return next((n for tag in tags for n in self.find(tag)), None)

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            else:
                yield child

    def text(self, strip: bool = True) -> str:
        return "".join(x.strip() if strip else x for x in self.strings())

    def within(self, tag: str) -> bool:
        up = self.parent
        while up is not None and up.tag != tag:
            up = up.parent
        return up is not None

    def replace(self, *new: Node | str) -> None:
        own = self.parent
        at = next(k for k, c in enumerate(own.children) if c is self)
        own.children[at : at + 1] = new
        for n in new:
            if isinstance(n, Node):
                n.parent = own


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.here.add(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.here.add(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        up = self.here
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.tag == tag and up.parent is not None:
            self.here = up.parent

    def handle_data(self, data: str) -> None:
        self.here.add(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.here.add(data[6:])


#: Scripts and styles, which have no references, or an ampersand with the rest of a finished reference.
_REFERENCE = re.compile(r"(?is)<(script|style)\b.*?</\1|&(#\d+;|#x[\da-f]+;|[a-z][a-z\d]*;)?")


def _finished(m: re.Match) -> str:
    rest = m[2] or ""
    return m[0] if m[1] or rest.startswith("#") or rest in html5 else f"&amp;{rest}"


def parse(html: str) -> Node:
    """The tree of a page; character data of the storage format is text, and so is a reference of no known name or without its end (``&amp`` at a cut), as in XML."""
    builder = _Builder()
    # the parser of this Python may end a CDATA section at its first >, so it becomes escaped text first
    text = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;"), html, flags=re.S)
    builder.feed(_REFERENCE.sub(_finished, text))
    builder.close()
    return builder.root


def parameter(macro: Node, name: str) -> str:
    """The text of a macro's parameter; empty without one."""
    return next((p.text() for p in macro.find("ac:parameter") if p.attrs.get("ac:name") == name), "")


# ---------------------------------------------------------------- storage format to plain elements


def _body(macro: Node) -> list:
    body = macro.first("ac:rich-text-body") or macro.first("ac:plain-text-body") or macro
    return list(body.children)


def _panel(macro: Node, name: str) -> None:
    title, sign = parameter(macro, "title"), PANELS[name]
    label = f"{sign} {title}".strip() if title else f"{sign} {name.upper()}" if sign else ""
    head = [Node("strong", children=[label]), Node("br")] if label else []
    macro.replace(Node("blockquote", children=[*head, *_body(macro)]))


def _code(macro: Node) -> None:
    language, body = parameter(macro, "language"), macro.first("ac:plain-text-body", "ac:rich-text-body") or macro
    macro.replace(Node("pre", children=[Node("code", {"class": f"language-{language}"} if language else {}, children=[body.text(False)])]))


def _expand(macro: Node) -> None:
    title = parameter(macro, "title") or parameter(macro, "")
    head = [Node("p", children=[Node("strong", children=[title])])] if title else []
    macro.replace(Node("div", children=[*head, *_body(macro)]))


def _unwrapped(macro: Node) -> None:
    macro.replace(*_body(macro))


def _image(node: Node) -> None:
    file, url = node.first("ri:attachment"), node.first("ri:url")
    name = file.attrs.get("ri:filename", "") if file else ""
    source = name if file else url.attrs.get("ri:value", "") if url else ""
    node.replace(Node("img", {"src": source, "alt": node.attrs.get("ac:alt", "") or name}))


def _link(node: Node) -> None:
    page, file, body = node.first("ri:page"), node.first("ri:attachment"), node.first("ac:link-body", "ac:plain-text-link-body")
    target = page.attrs.get("ri:content-title", "") if page else file.attrs.get("ri:filename", "") if file else ""
    node.replace(Node("a", {"href": target}, children=[(body.text() if body else "") or target or "link"]))


def plain(root: Node) -> Node:
    """The page with macros, images and links of the storage format as plain elements, and without scripts and styles."""
    for macro in list(root.find("ac:structured-macro")):
        name = macro.attrs.get("ac:name", "").lower()
        if not any(c is macro for c in macro.parent.children):
            continue  # in a macro that is gone
        if name in PANELS:
            _panel(macro, name)
        elif name in CODE_MACROS:
            _code(macro)
        elif name == "expand":
            _expand(macro)
        elif name in DROPPED_MACROS:
            macro.replace()
        else:
            _unwrapped(macro)
    for tag, make in (("ac:image", _image), ("ac:link", _link)):
        for node in list(root.find(tag)):
            make(node)
    for node in [n for n in root.all() if n.tag.startswith(("ac:", "ri:"))]:
        node.replace(*node.children)
    for node in list(root.find("script", "style")):
        node.replace()
    return root


def html(node: Node | str) -> str:
    """A tree as HTML."""
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    inner = "".join(map(html, node.children))
    if not node.tag:
        return inner
    attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}/>" if node.tag in _VOID and not node.children else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def storage_to_html(text: str | None) -> str:
    """A page of the storage format as HTML; blank pages are empty."""
    return html(plain(parse(text))) if text and text.strip() else ""


# ---------------------------------------------------------------- Markdown


def _inline(children: list) -> str:
    return "".join(_markdown(c) for c in children)


def _listed(node: Node, depth: int) -> str:
    out, number = [], 0
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            number += 1
            mark = f"{number}." if node.tag == "ol" else "*+-"[depth % 3]
            own = [c for c in child.children if not (isinstance(c, Node) and c.tag in ("ul", "ol"))]
            below = [_listed(c, depth + 1) for c in child.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
            text = re.sub(r"\s*\n\s*", " ", _inline(own).strip())
            pad = " " * (len(mark) + 1)
            out.append("\n".join([f"{mark} {text}", *(pad + line for b in below for line in b.split("\n"))]))
    return "\n".join(out)


def _table(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c.children).strip()).replace("|", "\\|") for c in tr.find("th", "td")] for tr in node.find("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _marked(node: Node, sign: str) -> str:
    inner = _inline(node.children)
    bare = inner.strip()
    return f"{inner[: len(inner) - len(inner.lstrip())]}{sign}{bare}{sign}{inner[len(inner.rstrip()) :]}" if bare else inner


def _markdown(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    tag = node.tag
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {re.sub(r'\s+', ' ', _inline(node.children)).strip()}\n\n"
    if tag in ("strong", "b"):
        return _marked(node, "**")
    if tag in ("em", "i"):
        return _marked(node, "*")
    if tag == "code" and not node.within("pre"):
        return _marked(node, "`")
    if tag == "pre":
        code = node.first("code") or node
        language = next((c[9:] for c in code.attrs.get("class", "").split() if c.startswith("language-")), "")
        return f"\n\n```{language}\n{node.text(False).strip(chr(10))}\n```\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "a":
        text, target = _inline(node.children).strip(), node.attrs.get("href", "")
        return f"[{text}]({target})" if text and target else text
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag in ("ul", "ol"):
        return f"\n\n{_listed(node, 0)}\n\n"
    if tag == "table":
        return f"\n\n{_table(node)}\n\n"
    if tag == "blockquote":
        inner = tidy(_inline(node.children)).strip()
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n" if inner else ""
    if tag in ("p", "div", "article", "section", "body", "html", "header", "footer", "main", "nav", "tr", "li", "figure"):
        return f"\n\n{_inline(node.children).strip(' ')}\n\n"
    return "" if tag in ("head", "title", "meta") else _inline(node.children)


def tidy(markdown: str) -> str:
    """At most one blank line between lines, and no blanks at their ends."""
    return re.sub(r"[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\n|[^ *+\-\d>|])", "\n", markdown)), flags=re.M)


def to_markdown(text: str | None) -> str:
    """A page as Markdown; blank pages are empty."""
    return tidy(re.sub(r"\n{3,}", "\n\n", _inline(plain(parse(text)).children))).strip() if text and text.strip() else ""


# ---------------------------------------------------------------- what a page holds


def slug(title: str) -> str:
    return re.sub(r"[^\w\-]", "", re.sub(r"\s+", "-", title.lower().strip()))


def _placed(root: Node) -> tuple[list[Section], dict[int, tuple[str, ...]]]:
    """(sections, the path that each element stands in): the path of the nearest heading before an element."""
    found: list[Section] = []
    where: dict[int, tuple[str, ...]] = {}
    above: list[tuple[int, str]] = []
    here: tuple[str, ...] = ()
    for node in root.all():
        where[id(node)] = here
        if node.tag not in HEADINGS:
            continue
        level, title = int(node.tag[1]), node.text()
        if not title:
            here = ()
            continue
        above = [*(x for x in above if x[0] < level), (level, title)]
        here = tuple(t for _, t in above)
        # what follows up to the next heading of this level or above, deeper sections included
        siblings = node.parent.children
        at = next(k for k, c in enumerate(siblings) if c is node) + 1
        end = next((k for k in range(at, len(siblings)) if isinstance(siblings[k], Node) and siblings[k].tag in HEADINGS and int(siblings[k].tag[1]) <= level), len(siblings))
        found.append(Section(level, title, here, to_markdown("".join(map(html, siblings[at:end]))), slug(title)))
    return found, where


def _links(root: Node, where: dict[int, tuple[str, ...]]) -> list[dict]:
    out = []
    for node in root.find("ac:link"):
        page, user, file = (node.first(t) for t in ("ri:page", "ri:user", "ri:attachment"))
        body = node.first("ac:link-body", "ac:plain-text-link-body")
        text = body.text() if body else ""
        if page:
            title = page.attrs.get("ri:content-title") or None
            out.append(("page", page.attrs.get("ri:content-id") or None, title, page.attrs.get("ri:space-key") or None, text or title or "", node))
        elif user:
            key = user.attrs.get("ri:userkey") or user.attrs.get("ri:account-id")
            out += [("user", key, None, None, text, node)] if key else []
        elif file:
            name = file.attrs.get("ri:filename")
            out += [("attachment", name, None, None, text or name, node)] if name else []
    out += [("url", a.attrs["href"], None, None, a.text(), a) for a in root.find("a") if a.attrs.get("href") and not a.attrs["href"].startswith("#")]
    for macro in root.find("ac:structured-macro"):
        if macro.attrs.get("ac:name", "").lower() == "jira" and (key := parameter(macro, "key")):
            out.append(("jira", key, None, None, key, macro))
    return [dict(zip(("kind", "target_id", "target_title", "target_space", "anchor_text"), x[:5], strict=True)) | {"in_section": list(where[id(x[5])])} for x in out]


def _codes(root: Node, where: dict[int, tuple[str, ...]]) -> list[dict]:
    out = []
    for macro in root.find("ac:structured-macro"):
        if macro.attrs.get("ac:name", "").lower() in CODE_MACROS:
            body = macro.first("ac:plain-text-body", "ac:rich-text-body") or macro
            out.append((parameter(macro, "language"), body.text(False), macro))
    for pre in root.find("pre"):
        code = pre.first("code")
        if code and not pre.within("ac:structured-macro"):
            out.append((next((c[9:] for c in code.attrs.get("class", "").split() if c.startswith("language-")), ""), code.text(False), pre))
    return [{"language": a, "content": b, "in_section": list(where[id(n)])} for a, b, n in out if b.strip()]


def _tables(root: Node, where: dict[int, tuple[str, ...]]) -> list[dict]:
    out = []
    for table in root.find("table"):
        headers: list[str] = []
        rows: list[list[str]] = []
        for tr in table.find("tr"):
            cells = list(tr.find("th", "td"))
            texts = [c.text() for c in cells]
            if cells and not headers and all(c.tag == "th" for c in cells):
                headers = texts
            elif cells:
                rows.append(texts)
        if headers or rows:
            out.append({"headers": headers, "rows": rows, "in_section": list(where[id(table)])})
    return out


def extract(text: str | None) -> dict:
    """plain_text, sections, outbound_links, code_blocks, tables and mentions of a page; all empty for a blank one."""
    if not text or not text.strip():
        return {"plain_text": "", "sections": [], "outbound_links": [], "code_blocks": [], "tables": [], "mentions": []}
    root = parse(text)
    found, where = _placed(root)
    links = _links(root, where)
    return {
        "plain_text": to_markdown(text),
        "sections": [{"level": s.level, "title": s.title, "anchor": s.anchor, "path": list(s.path), "body": s.body} for s in found],
        "outbound_links": links,
        "code_blocks": _codes(root, where),
        "tables": _tables(root, where),
        "mentions": [{"kind": x["kind"], "ref": x["target_id"]} for x in links if x["kind"] in ("user", "jira")],
    }


def document(text: str | None) -> Document:
    """A page as a document for chunks and units."""
    found = extract(text)
    return Document(found["plain_text"], [Section(s["level"], s["title"], tuple(s["path"]), s["body"], s["anchor"]) for s in found["sections"]])


EXTRACTED = (
    "plain_text string, sections array<struct<level: int, title: string, anchor: string, path: array<string>, body: string>>, "
    "outbound_links array<struct<kind: string, target_id: string, target_title: string, target_space: string, anchor_text: string, in_section: array<string>>>, "
    "code_blocks array<struct<language: string, content: string, in_section: array<string>>>, "
    "tables array<struct<headers: array<string>, rows: array<array<string>>, in_section: array<string>>>, mentions array<struct<kind: string, ref: string>>"
)


def _mapped(pages: DataFrame, id_col: str, html_col: str, ddl: str, make: Callable[[str | None], dict]) -> DataFrame:
    def run(part: pa.RecordBatch) -> list[dict]:
        return [{id_col: i} | make(t) for i, t in zip(part.column(id_col).to_pylist(), part.column(html_col).to_pylist(), strict=True)]

    source = pages.select(id_col, html_col)
    return mapped(source, [html_col], f"{id_col} {source.schema[id_col].dataType.simpleString()}, {ddl}", run)


def extracted(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row a page with all that ``extract`` finds."""
    return _mapped(pages, id_col, html_col, EXTRACTED, extract)


def markdown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, html, markdown): each page with macros as plain elements, and as Markdown."""
    return _mapped(pages, id_col, html_col, "html string, markdown string", lambda t: {"html": storage_to_html(t), "markdown": to_markdown(t)})
