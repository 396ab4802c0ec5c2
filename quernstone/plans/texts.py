"""Queries of what expands documents: chunks, units, pages, source files, relations of texts.

Parsers run over literal documents whose results were worked out by hand, and over
the whole tables where SQL can say what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, extraction, pages, parsing, units
from .base import query, rows, table


# ---------------------------------------------------------------- chunks

_DOC = "id int, text string"
_MD = "intro\n# Project\nabout\n## Architecture\n### Backend\nserver\n```\n# no code heading\n```\n## Deployment\n"


def _blocks(df: DataFrame) -> DataFrame:
    return chunking.chunked(df, "id", "text", lambda t: [chunking.Chunk(b, int(a)) for b, a in chunking.blocks(t)])


def _packed(size: int, overlap: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: chunking.chunked(df, "id", "text", lambda t: chunking.packed(chunking.blocks(t), size, overlap))


rows("exp07_markdown_blocks", _DOC, [(1, "a\nb\n\nc\n| x | y |\n|---|---|\n| 1 | 2 |\nd\n```py\n\ncode\n```\ne"), (2, "```\nopen"), (3, "a | b\nno table"), (4, "")], "id, chunk_index, content, token_count", [
    (1, 0, "a\nb", 0), (1, 1, "c", 0), (1, 2, "| x | y |\n|---|---|\n| 1 | 2 |", 1), (1, 3, "d", 0), (1, 4, "```py\n\ncode\n```", 1), (1, 5, "e", 0), (2, 0, "```\nopen", 1), (3, 0, "a | b\nno table", 0),
], _blocks)
rows("exp06_packed_blocks", _DOC, [(1, "aaaa\n\nbbbb\n\ncccc"), (2, "dd\n\n```\nlong fence\n```\n\nee"), (3, "f" * 13), (4, "gggg\n\n" + "h" * 12 + "\n\ni")], "id, chunk_index, content, token_count", [
    (1, 0, "aaaabbbb", 8), (1, 1, "bbcccc", 6), (2, 0, "dd", 2), (2, 1, "```\nlong fence\n```", 18), (2, 2, "ddee", 4),
    (3, 0, "ffffffff", 8), (3, 1, "fffffff", 7), (3, 2, "f", 1), (4, 0, "gggg", 4), (4, 1, "hhhhhhhh", 8), (4, 2, "hhhhhh", 6), (4, 3, "ggi", 3),
], _packed(8, 2))
rows("exp01_markdown_chunks", _DOC, [(1, _MD), (2, "  \n"), (3, None)], "id, chunk_index, section_path, content, token_count", [
    (1, 0, "", "intro", 5), (1, 1, "Project", "# Projectabout", 14), (1, 2, "Project > Architecture", "## Architecture", 15), (1, 3, "Project > Architecture > Backend", "### Backendserver```", 20),
    (1, 4, "no code heading", "# no code heading```", 20), (1, 5, "no code heading > Deployment", "## Deployment", 13),
], lambda df: chunking.markdown_chunks(df, "id", "text", 40, 5))
_PAGE = "<p>lead</p><h1>Top</h1><p>one</p><h2>Sub</h2><p>two</p>"


def _page_chunks(make: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda df: chunking.chunked(df, "id", "text", lambda t: make(pages.document(t)))


_TOP, _SUB = "# Top\n\none\n\n## Sub\n\ntwo", "## Sub\n\ntwo"
rows("exp02_section_chunks", _DOC, [(1, _PAGE), (2, "<p>only text</p>"), (3, None)], "id, chunk_index, section_path, section_anchor, section_index, content", [
    (1, 0, "Top", "top", 0, _TOP.replace("\n\n", "")), (1, 1, "Top > Sub", "sub", 1, "## Subtwo"), (2, 0, "", "", None, "only text"),
], _page_chunks(lambda doc: chunking.chunk_sections(doc, 60, 5)))
rows("exp03_whole_chunks", _DOC, [(1, _PAGE), (2, "<p>only text</p>"), (3, " ")], "id, chunk_index, section_path, section_index, content", [(1, 0, "", None, _TOP + "\n\n" + _SUB), (2, 0, "", None, "only text")], _page_chunks(lambda doc: chunking.chunk_whole(doc, 60)))
rows("exp04_chunks_by_section", _DOC, [(1, _PAGE)], "id, chunk_index, section_path, section_index, content, token_count", [(1, 0, "Top", 0, _TOP, 23), (1, 1, "Top > Sub", 1, _SUB, 11)], _page_chunks(lambda doc: chunking.chunk_whole(doc, 23)))
rows("exp05_plain_chunks", _DOC, [(1, " short "), (2, "aaaaaa\n\nbbbbbb"), (3, "")], "id, chunk_index, content", [(1, 0, "short"), (2, 0, "aaaaaa"), (2, 1, "abbbbbb")], lambda df: chunking.chunked(df, "id", "text", lambda t: chunking.chunk_plain(t, 10)))
rows("win13_section_paths", _DOC, [(1, _MD), (2, "no heading")], "id, chunk_index, section_path", [(1, 0, ""), (1, 1, "Project"), (1, 2, "Project > Architecture"), (1, 3, "Project > Architecture > Backend"), (1, 4, "no code heading"), (1, 5, "no code heading > Deployment"), (2, 0, "")], lambda df: chunking.chunked(df, "id", "text", lambda t: [chunking.Chunk(s.body, 0, " > ".join(s.path)) for s in chunking.sections(t)]))


@query("exp01_whole_chunks", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END AS chunk_number, length(trim(text))::INT AS token_count FROM documents WHERE length(text) > 0 AND length(trim(text)) <= 400 AND NOT contains(text, chr(10))")
def whole_chunks(spark, d):
    """Texts of one line that fit are one chunk each, over the whole table."""
    docs = table(spark, d, "documents").where("length(text) > 0 and length(trim(text)) <= 400 and not contains(text, '\n')")
    return chunking.markdown_chunks(docs, "doc_id", "text", 400, 50).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_number"), F.sum("token_count").cast("int").alias("token_count"))


# ---------------------------------------------------------------- units

_SIZES = units.UnitSizes(target=40, most=60, least=15, overlap=4, lead=6)
_UNIT = "id int, title string, text string"
_LONG = "# A\nshort\n## B\n" + "b" * 35 + "\n## C\n" + "c" * 30
rows("exp08_extraction_units", _UNIT, [(42, "T", "lead words\n# A\none\n## B\ntwo"), (7, "", _LONG), (8, "Plain", "just text"), (9, "E", " ")], "id, unit_id, ordinal, section_ids, primary_section_id, section_path, body, split_part, split_total", [
    (42, "42:0000", 0, ["42:0", "42:1"], "42:0", "A", "# A\n\none\n\n## B\n\ntwo", 0, 1),
    (7, "7:0000", 0, ["7:0", "7:1"], "7:1", "A > B", "# A\n\nshort\n\n## B\n\n" + "b" * 35, 0, 1), (7, "7:0001", 1, ["7:2"], "7:2", "A > C", "## C\n\n" + "c" * 30, 0, 1),
    (8, "8:0000", 0, ["8:0"], "8:0", "", "just text", 0, 1),
], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))
_ABOVE = ["# 문서: T\n\n## 위치: A\n\n## 문서 요약\nlead w...", "## 문서 요약\n| a |..."]
_WHOLE = [_ABOVE[0] + "\n\n---\n\n# A\n\none", _ABOVE[1] + "\n\n---\n\n| a | b |\n|---|---|\n```x```"]
rows("exp12_unit_contents", _UNIT, [(42, "T", "lead words\n# A\none"), (8, "", "| a | b |\n|---|---|\n```x```")], "unit_id, breadcrumb, content, token_count, has_table, has_code_block", [
    ("42:0000", _ABOVE[0], _WHOLE[0], len(_WHOLE[0]), False, False), ("8:0000", _ABOVE[1], _WHOLE[1], len(_WHOLE[1]), True, True),
], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))
_PARTS = "\n\n".join(c * 25 for c in "xyz")
rows("exp14_plain_units", _UNIT, [(1, "", _PARTS)], "unit_id, body, split_part, split_total", [("1:0000", "x" * 25, 0, 3), ("1:0001", "xxxx\n\n" + "y" * 25, 1, 3), ("1:0002", "yyyy\n\n" + "z" * 25, 2, 3)], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))
rows("win14_split_texts", _UNIT, [(1, "", "# H\n" + _PARTS)], "unit_id, section_ids, body, split_part", [("1:0000", ["1:0"], "# H\n\n" + "x" * 25, 0), ("1:0001", ["1:0"], "xxxx\n\n" + "y" * 25, 1), ("1:0002", ["1:0"], "yyyy\n\n" + "z" * 25, 2)], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))


def _nodes(df: DataFrame) -> DataFrame:
    """Sections in the order of the tree, with their own size, that of their subtree, and their number of children."""

    def of(text: str) -> list[chunking.Chunk]:
        top = units.tree([s for s in chunking.sections(text) if s.title], chunking.Tokens())
        return [chunking.Chunk(n.own, n.total(), " > ".join(n.section.path), str(len(n.children)), n.size) for root in top for n in root.walk()]

    return chunking.chunked(df, "id", "text", of).select("id", "chunk_index", "section_path", F.col("section_index").alias("own"), F.col("token_count").alias("total"), F.col("section_anchor").alias("children"))


_TREE = [(1, "# A\none\n## B\ntwo\n### C\n## D\nxx"), (2, "## X\n# Y")]
rows("exp09_section_trees", _DOC, _TREE, "id, chunk_index, section_path, children", [(1, 0, "A", "2"), (1, 1, "A > B", "1"), (1, 2, "A > B > C", "0"), (1, 3, "A > D", "0"), (2, 0, "X", "0"), (2, 1, "Y", "0")], _nodes)
rows("exp10_subtree_sizes", _DOC, _TREE, "id, chunk_index, own, total", [(1, 0, 8, 30), (1, 1, 9, 14), (1, 2, 5, 5), (1, 3, 8, 8), (2, 0, 4, 4), (2, 1, 3, 3)], _nodes)
rows("exp11_collected_units", _UNIT, [(5, "", "# P\n" + "p" * 70 + "\n## Q\nq"), (6, "", "# P\n" + "p" * 30 + "\n## Q\n" + "q" * 30)], "unit_id, section_ids, split_part, split_total", [
    ("5:0000", ["5:0"], 0, 2), ("5:0001", ["5:0"], 1, 2), ("5:0002", ["5:1"], 0, 1), ("6:0000", ["6:0"], 0, 1), ("6:0001", ["6:1"], 0, 1),
], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))
rows("exp48_rendered_subtrees", _UNIT, [(3, "", "# A\n## B\nb\n## C")], "section_ids, body", [(["3:0", "3:1", "3:2"], "# A\n\n## B\n\nb\n\n## C")], lambda df: units.extraction_units(df, "id", "title", "text", _SIZES))

# ---------------------------------------------------------------- pages

_STORAGE = (
    '<h1>Top</h1><p>see <ac:link><ri:page ri:content-title="Home" ri:space-key="DEV"/><ac:link-body>the home</ac:link-body></ac:link> and <a href="http://x/y">link</a> <a href="#here">no</a></p>'
    '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">python</ac:parameter><ac:plain-text-body><![CDATA[if a < b:\n    run()]]></ac:plain-text-body></ac:structured-macro>'
    '<h2>People</h2><ac:link><ri:user ri:userkey="kim"/></ac:link><ac:link><ri:attachment ri:filename="a.pdf"/></ac:link>'
    '<ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">AB-1</ac:parameter></ac:structured-macro>'
    "<table><tr><th>Name</th><th>Size</th></tr><tr><td>one</td><td>1</td></tr></table><h2></h2><h1>End</h1>"
    '<pre><code class="x language-go">func f() {}</code></pre><pre>no code</pre>'
)
_HTML = "id int, html string"


def _found(what: str, *fields: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: pages.extracted(df, "id", "html").select("id", F.posexplode(what).alias("pos", "x")).select("id", "pos", *(f"x.{f}" for f in fields))


rows("exp15_extracted_pages", _HTML, [(1, _STORAGE), (2, None), (3, "<p>t</p>")], "id, n_sections, n_links, n_codes, n_tables, n_mentions, blank", [(1, 3, 5, 2, 1, 2, False), (2, 0, 0, 0, 0, 0, True), (3, 0, 0, 0, 0, 0, False)], lambda df: pages.extracted(df, "id", "html").select("id", *(F.size(c).alias(n) for c, n in (("sections", "n_sections"), ("outbound_links", "n_links"), ("code_blocks", "n_codes"), ("tables", "n_tables"), ("mentions", "n_mentions"))), (F.col("plain_text") == "").alias("blank")))
rows("exp16_page_sections", _HTML, [(1, _STORAGE), (2, "<div><h2>A <b>b</b></h2><h4>Deep</h4></div><h2>c d!</h2>")], "id, pos, level, title, anchor, path", [
    (1, 0, 1, "Top", "top", ["Top"]), (1, 1, 2, "People", "people", ["Top", "People"]), (1, 2, 1, "End", "end", ["End"]),
    (2, 0, 2, "Ab", "ab", ["Ab"]), (2, 1, 4, "Deep", "deep", ["Ab", "Deep"]), (2, 2, 2, "c d!", "c-d", ["c d!"]),
], _found("sections", "level", "title", "anchor", "path"))
rows("exp17_section_bodies", _HTML, [(1, "<h1>A</h1><p>one</p><h2>B</h2><p>two</p><h1>C</h1>"), (2, "<div><h2>In</h2>x</div>y")], "id, title, body", [(1, "A", "one\n\n## B\n\ntwo"), (1, "B", "two"), (1, "C", ""), (2, "In", "x")], _found("sections", "title", "body"))
rows("exp18_page_links", _HTML, [(1, _STORAGE)], "id, pos, kind, target_id, target_title, target_space, anchor_text, in_section", [
    (1, 0, "page", None, "Home", "DEV", "the home", ["Top"]), (1, 1, "user", "kim", None, None, "", ["Top", "People"]), (1, 2, "attachment", "a.pdf", None, None, "a.pdf", ["Top", "People"]),
    (1, 3, "url", "http://x/y", None, None, "link", ["Top"]), (1, 4, "jira", "AB-1", None, None, "AB-1", ["Top", "People"]),
], _found("outbound_links", "kind", "target_id", "target_title", "target_space", "anchor_text", "in_section"))
rows("exp19_code_blocks", _HTML, [(1, _STORAGE)], "id, pos, language, content, in_section", [(1, 0, "python", "if a < b:\n    run()", ["Top"]), (1, 1, "go", "func f() {}", ["End"])], _found("code_blocks", "language", "content", "in_section"))
rows("exp20_page_tables", _HTML, [(1, _STORAGE), (2, "<table><tr><td>a</td></tr><tr></tr></table><table></table>")], "id, pos, headers, rows, in_section", [(1, 0, ["Name", "Size"], [["one", "1"]], ["Top", "People"]), (2, 0, [], [["a"]], [])], _found("tables", "headers", "rows", "in_section"))
rows("exp21_located_sections", _HTML, [(1, '<a href="a">x</a><h1>A</h1><a href="b">x</a><h3>B</h3><div><a href="c">x</a></div><h2>C</h2><a href="d">x</a>')], "target_id, in_section", [("a", []), ("b", ["A"]), ("c", ["A", "B"]), ("d", ["A", "C"])], _found("outbound_links", "target_id", "in_section"))
rows("fn68_preceding_headings", _HTML, [(1, '<h1>A</h1><table><tr><td>1</td></tr></table><h2>B</h2><pre><code>x</code></pre>')], "id, tables, codes", [(1, ["A"], ["A", "B"])], lambda df: pages.extracted(df, "id", "html").select("id", F.col("tables")[0]["in_section"].alias("tables"), F.col("code_blocks")[0]["in_section"].alias("codes")))
rows("fn69_macro_parameters", _HTML, [(1, '<ac:structured-macro ac:name="jira"><ac:parameter ac:name="server">S</ac:parameter><ac:parameter ac:name="key"> AB-9 </ac:parameter></ac:structured-macro>'), (2, '<ac:structured-macro ac:name="jira"></ac:structured-macro>')], "id, refs", [(1, ["AB-9"]), (2, [])], lambda df: pages.extracted(df, "id", "html").select("id", F.transform("mentions", lambda m: m["ref"]).alias("refs")))

_MARKDOWN = [
    ("<h2>Head</h2><p>a <strong>b</strong> <em>c</em> <code>d</code></p>", "## Head\n\na **b** *c* `d`"),
    ("<ul><li>one<ol><li>x</li><li>y</li></ol></li><li>two</li></ul>", "* one\n  1. x\n  2. y\n* two"),
    ('<p><a href="u">t</a><br/><img src="i.png" alt="A"/></p><hr/>', "[t](u)\n![A](i.png)\n\n---"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("<script>x()</script><style>y</style><p>kept</p>", "kept"),
    ('<ac:structured-macro ac:name="toc"/><blockquote><p>q</p></blockquote>', "> q"),
]
rows("exp22_markdown", _HTML, [(k, h) for k, (h, _) in enumerate(_MARKDOWN)] + [(90, None), (91, "  ")], "id, markdown", [(k, m) for k, (_, m) in enumerate(_MARKDOWN)] + [(90, ""), (91, "")], lambda df: pages.markdown(df, "id", "html"))
_MACROS = {
    "exp41_panels": [
        ('<ac:structured-macro ac:name="info"><ac:rich-text-body><p>x</p></ac:rich-text-body></ac:structured-macro>', "<blockquote><strong>ℹ️ INFO</strong><br/><p>x</p></blockquote>"),
        ('<ac:structured-macro ac:name="Warning"><ac:parameter ac:name="title">Mind</ac:parameter><ac:rich-text-body>y</ac:rich-text-body></ac:structured-macro>', "<blockquote><strong>⚠️ Mind</strong><br/>y</blockquote>"),
        ('<ac:structured-macro ac:name="panel"><ac:rich-text-body>z</ac:rich-text-body></ac:structured-macro>', "<blockquote>z</blockquote>"),
    ],
    "exp42_code_macros": [
        ('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a<b]]></ac:plain-text-body></ac:structured-macro>', '<pre><code class="language-py">a&lt;b</code></pre>'),
        ('<ac:structured-macro ac:name="noformat"><ac:plain-text-body>raw</ac:plain-text-body></ac:structured-macro>', "<pre><code>raw</code></pre>"),
    ],
    "exp43_expand_macros": [
        ('<ac:structured-macro ac:name="expand"><ac:parameter ac:name="title">More</ac:parameter><ac:rich-text-body><p>in</p></ac:rich-text-body></ac:structured-macro>', "<div><p><strong>More</strong></p><p>in</p></div>"),
        ('<ac:structured-macro ac:name="expand"><ac:rich-text-body>in</ac:rich-text-body></ac:structured-macro>', "<div>in</div>"),
    ],
    "exp44_unwrapped_macros": [
        ('a<ac:structured-macro ac:name="odd"><ac:rich-text-body><b>x</b></ac:rich-text-body></ac:structured-macro>b', "a<b>x</b>b"),
        ('a<ac:structured-macro ac:name="odd"></ac:structured-macro>b', "ab"),
    ],
    "exp45_images": [
        ('<ac:image><ri:attachment ri:filename="p.png"/></ac:image>', '<img src="p.png" alt="p.png"/>'),
        ('<ac:image ac:alt="A"><ri:url ri:value="http://i"/></ac:image>', '<img src="http://i" alt="A"/>'),
    ],
    "exp46_links": [
        ('<ac:link><ri:page ri:content-title="Home"/></ac:link>', '<a href="Home">Home</a>'),
        ('<ac:link><ri:attachment ri:filename="f.txt"/><ac:plain-text-link-body><![CDATA[file]]></ac:plain-text-link-body></ac:link>', '<a href="f.txt">file</a>'),
        ('<ac:link><ri:user ri:userkey="k"/></ac:link>', '<a href="">link</a>'),
    ],
    "exp24_macros": [
        ('x<ac:structured-macro ac:name="toc"/><ac:structured-macro ac:name="children"></ac:structured-macro>y', "xy"),
        ('<ac:structured-macro ac:name="info"><ac:rich-text-body><ac:structured-macro ac:name="code"><ac:plain-text-body>c</ac:plain-text-body></ac:structured-macro></ac:rich-text-body></ac:structured-macro>', "<blockquote><strong>ℹ️ INFO</strong><br/><pre><code>c</code></pre></blockquote>"),
    ],
    "exp23_storage_html": [("<p>a &amp; b</p><script>no</script><ac:task>t</ac:task>", "<p>a &amp; b</p>t"), (" ", ""), ("<br>x<img src=\"i\">", '<br/>x<img src="i"/>')],
}
for _name, _cases in _MACROS.items():
    rows(_name, _HTML, [(k, h) for k, (h, _) in enumerate(_cases)], "id, html", [(k, m) for k, (_, m) in enumerate(_cases)], lambda df: pages.markdown(df, "id", "html"))
rows("exp25_tidied_markdown", _HTML, [(1, "<p>a </p><div></div><div></div><p>b</p>"), (2, "<pre><code>x  \n\n\n\ny</code></pre>")], "id, markdown", [(1, "a\n\nb"), (2, "```\nx\n\ny\n```")], lambda df: pages.markdown(df, "id", "html"))


@query("exp18_links", "SELECT page_id, list_filter(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=\"([^\"]*)\"', 1), lambda x: x <> '' AND NOT starts_with(x, '#')) AS links FROM pages")
def page_links(spark, d):
    found = pages.extracted(table(spark, d, "pages"), "page_id", "html")
    return found.select("page_id", F.transform(F.filter("outbound_links", lambda x: x["kind"] == "url"), lambda x: x["target_id"]).alias("links"))


@query("exp16_headings", "SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'))), lambda x: x <> '') AS titles FROM pages")
def page_headings(spark, d):
    return pages.extracted(table(spark, d, "pages"), "page_id", "html").select("page_id", F.transform("sections", lambda s: s["title"]).alias("titles"))


# ---------------------------------------------------------------- source files

_FILE = "path string, content string"
_PY = '"""Doc."""\nimport os, re\nfrom a.b import c, d\nfrom . import e\nX = 1\nY: int = 2\n\n@wrap\ndef f(a, b=1, *c) -> int:\n    """Does."""\n    return a\n\nclass K(Base, meta=M):\n    def run(self):\n        pass\n    async def go(self, n: int): pass\n\nclass Empty: pass\n'
_GO = 'package m\nimport "fmt"\nimport (\n  x "net/http"\n  "os"\n)\n// Server serves.\ntype Server struct {\n  a string // }\n}\nfunc (s *Server) Run(n int) error {\n  if true { return nil }\n  return nil\n}\n# note\nfunc main() { s := "}" }\n'
_TS = "import {a} from './a';\nimport b from \"b\";\n/* View.\n * More. */\nexport class View {\n  constructor(x) { this.x = x; }\n  // draws\n  async draw(y) {\n    if (y) { return 1; }\n  }\n}\nexport function go() { return `}`; }\nexport interface Shape { n: number }\nclass Bare { }\n"
_JAVA = "import java.util.List;\nimport a.B;\npublic class Box {\n  private int n;\n  public int size() { return n; }\n}\n"


def _symbols(df: DataFrame) -> DataFrame:
    return parsing.code_symbols(df, "path", "content")


rows("exp27_python_symbols", _FILE, [("a.py", _PY)], "kind, name, signature, line, last_line, comment, parent, parent_signature", [
    ("module", "__module__", "module docstring", 1, 1, "Doc.", "", ""), ("module", "__constants__", "module constants: X, Y", 5, 6, "X, Y", "", ""),
    ("function", "f", "def f(a, b=1, *c) -> int", 8, 11, "Does.", "", ""), ("method", "run", "def run(self)", 14, 15, "", "K", "class K(Base, meta=M)"),
    ("method", "go", "async def go(self, n: int)", 16, 16, "", "K", "class K(Base, meta=M)"), ("class", "Empty", "class Empty", 18, 18, "", "", ""),
], _symbols)
rows("exp26_code_symbols", _FILE, [("x/a.PY", "def f(): pass"), ("bad.py", "def ("), ("r.md", "# Hi\nx"), ("blank.go", " \n"), ("m.js", "function g(a) { }"), (".env", "A=1")], "path, kind, name, signature, line, last_line", [
    ("x/a.PY", "function", "f", "def f()", 1, 1), ("bad.py", "module", "bad", "bad.py", 1, 1), ("r.md", "module", "r", "r.md", 1, 2), ("m.js", "function", "g", "function g(a)", 1, 1), (".env", "module", ".env", ".env", 1, 1),
], _symbols)
rows("exp28_go_symbols", _FILE, [("m.go", _GO)], "kind, name, signature, line, last_line, comment, parent", [
    ("struct", "Server", "type Server struct", 8, 9, "Server serves.", ""), ("method", "Run", "func (s *Server) Run(n int) error", 11, 14, "", "Server"), ("function", "main", "func main()", 16, 16, "note", ""),
], _symbols)
rows("exp29_class_methods", _FILE, [("v.ts", _TS), ("B.java", _JAVA)], "path, kind, name, signature, comment, parent, parent_signature", [
    ("v.ts", "method", "constructor", "constructor(x)", "", "View", "export class View"), ("v.ts", "method", "draw", "async draw(y)", "draws", "View", "export class View"),
    ("v.ts", "function", "go", "export function go()", "", "", ""), ("v.ts", "interface", "Shape", "export interface Shape", "", "", ""), ("v.ts", "class", "Bare", "class Bare", "", "", ""),
    ("B.java", "method", "size", "public int size()", "", "Box", "public class Box"),
], _symbols)
rows("exp47_brace_languages", _FILE, [("v.ts", "export function a(x: number): string {\n  return '{';\n}\n"), ("m.go", "type I interface {\n}\n")], "path, kind, name, line, last_line", [("v.ts", "function", "a", 1, 3), ("m.go", "interface", "I", 1, 2)], _symbols)
rows("exp32_whole_files", _FILE, [("docs/x.tar.txt", "a\nb")], "kind, name, signature, body, line, last_line", [("module", "x.tar", "x.tar.txt", "a\nb", 1, 2)], _symbols)
rows("exp34_closed_braces", _FILE, [("a.js", 'function f() { a("}"); { b } }\nrest'), ("b.js", "function g() { never")], "path, body", [("a.js", 'function f() { a("}"); { b } }'), ("b.js", "function g() { never")], _symbols)
rows("exp35_comments_above", _FILE, [("a.js", "// one\n// two\nfunction f() {}\nlet x;\nfunction g() {}\n"), ("b.js", "/* three */\nfunction h() {}")], "name, comment", [("f", "one\ntwo"), ("g", ""), ("h", "three")], _symbols)
rows("exp39_function_signatures", _FILE, [("a.py", "def a(x: int, /, *, y='s', **k) -> list[int]: ...\nasync def b(): ...")], "name, signature", [("a", "def a(x: int, /, *, y='s', **k) -> list[int]"), ("b", "async def b()")], _symbols)
rows("exp40_class_signatures", _FILE, [("a.py", "class A: ...\nclass B(x.Y, Z[int], metaclass=M, **kw): ...")], "name, signature", [("A", "class A"), ("B", "class B(x.Y, Z[int], metaclass=M, **kw)")], _symbols)
rows("fn81_first_lines", _FILE, [("a.py", "\n@one\n@two\ndef f(): pass\nclass C:\n    @three\n    def m(self): pass")], "name, line, last_line", [("f", 2, 4), ("m", 6, 7)], _symbols)
rows("exp30_imports", _FILE, [("a.py", _PY), ("v.ts", _TS), ("B.java", _JAVA), ("c.js", "const a = require('a'); import b from 'b'; require( \"a\" )")], "path, module", [("a.py", "os"), ("a.py", "re"), ("a.py", "a.b"), ("a.py", ".e"), ("v.ts", "./a"), ("v.ts", "b"), ("B.java", "java.util.List"), ("B.java", "a.B"), ("c.js", "a"), ("c.js", "b")], lambda df: parsing.code_imports(df, "path", "content"))
rows("exp31_go_imports", _FILE, [("m.go", _GO)], "path, module", [("m.go", "fmt"), ("m.go", "net/http"), ("m.go", "os")], lambda df: parsing.code_imports(df, "path", "content"))
rows("exp33_code_chunks", _FILE, [("a.py", 'class C(B):\n    def m(self):\n        """Text."""\ndef f(): pass\n')], "chunk_index, section_path, content, embed_text", [
    (0, "a.py > C > m", '# File: a.py\n# class C(B)\n# method: def m(self)\n\n    def m(self):\n        """Text."""\n', "a.py\nC\nm\ndef m(self)\nText."), (1, "a.py > f", "# File: a.py\n# function: def f()\n\ndef f(): pass\n", "a.py\nf\ndef f()"),
], lambda df: parsing.code_chunk_rows(df, "path", "content"))
rows("grf05_code_relations", _FILE, [("a.py", _PY), ("m.go", _GO)], "path, source, target, relation_type, label", [
    ("a.py", "a.py", "os", "imports", ""), ("a.py", "a.py", "re", "imports", ""), ("a.py", "a.py", "a.b", "imports", "c, d"), ("a.py", "a.py", ".", "imports", "e"), ("a.py", "a.py::K", "a.py::K.run", "contains", ""), ("a.py", "a.py::K", "a.py::K.go", "contains", ""),
    ("m.go", "m.go", "fmt", "imports", ""), ("m.go", "m.go", "net/http", "imports", ""), ("m.go", "m.go", "os", "imports", ""), ("m.go", "m.go::Server", "m.go::Server.Run", "contains", ""),
], lambda df: parsing.code_relations(df, "path", "content"))
rows("grf05_code_entities", _FILE, [("m.go", _GO)], "name, entity_type, description", [
    ("m.go", "module", "go file, 3 symbols"), ("fmt", "module", ""), ("net/http", "module", ""), ("os", "module", ""), ("m.go::Server", "struct", "type Server struct"), ("m.go::Server.Run", "method", "func (s *Server) Run(n int) error"), ("m.go::main", "function", "func main()"),
], lambda df: parsing.code_entities(df, "path", "content"))

# ---------------------------------------------------------------- relations of texts

_BODIES = "id int, title string, unit int, place string, text string"
rows("grf03_body_relations", _BODIES, [(1, "Pay", 0, "A", "GET /v1/pay. see AB-1, ab-2 `CD-3` **Key**"), (1, "Pay", 1, "B > C", "get /no and AB-1, EF-4; GET /v1/pay/"), (2, "", 0, "", "AB-1"), (3, "None", 0, "", "nothing")], "id, source, target, entity_type, relation_type, label", [
    (1, "Pay", "GET /v1/pay", "api", "documents", "A"), (1, "Pay", "AB-1", "ticket", "mentions_ticket", "A"), (1, "Pay", "EF-4", "ticket", "mentions_ticket", "B > C"),
], lambda df: extraction.body_relations(df, "id", "title", "text", label_col="place", unit_col="unit"))
rows("grf04_first_spellings", _BODIES, [(1, "Pay", 0, "A", "**Key Term** **key term** | Field | key term |"), (1, "Pay", 1, "B", "| Name | KEY TERM |\n|---|---|\n| a | b |")], "target, entity_type, relation_type, label", [
    ("Key Term", "concept", "mentions", "A"), ("Name", "concept", "has_attribute", "B"), ("KEY TERM", "concept", "has_attribute", "B"),
], lambda df: extraction.body_relations(df, "id", "title", "text", bold=True, headers=True, label_col="place", unit_col="unit"))
rows("grf02_link_relations", "id int, source string, ordinal int, kind string, target string, target_id string, in_section array<string>", [
    (1, "P", 0, "page", "Home", None, ["A", "B"]), (1, "P", 1, "page", "HOME", None, ["C"]), (1, "P", 2, "page", None, "77", []), (1, "P", 3, "url", None, "x", []), (1, "P", 4, "user", None, "kim", None), (1, "P", 5, "jira", None, "AB-1", ["A"]), (1, "P", 6, "page", None, None, []), (2, "", 0, "jira", None, "AB-2", []),
], "id, source, target, entity_type, relation_type, label", [
    (1, "P", "Home", "document", "references", "A / B"), (1, "P", "page:77", "document", "references", ""), (1, "P", "kim", "person", "mentions_user", ""), (1, "P", "AB-1", "ticket", "mentions_ticket", "A"),
], lambda df: extraction.link_relations(df, "id"))
