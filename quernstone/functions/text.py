"""Column functions over text: normalisation, hashes, patterns, names.

Built-in expressions throughout; NFKC, which Spark has not, goes through a pandas
UDF and only for text beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Unicode and Python see it, for Java's regular expressions.
SPACES = r"[\s\x1c-\x1f\x85   -     　]"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _alnum(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).lower() if c.isalnum()))


def nfkc(text: Column) -> Column:
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(_nfkc(text))


def normalized_name(name: Column) -> Column:
    """Key under which entity names merge: NFKC, lower case, without white space, - and _; null gives an empty key."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), rf"({SPACES}|[-_])+", ""))


def match_name(name: Column) -> Column:
    """As ``normalized_name``, but dots go too; for matching entities in evaluation."""
    return F.regexp_replace(normalized_name(name), r"\.", "")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda own: own if own is None else [x if x is None else unicodedata.normalize("NFKC", x) for x in own])


def match_names(names: Column) -> Column:
    """``match_name`` of each name of a list."""
    plain = F.forall(names, lambda x: F.coalesce(x, F.lit("")).rlike(r"^[\x00-\x7f]*$"))
    return F.transform(F.when(plain, names).otherwise(_nfkc_all(names)), lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), rf"({SPACES}|[-_.])+", "")))


def alnum_name(name: Column) -> Column:
    """NFKC, lower case, letters and digits only; for calibration."""
    text = F.coalesce(name, F.lit(""))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.regexp_replace(F.lower(text), "[^a-z0-9]", "")).otherwise(_alnum(text))


def scoped_name(name: Column) -> Column:
    """What follows the first ``::``; null without one."""
    rest = F.regexp_extract(name, r"^.*?::(.*)$", 1)
    return F.when(name.contains("::"), rest)


def short_name(name: Column) -> Column:
    """The last dotted part of the scoped name."""
    return F.element_at(F.split(scoped_name(name), r"\."), -1)


def display_name(name: Column) -> Column:
    return F.coalesce(scoped_name(name), name)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stable_seed(text: Column, base: int) -> Column:
    """base + SHA-256 of the text modulo ten million, folded over eight-digit parts of the hash."""
    digest, out = F.sha2(text, 256), F.lit(0).cast("long")
    for at in range(1, 65, 8):
        part = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        out = (out * (2**32 % 10_000_000) + part) % 10_000_000
    return out + base


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACES}+", " "))


def text_anchor(text: Column, max_chars: int = 200) -> Column:
    return F.substring(collapsed(text), 1, max_chars)


def slug(text: Column) -> Column:
    """Lower case, white space as -, other signs than letters, digits, _ and - dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), rf"{SPACES}+", "-"), r"[^\p{L}\p{N}_-]", "")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


#: Patterns of endpoints and tickets, and signs that are cut off what they find.
ENDPOINT = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[A-Za-z0-9_\-/{}:.~]+)"
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
ENDPOINT_TRIM = "`'\").,;:"
TERM_TRIM = "·•:,.;\"'`"
#: Words that are no identifiers of their own.
COMMON_WORDS = (
    "this", "that", "with", "from", "into", "true", "false", "none", "null", "self", "args", "kwargs", "return", "import", "class", "function", "def", "type", "interface", "struct",
    "package", "module", "main", "test", "data", "config", "user", "name", "value", "result", "error", "string", "int", "float", "bool", "list", "dict", "object",
)


def trimmed(text: Column, signs: str, left: bool = True) -> Column:
    """The text without any of the signs at its end and, unless told otherwise, its beginning."""
    one = "[" + "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in signs) + "]+"
    return F.regexp_replace(text, f"^{one}|{one}$" if left else f"{one}$", "")


def api_endpoints(text: Column) -> Column:
    """METHOD /path mentions in order, each once, without closing signs and slashes; the root alone is none."""
    method, path = (F.regexp_extract_all(text, F.lit(ENDPOINT), k) for k in (1, 2))
    bare = lambda p: F.regexp_replace(trimmed(p, ENDPOINT_TRIM, left=False), "/+$", "")
    found = F.zip_with(method, path, lambda m, p: F.when(bare(p) != "", F.concat(m, F.lit(" "), bare(p))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def ticket_keys(text: Column) -> Column:
    """Ticket keys such as AB-12 in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TICKET), 1))


def identifiers(text: Column, min_len: int = 4) -> Column:
    """ASCII identifiers of ``min_len`` characters or more in order, each once, case kept, common words left out."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), 0)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= min_len) & ~F.lower(x).isin(*COMMON_WORDS)))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores in order."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)


def without_code(text: Column) -> Column:
    """Prose: fenced code gives way to a line feed, inline code to a space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", "\n"), r"`[^`\n]+`", " ")


def term(text: Column) -> Column:
    """A term without white space and list signs around it."""
    return trimmed(F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+$", ""), TERM_TRIM)


def sound_term(text: Column, least: int = 2, most: int = 60) -> Column:
    """Whether a term is of a fair length, has no tab and has a letter or a sign of an East Asian script."""
    return F.length(text).between(least, most) & ~text.contains("\t") & text.rlike(r"[\p{L}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]")


def is_cjk(char: Column) -> Column:
    return char.rlike(r"^[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]$")


def first_of_case(values: Column) -> Column:
    """The values without those that an earlier one equals but for case."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, F.lower), F.lower(x)) == i + 1)


def bold_terms(text: Column, least: int = 2, most: int = 60) -> Column:
    """Sound terms in bold, first spelling of each."""
    spans = F.regexp_extract_all(text, F.lit(r"\*\*[^\n*]+?\*\*|__[^\n_]+?__"), 0)
    found = F.transform(spans, lambda x: term(F.substring(x, F.lit(3), F.length(x) - 4)))
    return first_of_case(F.filter(found, lambda x: sound_term(x, least, most)))


def table_cells(line: Column) -> Column:
    """Cells of a table row, empty ones left out."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.filter(F.transform(F.split(bare, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def table_headers(text: Column, most: int = 12) -> Column:
    """Header cells above separator rows, as terms of two characters or more, first spelling of each; tables of 2 to ``most`` columns count."""
    lines = F.split(text, "\n")
    heads = F.filter(F.arrays_zip(lines.alias("line"), F.slice(F.concat(lines, F.array(F.lit(""))), 2, F.size(lines)).alias("next")), lambda x: x["next"].rlike(SEPARATOR))
    cells = F.filter(F.transform(heads, lambda x: table_cells(x["line"])), lambda c: F.size(c).between(2, most))
    return first_of_case(F.filter(F.transform(F.flatten(cells), term), lambda x: F.length(x) >= 2))


#: Fixed pattern: the row below a table's header.
SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"


def has_table(text: Column) -> Column:
    return text.rlike("(?m)" + SEPARATOR)


def has_code_block(text: Column) -> Column:
    return text.contains("```")


def lead_paragraph(text: Column) -> Column:
    """What stands before the first heading line."""
    return F.regexp_replace(F.regexp_replace(text, r"(?ms)^#{1,6}\s.*\z", ""), r"^\s+|\s+\z", "")


def meta_view(title: Column, section_path: Column) -> Column:
    return F.concat_ws("\n", F.when(F.trim(title) != "", title), F.when(F.trim(section_path) != "", section_path))


def breadcrumb(*parts: Column) -> Column:
    return F.concat_ws(" > ", *(F.when(F.trim(p) != "", p) for p in parts))


def repo_label(url: Column) -> Column:
    """Last part of an address, without .git."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


#: Languages by file ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".java": "java", ".kt": "kotlin", ".scala": "scala", ".go": "go", ".rs": "rust", ".c": "c",
    ".cpp": "cpp", ".h": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql", ".html": "html",
    ".css": "css", ".scss": "scss", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".md": "markdown", ".txt": "plaintext",
    ".dockerfile": "dockerfile", ".gradle": "gradle",
}


def language_of(path: Column, languages: dict[str, str] | None = None) -> Column:
    """Programming language by file name or ending; what stands before the last colon is passed over; empty if unknown."""
    own = F.element_at(F.split(path, ":"), -1)
    base = F.lower(F.element_at(F.split(own, "/"), -1))
    ending = F.lower(F.regexp_extract(own, r"(\.[^.]*)$", 1))
    out = F.lit("")
    for k, v in (LANGUAGES if languages is None else languages).items():
        out = F.when(ending == k, v).otherwise(out)
    return F.when(base.isin("dockerfile", "makefile"), base).otherwise(out)


#: Answers that mean yes and no.
YES, NO = ("yes", "y", "true", "예", "네"), ("no", "n", "false", "아니오", "아니요")


def without_thought(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def yes_no(text: Column) -> Column:
    """True, false or null from the first line of an answer, after any block of thought."""
    bare = F.lower(F.regexp_replace(without_thought(text), rf"^{SPACES}+|{SPACES}+$", ""))
    line = trimmed(F.regexp_replace(F.regexp_extract(bare, r"^([^\r\n]*)", 1), rf"^{SPACES}+|{SPACES}+$", ""), ".,!?\"'`")
    return F.when(line.isin(*YES), True).when(line.isin(*NO), False).when(line.startswith("yes"), True).when(line.startswith("no"), False)


def number(text: Column) -> Column:
    """Double, or null for what is none, empty or the word none."""
    return text.try_cast("double")


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Shell patterns of which * and ? cross slashes, any of."""
    out = F.lit(False)
    for p in patterns:
        regex = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in p)
        out = out | path.rlike(f"(?s)^{regex}$")
    return out


def plural_variants(name: Column) -> Column:
    """A name, with s, with ies for a y that ends a word in no vowel and y, else with es after a hiss."""
    low = F.lower(name)
    ies = F.when(low.rlike("y$") & ~low.rlike("[aeou]y$"), F.concat(F.regexp_replace(low, "y$", ""), F.lit("ies")))
    made = F.array(low, F.concat(low, F.lit("s")), F.when(low.rlike("y$"), ies).when(low.rlike("(s|x|z|ch|sh)$"), F.concat(low, F.lit("es"))))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def name_tokens(path: Column) -> Column:
    """The parts of a file's name without its ending, between - and _."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return F.filter(F.split(stem, "[_-]"), lambda x: x != "")


def names_product(path: Column, product: Column) -> Column:
    """Whether a part of a file's name is a product's name in one of its forms."""
    return F.arrays_overlap(name_tokens(path), plural_variants(product))


#: Folders that no scan enters.
EXCLUDED_FOLDERS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "node_modules", "bower_components", "vendor", "dist", "build",
    "target", ".next", ".nuxt", "out", ".idea", ".vscode", ".gradle", ".terraform",
)


def excluded(path: Column) -> Column:
    """Whether any part of a path is a folder that no scan enters."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_FOLDERS)))


def file_kept(path: Column, size: Column, endings: list[str], limit_kb: int) -> Column:
    """Whether a file has an ending of the list, which has the dots, and is no larger than so many KB."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(*endings) & (size <= limit_kb * 1024)


def product_of(path: Column, scopes: list[tuple[str, list[str], list[str]]]) -> Column:
    """The first scope (name, paths, excluded paths) that holds a path; null if none does."""
    return F.coalesce(*(F.when(glob_match(path, paths) & ~glob_match(path, out), name) for name, paths, out in scopes))


def collapsed_length(text: Column) -> Column:
    return F.length(collapsed(text))


#: A character is a token where no vocabulary is at hand.
def count_tokens(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def first_tokens(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(text, F.lit(1), F.greatest(n, F.lit(0)))


def last_tokens(text: Column, n: int) -> Column:
    """The last n tokens; none for n = 0 or less."""
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def cut_with_dots(text: Column, n: int) -> Column:
    """The first n tokens without white space at their end and with three dots, if there are more."""
    short = F.concat(F.regexp_replace(first_tokens(text, n), rf"{SPACES}+$", ""), F.lit("..."))
    return F.lit("") if n <= 0 else F.when(count_tokens(text) <= n, text).otherwise(short)


def shrunk(text: Column, n: int) -> Column:
    """A struct of the text and whether it was cut: to three characters a token, then by tenths until it has n tokens, or 100 characters."""
    if n <= 0:
        return F.struct(text.alias("text"), F.lit(False).alias("cut"))
    start = F.least(F.length(text), F.lit(3 * n)).cast("int")
    steps = F.sequence(F.lit(1), F.lit(40))
    size = F.aggregate(steps, start, lambda a, _: F.when((a > n) & (a > 100), F.floor(a * 0.9).cast("int")).otherwise(a))
    cut = count_tokens(text) > n
    return F.struct(F.when(cut, F.substring(text, F.lit(1), size)).otherwise(text).alias("text"), cut.alias("cut"))


def clone_folder(data_dir: Column, url: Column) -> Column:
    """Where a repository is kept: by the last part of its address."""
    return F.concat(data_dir, F.lit("/git_repos/"), repo_label(url))


def class_language(classes: Column) -> Column:
    """The language that a class of an element names; empty without one."""
    named = F.filter(F.coalesce(classes, F.array().cast("array<string>")), lambda c: c.startswith("language-"))
    return F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 10, 1000), F.lit(""))
