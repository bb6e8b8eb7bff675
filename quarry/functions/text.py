"""Text expressions (D3-D11, H29, H31) as native Spark columns.

Python's ``re`` character classes are Unicode-aware while Java's are ASCII
unless ``(?U)`` is given, and RE2 (the oracle engine) has no ``(?U)`` at
all. Where a class matters the patterns therefore spell the Unicode
property out (``\\p{L}``, ``\\p{Nd}``, ``\\p{Z}``), which Java and RE2 read
the same way. ``(?d)`` (UNIX_LINES) makes ``^``, ``$`` and ``.`` treat only
``\\n`` as a line break, as Python does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace set (str.isspace) as a portable class body.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"

# The extension -> language map, the language -> extension map
# and the defaults used with them.
EXTENSION_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".html": "HTML", ".css": "CSS",
    ".java": "Java", ".c": "C", ".cpp": "C++", ".cs": "C#", ".php": "PHP", ".rb": "Ruby",
    ".go": "Go", ".rs": "Rust", ".swift": "Swift", ".kt": "Kotlin", ".sh": "Shell",
    ".bat": "Batch", ".ps1": "PowerShell", ".sql": "SQL", ".md": "Markdown", ".json": "JSON",
    ".yml": "YAML", ".yaml": "YAML", ".xml": "XML",
}
DEFAULT_LANGUAGE_LABEL = "プログラミング"
DEFAULT_MAIN_LANGUAGE = "Python"
LANGUAGE_EXTENSION = {
    "Python": ".py", "JavaScript": ".js", "TypeScript": ".ts", "Java": ".java", "C++": ".cpp",
    "C#": ".cs", "Ruby": ".rb", "Go": ".go", "Rust": ".rs", "PHP": ".php",
}
DEFAULT_EXTENSION = ".txt"

# Truncation markers.
MARK_DIFF = "...(以下省略)"
MARK_CODE = "\n\n# ... (以下省略) ..."
MARK_ELLIPSIS = "..."

# Review URL labels and messages.
REVIEW_URL_PREFIX = "https://github.com/"
REVIEW_URL_RE = r"^https://github\.com/([^/]+)/([^/]+)/pull/(\p{Nd}+)"
REVIEW_URL_NOT_PR = "URLはGitHubのプルリクエストURLである必要があります。"
REVIEW_URL_BAD_FORMAT = "PRのURL形式が正しくありません。"

# Message clean-up.
MESSAGE_QUOTES = "\"'`"
MESSAGE_LABEL_RE = rf"^コミットメッセージ[:：][{WS}]*"

# Section summary default.
NO_SUMMARY = "分析結果なし"

LIST_ITEM_RE = rf"(?md)^(?:[-*•]|[{DIGIT}]+\.)[{WS}]*(.+)$"
SECTION_SPLIT_RE = rf"(?md)#+[{WS}]*|^[{DIGIT}]+\.[{WS}]+"
CODE_BLOCK_RE = rf"(?s)```(?:[{WORD}]+)?\n(.*?)```"
CODE_SPAN_RE = r"(?s)```.*?```"


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(col, rf"^[{WS}]+|[{WS}]+\z", "")


def list_items(text: Column) -> Column:
    """D3: bullet / numbered lines; if there are none, the non-empty
    paragraphs split on blank lines (stripped)."""
    items = F.regexp_extract_all(text, F.lit(LIST_ITEM_RE), 1)
    paras = F.filter(F.transform(F.split(text, "\n\n", -1), strip_ws), lambda p: p != "")
    return F.when(F.size(items) > 0, items).otherwise(paras)


def sections(text: Column) -> Column:
    """Split on ``#`` headings or line-start numbers; stripped, non-empty."""
    return F.filter(F.transform(F.split(text, SECTION_SPLIT_RE, -1), strip_ws), lambda s: s != "")


def section_parts(text: Column) -> Column:
    """D4 record: summary (first section), risks / suggestions (list items of
    the 2nd / 3rd section)."""
    s = sections(text)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(NO_SUMMARY)).alias("summary"),
        F.when(F.size(s) > 1, list_items(F.try_element_at(s, F.lit(2)))).otherwise(empty).alias("risks"),
        F.when(F.size(s) > 2, list_items(F.try_element_at(s, F.lit(3)))).otherwise(empty).alias("suggestions"),
    )


def code_block(text: Column) -> Column:
    """Body of the first fenced block, else the whole text."""
    has = text.rlike(CODE_BLOCK_RE)
    return F.when(has, F.regexp_extract(text, CODE_BLOCK_RE, 1)).otherwise(text)


def outside_code(text: Column) -> Column:
    """The text with every fenced span removed, stripped."""
    return strip_ws(F.regexp_replace(text, CODE_SPAN_RE, ""))


def review_url(url: Column) -> Column:
    """struct(owner, repo, number, error)."""
    is_pr = url.startswith(REVIEW_URL_PREFIX) & url.contains("/pull/")
    ok = url.rlike(REVIEW_URL_RE)
    err = (F.when(~is_pr, F.lit(REVIEW_URL_NOT_PR))
           .when(~ok, F.lit(REVIEW_URL_BAD_FORMAT)))
    good = is_pr & ok
    return F.struct(
        F.when(good, F.regexp_extract(url, REVIEW_URL_RE, 1)).alias("owner"),
        F.when(good, F.regexp_extract(url, REVIEW_URL_RE, 2)).alias("repo"),
        F.when(good, F.regexp_extract(url, REVIEW_URL_RE, 3)).alias("number"),
        err.alias("error"),
    )


def language_of(ext: Column) -> Column:
    """Language label of a file extension ('.py' -> 'Python')."""
    return F.coalesce(F.element_at(_map_literal(EXTENSION_LANGUAGE), ext), F.lit(DEFAULT_LANGUAGE_LABEL))


def extension_of(path: Column) -> Column:
    """Extension with its dot, as ``os.path.splitext`` gives it ('' if none)."""
    base = F.element_at(F.split(path, "/", -1), -1)
    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)\z", 1)
    return F.coalesce(ext, F.lit(""))


def file_slug(description: Column, language: Column) -> Column:
    """Lower-case, drop punctuation, whitespace runs -> '_'; if longer
    than 30 chars and more than 3 words keep 3; add the language's
    extension."""
    name = F.regexp_replace(F.lower(description), rf"[^{WORD}{WS}]", "")
    name = F.regexp_replace(name, rf"[{WS}]+", "_")
    words = F.split(name, "_", -1)
    short = F.when((F.length(name) > 30) & (F.size(words) > 3),
                   F.array_join(F.slice(words, 1, 3), "_")).otherwise(name)
    ext = F.coalesce(F.element_at(_map_literal(LANGUAGE_EXTENSION), language), F.lit(DEFAULT_EXTENSION))
    return F.concat(short, ext)


def truncate(text: Column, n: int, marker: str = MARK_ELLIPSIS, keep: int | None = None) -> Column:
    """Texts longer than ``n`` are cut to ``keep`` (default ``n``)
    characters and the marker appended."""
    keep = n if keep is None else keep
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, keep), F.lit(marker))).otherwise(text)


def clean_message(text: Column) -> Column:
    """Strip quotes / backticks at both ends, drop a leading label."""
    q = "".join("\\" + c for c in MESSAGE_QUOTES)
    stripped = F.regexp_replace(text, rf"^[{q}]+|[{q}]+\z", "")
    return F.regexp_replace(stripped, MESSAGE_LABEL_RE, "")
