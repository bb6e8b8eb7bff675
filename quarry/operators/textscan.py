"""Scan texts for secrets and personal data.

Each pattern is a literal, so Spark compiles it once per task. Documents are
first tested against the union of all patterns (one regex pass); only
documents with a hit pay for the per-pattern passes. Everything a finding
needs is computed inside its own row, so keys may be null or repeat and
nothing is shuffled: a marker character is put before every match, the marked
text is split into lines, and a line's markers are its matches, in the order
in which the matches are extracted.

Patterns may span lines (``\\s*``), so texts are never pre-split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

# Finding categories and their patterns, in scan order.
# Matching is case-insensitive.
PATTERNS: list[tuple[str, str]] = [
    ("APIキー", r'api[_-]?key["\']?\s*[:=]\s*["\']?([a-zA-Z0-9]{16,})["\']\s*'),
    ("APIキー", r'api[_-]?secret["\']?\s*[:=]\s*["\']?([a-zA-Z0-9]{16,})["\']\s*'),
    ("APIキー", r'access[_-]?key["\']?\s*[:=]\s*["\']?([a-zA-Z0-9]{16,})["\']\s*'),
    ("APIキー", r'OPENAI_API_KEY["\']?\s*[:=]\s*["\']?([a-zA-Z0-9-]{20,})["\']\s*'),
    ("APIキー", r'sk-[a-zA-Z0-9]{48}'),
    ("パスワード", r'password["\']?\s*[:=]\s*["\']?([^\'"\s]{3,})["\']\s*'),
    ("パスワード", r'passwd["\']?\s*[:=]\s*["\']?([^\'"\s]{3,})["\']\s*'),
    ("パスワード", r'pwd["\']?\s*[:=]\s*["\']?([^\'"\s]{3,})["\']\s*'),
    ("認証情報", r'bearer\s+[a-zA-Z0-9_-]{10,}'),
    ("認証情報", r'authorization["\']?\s*[:=]\s*["\']?bearer\s+([a-zA-Z0-9_-]{10,})["\']\s*'),
    ("認証情報", r'auth[_-]?token["\']?\s*[:=]\s*["\']?([a-zA-Z0-9_.-]{10,})["\']\s*'),
    ("秘密鍵", r'-----BEGIN\s+(?:RSA|OPENSSH|DSA|EC|PGP)\s+PRIVATE\s+KEY-----'),
    ("秘密鍵", r'private[_-]?key["\']?\s*[:=]\s*["\']?([a-zA-Z0-9/+]{10,})["\']\s*'),
    ("証明書", r'-----BEGIN\s+CERTIFICATE-----'),
    ("個人識別情報", r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'),
    ("個人識別情報", r'\b\d{3}-\d{2}-\d{4}\b'),
    ("個人識別情報", r'\b\d{4}-\d{4}-\d{4}-\d{4}\b'),
]

# Category column names of the summary and its messages.
CATEGORY_COLUMNS = [("APIキー", "api_key"), ("パスワード", "password"), ("認証情報", "auth"),
                    ("秘密鍵", "private_key"), ("証明書", "certificate"), ("個人識別情報", "pii")]
MSG_FOUND = "{n}件の機密情報の漏洩リスクが検出されました。"
MSG_SAFE = "機密情報の漏洩リスクは検出されませんでした。"

# Python re.IGNORECASE on str patterns: case-insensitive with Unicode case
# folding, and \b \d \s \w Unicode-aware.
FLAGS = "(?iuU)"


def java_pattern(p: str) -> str:
    return FLAGS + p


ANY_PATTERN = FLAGS + "|".join(f"(?:{p})" for _, p in PATTERNS)


#: stands before a match while lines are counted; one that a text itself
#: holds counts as its neighbour character, which no pattern tells apart
MARK, MARK_IN_TEXT = "\ue000", "\ue001"


def _line_numbers(text, pattern: str):
    """1-based line of each match of ``pattern``, in order of the matches."""
    marked = F.regexp_replace(F.translate(text, MARK, MARK_IN_TEXT), F.lit(java_pattern(pattern)), F.lit(MARK + "$0"))
    return F.flatten(F.transform(
        F.split(marked, "\n", -1),
        lambda line, i: F.array_repeat(i + 1, (F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))).cast("int"))))


def _any_hit(text, patterns):
    return F.coalesce(text.rlike(FLAGS + "|".join(f"(?:{p})" for _, p in patterns)), F.lit(False))


def sensitive_scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   patterns: Sequence[tuple[str, str]] = PATTERNS) -> DataFrame:
    """One row per match: (key, pattern_id, type, line, match, context).

    ``line`` is 1 + the number of '\\n' before the match start; ``context``
    is that line's text (of CRLF texts without the trailing CR, as a line
    splitter that treats CRLF as one break returns it). Overlapping patterns
    give one row each. Every row of ``docs`` is scanned for itself: null and
    repeated keys are kept as they are; a null text has no findings.
    """
    t = F.col("_text")
    # The union test is evaluated as a generator output after the spread:
    # a plain filter would be pushed below the exchange into the scan, where
    # a small corpus sits in one split.
    hits = (spread(docs.select(docs[key].alias("_key"), docs[text].alias("_text")))
            .select("_key", "_text", F.explode(F.array(_any_hit(t, patterns))).alias("_hit"))
            .filter(F.col("_hit")).drop("_hit"))
    per_pattern = F.array(*[
        F.struct(F.lit(i).alias("pattern_id"), F.lit(cat).alias("type"),
                 F.regexp_extract_all(t, F.lit(java_pattern(p)), 0).alias("matches"),
                 F.when(t.rlike(java_pattern(p)), _line_numbers(t, p)).alias("lines"))
        for i, (cat, p) in enumerate(patterns)
    ])
    found = (hits.select("_key", F.split(t, "\n", -1).alias("_lines"), F.inline(per_pattern))
             .filter(F.size("matches") > 0)
             .select("_key", "_lines", "pattern_id", "type",
                     F.inline(F.arrays_zip(F.col("matches").alias("match"), F.col("lines").alias("line")))))
    return found.select(
        F.col("_key").alias(key), "pattern_id", "type", F.col("line").cast("long").alias("line"), "match",
        F.regexp_replace(F.element_at("_lines", F.col("line")), "\r\\z", "").alias("context"))


def sensitive_summary(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      patterns: Sequence[tuple[str, str]] = PATTERNS) -> DataFrame:
    """For every row of ``docs``: issue count, count per category,
    ``safe`` and the message; rows without findings have count 0 and are
    safe. Computed inside the row, so repeated and null keys stay apart."""
    t = F.col("_text")
    rows = (spread(docs.select(docs[key].alias("_key"), docs[text].alias("_text")))
            .select("_key", "_text", F.explode(F.array(_any_hit(t, patterns))).alias("_hit")))

    def matches(category):
        return sum((F.size(F.regexp_extract_all(t, F.lit(java_pattern(p)), 0)) for c, p in patterns if c == category), F.lit(0))

    out = rows.select(F.col("_key").alias(key), *[
        F.when(F.col("_hit"), matches(label)).otherwise(F.lit(0)).cast("long").alias(name) for label, name in CATEGORY_COLUMNS])
    n = sum((F.col(name) for _, name in CATEGORY_COLUMNS[1:]), F.col(CATEGORY_COLUMNS[0][1]))
    msg = F.when(n > 0, F.concat(F.lit(MSG_FOUND.split("{n}")[0]), n.cast("string"),
                                  F.lit(MSG_FOUND.split("{n}")[1]))).otherwise(F.lit(MSG_SAFE))
    return out.select(key, n.alias("n_issues"), *[name for _, name in CATEGORY_COLUMNS],
                      (n == 0).alias("safe"), msg.alias("message"))


def sensitive_overall(summary: DataFrame) -> DataFrame:
    """D2 overall: one row over all documents."""
    n = F.sum("n_issues")
    return summary.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(n, F.lit(0)).alias("n_issues"),
                       F.count_if(~F.col("safe")).alias("n_unsafe_documents"),
                       (F.coalesce(n, F.lit(0)) == 0).alias("safe"))
