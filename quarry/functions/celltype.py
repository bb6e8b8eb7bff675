"""The logical type of one text cell, as a native Spark expression.

The label set and rule order are fixed by the profiler being matched:
null/'' -> STR; trimmed lower-case in {true,false,0,1,yes,no} -> BOOLEAN;
parses as a (comma-stripped) Python-style float -> INT when the value is a
finite whole number and the text has no '.', else FLOAT; YYYY[/-]M[/-]D ->
DATE; the same followed by [T or space]H:M -> TIMESTAMP (prefix match);
anything else -> STR.

Spark's own string->double cast accepts things Python's float() rejects
("1d") and rejects things it accepts ("1_000", full-width digits), so a
regex gate decides *whether* a cell is numeric and the cast only computes
the value of cells that passed the gate.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six type labels and the boolean spellings.
STR, INT, FLOAT, DATE, TIMESTAMP, BOOLEAN = "STR", "INT", "FLOAT", "DATE", "TIMESTAMP", "BOOLEAN"
TYPE_LABELS = (STR, INT, FLOAT, DATE, TIMESTAMP, BOOLEAN)
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no")

# Python's str.strip() removes Unicode White_Space plus U+001C..U+001F.
_WS = r"[\s\x{1C}-\x{1F}]"
STRIP_RE = rf"(?U)^{_WS}+|{_WS}+$"

# Python float() literal grammar (PEP 515 underscores, optional exponent),
# allowing the whitespace float() itself tolerates.
_DIGITS = r"\d(?:_?\d)*"
# float() itself tolerates Unicode White_Space around the number (but not
# U+001C..U+001F, which str.strip() removes).
NUMBER_RE = (
    rf"(?U)^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
    rf"(?:[eE][+-]?{_DIGITS})?\s*$"
)
SPECIAL_FLOAT_RE = r"(?iU)^\s*[+-]?(?:inf|infinity|nan)\s*$"
DATE_RE = r"(?U)^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"
TIMESTAMP_RE = r"(?U)^\d{4}[/-]\d{1,2}[/-]\d{1,2}[T\s]\d{1,2}:\d{1,2}"


@lru_cache(maxsize=1)
def _decimal_digit_map() -> tuple[str, str]:
    """All Unicode decimal digits (category Nd) and their ASCII values.

    Python's float() accepts any of them; Spark's cast only ASCII, so cells
    that pass the gate are translated first. Built from the Unicode tables,
    not listed by hand.
    """
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


# ASCII characters Python treats as whitespace; any non-ASCII character is
# treated as "maybe" by the cheap gates below and left to the regexes.
ASCII_WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
NUMBER_START = "+-.0123456789"
PLAIN_NUMBER_CHARS = "0123456789+-.eE \t\n\x0b\x0c\r"  # no U+001C..U+001F: float() rejects them


def _maybe_space(ch: Column) -> Column:
    return (F.instr(F.lit(ASCII_WS), ch) > 0) | (ch > F.lit("\x7f"))


def strip_py(col: Column) -> Column:
    """Python ``str.strip()`` semantics (Spark's ``trim`` only strips ' ').
    The regex runs only for cells whose first or last character may be
    whitespace."""
    edge = _maybe_space(F.substring(col, 1, 1)) | _maybe_space(F.substring(col, -1, 1))
    return F.when((F.length(col) > 0) & edge, F.regexp_replace(col, STRIP_RE, "")).otherwise(col)


def numeric_value(stripped: Column) -> Column:
    """Double value of a cell already known to match ``NUMBER_RE``.
    Non-ASCII digits are translated only when the cell has any non-ASCII
    character."""
    src, dst = _decimal_digit_map()
    ascii_only = F.length(stripped) == F.octet_length(stripped)
    # ASCII cells: drop commas, underscores and ASCII spaces with a character
    # map (no regex); other cells: map Unicode digits, then drop separators.
    ascii_clean = F.translate(stripped, ",_" + ASCII_WS, "")
    unicode_clean = F.regexp_replace(F.translate(stripped, src, dst), r"(?U)[,_\s\x{1C}-\x{1F}]", "")
    return F.when(ascii_only, ascii_clean).otherwise(unicode_clean).try_cast("double")


def cell_type_of(value: Column, stripped: Column) -> Column:
    """Label one cell from its raw value and its stripped form (computed
    once by the caller, so the regex strip is not repeated per branch)."""
    no_commas = F.replace(stripped, F.lit(","), F.lit(""))
    # Cheap first-character gates keep the regexes off cells that cannot
    # match (most text cells); non-ASCII first characters always go on.
    f = F.substring(no_commas, 1, 1)
    may_number = ((F.instr(F.lit(NUMBER_START), f) > 0) | f.isin("i", "I", "n", "N") | _maybe_space(f)
                  | (F.length(no_commas) == 0))
    g = F.substring(stripped, 1, 1)
    may_date = ((g >= F.lit("0")) & (g <= F.lit("9"))) | (g > F.lit("\x7f"))
    # Plain ASCII numbers (only digits, sign, point, exponent and ASCII
    # spaces) are decided by the cast itself, which accepts exactly
    # Python's float() syntax on that alphabet; everything else (underscores,
    # Unicode digits or spaces, inf / nan) goes through the regex gate.
    plain = (F.length(no_commas) > 0) & (F.translate(no_commas, PLAIN_NUMBER_CHARS, "") == "")
    is_number = F.when(plain, no_commas.try_cast("double").isNotNull()).otherwise(
        may_number & (no_commas.rlike(NUMBER_RE) | no_commas.rlike(SPECIAL_FLOAT_RE)))
    # NaN and +-inf give NaN for ``% 1``, so one test covers finite and whole
    whole = (numeric_value(no_commas) % 1) == 0
    return (
        F.when(value.isNull() | (value == ""), F.lit(STR))
        .when((F.length(stripped) <= 5) & F.lower(stripped).isin(*BOOLEAN_WORDS), F.lit(BOOLEAN))
        .when(is_number, F.when(whole & ~stripped.contains("."), F.lit(INT)).otherwise(F.lit(FLOAT)))
        .when(may_date & stripped.rlike(DATE_RE), F.lit(DATE))
        .when(may_date & stripped.rlike(TIMESTAMP_RE), F.lit(TIMESTAMP))
        .otherwise(F.lit(STR))
    )


def cell_type(value: Column) -> Column:
    """Label one cell. ``value`` must be a string column. (Prefer
    :func:`cell_type_of` with a precomputed stripped column in wide plans.)"""
    return cell_type_of(value, strip_py(value))


def is_blank_cell(value: Column) -> Column:
    """Cells the consistency check skips: null or exactly ''."""
    return value.isNull() | (value == "")
