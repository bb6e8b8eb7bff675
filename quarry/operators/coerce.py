"""Report cells as pandas hands them on (N1): columns whose cells are all numbers lose their text.

A column of numbers with a missing cell, or with a decimal among its whole numbers, becomes one of floats, so
``10`` is profiled as ``10.0``; one of whole numbers without gaps loses signs, spaces and leading zeros. What a
column is follows from three flags (all cells numeric, any missing, any decimal), found in one
pass by a hash aggregate with one row per column, which the projection reads from a broadcast row as wide as the schema, so
building the plan runs no job and the flags travel with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.schema_infer import profiled_columns, unpivot_cells

# What the CSV parser reads as a whole number and as a decimal.
WHOLE_RE = r"^[ \t]*[+-]?[0-9]{1,18}[ \t]*$"
DECIMAL_RE = r"(?i)^[ \t]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)[ \t]*$"


def float_text(number: Column) -> Column:
    """A double as Python's ``str`` writes it."""
    plain, size = number.cast("string"), F.abs(number)
    whole = (size < 1e16) & (number == F.floor(number))
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([^E]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    shifted = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    return (F.when(F.isnan(number), F.lit("nan")).when(size == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(number == 0, F.when(plain.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .when(whole, F.concat(number.cast("decimal(20,0)").cast("string"), F.lit(".0")))
            .when(~plain.contains("E"), plain)
            .when((size >= 1e-4) & (size < 1e16), shifted)
            .otherwise(exponent))


def column_kinds(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    """(col_pos, kind): ``float``, ``int`` or ``object`` per column, one row each."""
    cells = unpivot_cells(df, rn, columns)
    v = F.col("value")
    flags = cells.groupBy("col_pos").agg(
        F.bool_and(v.isNull() | v.rlike(DECIMAL_RE)).alias("numbers"), F.bool_and(v.isNull() | v.rlike(WHOLE_RE)).alias("whole"),
        F.bool_or(v.isNull()).alias("gaps"), F.bool_or(v.rlike(DECIMAL_RE) & ~v.rlike(r"^[ \t]*[+-]?[0-9]+[ \t]*$")).alias("decimals"))
    return flags.select("col_pos", F.when(F.col("whole") & ~F.col("gaps"), F.lit("int"))
                        .when(F.col("numbers") & (F.col("whole") | F.col("decimals")), F.lit("float")).otherwise(F.lit("object")).alias("kind"))


def as_pandas(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` (text cells; missing ones null, as ``read_report_csv`` reads them) with every cell as the text
    of pandas' value. Empty cells count as missing."""
    cols = list(columns) if columns is not None else profiled_columns(df, rn)
    text = {c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols}
    df = df.select(rn, *[text[c].alias(c) for c in cols])
    kinds = column_kinds(df, rn, cols).agg(F.map_from_entries(F.collect_list(F.struct("col_pos", "kind"))).alias("_kinds"))
    # a table of one row, as wide as the schema
    df = df.withColumn("_one", F.lit(1)).join(F.broadcast(kinds.withColumn("_one", F.lit(1))), "_one")

    def cell(x):
        v, kind, trimmed = x["v"], x["kind"], F.trim(x["v"], F.lit(" \t"))
        return (F.when(kind == "float", float_text(trimmed.try_cast("double")))
                .when(kind == "int", trimmed.try_cast("long").cast("string")).otherwise(v))
    # one lambda for all columns: as an expression per column the generated code would outgrow the compiler
    pairs = F.array(*[F.struct(F.col(f"`{c}`").alias("v"), F.try_element_at("_kinds", F.lit(i)).alias("kind")) for i, c in enumerate(cols)])
    cells = df.select(rn, F.transform(pairs, cell).alias("_cells"))
    return cells.select(rn, *[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(cols)])
