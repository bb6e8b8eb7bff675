"""Type votes, dominant type, sample value, consistency and the
schema table of a text table.

Input is any DataFrame plus the name of a column giving row order (``rn``,
1-based file order for a CSV scan, or a dense table key). All other columns
are profiled as text.

Plan shape: the table is unpivoted inside the scan stage (``Generate``), and
one hash aggregate keyed by (column, type) with map-side partial aggregation
collapses each partition to at most 6 rows per column before the shuffle.
Votes, first-seen rows, blank counts and the row of the first non-blank cell
come from that pass (fixed-width buffers only, so it stays a code-generated
hash aggregate). The schema table then needs one more pass that picks the
sample cell and the inconsistent cells of each column against the
per-column result (one row per column, bounded by the schema width, so it
is broadcast); the stand-alone operators (sample_value, inconsistent_cells)
do the same lookups separately.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import spread
from quarry.functions.celltype import STR, cell_type_of, is_blank_cell, strip_py

LOW_CONSISTENCY = 0.9
SAMPLE_CAP = 10
# Per-column tables have one row per profiled column; they are broadcast
# only while that count (known from the schema before any job runs) stays
# under this bound, otherwise the joins are left to the planner.
MAX_BROADCAST_COLUMNS = 20000


def per_column(df: DataFrame, n_columns: int) -> DataFrame:
    """Broadcast hint for a table with one row per column, bounded by the
    schema width."""
    return F.broadcast(df) if n_columns <= MAX_BROADCAST_COLUMNS else df


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profiled_columns(df: DataFrame, rn: str) -> list[str]:
    return [c for c in df.columns if c != rn]


def column_list(df: DataFrame, rn: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_pos, column_name) for the profiled columns, from the schema only."""
    spark = df.sparkSession
    cols = list(columns) if columns is not None else profiled_columns(df, rn)
    schema = T.StructType([T.StructField("col_pos", T.IntegerType(), False),
                           T.StructField("column_name", T.StringType(), False)])
    return spark.createDataFrame([(i, c) for i, c in enumerate(cols)], schema)


def unpivot_cells(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (col_pos, column_name, rn, value); one row per cell."""
    cols = list(columns) if columns is not None else profiled_columns(df, rn)
    if not cols:
        return df.select(F.lit(0).alias("col_pos"), F.lit("").alias("column_name"),
                         F.col(rn).cast("long").alias("rn"), F.lit("").alias("value")).limit(0)
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column_name"),
                 F.col(_q(c)).cast("string").alias("value"))
        for i, c in enumerate(cols)
    ])
    rows = spread(df.select(F.col(rn).cast("long").alias("rn"), *[F.col(_q(c)) for c in cols]), "rn")
    return rows.select("rn", F.inline(cells)).select("col_pos", "column_name", "rn", "value")


def cell_types(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None,
               keep_stripped: bool = False) -> DataFrame:
    """T1 applied to every cell: (col_pos, column_name, rn, value, data_type)."""
    cells = unpivot_cells(df, rn, columns).withColumn("_s", strip_py(F.col("value")))
    out = cells.withColumn("data_type", cell_type_of(F.col("value"), F.col("_s")))
    return out if keep_stripped else out.drop("_s")


def type_votes(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    """Votes per (column, type) with the first row each type was seen in.

    Also carries what later steps need from the same pass: blank cells
    (null or '') inside the vote and the first non-blank value.
    """
    typed = cell_types(df, rn, columns, keep_stripped=True)
    nonblank = F.col("value").isNotNull() & (F.col("_s") != "")
    # Only fixed-width aggregates here, so the plan is a hash aggregate with
    # map-side combining (a string in the buffer would force a sort-based
    # aggregate over every cell); the sample value is fetched by its row.
    return (
        typed.groupBy("col_pos", "column_name", "data_type")
        .agg(F.count(F.lit(1)).alias("votes"),
             F.min("rn").alias("first_rn"),
             F.count_if(is_blank_cell(F.col("value"))).alias("blank_votes"),
             F.min(F.when(nonblank, F.col("rn"))).alias("first_nonblank_rn"))
    )


def column_stats(votes: DataFrame, columns: DataFrame, n_columns: int = 0) -> DataFrame:
    """T3+T4+T5 from the vote table; one row per column (left join keeps
    columns without any cell: type STR, rate 1.0)."""
    dom = F.max_by(F.struct("data_type", "votes", "blank_votes"),
                   F.struct(F.col("votes"), -F.col("first_rn")))
    per_col = (
        votes.groupBy("col_pos")
        .agg(dom.alias("dom"),
             F.sum("votes").alias("n_cells"),
             F.sum("blank_votes").alias("n_blank"),
             F.min("first_nonblank_rn").alias("sample_rn"))
    )
    n = F.coalesce(F.col("n_cells"), F.lit(0))
    bad = (n - F.coalesce(F.col("n_blank"), F.lit(0))) - (F.col("dom.votes") - F.col("dom.blank_votes"))
    bad = F.coalesce(bad, F.lit(0)).cast("long")
    return (
        columns.join(per_column(per_col, n_columns), "col_pos", "left")
        .select(
            "col_pos", "column_name",
            F.coalesce(F.col("dom.data_type"), F.lit(STR)).alias("data_type"),
            "sample_rn",
            n.cast("long").alias("n_cells"),
            bad.alias("inconsistent_count"),
            F.when(n == 0, F.lit(1.0))
             .otherwise(F.lit(1.0) - bad.cast("double") / n.cast("double"))
             .alias("consistency_rate"),
        )
    )


def sample_values(df: DataFrame, stats: DataFrame, rn: str = "rn",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """T4: the value of each column's first non-blank cell, looked up by
    (column, row) in a pass without type inference; the lookup side has one
    row per column."""
    n_cols = len(list(columns) if columns is not None else profiled_columns(df, rn))
    want = per_column(stats.filter(F.col("sample_rn").isNotNull())
                      .select("col_pos", F.col("sample_rn").alias("rn")), n_cols)
    hit = unpivot_cells(df, rn, columns).join(want, ["col_pos", "rn"])
    return hit.groupBy("col_pos").agg(F.min("value").alias("sample_value"))


def column_types(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column from the vote pass alone: type, counts and
    consistency (no sample values, so no second pass)."""
    n_cols = len(list(columns) if columns is not None else profiled_columns(df, rn))
    return column_stats(type_votes(df, rn, columns), column_list(df, rn, columns), n_cols).drop("sample_rn")


def profile_columns(df: DataFrame, rn: str = "rn", columns: Sequence[str] | None = None) -> DataFrame:
    n_cols = len(list(columns) if columns is not None else profiled_columns(df, rn))
    stats = column_stats(type_votes(df, rn, columns), column_list(df, rn, columns), n_cols)
    samples = sample_values(df, stats, rn, columns)
    return (stats.join(samples, "col_pos", "left")
            .withColumn("sample_value", F.coalesce(F.col("sample_value"), F.lit("")))
            .drop("sample_rn"))


def dominant_type(df: DataFrame, rn: str = "rn") -> DataFrame:
    """(column_name, data_type)."""
    return column_types(df, rn).select("col_pos", "column_name", "data_type")


def sample_value(df: DataFrame, rn: str = "rn") -> DataFrame:
    """T4: first non-blank value in row order, else ''."""
    return profile_columns(df, rn).select("col_pos", "column_name", "sample_value")


def consistency(df: DataFrame, rn: str = "rn") -> DataFrame:
    """T5: consistency rate and inconsistent count per column."""
    return column_types(df, rn).select(
        "col_pos", "column_name", "data_type", "consistency_rate", "inconsistent_count")


def inconsistent_cells(df: DataFrame, rn: str = "rn", stats: DataFrame | None = None,
                       cap: int | None = None, salt_buckets: int | None = None) -> DataFrame:
    """Non-blank cells whose type differs from their column's dominant
    type, as a long table (col_pos, column_name, rn, value); ``rn`` is the
    1-based row of the cell.

    ``cap`` keeps the first ``cap`` per column. A column may hold most of the
    table, so the top-k runs in two steps: first within (column, salt) so no
    task sees a whole hot column, then over at most cap*salt_buckets
    survivors per column. The salt count follows
    ``spark.sql.shuffle.partitions``, which is sized to the data on a
    cluster, so the per-task share of a hot column stays bounded.
    """
    if salt_buckets is None:
        salt_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    stats = stats if stats is not None else column_types(df, rn)
    dom = per_column(stats.select("col_pos", F.col("data_type").alias("dominant_type")),
                     len(profiled_columns(df, rn)))
    bad = (
        cell_types(df, rn)
        .filter(~is_blank_cell(F.col("value")))
        .join(dom, "col_pos")
        .filter(F.col("data_type") != F.col("dominant_type"))
        .select("col_pos", "column_name", "rn", "value")
    )
    if cap is None:
        return bad
    salted = bad.withColumn("_salt", F.pmod(F.xxhash64("rn"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("col_pos", "_salt").orderBy("rn")
    w2 = Window.partitionBy("col_pos").orderBy("rn")
    return (
        salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= cap)
        .withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= cap)
        .select("col_pos", "column_name", "rn", "value")
    )


def schema_table(df: DataFrame, rn: str = "rn", cap: int = SAMPLE_CAP, coerce: str | None = None) -> DataFrame:
    """One row per column in header order, the profiler's record layout. ``coerce="pandas"``
    profiles the cells as pandas hands them on (see ``operators.coerce``), not as the file's text.

    Two passes over the table: the vote aggregate, then one that types the
    cells again and keeps, per column, the sample cell and the first ``cap``
    inconsistent cells. The row_number filter trims every map task to ``cap``
    rows per column before the exchange, so a column that holds most of
    the inconsistent cells doesn't land in one task."""
    if coerce is not None:
        if coerce != "pandas":
            raise ValueError(f"unknown coercion {coerce}")
        from quarry.operators.coerce import as_pandas
        df = as_pandas(df, rn)
    cols = profiled_columns(df, rn)
    stats = column_stats(type_votes(df, rn), column_list(df, rn), len(cols))
    lookup = per_column(stats.select("col_pos", F.col("data_type").alias("dominant_type"), "sample_rn"),
                        len(cols))
    bad = ~is_blank_cell(F.col("value")) & (F.col("data_type") != F.col("dominant_type"))
    kinds = F.array_compact(F.array(F.when(F.col("rn") == F.col("sample_rn"), F.lit(0)), F.when(bad, F.lit(1))))
    picked = (cell_types(df, rn).join(lookup, "col_pos").where(bad | (F.col("rn") == F.col("sample_rn")))
              .select("col_pos", "rn", "value", F.explode(kinds).alias("_kind")))
    order = Window.partitionBy("col_pos", "_kind").orderBy("rn")
    found = (picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap)
             .groupBy("col_pos")
             .agg(F.min(F.when((F.col("_kind") == 0) & (F.col("_r") == 1), F.col("value"))).alias("sample_value"),
                  F.array_sort(F.collect_list(F.when(F.col("_kind") == 1, F.struct("rn", "value")))).alias("_s"))
             .select("col_pos", "sample_value", F.transform("_s", lambda x: x["value"]).alias("samples")))
    return (
        stats.join(per_column(found, len(cols)), "col_pos", "left")
        .select(
            "col_pos",
            F.col("column_name").alias("COLUMN_ORIGIN_NAME"),
            F.col("data_type").alias("DATA_TYPE"),
            F.lit("").alias("COLUMN_AFTER_NAME"),
            F.lit("").alias("DESCRIPTION"),
            F.coalesce(F.col("sample_value"), F.lit("")).alias("SAMPLE_DATA"),
            F.col("consistency_rate").alias("CONSISTENCY_RATE"),
            F.col("inconsistent_count").alias("INCONSISTENT_COUNT"),
            F.coalesce(F.col("samples"), F.array().cast("array<string>")).alias("INCONSISTENT_SAMPLES"),
        )
        .orderBy("col_pos")
    )


def low_consistency(schema: DataFrame, threshold: float = LOW_CONSISTENCY) -> DataFrame:
    """Columns whose consistency rate is below ``threshold``."""
    return schema.filter(F.col("CONSISTENCY_RATE") < F.lit(threshold))


def type_census(schema: DataFrame) -> DataFrame:
    """Number of columns per inferred type, of a schema table or of ``column_types``."""
    return schema.groupBy("DATA_TYPE").agg(F.count(F.lit(1)).alias("n_columns"))


def table_profile(df: DataFrame, rn: str = "rn", threshold: float = LOW_CONSISTENCY) -> DataFrame:
    """Header count, record count and number of low-consistency columns
    as a single row."""
    n_headers = len(profiled_columns(df, rn))
    stats = column_types(df, rn)
    return stats.agg(
        F.lit(n_headers).cast("long").alias("header_count"),
        F.coalesce(F.max("n_cells"), F.lit(0)).cast("long").alias("record_count"),
        F.count_if(F.col("consistency_rate") < F.lit(threshold)).alias("low_consistency_columns"),
    )
