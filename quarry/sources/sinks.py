"""Schema documents and selector exports.

S7 writes one JSON document per profiled table: the schema records (with
their first 10 inconsistent samples) and the consistency summary per
column. The full list of inconsistent cells can be as large as the table,
so it is written next to the document as a JSON-lines long table rather
than inlined.

S8 writes the selector table as CSV (fixed columns, then the data-attribute
keys as extra columns in sorted order, every field quoted, newlines turned
into spaces, escaped quotes in xpaths unescaped) and as JSON lines with
everything kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTOR_CSV_COLUMNS = ("group", "name", "text_value", "id", "class", "css", "xpath", "full_xpath",
                        "element_type", "category")


def schema_document(schema: DataFrame) -> DataFrame:
    """One row ``document`` (JSON text) from a schema table.
    ``schema`` has one row per column, so the document is bounded by the
    table's width."""
    rec = F.struct(
        F.col("col_pos"),
        F.struct("COLUMN_ORIGIN_NAME", "DATA_TYPE", "COLUMN_AFTER_NAME", "DESCRIPTION", "SAMPLE_DATA",
                 "CONSISTENCY_RATE", "INCONSISTENT_COUNT", "INCONSISTENT_SAMPLES").alias("schema"),
        F.struct(F.col("COLUMN_ORIGIN_NAME").alias("column_name"), F.col("DATA_TYPE").alias("data_type"),
                 F.col("CONSISTENCY_RATE").alias("consistency_rate"),
                 F.col("INCONSISTENT_COUNT").alias("inconsistent_count")).alias("consistency"))
    doc = schema.agg(F.array_sort(F.collect_list(rec)).alias("_r"))
    return doc.select(F.to_json(F.struct(
        F.transform("_r", lambda r: r["schema"]).alias("schema"),
        F.transform("_r", lambda r: r["consistency"]).alias("consistency_results"))).alias("document"))


def write_schema_document(schema: DataFrame, cells: DataFrame, path: str) -> str:
    """S7 sink: ``{path}/document`` (one JSON document) and
    ``{path}/inconsistent_cells`` (JSON lines: column, row, value)."""
    schema_document(schema).write.mode("overwrite").text(f"{path}/document")
    cells.select("column_name", F.col("rn").alias("row"), "value").write.mode("overwrite").json(
        f"{path}/inconsistent_cells")
    return path



def selector_csv_frame(selectors: DataFrame, data_keys: list[str] | None = None,
                       max_columns: int | None = None) -> DataFrame:
    """The CSV layout as a DataFrame of strings. ``data_keys`` (the
    data-attribute keys that become columns, sorted) is looked up from the
    data when not given: every key is a column, as a CSV's layout needs. With ``max_columns``
    only the first so many by name are, and the rest of an element's attributes stay
    together as JSON in a column ``data_other``."""
    more = False
    if data_keys is None:
        keys = selectors.select(F.explode(F.map_keys("data")).alias("k")).distinct().orderBy("k")
        data_keys = sorted(r["k"] for r in (keys if max_columns is None else keys.limit(max_columns + 1)).collect())
        if max_columns is not None:
            more, data_keys = len(data_keys) > max_columns, data_keys[:max_columns]

    def clean(c):
        return F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), "[\r\n]+", " ")

    fixed = [clean(c).alias(c) if c not in ("xpath", "full_xpath")
             else F.replace(clean(c), F.lit('\\"'), F.lit('"')).alias(c) for c in SELECTOR_CSV_COLUMNS]
    extra = [F.regexp_replace(F.coalesce(F.element_at(F.col("data"), F.lit(k)), F.lit("")), "[\r\n]+", " ").alias(k)
             for k in data_keys if k not in SELECTOR_CSV_COLUMNS]
    if more:
        rest = F.map_filter("data", lambda k, _: ~F.array_contains(F.lit(data_keys), k))
        extra.append(F.when(F.size(rest) > 0, clean(F.to_json(rest))).otherwise(F.lit("")).alias("data_other"))
    return selectors.select(*fixed, *extra)


def write_selector_exports(selectors: DataFrame, path: str) -> str:
    """S8 sink: ``{path}/csv`` (quoted CSV with header) and ``{path}/json``."""
    selector_csv_frame(selectors).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(
        f"{path}/csv")
    selectors.write.mode("overwrite").json(f"{path}/json")
    return path


def read_selector_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV of ``write_selector_exports`` as written: text columns, empty fields as empty text."""
    return spark.read.option("header", True).option("nullValue", "\u0000").csv(f"{path}/csv")
