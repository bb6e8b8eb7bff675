"""Roll-ups of pass/fail result records.

A result value may be a record (object with ``passed``, ``description``,
``category``, ``execution_time`` ...), a bare boolean, a number or anything
else. Values are carried as VARIANT so one column holds all of them; the
status rule is evaluated with native variant functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default labels used by the result reports.
DEFAULT_CATEGORY = "その他"
DEFAULT_DESCRIPTION = "No description"
NON_RECORD_DESCRIPTION = "No description available"
UNKNOWN = "不明"
DISPLAY_WIDTH = 57
DISPLAY_CUT = 54


def _kind(v: Column) -> Column:
    """Coarse kind of a variant: object / boolean / number / null / other."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == F.lit("VOID")), F.lit("null"))
        .when(t.startswith("OBJECT"), F.lit("object"))
        .when(t == F.lit("BOOLEAN"), F.lit("boolean"))
        .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit("number"))
        .otherwise(F.lit("other"))
    )


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON scalar held in a variant."""
    k = _kind(v)
    return (
        F.when(k == "boolean", F.try_variant_get(v, "$", "boolean"))
        .when(k == "number", F.try_variant_get(v, "$", "double") != 0)
        .when(k == "null", F.lit(False))
        .when(F.schema_of_variant(v) == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
        .when(F.schema_of_variant(v).startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .otherwise(F.lit(True))
    )


def result_status(df: DataFrame, value: str = "value") -> DataFrame:
    """A1: add ``kind``, ``passed`` and ``status`` (PASS / FAIL / ERROR).

    record -> its ``passed`` field (missing = False); boolean / number ->
    truthiness; anything else -> ERROR, which counts as failed.
    """
    v = F.col(value)
    k = _kind(v)
    passed_field = F.try_variant_get(v, "$.passed", "variant")
    passed = (
        F.when(k == "object", F.coalesce(truthy(passed_field), F.lit(False)))
        .when(k.isin("boolean", "number"), truthy(v))
        .otherwise(F.lit(False))
    )
    status = (
        F.when(k.isin("object", "boolean", "number"),
               F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")))
        .otherwise(F.lit("ERROR"))
    )
    return df.withColumn("kind", k).withColumn("passed", passed).withColumn("status", status)


def _py_type_name(v: Column) -> Column:
    t = F.schema_of_variant(v)
    name = (F.when(v.isNull() | (t == "VOID"), F.lit("NoneType"))
            .when(t == "STRING", F.lit("str"))
            .when(t.startswith("ARRAY"), F.lit("list"))
            .otherwise(F.lower(t)))
    return F.concat(F.lit("<class '"), name, F.lit("'>"))


def _field(v: Column, path: str, typ: str, default) -> Column:
    return F.coalesce(F.try_variant_get(v, path, typ), F.lit(default))


def normalize_results(df: DataFrame, key: str = "test_key", value: str = "value") -> DataFrame:
    """Flatten result values to (test_key, kind, passed, status, description,
    category, source_file, method, execution_time, execution_timestamp).

    Optional ``default_category`` / ``default_source`` columns (from the
    result document) fill record values lacking those keys; a record's
    method defaults to its test key.
    """
    cols = set(df.columns)
    cat_default = F.coalesce(F.col("default_category"), F.lit(DEFAULT_CATEGORY)) \
        if "default_category" in cols else F.lit(DEFAULT_CATEGORY)
    src_default = F.coalesce(F.col("default_source"), F.lit(UNKNOWN)) \
        if "default_source" in cols else F.lit(UNKNOWN)
    s = result_status(df, value)
    v = F.col(value)
    is_rec = F.col("kind") == "object"
    desc = (F.when(is_rec, _field(v, "$.description", "string", DEFAULT_DESCRIPTION))
            .when(F.col("kind").isin("boolean", "number"), F.lit(NON_RECORD_DESCRIPTION))
            .otherwise(F.concat(F.lit("Invalid data type: "), _py_type_name(v))))
    return s.select(
        F.col(key).alias("test_key"), "kind", "passed", "status",
        desc.alias("description"),
        F.when(is_rec, F.coalesce(F.try_variant_get(v, "$.category", "string"), cat_default))
         .otherwise(F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.when(is_rec, F.coalesce(F.try_variant_get(v, "$.source_file", "string"), src_default))
         .otherwise(F.lit(UNKNOWN)).alias("source_file"),
        F.when(is_rec, F.coalesce(F.try_variant_get(v, "$.method", "string"), F.col(key)))
         .otherwise(F.lit(UNKNOWN)).alias("method"),
        F.when(is_rec, _field(v, "$.execution_time", "double", 0.0))
         .otherwise(F.lit(0.0)).alias("execution_time"),
        F.when(is_rec, _field(v, "$.execution_timestamp", "string", UNKNOWN))
         .otherwise(F.lit(UNKNOWN)).alias("execution_timestamp"),
    )


def pass_stats(results: DataFrame) -> DataFrame:
    """A2: total, passed, failed, pass rate in percent; no rows -> zeros."""
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("passed"))
    return results.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        F.when(total > 0, passed.cast("double") / total.cast("double") * 100.0)
         .otherwise(F.lit(0.0)).alias("pass_rate"),
    )


def category_rollup(results: DataFrame) -> DataFrame:
    """A3: per category (sorted) passed / total.

    The list of passed tests per category is :func:`category_detail`, kept
    as a long table: a category can hold any number of tests.
    """
    return (
        results.groupBy("category")
        .agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_total"))
        .orderBy("category")
    )


def category_detail(results: DataFrame) -> DataFrame:
    """A3 detail: passed tests with their category, sorted by category and
    key."""
    return (results.filter(F.col("passed"))
            .select("category", "test_key", "source_file", "method", "execution_time",
                    "execution_timestamp", "description")
            .orderBy("category", "test_key"))


def display_name(key: Column) -> Column:
    """``file::test`` -> ``file > test`` (file without ``_test_results``,
    ``_`` -> space), cut to 54 chars + '...' when longer than 57."""
    parts = F.split(key, "::", -1)
    test = F.element_at(parts, -1)
    file = F.replace(F.replace(F.element_at(parts, 1), F.lit("_test_results"), F.lit("")),
                     F.lit("_"), F.lit(" "))
    name = F.when(F.size(parts) > 1, F.concat(file, F.lit(" > "), test)).otherwise(test)
    return F.when(F.length(name) > DISPLAY_WIDTH,
                  F.concat(F.substring(name, 1, DISPLAY_CUT), F.lit("..."))).otherwise(name)


def summary_listing(results: DataFrame) -> DataFrame:
    """A4: one line per result sorted by key: display name, status,
    description."""
    return results.select(
        "test_key", display_name(F.col("test_key")).alias("display_name"), "status", "description",
    ).orderBy("test_key")


def timing_stats(results: DataFrame) -> DataFrame:
    """A5: total, mean and max execution time and the slowest test.

    Sums run in decimal (to the nanosecond) so the result does not depend
    on the order in which partial sums are combined across tasks."""
    t = F.col("execution_time").cast("decimal(38,9)")
    return results.agg(
        F.coalesce(F.sum(t).cast("double"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.sum(t).cast("double") / F.count(t).cast("double"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.max("execution_time"), F.lit(0.0)).alias("max_time"),
        F.min_by("test_key", F.struct(-F.col("execution_time"), F.col("test_key"))).alias("longest_test"),
    )


def outcome_summary(outcomes: DataFrame, success: str = "success", rule: str = "batch") -> DataFrame:
    """Total / success / failure; ``ok`` = no failures and total > 0
    (``batch``) or at least one success (``report``)."""
    total = F.count(F.lit(1))
    ok_n = F.count_if(F.coalesce(F.col(success), F.lit(False)))
    ok = ((total - ok_n) == 0) & (total > 0) if rule == "batch" else ok_n > 0
    return outcomes.agg(total.alias("total"), ok_n.alias("success"),
                        (total - ok_n).alias("failure"), ok.alias("ok"))
