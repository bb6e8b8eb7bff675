"""Result JSON documents -> one row per test result.

Two layouts are accepted:

* nested: ``{"test_timestamp", "category", "test_file", "results": {test: record}}``
* flat:   ``{"test_timestamp", "category", test: record, ...}`` (every key
  except ``test_timestamp`` and ``category`` is a test).

Records of the nested layout get the document's category (default
``その他``), a source file derived from ``test_file`` and the test name as
method when they lack them. When several documents hold the same test, the
later document (by modification time, then path) wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.results import DEFAULT_CATEGORY, UNKNOWN
from quarry.session import spread

# File-name patterns and keys of the result documents.
RESULT_GLOB = "test_*_results.json"
REPORT_DIR_MARK = "report_"
FLAT_META_KEYS = ("test_timestamp", "category")


def read_result_files(spark: SparkSession, root: str, glob: str = RESULT_GLOB) -> DataFrame:
    """(path, file_order, content) for every result file under ``root``;
    files inside ``report_*`` folders are skipped."""
    df = (spark.read.option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).text(root, wholetext=True))
    return (
        df.select(F.col("_metadata.file_path").alias("path"),
                  F.col("_metadata.file_modification_time").alias("file_order"),
                  F.col("value").alias("content"))
        .filter(~F.element_at(F.split(F.col("path"), "/"), -2).contains(REPORT_DIR_MARK))
    )


def parse_result_documents(docs: DataFrame, content: str = "content", path: str = "path",
                           order: str = "file_order") -> DataFrame:
    """(test_key, value VARIANT, path, default_category, default_source); the
    defaults apply to record values lacking those keys."""
    doc = F.try_parse_json(F.col(content))
    nested = F.try_variant_get(doc, "$.results", "map<string,variant>")
    flat = F.try_variant_get(doc, "$", "map<string,variant>")
    file_cat = F.coalesce(F.try_variant_get(doc, "$.category", "string"), F.lit(DEFAULT_CATEGORY))
    test_file = F.coalesce(F.try_variant_get(doc, "$.test_file", "string"), F.lit(UNKNOWN))
    src = F.replace(F.replace(test_file, F.lit("tests/test_file/"), F.lit("src/")),
                    F.lit("test_"), F.lit(""))
    entries = F.when(nested.isNotNull(), nested).otherwise(
        F.map_filter(flat, lambda k, _v: ~k.isin(*FLAT_META_KEYS)))
    docs = spread(docs, path)  # JSON parsing is CPU-bound per document
    exploded = docs.select(
        F.col(path).alias("path"), F.col(order).alias("_order"),
        file_cat.alias("_file_category"), src.alias("_file_source"),
        F.explode(entries).alias("test_key", "_raw"))
    latest = exploded.groupBy("test_key").agg(
        F.max_by(F.struct(F.col("_raw").alias("value"), F.col("path"),
                          F.col("_file_category").alias("default_category"),
                          F.col("_file_source").alias("default_source")),
                 F.struct(F.col("_order"), F.col("path"))).alias("r"))
    return latest.select("test_key", "r.value", "r.path", "r.default_category", "r.default_source")
