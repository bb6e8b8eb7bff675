"""The selector registry (group, name) -> selector.

The registry is a small dimension table. Lookups are left joins; Spark's
adaptive execution turns them into broadcast joins when the runtime size of
the registry is under the broadcast threshold and keeps a shuffle join when
it is not, so no size is assumed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY_COLUMNS = ("group", "name", "selector_type", "selector_value", "description")
REQUIRED_COLUMNS = ("group", "name", "selector_type", "selector_value")

# Descriptions applied by the registry repair, by selector name.
DESCRIPTION_MAP = {
    "all_traffic_tab": "全トラフィックタブ（最高信頼度セレクタ）",
    "all_traffic_tab_xpath": "全トラフィックタブ（XPath）",
    "all_traffic_tab_text": "全トラフィックタブ（テキスト検索用）",
    "navbar": "ナビゲーションバー",
    "menu_nav": "メニューナビゲーション",
    "date_picker_trigger": "日付カレンダーを開くボタン",
    "date_input": "日付入力フィールド",
    "apply_button": "適用ボタン",
    "calendar_prev_month": "カレンダーの前月ボタン",
    "calendar_next_month": "カレンダーの次月ボタン",
    "download_csv_button": "CSVダウンロードボタン",
    "search_button": "検索ボタン",
    "refresh_button": "更新ボタン",
    "search_input": "検索入力フィールド",
    "checkbox_item": "チェックボックス",
    "radio_button": "ラジオボタン",
    "dropdown_select": "ドロップダウン選択",
    "data_table": "データテーブル",
    "table_header": "テーブルヘッダー",
    "table_body": "テーブル本体",
    "table_row": "テーブル行",
    "table_cell": "テーブルセル",
    "chart_container": "チャートコンテナ",
    "kpi_value": "KPI値",
    "report_title": "レポートタイトル",
}

FOUND, NO_NAME, NO_GROUP = "found", "no_name", "no_group"


def read_registry_csv(spark, path: str, encoding: str = "utf-8") -> DataFrame:
    """S3 scan: registry CSV with a header; ``pos`` = (file, row in file),
    so "later row wins" follows file order and then path order."""
    from quarry.sources.reports import with_file_row_number
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return (with_file_row_number(df, "_rn")
            .withColumn("pos", F.struct(F.col("_file").alias("file"), F.col("_rn").alias("row")))
            .drop("_file", "_rn"))


def registry_load(rows: DataFrame, order: str = "pos") -> DataFrame:
    """S3: one row per (group, name); a later row wins; a missing
    description becomes ''."""
    # keep-last as an aggregate (partial on the map side), so a (group,
    # name) repeated on a third of the rows never lands in one sort.
    last = F.max_by(F.struct("selector_type", "selector_value", "description"), F.col(order))
    return (
        rows.groupBy("group", "name").agg(last.alias("_r"))
        .select("group", "name", "_r.selector_type", "_r.selector_value",
                F.coalesce(F.col("_r.description"), F.lit("")).alias("description"))
    )


def registry_lookup(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolve (group, name) requests; ``status`` tells found / unknown
    name in a known group / unknown group apart."""
    groups = registry.select(F.col("group").alias("_g")).distinct().withColumn("_group_known", F.lit(True))
    sel = registry.select(F.col("group").alias("_rg"), F.col("name").alias("_rn"),
                          "selector_type", "selector_value", "description", F.lit(True).alias("_found"))
    out = (
        requests
        .join(sel, (F.col("group") == F.col("_rg")) & (F.col("name") == F.col("_rn")), "left")
        .join(groups, F.col("group") == F.col("_g"), "left")
    )
    status = (F.when(F.col("_found"), F.lit(FOUND))
              .when(F.col("_group_known"), F.lit(NO_NAME))
              .otherwise(F.lit(NO_GROUP)))
    return out.withColumn("status", status).drop("_rg", "_rn", "_found", "_g", "_group_known")


def registry_repair(rows: DataFrame) -> DataFrame:
    """R2: take the description from the fixed name -> text map when the name
    is in it, project to 5 columns. A table that lacks a required column has
    no usable row; a row whose value is merely empty is kept ('')."""
    desc_map = F.create_map(*[F.lit(x) for kv in DESCRIPTION_MAP.items() for x in kv])
    if not set(REQUIRED_COLUMNS) <= set(rows.columns):
        missing = [c for c in (*REQUIRED_COLUMNS, "description") if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing}).limit(0)
    elif "description" not in rows.columns:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    return rows.select(
        F.coalesce(F.col("group"), F.lit("")).alias("group"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("selector_type"), F.lit("")).alias("selector_type"),
        F.coalesce(F.col("selector_value"), F.lit("")).alias("selector_value"),
        F.coalesce(F.element_at(desc_map, F.col("name")), F.col("description"), F.lit("")).alias("description"),
    )


def registry_report(selectors: DataFrame, order: str = "pos") -> DataFrame:
    """Grouped listing; one ``group,name,element_type,css,category`` line
    per selector, groups in first-seen order, selectors in row order.

    Returned long (group_first_pos, group, pos, line), sorted, rather than
    one text blob: a group can hold any number of selectors. Missing fields
    print as ``None`` like the text template does.
    """
    g = F.coalesce(F.col("group"), F.lit("other"))
    txt = [F.coalesce(F.col(c).cast("string"), F.lit("None"))
           for c in ("group", "name", "element_type", "css")]
    line = F.concat_ws(",", *txt, F.coalesce(F.col("category"), F.lit("")))
    rows = selectors.select(g.alias("group"), F.col(order).alias("pos"), line.alias("line"))
    firsts = rows.groupBy("group").agg(F.min("pos").alias("group_first_pos"))
    return (rows.join(firsts, "group")
            .select("group_first_pos", "group", "pos", "line")
            .orderBy("group_first_pos", "pos"))
