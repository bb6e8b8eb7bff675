"""Registered queries: one per operator of the inventory.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the driver tables (or from data Spark derives from them). Column names match
the oracle SQL in ``quarry.plans.oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import page_elements as pe
from quarry.operators import registry as rg
from quarry.operators import report as rp
from quarry.operators import results as rs
from quarry.operators import schema_infer as si
from quarry.operators import selectors as sl
from quarry.operators import text_structure as ts
from quarry.operators import textscan as sc
from quarry.plans import fixtures as fx
from quarry.plans.fixtures import report_runs, report_text, result_documents
from quarry.session import load_table, materialize, spread
from quarry.sources import reports as rpt
from quarry.sources import sinks as sk
from quarry.sources.pages import COMPACT, TASKS_A_CORE, extract_elements, page_texts, with_ancestors, with_text
from quarry.sources.results_json import parse_result_documents, read_result_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


def report(spark: SparkSession, sf_dir: str, table: str, key) -> DataFrame:
    df = load_table(spark, sf_dir, table)
    if isinstance(key, str):
        return report_text(df, key)
    return report_text(df.withColumn("_key", key), "_key").drop("_key")


# ---- T1-T10 ---------------------------------------------------------------

@query("cell_types")
def q_cell_types(spark, sf_dir):
    return si.cell_types(report(spark, sf_dir, "events", "event_id")).select(
        "column_name", "rn", "value", "data_type")


@query("type_votes")
def q_type_votes(spark, sf_dir):
    return si.type_votes(report(spark, sf_dir, "orders", "o_orderkey")).select(
        "column_name", "data_type", "votes", "first_rn")


@query("dominant_type")
def q_dominant_type(spark, sf_dir):
    return si.dominant_type(report(spark, sf_dir, "orders", "o_orderkey")).select(
        "column_name", "data_type")


@query("sample_value")
def q_sample_value(spark, sf_dir):
    return si.sample_value(report(spark, sf_dir, "customer", "c_custkey")).select(
        "column_name", "sample_value")


@query("consistency")
def q_consistency(spark, sf_dir):
    return si.consistency(report(spark, sf_dir, "orders", "o_orderkey")).select(
        "column_name", "data_type", "consistency_rate", "inconsistent_count")


@query("inconsistent_cells")
def q_inconsistent_cells(spark, sf_dir):
    return si.inconsistent_cells(report(spark, sf_dir, "orders", "o_orderkey")).select(
        "column_name", "rn", "value")


def _flat_schema(schema: DataFrame) -> DataFrame:
    return schema.select(
        "COLUMN_ORIGIN_NAME", "DATA_TYPE", "COLUMN_AFTER_NAME", "DESCRIPTION", "SAMPLE_DATA",
        "CONSISTENCY_RATE", "INCONSISTENT_COUNT",
        F.array_join("INCONSISTENT_SAMPLES", "|").alias("INCONSISTENT_SAMPLES"))


@query("schema_table")
def q_schema_table(spark, sf_dir):
    return _flat_schema(si.schema_table(report(spark, sf_dir, "orders", "o_orderkey")))


@query("schema_table_pandas")
def q_schema_table_pandas(spark, sf_dir):
    """T7 over cells as pandas hands them on: whole numbers with gaps are floats."""
    return _flat_schema(si.schema_table(fx.gappy_report(load_table(spark, sf_dir, "events")), coerce="pandas"))


@query("low_consistency")
def q_low_consistency(spark, sf_dir):
    return _flat_schema(si.low_consistency(si.schema_table(fx.uneven_report(load_table(spark, sf_dir, "events")))))


def _lineitem_key():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


@query("type_census")
def q_type_census(spark, sf_dir):
    return si.type_census(si.column_types(report(spark, sf_dir, "lineitem", _lineitem_key()))).withColumnRenamed(
        "data_type", "DATA_TYPE")


@query("table_profile")
def q_table_profile(spark, sf_dir):
    return si.table_profile(report(spark, sf_dir, "events", "event_id"))


# ---- P1-P5 ---------------------------------------------------------------

RUN_DATE = "2024-01-21"
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


@query("add_report_date")
def q_add_report_date(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select("event_id", "event_type")
    return rp.add_report_date(ev, RUN_DATE)


@query("date_range")
def q_date_range(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return rp.date_range(ev, "ts", RUN_DATE, start="2024-01-10", end="2024-01-20").select(
        "event_id", "event_type")


@query("date_range_yesterday")
def q_date_range_yesterday(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return rp.date_range(ev, "ts", RUN_DATE, yesterday=True).select("event_id", "user_id")


@query("traffic_filter")
def q_traffic_filter(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return rp.traffic_filter(ev, "event_type", "click", known=EVENT_TYPES).select("event_id", "value")


@query("preview")
def q_preview(spark, sf_dir):
    return rp.preview(report(spark, sf_dir, "events", "event_id"), "rn", 5)


@query("report_dispatch")
def q_report_dispatch(spark, sf_dir):
    runs = report_runs(load_table(spark, sf_dir, "events"))
    return rp.report_dispatch(runs, "cv_attribute").select("event_id", "report_type", "success")


# ---- S4, A1-A6 -----------------------------------------------------------

def _results(spark, sf_dir):
    docs = result_documents(load_table(spark, sf_dir, "events"))
    return rs.normalize_results(parse_result_documents(docs))


@query("results_load")
def q_results_load(spark, sf_dir):
    return _results(spark, sf_dir)


@query("results_files")
def q_results_files(spark, sf_dir):
    """S4 over landed files: some folders are reports of earlier runs and are skipped."""
    path = fx.write_result_files(spark, load_table(spark, sf_dir, "events"))
    files = read_result_files(spark, path, glob="part-*")
    return files.select(F.regexp_extract("path", r"run_(\d+)/", 1).cast("long").alias("run"),
                        F.size(F.split(F.regexp_replace("content", "\n\\z", ""), "\n")).cast("long").alias("n_lines"))


@query("result_status")
def q_result_status(spark, sf_dir):
    docs = result_documents(load_table(spark, sf_dir, "events"))
    return rs.result_status(parse_result_documents(docs)).select("test_key", "kind", "passed", "status")


@query("pass_stats")
def q_pass_stats(spark, sf_dir):
    return rs.pass_stats(_results(spark, sf_dir))


@query("category_rollup")
def q_category_rollup(spark, sf_dir):
    return rs.category_rollup(_results(spark, sf_dir))


@query("summary_listing")
def q_summary_listing(spark, sf_dir):
    return rs.summary_listing(_results(spark, sf_dir))


@query("timing_stats")
def q_timing_stats(spark, sf_dir):
    return rs.timing_stats(_results(spark, sf_dir))


@query("outcome_summary")
def q_outcome_summary(spark, sf_dir):
    return rs.outcome_summary(report_runs(load_table(spark, sf_dir, "events")), "success", "batch")


# ---- S3, R1-R3 -------------------------------------------------------------


@query("registry_load")
def q_registry_load(spark, sf_dir):
    return rg.registry_load(fx.registry_rows(load_table(spark, sf_dir, "part")))


@query("registry_lookup")
def q_registry_lookup(spark, sf_dir):
    part = load_table(spark, sf_dir, "part")
    registry = rg.registry_load(fx.registry_rows(part))
    return rg.registry_lookup(fx.registry_requests(part), registry).select(
        "request_id", "group", "name", "status", "selector_type", "selector_value", "description")


@query("registry_repair")
def q_registry_repair(spark, sf_dir):
    return rg.registry_repair(fx.registry_rows(load_table(spark, sf_dir, "part")))


@query("registry_report")
def q_registry_report(spark, sf_dir):
    return rg.registry_report(fx.selector_records(load_table(spark, sf_dir, "part")))


# ---- D3-D11 -----------------------------------------------------------------
CONV_KEYS = ("conv_id", "turn")


@query("list_items")
def q_list_items(spark, sf_dir):
    return ts.list_items(load_table(spark, sf_dir, "conversations"), CONV_KEYS)


@query("sections")
def q_sections(spark, sf_dir):
    out = ts.sections(fx.analysis_text(load_table(spark, sf_dir, "conversations")), CONV_KEYS)
    return out.select(*CONV_KEYS, "summary", F.array_join("risks", "\n").alias("risks"),
                      F.array_join("suggestions", "\n").alias("suggestions"))


@query("code_blocks")
def q_code_blocks(spark, sf_dir):
    return ts.code_blocks(fx.fenced_text(load_table(spark, sf_dir, "conversations")), CONV_KEYS)


@query("review_url")
def q_review_url(spark, sf_dir):
    return ts.review_urls(fx.review_urls(load_table(spark, sf_dir, "pages")), ["page_id"])


@query("language_of")
def q_language_of(spark, sf_dir):
    return ts.languages(fx.document_files(load_table(spark, sf_dir, "documents")), ["doc_id"])


@query("main_language")
def q_main_language(spark, sf_dir):
    files = fx.document_files(load_table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "pos")
    return ts.main_language(files, ["source"])


@query("file_slug")
def q_file_slug(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    lang = F.element_at(F.array(F.lit("Python"), F.lit("Go"), F.lit("Cobol")),
                        (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int"))
    return ts.file_slugs(conv.withColumn("language", lang), CONV_KEYS)


@query("truncate_text")
def q_truncate_text(spark, sf_dir):
    out = ts.truncate_texts(load_table(spark, sf_dir, "documents"), ["doc_id"], n=4000)
    return out.select("doc_id", "truncated", F.length("truncated").alias("n"))


@query("clean_message")
def q_clean_message(spark, sf_dir):
    return ts.clean_messages(fx.quoted_messages(load_table(spark, sf_dir, "conversations")), CONV_KEYS)


# ---- D1-D2 -------------------------------------------------------------------


@query("sensitive_scan")
def q_sensitive_scan(spark, sf_dir):
    return sc.sensitive_scan(load_table(spark, sf_dir, "documents"))


@query("sensitive_scan_rt")
def q_sensitive_scan_rt(spark, sf_dir):
    return sc.sensitive_scan(fx.secret_documents(load_table(spark, sf_dir, "customer")))


@query("sensitive_summary")
def q_sensitive_summary(spark, sf_dir):
    return sc.sensitive_summary(load_table(spark, sf_dir, "documents"))


@query("sensitive_summary_rt")
def q_sensitive_summary_rt(spark, sf_dir):
    return sc.sensitive_summary(fx.secret_documents(load_table(spark, sf_dir, "customer")))


# ---- H1-H31 -------------------------------------------------------------------


def _elements(spark, sf_dir, shared: bool = False, columns=None, tags=None):
    """Element table of the real pages; ``shared`` writes it once for plans
    that read it in several branches, ``columns`` and ``tags`` are all that the parse builds."""
    el = extract_elements(load_table(spark, sf_dir, "pages"), columns=columns, tags=tags)
    return materialize(el) if shared else el


def _spread_customers(spark, sf_dir):
    """The customers in many short partitions: their narrow rows move, not the pages rendered from them."""
    return spread(load_table(spark, sf_dir, "customer"), "c_custkey", per_core=TASKS_A_CORE)


def _rt_elements(spark, sf_dir, shared: bool = False, columns=None, tags=None, steps=None, having=None):
    el = extract_elements(fx.customer_pages(_spread_customers(spark, sf_dir)), columns=columns, tags=tags, steps=steps,
                          having=having, spread_out=False)
    return materialize(el) if shared else el


def _by_page(spark, sf_dir, query, columns, facts, steps=None, tags=None, having=None):
    """``query(elements, own)`` over the rendered pages in two parts. Elements of pages that are alone under their
    page_id carry ``facts`` that the parse finds inside the page (own=True; only the elements of ``tags`` and ``having``,
    where given), so nothing is written, joined or counted for them. Pages that share
    their page_id, or have none, go by the operators' joins over all elements of the id (own=False)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("c_custkey"))
    counted = _spread_customers(spark, sf_dir).withColumn("_pages", n)
    alone = F.col("c_custkey").isNotNull() & (F.col("_pages") == 1)
    lone, others = fx.customer_pages(counted.filter(alone)), fx.customer_pages(counted.filter(~alone))
    kept = [c for c in columns if "kids" not in facts or c not in ("parent_idx", "text")]  # kids stand for those
    first = extract_elements(lone, columns=[*kept, *facts], steps=steps, tags=tags, having=having, spread_out=False)
    return query(first, True).unionByName(query(extract_elements(others, columns=columns, steps=steps, spread_out=False), False))


def _whole_elements(el):
    return el.select("page_id", "idx", "parent_idx", "depth", "tag", "id", "class", F.to_json("attrs").alias("attrs"),
                     "own_text", "text", F.to_json("anc").alias("anc"))


# what queries ask of the parse: no ancestor paths; paths and no texts
FLAT = [*COMPACT, "text"]
PATH = ["page_id", "idx", "tag", "id", "class", "anc"]
SHOWN = ["page_id", "idx", "tag", "class", "attrs", "text"]
WHOLE = [*SHOWN, "id", "anc"]
STEP = ("tag", "id", "nth_tag")  # what xpaths and css levels take of an ancestor
CSS_STEP = ("tag", "id", "class", "nth_child", "n_child", "role", "name", "data")  # what css paths take
HEADINGS = tuple(f"h{i}" for i in range(1, 7))


@query("elements_compact")
def q_elements_compact(spark, sf_dir):
    """H1 with the tree as intervals: descendants and text as ranges."""
    return _elements(spark, sf_dir, columns=COMPACT).select(
        "page_id", "idx", "end_idx", "parent_idx", "depth", "tag", F.to_json("attrs").alias("attrs"), "own_text", "text_from", "text_to")


@query("element_paths")
def q_element_paths(spark, sf_dir):
    """Texts and ancestor paths of the compact table's elements, from the intervals."""
    el = _elements(spark, sf_dir, shared=True, columns=COMPACT)
    out = with_text(with_ancestors(el, el), page_texts(load_table(spark, sf_dir, "pages")))
    return out.select("page_id", "idx", "tag", "text", F.to_json("anc").alias("anc"))


@query("elements")
def q_elements(spark, sf_dir):
    """H1 on the real pages: the tree, attributes, texts and ancestors."""
    return _whole_elements(_elements(spark, sf_dir))


@query("page_summary")
def q_page_summary(spark, sf_dir):
    return pe.page_summary(_elements(spark, sf_dir, columns=FLAT), ["links", "headings", "forms", "images", "tables"],
                           pages=load_table(spark, sf_dir, "pages"))


@query("page_summary_rt")
def q_page_summary_rt(spark, sf_dir):
    return pe.page_summary(_rt_elements(spark, sf_dir, columns=FLAT), pages=fx.customer_pages(load_table(spark, sf_dir, "customer")))


@query("headings")
def q_headings(spark, sf_dir):
    return pe.headings(_elements(spark, sf_dir, columns=FLAT, tags=HEADINGS)).select("page_id", "level", "ordinal", "text")


@query("forms")
def q_forms(spark, sf_dir):
    return pe.forms(_rt_elements(spark, sf_dir)).select("page_id", "form_id", "action", "method")


@query("form_inputs")
def q_form_inputs(spark, sf_dir):
    el = _rt_elements(spark, sf_dir, shared=True, columns=["page_id", "idx", "tag", "id", "attrs", "anc"],
                      tags=("form", "input", "select", "textarea"), steps=("tag", "nth_child"))
    return pe.form_inputs(el).select(
        "page_id", "form_id", "type", "name", "id", "placeholder", "required")


@query("inputs")
def q_inputs(spark, sf_dir):
    el = _rt_elements(spark, sf_dir, shared=True, columns=["page_id", "idx", "parent_idx", "tag", "id", "attrs"],
                      tags=("input", "select", "textarea", "option"))
    return pe.inputs(el).select(
        "page_id", "tag", "type", "name", "value", "placeholder", "required", "n_options")


@query("buttons")
def q_buttons(spark, sf_dir):
    return pe.buttons(_rt_elements(spark, sf_dir, columns=FLAT, tags=("a", "button", "input"))).select("page_id", "tag", "id", "text", "type")


@query("links")
def q_links(spark, sf_dir):
    return pe.links(_elements(spark, sf_dir, columns=FLAT, tags=("a",))).select(
        "page_id", "ordinal", "text", "href", "is_external", "is_external_page")


@query("links_rt")
def q_links_rt(spark, sf_dir):
    return pe.links(_rt_elements(spark, sf_dir, columns=FLAT, tags=("a",))).select(
        "page_id", "ordinal", "text", "href", "title", "target", "is_external", "is_external_page")


@query("images")
def q_images(spark, sf_dir):
    return pe.images(_rt_elements(spark, sf_dir, columns=COMPACT, tags=("img",))).select("page_id", "src", "alt", "title", "width", "height")


@query("meta_tags")
def q_meta_tags(spark, sf_dir):
    return pe.meta_tags(_rt_elements(spark, sf_dir, columns=COMPACT, tags=("meta",)))


@query("html_tables")
def q_html_tables(spark, sf_dir):
    return pe.html_tables(_rt_elements(spark, sf_dir, shared=True)).select(
        "page_id", "table_id", F.array_join("headers", "|").alias("headers"), "n_rows", "n_columns")


@query("error_messages")
def q_error_messages(spark, sf_dir):
    return pe.error_messages(_rt_elements(spark, sf_dir, columns=FLAT)).select("page_id", "selector", "text")


@query("login_error_message")
def q_login_error_message(spark, sf_dir):
    return pe.login_error_message(_rt_elements(spark, sf_dir, shared=True, columns=[*SHOWN, "own_text"]))


@query("interactive")
def q_interactive(spark, sf_dir):
    el = _rt_elements(spark, sf_dir, columns=SHOWN, tags=pe.INTERACTIVE_TAGS, having=pe.INTERACTIVE_ATTRS)
    named = {"browser": pe.browser_selectors(), "page_tool": pe.page_tool_selectors(), "page_analyzer": pe.page_analyzer_selectors()}
    return pe.interactive(el, named=named).select("lists", "page_id", "kind", "selector", "tag", "text", "type")


@query("text_search")
def q_text_search(spark, sf_dir):
    return pe.text_search(_elements(spark, sf_dir, tags=("a", "h1", "title", "div")), "th", tags=["a", "h1", "title", "div"]).select(
        "page_id", "tag", "own_text")


@query("text_search_ancestor")
def q_text_search_ancestor(spark, sf_dir):
    """H15 where no allowed tag holds the text itself: the nearest allowed ancestor."""
    return pe.text_search_best(_rt_elements(spark, sf_dir, shared=True), "invalid balance", tags=["main", "body"]).select(
        "page_id", "stage", "tag")


@query("text_search_best")
def q_text_search_best(spark, sf_dir):
    return pe.text_search_best(_rt_elements(spark, sf_dir, shared=True), "Save", tags=["button", "form", "main"]).select(
        "page_id", "stage", "tag", "own_text")


@query("css_selector")
def q_css_selector(spark, sf_dir):
    def css(el, own):
        el = sl.with_css_levels(el).drop("anc")
        return sl.css_selector(el if own else materialize(el)).select("page_id", "tag", "css")
    return _by_page(spark, sf_dir, css, PATH, ("n_class",), steps=STEP)


@query("xpath")
def q_xpath(spark, sf_dir):
    return sl.add_xpaths(_elements(spark, sf_dir, columns=PATH)).select("page_id", "idx", "tag", "xpath", "xpath_soup", "full_xpath")


def _pathed(spark, sf_dir, query, tags=None, having=None):
    """``query`` over the rendered pages' elements with their paths as text in the place of the ancestors."""
    def run(el, own):
        el = sl.with_css_levels(sl.add_xpaths(el)).drop("anc", "xpath_soup")
        return query(el if own else materialize(el))
    return _by_page(spark, sf_dir, run, WHOLE, ("n_class",), steps=STEP, tags=tags, having=having)


@query("element_selectors")
def q_element_selectors(spark, sf_dir):
    out = _pathed(spark, sf_dir, lambda el: sl.element_selectors(sl.css_selector(el)))
    return out.withColumn("reliable_selectors", F.to_json("reliable_selectors"))


@query("reliable_selectors")
def q_reliable_selectors(spark, sf_dir):
    rel = sl.reliable_selectors(F.col("tag"), F.col("text"), F.col("id"), F.col("class"),
                                F.map_filter(F.col("attrs"), lambda k, v: k.startswith("data-")))
    return _rt_elements(spark, sf_dir, columns=FLAT).select("page_id", "idx", "tag", F.posexplode(rel).alias("pos", "sel")).select(
        "page_id", "idx", "tag", "pos", "sel.type", "sel.value")


def _best_selector(el):
    return sl.best_selector(el).select("page_id", "idx", "best.kind", "best.type", "best.value", "selector_list")


@query("best_selector")
def q_best_selector(spark, sf_dir):
    out = _pathed(spark, sf_dir, lambda el: _best_selector(sl.css_selector(el)))
    return out.withColumn("selector_list", F.to_json("selector_list"))


@query("element_category")
def q_element_category(spark, sf_dir):
    return sl.element_category(_rt_elements(spark, sf_dir, columns=PATH)).select("page_id", "idx", "tag", "category", "category_detailed")


@query("page_structure")
def q_page_structure(spark, sf_dir):
    return pe.page_structure(_rt_elements(spark, sf_dir)).select("page_id", "region", "tag")


@query("dedup_elements")
def q_dedup_elements(spark, sf_dir):
    el = _rt_elements(spark, sf_dir, columns=WHOLE, steps=STEP, tags=pe.INTERACTIVE_TAGS, having=pe.INTERACTIVE_ATTRS)
    el = sl.add_xpaths(el).filter(F.col("page_id").isNotNull())
    cand = (pe.interactive(el, ("clickable", "input"), lists=pe.page_tool_selectors(), keep=["xpath"])
            .drop("type", "name", "src").withColumn("order", F.struct("selector", "idx")))
    return pe.dedup_elements(cand, kind="kind").select("page_id", "kind", "selector", "xpath", "tag", "text")


@query("category_summary")
def q_category_summary(spark, sf_dir):
    return pe.category_summary(sl.element_category(_rt_elements(spark, sf_dir, columns=PATH)))


def _selector_table(spark, sf_dir):
    return _pathed(spark, sf_dir, sl.selector_table, tags=pe.INTERACTIVE_TAGS, having=pe.INTERACTIVE_ATTRS)


@query("selector_table")
def q_selector_table(spark, sf_dir):
    return _selector_table(spark, sf_dir).select(
        "page_id", "name", "text_value", "id", "class", "css", "xpath", "element_type", "category",
        F.to_json("data").alias("data"))


@query("data_attributes")
def q_data_attributes(spark, sf_dir):
    el = _rt_elements(spark, sf_dir)
    return el.select("page_id", "idx", F.explode(sl.data_attributes(F.col("attrs"))).alias("key", "value")).select(
        "page_id", "key", "value")


@query("page_slug")
def q_page_slug(spark, sf_dir):
    return load_table(spark, sf_dir, "pages").select("page_id", pe.page_slug(F.col("url")).alias("slug"))


@query("page_changes")
def q_page_changes(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    after = fx.changed_pages(pages)
    return pe.page_changes(pe.page_metrics(pages, extract_elements(pages)),
                           pe.page_metrics(after, extract_elements(after)))


@query("alert_kind")
def q_alert_kind(spark, sf_dir):
    return load_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", pe.alert_kind(F.col("text")).alias("kind"))


# ---- S1-S9, ST1-ST2 -------------------------------------------------------------

ORDER_COLS = fx.ORDER_REPORT_HEADER


@query("read_report_csv")
def q_read_report_csv(spark, sf_dir):
    path = fx.write_order_report(spark, load_table(spark, sf_dir, "orders"), "cp932", junk_line=True)
    df = rpt.read_report_csv(spark, path, encoding="cp932", header_row=2)
    return df.select("rn", F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long").alias("part"),
                     *[F.col(f"`{c}`") for c in ORDER_COLS])


@query("report_schema_table")
def q_report_schema_table(spark, sf_dir):
    """S1 -> T7 over the landed files; row order = (file, row in file),
    i.e. block * file_rows + rn."""
    path = fx.write_order_report(spark, load_table(spark, sf_dir, "orders"), "utf-8", junk_line=False)
    df = rpt.read_report_csv(spark, path, encoding="utf-8", header_row=1)
    df = df.withColumn("part", F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long"))
    return _flat_schema(si.schema_table(rpt.order_rows(df, "part")))


@query("read_report_auto")
def q_read_report_auto(spark, sf_dir):
    """S1 over one folder of mixed encodings, headers and column orders."""
    path = fx.write_mixed_reports(spark, load_table(spark, sf_dir, "customer"))
    df = rpt.read_report_csv(spark, path, encoding="auto")
    return df.select("rn", F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long").alias("part"),
                     "番号", "氏名", F.col("`氏名.1`").alias("seg"), "区分")


@query("read_report_notes")
def q_read_report_notes(spark, sf_dir):
    """S1 over reports whose free text holds line breaks."""
    df = rpt.read_report_csv(spark, fx.write_note_report(spark, load_table(spark, sf_dir, "conversations")))
    return df.select("rn", F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long").alias("part"),
                     "conv_id", "turn", "role", F.col("`free\ntext`").alias("text"))


@query("read_report_headers")
def q_read_report_headers(spark, sf_dir):
    """S1 over one folder of six headers, read by one scan."""
    df = rpt.read_report_csv(spark, fx.write_many_headers(spark, load_table(spark, sf_dir, "part")))
    own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in (f"x{v}" for v in range(fx.HEADER_KINDS))]
    return df.select("rn", F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long").alias("part"), "key", "name", "brand", "kind", "size", *own)


@query("file_encoding")
def q_file_encoding(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    out = None
    for enc in ("utf-8", "cp932", "euc_jp"):
        path = fx.write_order_report(spark, orders, enc, junk_line=True)
        e = rpt.file_encoding(spark, path, "*.csv").select(F.lit(enc).alias("written"), "encoding")
        out = e if out is None else out.unionByName(e)
    return out


@query("registry_csv")
def q_registry_csv(spark, sf_dir):
    path = fx.scratch_dir(spark, "registry")
    rows = fx.registry_rows(load_table(spark, sf_dir, "part"))
    rows.orderBy("pos").drop("pos").write.option("header", True).csv(path)  # files in row order
    return rg.registry_load(rg.read_registry_csv(spark, path))


@query("latest_file")
def q_latest_file(spark, sf_dir):
    """S5 over folders of several files: empty newest ones and partial downloads among them."""
    listing = rpt.list_files(spark, fx.write_landing_folders(spark, load_table(spark, sf_dir, "orders")))
    return rpt.latest_file(listing, extensions=[".csv"]).select(
        F.regexp_extract("dir", r"part=(\d+)$", 1).cast("long").alias("part"), "length")


@query("new_files")
def q_new_files(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    first = rpt.list_files(spark, fx.write_order_report(spark, orders, "utf-8", junk_line=False))
    second_path = fx.write_order_report(spark, orders, "utf-8", junk_line=True)
    after = first.unionByName(rpt.list_files(spark, second_path))
    return rpt.new_files(first, after, pattern=".CSV").select(
        F.regexp_extract("dir", r"part=(\d+)$", 1).cast("long").alias("part"))


@query("schema_document")
def q_schema_document(spark, sf_dir):
    """Both parts of the document, an entry of each per column."""
    doc = sk.schema_document(si.schema_table(report(spark, sf_dir, "orders", "o_orderkey")))
    entry = "struct<COLUMN_ORIGIN_NAME:string,DATA_TYPE:string,COLUMN_AFTER_NAME:string,DESCRIPTION:string," \
            "SAMPLE_DATA:string,CONSISTENCY_RATE:double,INCONSISTENT_COUNT:bigint,INCONSISTENT_SAMPLES:array<string>>"
    result = "struct<column_name:string,data_type:string,consistency_rate:double,inconsistent_count:bigint>"
    parsed = doc.select(F.from_json("document", f"schema array<{entry}>, consistency_results array<{result}>").alias("d"))
    both = parsed.select(F.posexplode(F.arrays_zip("d.schema", "d.consistency_results")).alias("pos", "z"))
    part = both.select("pos", "z.consistency_results.*").select(
        "pos", F.col("column_name").alias("result_column"), F.col("data_type").alias("result_type"),
        F.col("consistency_rate").alias("result_rate"), F.col("inconsistent_count").alias("result_count"))
    samples = F.array_join("INCONSISTENT_SAMPLES", "|").alias("INCONSISTENT_SAMPLES")
    return both.select("pos", "z.schema.*").withColumn("INCONSISTENT_SAMPLES", samples).join(part, "pos")


@query("selector_export")
def q_selector_export(spark, sf_dir):
    """The CSV written and read back."""
    path = fx.scratch_dir(spark, "selector-export")
    sk.write_selector_exports(materialize(_selector_table(spark, sf_dir)), path)
    return sk.read_selector_csv(spark, path)


@query("report_target")
def q_report_target(spark, sf_dir):
    runs = fx.report_runs(load_table(spark, sf_dir, "events"))
    norm = rp.normalize_report_type(F.col("report_type"))
    return runs.select("event_id", rpt.report_target_name(norm, RUN_DATE).alias("target"))


@query("stream_arrivals")
def q_stream_arrivals(spark, sf_dir):
    from quarry.streaming.arrivals import arrivals, land_arrivals
    from pyspark.sql import types as T
    src = fx.write_order_report(spark, load_table(spark, sf_dir, "orders"), "utf-8", junk_line=False)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ORDER_COLS])
    sink = fx.scratch_dir(spark, "arrivals-sink")
    q = land_arrivals(arrivals(spark, src + "/*", schema, glob="*.csv", run_date=RUN_DATE), sink, sink + "-ckpt")
    q.awaitTermination()
    return spark.read.parquet(sink).drop("source_file")


@query("stream_landing")
def q_stream_landing(spark, sf_dir):
    """ST1 -> S1 -> P1 -> S9: cp932 reports with a junk line, landed batch by batch."""
    from quarry.plans.flows import StreamLanding
    src = fx.write_order_report(spark, load_table(spark, sf_dir, "orders"), "cp932", junk_line=True)
    landing = StreamLanding(spark, fx.scratch_dir(spark, "stream-landing"), RUN_DATE, header_row=2)
    landing.run(src, fx.scratch_dir(spark, "stream-landing-ckpt"), max_files=20)
    return landing.rows().select("日付", *[F.col(f"`{c}`") for c in ORDER_COLS])


@query("stream_page_changes")
def q_stream_page_changes(spark, sf_dir):
    from quarry.streaming.page_changes import page_change_stream
    pages = load_table(spark, sf_dir, "pages")
    src = fx.scratch_dir(spark, "snapshots")
    pages.withColumn("snapshot", F.lit(1)).write.parquet(src + "/s1")
    fx.changed_pages(pages).withColumn("snapshot", F.lit(2)).write.parquet(src + "/s2")
    schema = spark.read.parquet(src + "/s1").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(src + "/*")
    from quarry.streaming.page_changes import stream_metrics
    changes = page_change_stream(stream_metrics(stream))
    sink = fx.scratch_dir(spark, "changes-sink")
    q = (changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


@query("css_path")
def q_css_path(spark, sf_dir):
    def path(el, own):
        el = sl.with_css_steps(el).drop("anc", "text")
        return sl.css_path(el if own else materialize(el)).select("page_id", "idx", "tag", "css_path")
    return _by_page(spark, sf_dir, path, [*PATH, "parent_idx", "text"], ("kids",), steps=CSS_STEP)


@query("xpath_unified")
def q_xpath_unified(spark, sf_dir):
    def path(el, own):
        el = sl.with_xpath_steps(el).drop("anc", "text")
        return sl.xpath_unified(el if own else materialize(el)).select("page_id", "idx", "tag", "xpath_unified")
    return _by_page(spark, sf_dir, path, [*PATH, "parent_idx", "text"], ("kids",), steps=(*STEP, "n_same"))


@query("element_counts")
def q_element_counts(spark, sf_dir):
    """H1 on the real pages: elements per (page, tag)."""
    return _elements(spark, sf_dir, columns=("page_id", "tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("elements_rt")
def q_elements_rt(spark, sf_dir):
    """H1 on the rendered customer pages: the tree, attributes, texts and ancestors."""
    return _whole_elements(_rt_elements(spark, sf_dir))


# names of the round before for the same whole results
for _name in ("elements", "elements_rt", "xpath", "element_selectors", "reliable_selectors", "best_selector", "element_category",
              "css_path", "xpath_unified", "schema_document", "latest_file"):
    QUERIES[f"{_name}_all"] = QUERIES[_name]
