"""Derived inputs: text renderings of the driver tables.

Several operators profile *report files*: tables of text cells in file
order. The registered queries build those from the driver tables so their
work grows with the data: each typed column is rendered as text the way a
report export writes it, and the dense table key gives the 1-based row
order. The oracle SQL renders the same text with DuckDB functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_column(df: DataFrame, name: str):
    """Render one typed column as report text (fixed formats so Spark and
    DuckDB print identical strings)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.format_string("%.2f", c).alias(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    return c.cast("string").alias(name)


def report_text(df: DataFrame, key: str, rn: str = "rn") -> DataFrame:
    """(rn, col1, col2, ...) all strings; rn = key + 1 (keys are dense from 0)."""
    return df.select((F.col(key).cast("long") + 1).alias(rn),
                     *[text_column(df, c) for c in df.columns])


def result_documents(events: DataFrame) -> DataFrame:
    """Result JSON documents derived from ``events``, one per event.

    Even events use the nested layout (with ``test_file``), odd ones the flat
    layout. The test key repeats every 4000 events so later documents
    override earlier ones. Value kinds by event type: error -> failed
    record, click -> passed record with its own category, view -> ``true``,
    purchase -> the event value (a number), signup -> the string ``"x"``.
    """
    suite = F.pmod(F.col("user_id"), F.lit(7)).cast("string")
    cat_n = F.pmod(F.col("user_id"), F.lit(10))
    key = F.concat(F.lit("suite"), suite, F.lit("_test_results::test_event_"),
                   F.pmod(F.col("event_id"), F.lit(4000)).cast("string"))
    desc = F.concat(F.col("event_type"), F.lit(" check "), F.col("event_id").cast("string"))
    record = F.to_json(F.struct(
        (F.col("event_type") == "click").alias("passed"),
        desc.alias("description"),
        F.col("value").alias("execution_time"),
        F.when(F.col("event_type") == "click", F.lit("clicks")).alias("category")))
    value = (F.when(F.col("event_type").isin("error", "click"), record)
             .when(F.col("event_type") == "view", F.lit("true"))
             .when(F.col("event_type") == "purchase", F.to_json(F.array(F.col("value"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("value")))) - 2))
             .otherwise(F.lit('"x"')))
    entry = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2),
                     F.lit(": "), value)
    head = F.concat(
        F.lit('{"test_timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'),
        F.when(cat_n != 0, F.concat(F.lit(', "category": "cat'), cat_n.cast("string"), F.lit('"')))
         .otherwise(F.lit("")))
    nested = F.concat(head, F.lit(', "test_file": "tests/test_file/suite/test_suite'), suite,
                      F.lit('.py", "results": {'), entry, F.lit("}}"))
    flat = F.concat(head, F.lit(", "), entry, F.lit("}"))
    return events.select(
        F.concat(F.lit("results/doc"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        F.col("event_id").alias("file_order"),
        F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, nested).otherwise(flat).alias("content"))


def write_result_files(spark, events: DataFrame) -> str:
    """Land the result documents of ``events`` as text files of many documents:
    folders ``run_k``, and ``report_k`` (every fifth event) of earlier runs."""
    path = scratch_dir(spark, "result-files")
    k = F.col("file_order")
    folder = F.concat(F.when(k % 5 == 0, F.lit("report_")).otherwise(F.lit("run_")), (k % 40).cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (result_documents(events).select(folder.alias("folder"), "content").repartition(n, "folder")
     .write.partitionBy("folder").text(path))
    return path


def report_runs(events: DataFrame) -> DataFrame:
    """Report download runs derived from ``events``: type by event type
    (``conversion_attribute`` is the alias spelling), success unless the
    event is an error."""
    rtype = (F.when(F.col("event_type").isin("view", "click"), F.lit("detailed_analysis"))
             .when(F.col("event_type") == "purchase", F.lit("cv_attribute"))
             .when(F.col("event_type") == "signup", F.lit("conversion_attribute"))
             .otherwise(F.lit("unknown")))
    return events.select("event_id", rtype.alias("report_type"),
                         (F.col("event_type") != "error").alias("success"))


def registry_rows(part: DataFrame) -> DataFrame:
    """Selector registry rows derived from ``part`` (row order = part key).

    Names repeat inside a group (later row wins); every tenth part is named
    ``navbar`` and the next ``apply_button`` so the repair map applies; some
    rows lack a description or a selector value.
    """
    k = F.col("p_partkey")
    name = (F.when(F.pmod(k, F.lit(10)) == 0, F.lit("navbar"))
            .when(F.pmod(k, F.lit(10)) == 1, F.lit("apply_button"))
            .otherwise(F.regexp_replace(F.col("p_name"), " ", "_")))
    stype = (F.when(F.pmod(F.col("p_size"), F.lit(3)) == 0, F.lit("id"))
             .when(F.pmod(F.col("p_size"), F.lit(3)) == 1, F.lit("css"))
             .otherwise(F.lit("xpath")))
    return part.select(
        F.lower(F.col("p_type")).alias("group"), name.alias("name"), stype.alias("selector_type"),
        F.when(F.pmod(k, F.lit(17)) != 0, F.concat(F.lit("#part-"), k.cast("string"))).alias("selector_value"),
        F.when(F.pmod(F.col("p_size"), F.lit(5)) != 0, F.col("p_brand")).alias("description"),
        k.alias("pos"))


def registry_requests(part: DataFrame) -> DataFrame:
    """Look-up requests derived from ``part``: some groups and names that the
    registry does not have."""
    k = F.col("p_partkey")
    name = F.regexp_replace(F.col("p_name"), " ", "_")
    return part.select(
        k.alias("request_id"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.lit("nogroup")).otherwise(F.lower(F.col("p_type"))).alias("group"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.concat(name, F.lit("_v2"))).otherwise(name).alias("name"))


def selector_records(part: DataFrame) -> DataFrame:
    """Selector records (group, name, element_type, css, category, pos)
    derived from ``part``."""
    k = F.col("p_partkey")
    etype = F.element_at(F.array(*[F.lit(x) for x in ("button", "a", "input", "select")]),
                         (F.pmod(F.col("p_size"), F.lit(4)) + 1).cast("int"))
    return part.select(
        F.lower(F.col("p_type")).alias("group"),
        F.concat(F.regexp_replace(F.col("p_name"), " ", "_"), F.lit("_"), k.cast("string")).alias("name"),
        etype.alias("element_type"),
        F.concat(F.lit("#part-"), k.cast("string")).alias("css"),
        F.when(F.pmod(k, F.lit(3)) != 0, F.col("p_brand")).alias("category"),
        k.alias("pos"))


# Fixed list used to derive file extensions from a key (all 24 mapped
# extensions plus two unmapped ones).
DERIVED_EXTENSIONS = (".py", ".js", ".ts", ".html", ".css", ".java", ".c", ".cpp", ".cs", ".php",
                      ".rb", ".go", ".rs", ".swift", ".kt", ".sh", ".bat", ".ps1", ".sql", ".md",
                      ".json", ".yml", ".yaml", ".xml", ".txt", ".PY")


def document_files(documents: DataFrame) -> DataFrame:
    """(doc_id, source, path) with an extension picked by the key."""
    n = len(DERIVED_EXTENSIONS)
    ext = F.element_at(F.array(*[F.lit(x) for x in DERIVED_EXTENSIONS]),
                       (F.pmod(F.col("doc_id") * 7 + F.col("n_chars"), F.lit(n)) + 1).cast("int"))
    return documents.select("doc_id", "source",
                            F.concat(F.col("source"), F.lit("/file"), F.col("doc_id").cast("string"), ext).alias("path"))


def analysis_text(conv: DataFrame) -> DataFrame:
    """Review-style text around each conversation turn: a summary section
    holding the turn, a risk list and a suggestion section."""
    t = F.concat(F.lit("## Summary\n"), F.col("text"), F.lit("\n## Risks\n- role "), F.col("role"),
                 F.lit("\n* turn "), F.col("turn").cast("string"), F.lit("\n## Suggestions\n"), F.col("text"))
    return conv.select("conv_id", "turn", t.alias("text"))


def fenced_text(conv: DataFrame) -> DataFrame:
    """Every other turn wrapped in a fenced code block with text around it."""
    t = F.when(F.pmod(F.col("turn"), F.lit(2)) == 0,
               F.concat(F.col("role"), F.lit(":\n```python\n"), F.col("text"), F.lit("\n```\nend of "),
                        F.col("role"))).otherwise(F.col("text"))
    return conv.select("conv_id", "turn", t.alias("text"))


def quoted_messages(conv: DataFrame) -> DataFrame:
    """Every third turn quoted and labelled like a generated message."""
    t = (F.when(F.pmod(F.col("turn"), F.lit(3)) == 0,
                F.concat(F.lit("\"コミットメッセージ: "), F.col("text"), F.lit("`")))
         .when(F.pmod(F.col("turn"), F.lit(3)) == 1, F.concat(F.lit("'"), F.col("text"), F.lit("'")))
         .otherwise(F.col("text")))
    return conv.select("conv_id", "turn", t.alias("text"))


def review_urls(pages: DataFrame) -> DataFrame:
    """Review URLs derived from page URLs: a valid pull-request URL, a
    malformed one, or the page URL itself."""
    host = F.regexp_extract(F.col("url"), r"^https?://([^/]+)", 1)
    k = F.col("page_id")
    u = (F.when(F.pmod(k, F.lit(3)) == 0,
                F.concat(F.lit("https://github.com/"), host, F.lit("/repo"), k.cast("string"),
                         F.lit("/pull/"), k.cast("string")))
         .when(F.pmod(k, F.lit(3)) == 1, F.concat(F.lit("https://github.com/"), host, F.lit("/pull/x"),
                                                  k.cast("string")))
         .otherwise(F.col("url")))
    return pages.select("page_id", u.alias("url"))


def secret_documents(customer: DataFrame) -> DataFrame:
    """Config-like documents derived from ``customer`` that contain every
    kind of finding (values are hashes of the customer name, not real
    secrets). One of them spans two lines."""
    k = F.col("c_custkey")
    h = F.md5(F.col("c_name"))
    h2 = F.md5(F.concat(F.col("c_name"), F.lit("x")))
    email = F.concat(F.lower(F.regexp_replace(F.col("c_name"), "#", ".")), F.lit("@example.com"))
    ssn = F.format_string("%03d-%02d-%04d", F.pmod(k, F.lit(1000)), F.pmod(k, F.lit(100)), F.pmod(k * 7, F.lit(10000)))
    card = F.format_string("%04d-%04d-%04d-%04d", F.pmod(k, F.lit(10000)), F.pmod(k * 3, F.lit(10000)),
                           F.pmod(k * 7, F.lit(10000)), F.pmod(k * 11, F.lit(10000)))
    body = (
        F.when(F.pmod(k, F.lit(6)) == 0, F.concat(F.lit("api_key =\n  \""), h, F.lit("\"\nmode = 1")))
        .when(F.pmod(k, F.lit(6)) == 1, F.concat(F.lit("password: \""), F.substring(h, 1, 8), F.lit("\"\npwd='"),
                                               F.substring(h2, 1, 6), F.lit("'")))
        .when(F.pmod(k, F.lit(6)) == 2, F.concat(F.lit("Authorization: \"Bearer "), h, F.lit("\"\nauth_token=\""),
                                               h2, F.lit("\"")))
        .when(F.pmod(k, F.lit(6)) == 3, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\nprivate_key = '"), h,
                                               F.lit("'\nOPENAI_API_KEY=\""), h2, F.lit("\"")))
        .when(F.pmod(k, F.lit(6)) == 4, F.concat(F.lit("-----BEGIN CERTIFICATE-----\nssn "), ssn,
                                               F.lit("\naccess_key: '"), h2, F.lit("'")))
        .otherwise(F.concat(F.lit("card "), card, F.lit("\ncontact "), email, F.lit("\nkey sk-"), h,
                            F.substring(h2, 1, 16), F.lit("\napi-secret=\""), h, F.lit("\""))))
    text = F.concat(F.lit("# settings for "), F.col("c_name"), F.lit("\n"), body, F.lit("\n# end\n"))
    return customer.select(k.alias("doc_id"), text.alias("text"))


def customer_pages(customer: DataFrame) -> DataFrame:
    """One rendered page per customer, holding every element kind the page
    operators look for: meta tags, a header bar, a sidebar link with data
    attributes, a form (named on even keys) with inputs / select / textarea /
    buttons, a table with headers (id on keys divisible by 3) and one
    without, an image, an error box for negative balances, link buttons.
    Option and cell end tags are left implied on purpose."""
    k = F.col("c_custkey").cast("string")
    even = F.pmod(F.col("c_custkey"), F.lit(2)) == 0
    by3 = F.pmod(F.col("c_custkey"), F.lit(3)) == 0
    bal = F.format_string("%.2f", F.col("c_acctbal"))
    form_open = F.when(even, F.concat(F.lit('<form id="f'), k, F.lit('" action="/save/'), k, F.lit('" method="post">'))) \
        .otherwise(F.concat(F.lit('<form action="/save/'), k, F.lit('">')))
    table_open = F.when(by3, F.concat(F.lit('<table id="t'), k, F.lit('">'))).otherwise(F.lit("<table>"))
    error = F.when(F.col("c_acctbal") < 0, F.concat(
        F.lit('<div class="alert alert-danger" role="alert">Error '), k,
        F.lit(': invalid balance</div><p class="error-message">failed to save '), k, F.lit("</p>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), F.col("c_name"),
        F.lit('</title><meta name="segment" content="'), F.col("c_mktsegment"),
        F.lit('"><meta property="og:id" content="'), k, F.lit('"><meta content="none"></head><body>'),
        F.lit('<header class="navbar top"><a class="btn nav-link" href="/home">Home</a></header>'),
        F.lit('<div id="sidebar" class="sidebar menu"><a href="https://ext.example.com/c/'), k,
        F.lit('" data-track-id="'), k, F.lit('" data-empty="">Ext '), k, F.lit("</a></div>"),
        F.lit('<main class="content"><h2>'), F.col("c_name"), F.lit("</h2>"),
        form_open,
        F.lit('<input type="text" name="name" id="name'), k, F.lit('" placeholder="Name" required>'),
        F.lit('<input type="hidden" name="k" value="'), k, F.lit('">'),
        F.lit('<input name="bal" value="'), bal, F.lit('">'),
        F.lit('<select name="seg"><option>A<option>B<option>'), F.col("c_mktsegment"), F.lit("</select>"),
        F.lit('<textarea name="note"></textarea>'),
        F.lit('<button type="submit" id="submit'), k, F.lit('">Save</button>'),
        F.lit('<input type="button" value="Cancel"></form>'),
        table_open, F.lit("<tr><th>Key<th>Balance</tr><tr><td>"), k, F.lit("<td>"), bal, F.lit("</tr></table>"),
        F.lit("<table><tr><td>a<td>b<td>c</tr><tr><td>d</tr></table>"),
        F.lit('<img src="/img/'), k, F.lit('.png" alt="'), F.col("c_name"), F.lit('" width="'),
        F.col("c_nationkey").cast("string"), F.lit('">'),
        error,
        F.lit('<a class="btn" href="#">Go</a><a role="button">Act</a></main></body></html>'))
    return customer.select(F.col("c_custkey").alias("page_id"),
                           F.concat(F.lit("https://shop.example.com/c/"), k).alias("url"), html.alias("html"))


def changed_pages(pages: DataFrame) -> DataFrame:
    """A second snapshot of ``pages``: unchanged, one added paragraph, or a
    block of seven added elements, by page key."""
    k = F.pmod(F.col("page_id"), F.lit(3))
    html = (F.when(k == 0, F.col("html"))
            .when(k == 1, F.replace(F.col("html"), F.lit("</article>"),
                                    F.lit("<p>An added paragraph that is long enough.</p></article>")))
            .otherwise(F.replace(F.col("html"), F.lit("<footer>"),
                                 F.lit("<div><span>a</span><span>b</span><span>c</span><span>d</span>"
                                       "<span>e</span><span>f</span></div><footer>"))))
    return pages.select("page_id", "url", html.alias("html"))


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage
    on a cluster) for files a registered query lands and reads back."""
    import uuid

    from quarry.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-rt/{name}-{uuid.uuid4().hex[:12]}"


# Header names of the landed orders report (Japanese headers
# exercise the cp932 path).
ORDER_REPORT_HEADER = ("注文番号", "顧客番号", "状態", "金額", "注文日", "優先度")
ORDER_REPORT_FILE_ROWS = 4096


def uneven_report(events: DataFrame) -> DataFrame:
    """Report text of ``events`` with two columns of mixed types (rn = key + 1)."""
    k, user = F.col("event_id"), F.col("user_id")
    mixed = (F.when(k % 4 == 0, F.col("event_type")).when(k % 4 == 1, user.cast("string"))
             .when(k % 4 == 2, (user + 100).cast("string")).otherwise(F.concat(user.cast("string"), F.lit(".5"))))
    half = (F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.concat(F.lit("2024/01/0"), (k % 9 + 1).cast("string")))
            .otherwise(F.col("event_type")))
    return events.select((k.cast("long") + 1).alias("rn"), k.cast("string").alias("event_id"), mixed.alias("mixed"),
                         half.alias("half"))


def gappy_report(events: DataFrame) -> DataFrame:
    """Report text of ``events`` (rn = key + 1): whole numbers without gaps, with gaps, and among decimals."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    money = F.format_string("%.2f", "value")
    return events.select((k.cast("long") + 1).alias("rn"), k.cast("string").alias("event_id"),
                         F.when(k % 7 == 0, F.lit("")).otherwise(user).alias("points"),
                         F.when(k % 3 == 0, money).otherwise(user).alias("amount"), F.col("event_type"))


MIXED_FILE_ROWS = 36


def write_mixed_reports(spark, customer: DataFrame) -> str:
    """Land ``customer`` as report files of two encodings and two headers in
    one folder, one per block of MIXED_FILE_ROWS keys (``part=k``). Even
    blocks are utf-8, odd ones cp932, with the first characters beyond ASCII
    after line 20; of each four blocks the last two have another column
    order and one column more. Both headers repeat a name."""
    path = scratch_dir(spark, "mixed-reports")
    key = F.col("c_custkey")
    k = F.floor(key / F.lit(MIXED_FILE_ROWS)).cast("long")
    name = F.when(key % MIXED_FILE_ROWS >= 20, F.concat(F.lit("顧客"), key.cast("string"))).otherwise(F.col("c_name"))
    other = F.floor(k / 2) % 2 == 1
    plain = F.concat_ws(",", key.cast("string"), name, "c_mktsegment")
    more = F.concat_ws(",", F.concat(F.lit("K"), F.col("c_nationkey").cast("string")), name, key.cast("string"), "c_mktsegment")
    data = customer.select(k.alias("part"), key.cast("long").alias("key"), F.when(other, more).otherwise(plain).alias("line"))
    head = customer.select(k.alias("part")).distinct().select(
        "part", F.lit(-1).cast("long").alias("key"),
        F.when(F.floor(F.col("part") / 2) % 2 == 1, F.lit("区分,氏名,番号,氏名")).otherwise(F.lit("番号,氏名,氏名")).alias("line"))
    from quarry.sources.reports import _ensure_charsets
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rest, encoding in ((0, "utf-8"), (1, "cp932")):
        _ensure_charsets(spark, encoding)
        (data.unionByName(head).filter(F.col("part") % 2 == rest).repartition(n, "part").sortWithinPartitions("part", "key")
         .select("part", "line").write.mode("append").partitionBy("part").option("encoding", encoding)
         .option("quote", "").option("sep", "\u0001").option("header", False).csv(path))
    return path


NOTE_FILE_CONVS = 64


def write_note_report(spark, conversations: DataFrame) -> str:
    """Land ``conversations`` as report files (one per NOTE_FILE_CONVS ids, ``part=k``) whose last
    column is free text in quotes: its line breaks stay inside the field."""
    path = scratch_dir(spark, "note-report")
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    part = F.floor(F.col("conv_id") / F.lit(NOTE_FILE_CONVS)).cast("long")
    data = conversations.select(part.alias("part"), "conv_id", "turn", F.concat_ws(",", "conv_id", "turn", "role", text).alias("line"))
    head = data.select("part").distinct().select("part", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"),
                                                 F.lit('conv_id,turn,role,"free\ntext"').alias("line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (data.unionByName(head).repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_first("conv_id"), "turn")
     .select("part", "line").write.partitionBy("part").text(path))
    return path


HEADER_KINDS, HEADER_FILE_ROWS = 6, 50


def write_many_headers(spark, part: DataFrame) -> str:
    """Land ``part`` as report files of HEADER_KINDS headers: each kind turns the
    columns round by another number of places and has a column of its own."""
    path = scratch_dir(spark, "many-headers")
    k = F.floor(F.col("p_partkey") / F.lit(HEADER_FILE_ROWS)).cast("long")
    cols = {"key": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"),
            "size": F.col("p_size").cast("string")}
    line = head = F.lit(None)
    for v in range(HEADER_KINDS):
        names = [*list(cols)[v % len(cols):], *list(cols)[:v % len(cols)]]
        here = k % HEADER_KINDS == v
        line = F.when(here, F.concat_ws(",", *[cols[n] for n in names], F.concat(F.lit(f"v{v}-"), cols["key"]))).otherwise(line)
        head = F.when(F.col("part") % HEADER_KINDS == v, F.lit(",".join([*names, f"x{v}"]))).otherwise(head)
    data = part.select(k.alias("part"), F.col("p_partkey").cast("long").alias("key"), line.alias("line"))
    heads = data.select("part").distinct().select("part", F.lit(None).cast("long").alias("key"), head.alias("line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (data.unionByName(heads).repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_first("key"))
     .select("part", "line").write.partitionBy("part").text(path))
    return path


def write_order_report(spark, orders: DataFrame, encoding: str = "cp932", junk_line: bool = True,
                       file_rows: int = ORDER_REPORT_FILE_ROWS, path: str | None = None) -> str:
    """Land ``orders`` as report CSV files, one per block of ``file_rows``
    consecutive keys (folder ``part=k``, k = key div file_rows), so the
    number of files grows with the table and no task writes more than one
    block: an optional junk first line, a header line, then the rows in
    key order. Returns the folder (``path``, where given, gets the files beside those that it has)."""
    path = path or scratch_dir(spark, "orders-report")
    k = F.floor(F.col("o_orderkey") / F.lit(file_rows)).cast("long")
    fields = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"),
              F.format_string("%.2f", F.col("o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd"),
              F.col("o_orderpriority")]
    data = orders.select(k.alias("part"), F.lit(2).alias("seq"), F.col("o_orderkey").alias("key"),
                         F.concat_ws(",", *fields).alias("line"))
    parts = orders.select(k.alias("part")).distinct()
    head = parts.select("part", F.lit(1).alias("seq"), F.lit(-1).cast("long").alias("key"),
                        F.lit(",".join(ORDER_REPORT_HEADER)).alias("line"))
    lines = data.unionByName(head)
    if junk_line:
        lines = lines.unionByName(parts.select("part", F.lit(0).alias("seq"), F.lit(-2).cast("long").alias("key"),
                                               F.lit("ダミー1,ダミー2,ダミー3").alias("line")))
    from quarry.sources.reports import _ensure_charsets
    _ensure_charsets(spark, encoding)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartition(n, "part").sortWithinPartitions("part", "seq", "key").select("part", "line")
     .write.mode("append").partitionBy("part").option("encoding", encoding).option("quote", "")
     .option("sep", "\u0001").option("header", False).csv(path))
    return path


def write_landing_folders(spark, orders: DataFrame) -> str:
    """Folders (``part=k``) of several files each: the orders report landed twice, the second time with a
    junk line, then by k modulo 3: an empty newest file; two of them; a partial download."""
    path = write_order_report(spark, orders, "utf-8", junk_line=False)
    write_order_report(spark, orders, "utf-8", junk_line=True, path=path)
    parts = orders.select(F.floor(F.col("o_orderkey") / F.lit(ORDER_REPORT_FILE_ROWS)).cast("long").alias("part")).distinct()
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for row in parts.toLocalIterator():
        for name, text in {0: [("z1.csv", b"")], 1: [("z1.csv", b""), ("z2.csv", b"")], 2: [("z1.csv.crdownload", b"half")]}[row.part % 3]:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/part={row.part}/{name}")
            out = at.getFileSystem(conf).create(at)
            out.write(bytearray(text))
            out.close()
    return path
