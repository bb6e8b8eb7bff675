"""Page analytics on the ``elements`` table.

Every operator is a filter / projection / aggregate keyed by ``page_id``;
windows are always partitioned by page (bounded by one page's elements).
Selectors of the kind a browser would evaluate (``.error``,
``[role='alert']``, ``input:not([type='hidden'])`` ...) are written as
column predicates on ``tag``, the class list and the attribute map.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws

# Labels and defaults.
UNNAMED_FORM = "unnamed_form_"
UNNAMED_TABLE = "unnamed_table_"
ERROR_JOIN = "; "
ALERT_CONFIRM, ALERT_PROMPT, ALERT_ALERT = "confirm", "prompt", "alert"


# ---- predicates --------------------------------------------------------------

def classes(c: Column | None = None) -> Column:
    c = F.col("class") if c is None else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\f\r]+"), lambda x: x != "")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("class"), F.lit("")), r"[ \t\n\f\r]+"), F.lit(name))


def attr(name: str) -> Column:
    return F.element_at(F.col("attrs"), F.lit(name))


def has_attr(name: str) -> Column:
    return F.map_contains_key(F.col("attrs"), F.lit(name))


def attr_eq(name: str, value: str) -> Column:
    return F.coalesce(attr(name) == F.lit(value), F.lit(False))


def attr_contains(name: str, value: str) -> Column:
    return F.coalesce(attr(name).contains(value), F.lit(False))


def tag_is(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def input_type() -> Column:
    """``input`` type as the DOM reports it (missing -> text)."""
    return F.coalesce(F.lower(attr("type")), F.lit("text"))


def dom_type() -> Column:
    """The ``type`` property a browser reports: inputs default to text,
    selects are select-one / select-multiple, other elements use their
    type attribute, else the tag name."""
    return (F.when(tag_is("input"), input_type())
            .when(tag_is("select"), F.when(has_attr("multiple"), F.lit("select-multiple"))
                  .otherwise(F.lit("select-one")))
            .when(tag_is("textarea"), F.lit("textarea"))
            .otherwise(F.coalesce(attr("type"), F.col("tag"))))


def _tagged(hits: Column, label_name: str, label: str) -> Column:
    """Turn an array of selector positions into structs (label, selector)."""
    return F.transform(hits, lambda i: F.struct(F.lit(label).alias(label_name), i.alias("selector")))


# ---- selector lists (fixed values) -------------------------------------------------

def clickable_selectors() -> list[Column]:
    return [tag_is("a"), tag_is("button"), tag_is("input") & (input_type() == "button"),
            tag_is("input") & (input_type() == "submit"), has_attr("onclick"), attr_eq("role", "button"),
            attr_contains("class", "btn")]


def input_selectors() -> list[Column]:
    return [tag_is("input") & (input_type() != "hidden"), tag_is("textarea"), tag_is("select"),
            attr_eq("contenteditable", "true")]


def browser_selectors() -> dict[str, list[Column]]:
    return {"clickable": clickable_selectors(), "input": input_selectors(), "media": media_selectors()}


def page_tool_selectors() -> dict[str, list[Column]]:
    """The page tool's lists, which feed the selector table."""
    return {"clickable": [tag_is("a"), tag_is("button"), tag_is("input") & (input_type() == "button"),
                          tag_is("input") & (input_type() == "submit"), attr_eq("role", "button"), has_class("btn"),
                          has_attr("onclick"), tag_is("input") & (input_type() == "checkbox"),
                          tag_is("input") & (input_type() == "radio")],
            "input": [tag_is("input") & (input_type() != "hidden"), tag_is("textarea"), tag_is("select")]}


def page_analyzer_selectors() -> dict[str, list[Column]]:
    """The page analyzer's lists."""
    types = ("text", "email", "password", "search", "tel", "url", "number", "date")
    return {"clickable": [tag_is("button"), tag_is("a"), tag_is("input") & (input_type() == "button"),
                          tag_is("input") & (input_type() == "submit"), tag_is("input") & (input_type() == "checkbox"),
                          tag_is("input") & (input_type() == "radio"), has_class("btn"), attr_eq("role", "button")],
            "input": [*(tag_is("input") & (attr("type") == t) for t in types), tag_is("textarea"), tag_is("select")]}


def media_selectors() -> list[Column]:
    return [tag_is("video"), tag_is("audio"), tag_is("iframe"), tag_is("canvas")]


HIT_BITS = 62  # hits that one number holds
# Every selector of the lists above asks for one of these tags or of these attributes: a parse for
# ``interactive`` needn't give rows to other elements.
INTERACTIVE_TAGS = ("a", "button", "input", "textarea", "select", "video", "audio", "iframe", "canvas")
INTERACTIVE_ATTRS = ("onclick", "role", "class", "contenteditable")


def error_selectors() -> list[Column]:
    return [has_class("error"), has_class("alert"), has_class("alert-danger"), has_class("alert-error"),
            attr_eq("role", "alert"), attr_contains("class", "error"), attr_contains("class", "alert"),
            has_class("invalid-feedback"), has_class("text-danger")]


def login_error_selectors() -> list[Column]:
    """Ordered list for the single login error message."""
    def own_contains(s):
        return F.coalesce(F.col("own_text").contains(s), F.lit(False))
    return [has_class("error-message"), has_class("alert-danger"), has_class("login-error"),
            tag_is("div") & attr_contains("class", "error"), tag_is("span") & attr_contains("class", "error"),
            tag_is("p") & attr_contains("class", "error"), tag_is("div") & attr_contains("class", "alert"),
            own_contains("エラー"), own_contains("失敗"), own_contains("invalid"), own_contains("incorrect"),
            own_contains("failed")]


def _selector_hits(selectors: Sequence[Column]) -> Column:
    """Array of the 0-based positions of the selectors an element matches."""
    return F.filter(F.array(*[F.when(s, F.lit(i)) for i, s in enumerate(selectors)]), lambda x: x.isNotNull())


# ---- H2 -------------------------------------------------------------------------

def _shown(elements: DataFrame, check_visibility: bool) -> DataFrame:
    """Only displayed elements (no hidden attribute / hidden input / inline
    display:none on the element or an ancestor, not in head) when asked."""
    return elements.filter(F.col("visible")) if check_visibility else elements


def page_summary(elements: DataFrame, kinds: Sequence[str] | None = None,
                 check_visibility: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """H2: title, url and element counts per page. ``kinds`` picks the
    counts wanted (forms, buttons, links, inputs, errors, headings, images,
    tables); the rest are not computed. ``check_visibility`` counts only
    displayed elements (the title is read either way). With ``pages``
    (page_id, url) every page has a row, also one without any element."""
    shown = F.col("visible") if check_visibility else F.lit(True)

    def n(cond: Column) -> Column:
        return F.count_if(shown & cond)

    nonempty = strip_ws(F.coalesce(F.col("text"), F.lit(""))) != ""
    counts = {
        "n_forms": n(tag_is("form")),
        "n_buttons": n(tag_is("button") | (tag_is("input") & input_type().isin("button", "submit"))),
        "n_links": n(tag_is("a")),
        "n_inputs": sum((n(c) for c in input_selectors()[:3]), F.lit(0)),
        "n_errors": sum((n(c & nonempty) for c in error_selectors()), F.lit(0)),
        "n_headings": n(F.col("tag").rlike("^h[1-6]$")),
        "n_images": n(tag_is("img")),
        "n_tables": n(tag_is("table")),
    }
    wanted = [k for k in counts if kinds is None or k[2:] in kinds]
    # One pass over the elements (the element table is often a Python stage
    # upstream): the title elements are collected per page (an object-hash
    # aggregate; a page has one title) instead of a string-valued min_by,
    # which would force a sort-based aggregate over every element.
    per_page = elements.groupBy("page_id", "url").agg(
        F.count(F.lit(1)).alias("n_elements"), *[counts[k].cast("long").alias(k) for k in wanted],
        F.array_min(F.collect_list(F.when(tag_is("title"), F.struct(F.col("idx"), strip_ws(F.col("text")).alias("t")))))
        .alias("_title"))
    out = per_page.select(
        "page_id", "url", F.coalesce(F.col("_title.t"), F.lit("")).alias("title"), "n_elements", *wanted)
    if pages is None:
        return out
    every = pages.select(F.col("page_id").alias("_p"), F.col("url").alias("_u")).distinct()
    return (every.join(out, F.col("_p").eqNullSafe(F.col("page_id")) & F.col("_u").eqNullSafe(F.col("url")), "left")
            .select(F.col("_p").alias("page_id"), F.col("_u").alias("url"), F.coalesce("title", F.lit("")).alias("title"),
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_elements", *wanted)]))


# ---- H3 -------------------------------------------------------------------------

def headings(elements: DataFrame) -> DataFrame:
    """H3: h1-h6 with level, stripped text and position among the page's
    headings of that level."""
    w = Window.partitionBy("page_id", "level").orderBy("idx")
    return (elements.filter(F.col("tag").rlike("^h[1-6]$"))
            .select("page_id", "idx", F.substring("tag", 2, 1).cast("int").alias("level"),
                    strip_ws(F.col("text")).alias("text"))
            .withColumn("ordinal", F.row_number().over(w)))


def headings_grouped(elements: DataFrame) -> DataFrame:
    """H3 grouped form: per page, ``h{n}`` -> texts in document order."""
    return (headings(elements)
            .groupBy("page_id", F.concat(F.lit("h"), F.col("level").cast("string")).alias("level"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_t"))
            .groupBy("page_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("level", F.transform("_t", lambda x: x["text"]))))
                 .alias("headings")))


# ---- H4-H7, H9-H11 ---------------------------------------------------------------

def forms(elements: DataFrame) -> DataFrame:
    """H4: id (default ``unnamed_form_{i}``, i = 0-based form position in the
    page), action, method upper-cased (default GET)."""
    w = Window.partitionBy("page_id").orderBy("idx")
    f = elements.filter(tag_is("form")).withColumn("_i", F.row_number().over(w) - 1)
    return f.select("page_id", "idx",
                    F.coalesce(F.col("id"), F.concat(F.lit(UNNAMED_FORM), F.col("_i").cast("string"))).alias("form_id"),
                    F.coalesce(attr("action"), F.lit("")).alias("action"),
                    F.upper(F.coalesce(attr("method"), F.lit("get"))).alias("method"))


def _path_key(anc: Column, upto: Column) -> Column:
    """Identity of the ancestor at depth ``upto`` (1-based) in ``anc``: the
    chain of child positions from the root, which is unique per element."""
    return F.array_join(F.transform(F.slice(anc, 1, upto), lambda a: a["nth_child"].cast("string")), ".")


def within(elements: DataFrame, container_tag: str) -> DataFrame:
    """Elements inside each ``container_tag`` element: (page_id,
    container_idx, <element columns>). Joined by (page, tree path) so it is
    an equi-join partitioned by page, not a pairwise scan."""
    holders = elements.filter(tag_is(container_tag)).select(
        "page_id", F.col("idx").alias("container_idx"), _path_key(F.col("anc"), F.size("anc")).alias("_key"))
    pos = F.sequence(F.lit(1), F.greatest(F.size("anc") - 1, F.lit(1)))
    inner = (elements
             .withColumn("_d", F.explode(F.filter(pos, lambda d: (d < F.size(F.col("anc")))
                                                  & (F.col("anc")[d - 1]["tag"] == container_tag))))
             .withColumn("_key", _path_key(F.col("anc"), F.col("_d"))))
    return inner.join(holders, ["page_id", "_key"]).drop("_key", "_d")


def form_inputs(elements: DataFrame) -> DataFrame:
    """H5: inputs / selects / textareas of each form: type (``input`` ->
    its type attribute, default text; else the tag), name, id,
    placeholder, required."""
    f = forms(elements).select("page_id", F.col("idx").alias("container_idx"), "form_id")
    inner = within(elements, "form").filter(tag_is("input", "select", "textarea"))
    typ = F.when(tag_is("input"), F.coalesce(attr("type"), F.lit("text"))).otherwise(F.col("tag"))
    return inner.join(f, ["page_id", "container_idx"]).select(
        "page_id", "form_id", F.col("idx").alias("input_idx"), typ.alias("type"),
        F.coalesce(attr("name"), F.lit("")).alias("name"), F.coalesce(F.col("id"), F.lit("")).alias("id"),
        F.coalesce(attr("placeholder"), F.lit("")).alias("placeholder"), has_attr("required").alias("required"))


def inputs(elements: DataFrame, visible_only: bool = True) -> DataFrame:
    """H6: input fields (non-hidden inputs, textareas, selects); selects get
    their option count (children ``option`` elements)."""
    sel = input_selectors()[:3] if visible_only else [tag_is("input"), tag_is("textarea"), tag_is("select")]
    cond = sel[0] | sel[1] | sel[2]
    opts = (elements.filter(tag_is("option") & F.col("parent_idx").isNotNull())
            .groupBy("page_id", F.col("parent_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_options")))
    typ = dom_type()
    return (elements.filter(cond)
            .join(opts, ["page_id", "idx"], "left")
            .select("page_id", "idx", "tag", typ.alias("type"),
                    F.coalesce(attr("name"), F.lit("")).alias("name"), F.coalesce(F.col("id"), F.lit("")).alias("id"),
                    F.coalesce(attr("value"), F.lit("")).alias("value"),
                    F.coalesce(attr("placeholder"), F.lit("")).alias("placeholder"),
                    has_attr("required").alias("required"), has_attr("readonly").alias("readonly"),
                    F.when(tag_is("select"), F.coalesce(F.col("n_options"), F.lit(0))).alias("n_options")))


def buttons(elements: DataFrame, check_visibility: bool = False) -> DataFrame:
    """H7: ``button``, ``input[type=button|submit]``, ``a.btn`` and
    ``a[role=button]`` (type ``link-button``); text falls back to value."""
    elements = _shown(elements, check_visibility)
    is_link_button = tag_is("a") & (has_class("btn") | attr_eq("role", "button"))
    cond = tag_is("button") | (tag_is("input") & input_type().isin("button", "submit")) | is_link_button
    typ = F.when(is_link_button, F.lit("link-button")).otherwise(F.coalesce(attr("type"), F.lit("")))
    text = F.coalesce(F.nullif(strip_ws(F.col("text")), F.lit("")), attr("value"), F.lit(""))
    return elements.filter(cond).select("page_id", "idx", "tag", F.coalesce(F.col("id"), F.lit("")).alias("id"),
                                        text.alias("text"), typ.alias("type"))


def links(elements: DataFrame, check_visibility: bool = False) -> DataFrame:
    """H8: ``a`` elements with an href: text, href, title, target and both
    external-link definitions (``is_external``: http/https/'//' prefix;
    ``is_external_page``: that and not under the page's own URL)."""
    elements = _shown(elements, check_visibility)
    w = Window.partitionBy("page_id").orderBy("idx")
    href = attr("href")
    ext = href.startswith("http") | href.startswith("//")
    return (elements.filter(tag_is("a") & has_attr("href"))
            .select("page_id", "idx", strip_ws(F.col("text")).alias("text"), href.alias("href"),
                    F.coalesce(attr("title"), F.lit("")).alias("title"),
                    F.coalesce(attr("target"), F.lit("")).alias("target"),
                    ext.alias("is_external"), (ext & ~href.startswith(F.col("url"))).alias("is_external_page"))
            .withColumn("ordinal", F.row_number().over(w)))


def images(elements: DataFrame) -> DataFrame:
    """H9: src, alt, title, width, height ('' when missing)."""
    return elements.filter(tag_is("img")).select(
        "page_id", "idx", *[F.coalesce(attr(a), F.lit("")).alias(a) for a in ("src", "alt", "title", "width", "height")])


def meta_tags(elements: DataFrame) -> DataFrame:
    """Per page, ``name`` (else ``property``) -> content; the last tag
    with a name wins; tags without a name are skipped."""
    key = F.coalesce(attr("name"), attr("property"))
    m = (elements.filter(tag_is("meta") & key.isNotNull() & (key != ""))
         .select("page_id", "idx", key.alias("name"), F.coalesce(attr("content"), F.lit("")).alias("content"))
         .groupBy("page_id", "name").agg(F.max_by("content", "idx").alias("content")))
    return m


def html_tables(elements: DataFrame) -> DataFrame:
    """Per table: id (default ``unnamed_table_{i}``), header texts, row
    count, column count (th count, else cells of the first row)."""
    w = Window.partitionBy("page_id").orderBy("idx")
    t = (elements.filter(tag_is("table")).withColumn("_i", F.row_number().over(w) - 1)
         .select("page_id", F.col("idx").alias("container_idx"),
                 F.coalesce(F.col("id"), F.concat(F.lit(UNNAMED_TABLE), F.col("_i").cast("string"))).alias("table_id")))
    inner = within(elements, "table")
    rows = inner.filter(tag_is("tr"))
    first_row = rows.groupBy("page_id", "container_idx").agg(F.min("idx").alias("_first_tr"))
    # cells anywhere below the first row (a recursive search, as the
    # original find-all does), matched to the row by its tree path
    row_cells = (within(elements, "tr").filter(tag_is("td", "th"))
                 .select("page_id", F.col("container_idx").alias("_first_tr")))
    first_cells = (row_cells.join(first_row, ["page_id", "_first_tr"])
                   .groupBy("page_id", "container_idx").agg(F.count(F.lit(1)).alias("_first_cells")))
    ths = (inner.filter(tag_is("th")).groupBy("page_id", "container_idx")
           .agg(F.array_sort(F.collect_list(F.struct("idx", strip_ws(F.col("text")).alias("t")))).alias("_h")))
    n_rows = rows.groupBy("page_id", "container_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    out = (t.join(ths, ["page_id", "container_idx"], "left").join(n_rows, ["page_id", "container_idx"], "left")
           .join(first_cells, ["page_id", "container_idx"], "left"))
    headers = F.coalesce(F.transform("_h", lambda x: x["t"]), F.array().cast("array<string>"))
    n_th = F.size(headers)
    return out.select("page_id", F.col("container_idx").alias("idx"), "table_id", headers.alias("headers"),
                      F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
                      F.when(n_th > 0, n_th).otherwise(F.coalesce(F.col("_first_cells"), F.lit(0))).cast("long")
                      .alias("n_columns"))


# ---- H12-H15 ---------------------------------------------------------------------

def error_messages(elements: DataFrame, check_visibility: bool = False) -> DataFrame:
    """Elements matching any of the error selectors with non-empty
    text; one row per (element, matching selector) like the selector loop."""
    return (_shown(elements, check_visibility).select("page_id", "idx", strip_ws(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
                            F.explode(_selector_hits(error_selectors())).alias("selector"))
            .filter(F.col("text") != ""))


def login_error_message(elements: DataFrame) -> DataFrame:
    """H12 single-message form: the first hit of the ordered selector list
    (document order inside a selector), else all error messages joined by
    '; ' (in selector, then document order); pages with neither are
    absent."""
    t = strip_ws(F.coalesce(F.col("text"), F.lit("")))
    first = (elements.select("page_id", "idx", t.alias("text"),
                             F.array_min(_selector_hits(login_error_selectors())).alias("prio"))
             .filter(F.col("prio").isNotNull() & (F.col("text") != ""))
             .groupBy("page_id").agg(F.min_by("text", F.struct("prio", "idx")).alias("first")))
    joined = (error_messages(elements).groupBy("page_id")
              .agg(F.array_sort(F.collect_list(F.struct("selector", "idx", "text"))).alias("_m"))
              .select("page_id", F.array_join(F.transform("_m", lambda x: x["text"]), ERROR_JOIN).alias("joined")))
    return (first.join(joined, "page_id", "full")
            .select("page_id", F.coalesce(F.col("first"), F.col("joined")).alias("message")))


def interactive(elements: DataFrame, kinds: Sequence[str] = ("clickable", "input", "media"),
                check_visibility: bool = False, lists: dict[str, list[Column]] | None = None,
                keep: Sequence[str] = (), named: dict[str, dict[str, list[Column]]] | None = None) -> DataFrame:
    """Interactive elements by kind; an element appears once per
    selector of its kind that it matches (as the selector loops do). ``lists``
    holds the selectors of each kind: ``browser_selectors`` (default),
    ``page_tool_selectors`` or ``page_analyzer_selectors``; ``keep`` names more
    columns of the elements that their rows carry. ``named`` holds several such lists, all of whose kinds are
    found in one pass over the elements; a first column ``lists`` names the list."""
    elements = _shown(elements, check_visibility)
    which = {n: [(k, s) for k in by_kind for s in enumerate(by_kind[k])] for n, by_kind in named.items()} if named else {
        None: [(k, s) for k in kinds for s in enumerate((lists or browser_selectors())[k])]}
    hits = [(n, k, i, sel) for n, sels in which.items() for k, (i, sel) in sels]
    # an element's hits are bits of numbers (plain conditions, nothing is built for a selector that doesn't match); a
    # table of the selectors then gives each bit its row, and what a row carries is built once an element
    groups = [hits[at:at + HIT_BITS] for at in range(0, len(hits), HIT_BITS)]
    bits = [reduce(lambda x, y: x.bitwiseOR(y), [F.when(h[3], F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))
                                                 for at, h in enumerate(g)]).alias(f"_bits{j}") for j, g in enumerate(groups)]
    text = F.coalesce(F.nullif(strip_ws(F.coalesce(F.col("text"), F.lit(""))), F.lit("")), attr("value"), F.lit(""))
    found = elements.select(
        "page_id", "idx", "tag", text.alias("text"), dom_type().alias("type"), F.coalesce(attr("name"), F.lit("")).alias("name"),
        F.coalesce(attr("src"), F.lit("")).alias("src"), *keep, *bits)
    table = F.array(*[F.struct(F.lit(n).cast("string").alias("lists"), F.lit(k).alias("kind"), F.lit(i).alias("selector"),
                               F.lit(j).alias("group"), F.lit(1 << at).cast("long").alias("bit"))
                      for j, g in enumerate(groups) for at, (n, k, i, _) in enumerate(g)])
    hit = reduce(lambda x, y: x | y, [(F.col("_h.group") == j) & (F.col(f"_bits{j}").bitwiseAND(F.col("_h.bit")) != 0)
                                      for j in range(len(groups))], F.lit(False))
    rows = found.select("*", F.explode(table).alias("_h")).filter(hit)
    return rows.select(*([F.col("_h.lists").alias("lists")] if named else []), "page_id", "idx", F.col("_h.kind").alias("kind"),
                       F.col("_h.selector").alias("selector"), "tag", "text", "type", "name", "src", *keep)


def _match(col: Column, needle: str, exact: bool, case_sensitive: bool) -> Column:
    c = col if case_sensitive else F.lower(col)
    n = needle if case_sensitive else needle.lower()
    return (c == F.lit(n)) if exact else c.contains(n)


def text_search(elements: DataFrame, needle: str, exact: bool = False, case_sensitive: bool = False,
                tags: Sequence[str] | None = None, on: str = "own_text") -> DataFrame:
    """Elements whose own text contains / equals ``needle``."""
    cond = F.coalesce(_match(F.col(on), needle, exact, case_sensitive), F.lit(False))
    if tags:
        cond = cond & tag_is(*tags)
    return elements.filter(cond).select("page_id", "idx", "tag", "own_text")


def text_search_best(elements: DataFrame, needle: str, tags: Sequence[str], exact: bool = False,
                     case_sensitive: bool = False) -> DataFrame:
    """Per page the first element of the first non-empty stage:
    (1) an allowed-tag element whose own text matches, (2) the nearest
    allowed-tag ancestor of any element whose own text matches, (3) an
    allowed-tag element with a ``div`` descendant whose own text matches."""
    allowed = list(tags)
    hit = F.coalesce(_match(F.col("own_text"), needle, exact, case_sensitive), F.lit(False))
    hits = elements.filter(hit)
    s1 = hits.filter(tag_is(*allowed)).select("page_id", F.lit(1).alias("stage"), F.col("idx").alias("order"),
                                              F.col("idx").alias("found_idx"))
    # nearest allowed ancestor: last entry of the ancestor path (excluding
    # self) with an allowed tag; its idx is recovered by the path join.
    pos = F.sequence(F.lit(1), F.greatest(F.size("anc") - 1, F.lit(1)))
    anc_ok = F.filter(pos, lambda d: (d < F.size(F.col("anc"))) & F.col("anc")[d - 1]["tag"].isin(*allowed))
    s2_keys = (hits.select("page_id", F.col("idx").alias("order"), "anc", F.array_max(anc_ok).alias("_d"))
               .filter(F.col("_d").isNotNull())
               .select("page_id", "order", _path_key(F.col("anc"), F.col("_d")).alias("_key")))
    s3_keys = (hits.filter(tag_is("div"))
               .select("page_id", F.col("idx").alias("order"), "anc",
                       F.explode(anc_ok).alias("_d"))
               .select("page_id", "order", _path_key(F.col("anc"), F.col("_d")).alias("_key")))
    keyed = elements.select("page_id", F.col("idx").alias("found_idx"),
                            _path_key(F.col("anc"), F.size("anc")).alias("_key"))
    s2 = s2_keys.join(keyed, ["page_id", "_key"]).select("page_id", F.lit(2).alias("stage"), "order", "found_idx")
    s3 = (s3_keys.join(keyed, ["page_id", "_key"])
          .select("page_id", F.lit(3).alias("stage"), F.col("found_idx").alias("order"), "found_idx"))
    best = (s1.unionByName(s2).unionByName(s3).groupBy("page_id")
            .agg(F.min_by(F.struct("stage", "found_idx"), F.struct("stage", "order")).alias("b")))
    return (best.select("page_id", F.col("b.stage").alias("stage"), F.col("b.found_idx").alias("idx"))
            .join(elements.select("page_id", "idx", "tag", "own_text"), ["page_id", "idx"]))


# ---- H24-H26 ----------------------------------------------------------------------

def structure_candidates() -> dict[str, list[Column]]:
    """Candidate selectors per page region, in priority order."""
    return {
        "top_bar": [F.col("id") == "top-bar", tag_is("header"), has_class("navbar"), has_class("header"),
                    attr_eq("role", "banner"), tag_is("nav") & has_class("navbar")],
        "side_bar": [F.col("id") == "navbar", has_class("sidebar"), F.col("id") == "sidebar", has_class("sidenav"),
                     has_class("menu-nav"), has_class("side-menu")],
        "main_content": [tag_is("main"), F.col("id") == "content", has_class("content"), attr_eq("role", "main"),
                         has_class("main-content"), has_class("container")],
        "navigation": [tag_is("nav"), attr_eq("role", "navigation"), has_class("navigation"),
                       has_class("nav-container")],
    }


def page_structure(elements: DataFrame) -> DataFrame:
    """Per page and region, the first element of the first candidate
    selector that matches anything (all candidates are tried in order)."""
    regions = structure_candidates()
    arr = F.concat(*[_tagged(_selector_hits([F.coalesce(c, F.lit(False)) for c in cands]), "region", r)
                     for r, cands in regions.items()])
    return (elements.select("page_id", "idx", "tag", F.explode(arr).alias("_h"))
            .groupBy("page_id", F.col("_h.region").alias("region"))
            .agg(F.min_by(F.struct("idx", "tag"), F.struct(F.col("_h.selector"), F.col("idx"))).alias("e"))
            .select("page_id", "region", F.col("e.idx").alias("idx"), F.col("e.tag").alias("tag")))


def dedup_elements(candidates: DataFrame, key: str = "xpath", order: str = "order",
                   location: str | None = None, kind: str | None = None) -> DataFrame:
    """Drop candidates whose node or xpath (and, when a ``location``
    column is given, whose (tag, text, location)) equals an earlier kept
    one; with a ``kind`` column only those of the same kind count. The node
    fixes the xpath, so the node rule is implied by the xpath rule; each rule
    is a keep-first aggregate (no sort of a hot key)."""
    cols, within = candidates.columns, ["page_id", *([kind] if kind else [])]
    keep_first = (candidates.groupBy(*within, key)
                  .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select("_r.*"))
    if location is None:
        return keep_first
    return (keep_first.groupBy(*within, "tag", "text", location)
            .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select("_r.*"))


# The labels of the category summary, in display order.
CATEGORY_LABELS = ["トップバー", "サイドバー", "ナビゲーションバー", "サブメニュー", "テーブル", "フォーム",
                   "ボタン", "リンク", "コンテンツ本体", "その他"]


def category_summary(categorized: DataFrame, labels: Sequence[str] = CATEGORY_LABELS) -> DataFrame:
    """Elements per category over the fixed label list, zero rows
    included (labels outside the list are added after it)."""
    spark = categorized.sparkSession
    lab = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "pos int, category string")
    counts = categorized.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return (lab.join(counts, "category", "full")
            .select(F.coalesce(F.col("pos"), F.lit(len(labels))).alias("pos"), "category",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# ---- H29-H31 ----------------------------------------------------------------------

def page_slug(url: Column) -> Column:
    """Host + '_' + path ('/' -> '_', only letters, digits and '_-.',
    first 30 chars); host alone when the path is empty or '/'."""
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    part = F.regexp_replace(F.replace(F.regexp_replace(path, r"^/+|/+\z", ""), F.lit("/"), F.lit("_")),
                            r"[^\p{L}\p{N}_.-]", "")
    return F.when((path != "") & (path != "/") & (part != ""),
                  F.concat(netloc, F.lit("_"), F.substring(part, 1, 30))).otherwise(netloc)


def alert_kind(text: Column) -> Column:
    """Confirm / prompt / alert by keywords."""
    low = F.lower(text)
    return (F.when(text.contains("?") | text.contains("確認") | low.contains("confirm"), F.lit(ALERT_CONFIRM))
            .when(text.contains("入力") | text.contains("プロンプト") | low.contains("prompt"), F.lit(ALERT_PROMPT))
            .otherwise(F.lit(ALERT_ALERT)))


def page_metrics(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Per page: url, hash of the source, element count and body text length
    (narrow rows: no source crosses an exchange)."""
    m = elements.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.coalesce(F.max(F.when(tag_is("body"), F.length("text"))), F.lit(0)).alias("text_len"))
    return (pages.select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("source"))
            .join(m, "page_id", "left"))


def page_changes(before: DataFrame, after: DataFrame, element_delta: int = 5, text_delta: int = 20) -> DataFrame:
    """Compare two snapshots (page_metrics rows) per url: changed if
    the source differs, or |d elements| > 5, or |d text length| > 20.
    Pages present on one side only count as changed; of a url that a
    snapshot holds several times its largest page_id counts."""
    def side(df, n):
        last = F.max_by(F.struct("source", "n_elements", "text_len"), "page_id")
        return df.groupBy("url").agg(last.alias("_m")).select(
            F.col("url").alias(f"u{n}"), F.col("_m.source").alias(f"h{n}"), F.col("_m.n_elements").alias(f"e{n}"),
            F.col("_m.text_len").alias(f"t{n}"))
    j = side(before, 0).join(side(after, 1), F.col("u0").eqNullSafe(F.col("u1")), "full")
    src = ~F.coalesce(F.col("h0") == F.col("h1"), F.lit(False))
    de = F.coalesce(F.col("e1"), F.lit(0)) - F.coalesce(F.col("e0"), F.lit(0))
    dt = F.coalesce(F.col("t1"), F.lit(0)) - F.coalesce(F.col("t0"), F.lit(0))
    return j.select(F.coalesce("u0", "u1").alias("url"), src.alias("source_changed"), de.cast("long").alias("d_elements"),
                    dt.cast("long").alias("d_text"),
                    (src | (F.abs(de) > element_delta) | (F.abs(dt) > text_delta)).alias("changed"))
