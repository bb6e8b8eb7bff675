"""Selectors, categories and the selector table.

All selector strings are built from the element's ancestor path with array
functions (``slice``, ``transform``, ``array_join``); nothing walks a DOM.
The only cross-element fact a selector needs is whether a class list is
unique in its page; that is a count over the
intersected bitmaps of its classes (see ``class_superset_counts``; no pairs of elements
or sets are formed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws
from quarry.operators.page_elements import attr, classes, dedup_elements, interactive, page_tool_selectors, tag_is

# Labels.
GROUP_DEFAULT = "detailed_analysis"
KIND_CLICKABLE = "クリック可能"
KIND_INPUT = "入力フィールド"
CATEGORY_FORM = CAT_FORM = "フォーム"
CAT_NAV, CAT_SIDE, CAT_BUTTON, CAT_LINK, CAT_TAB, CAT_MENU, CAT_HEADER, CAT_FOOTER, CAT_OTHER = (
    "ナビゲーションバー", "サイドバー", "ボタン", "リンク", "タブ", "メニュー", "ヘッダー", "フッター", "その他")
CAT_TOP, CAT_SUB, CAT_TABLE, CAT_CONTENT = "トップバー", "サブメニュー", "テーブル", "コンテンツ本体"
IMPORTANT_CLASS_RE = r"^(nav|menu|btn|button|tab|header|footer|main|content|row|col)"
IMPORTANT_CLASSES = ("active", "selected", "primary", "secondary", "container")
CSS_MAX_LEVELS = 4
RELIABLE_TEXT_MAX = 50
RELIABLE_CLASS_MAX = 3


def _step(a: Column) -> Column:
    """XPath step: tag, plus [n] for the 2nd+ same-tag sibling."""
    return F.concat(a["tag"], F.when(a["nth_tag"] > 1, F.concat(F.lit("["), a["nth_tag"].cast("string"), F.lit("]")))
                    .otherwise(F.lit("")))


def xpath_steps(anc: Column) -> Column:
    return F.array_join(F.transform(anc, _step), "/")


def xpath_soup(anc: Column) -> Column:
    """H18 soup form: ``//html/body/...`` (document root not a step)."""
    return F.concat(F.lit("//"), xpath_steps(anc))


def xpath_id(anc: Column, el_id: Column) -> Column:
    """H18 id-shortcut form: ``//*[@id='x']`` else ``/html/body/...``."""
    return F.when(F.coalesce(el_id, F.lit("")) != "", F.concat(F.lit("//*[@id='"), el_id, F.lit("']"))) \
        .otherwise(F.concat(F.lit("/"), xpath_steps(anc)))


def xpath_full(anc: Column) -> Column:
    """H18 absolute form: ``//*/html/body/...``."""
    return F.concat(F.lit("//*/"), xpath_steps(anc))


def class_key(c: Column) -> Column:
    """Canonical class set: distinct names sorted, joined by '.'."""
    return F.array_join(F.array_sort(F.array_distinct(classes(c))), ".")


#: elements that one word of a bitmap holds
WORD = 62


def class_superset_counts(elements: DataFrame) -> DataFrame:
    """(page_id, class_key, n_containing): how many elements of the page have
    all the classes of ``class_key``, for every key that is some element's
    full class set (the keys the CSS rule looks up).

    Each class of a page has a bitmap of the elements that have it (words of ``WORD`` bits, only
    those with a bit). The bitmaps of a set's classes are intersected, the shortest first, and the bits
    left are counted. A set meets one row per class of its own, however many other sets share the class.
    """
    cls = F.array_sort(F.array_distinct(classes(F.col("class"))))
    held = elements.select("page_id", "idx", cls.alias("_c")).filter(F.size("_c") > 0)
    each = held.select("page_id", "idx", F.explode("_c").alias("_cls"))
    words = each.groupBy("page_id", "_cls", F.floor(F.col("idx") / F.lit(WORD)).cast("int").alias("_w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, idx % {WORD})")).alias("_b"))
    postings = words.groupBy("page_id", "_cls").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_bits"))
    sets = held.select("page_id", "_c").distinct().select("page_id", "_c", F.explode("_c").alias("_cls"))
    met = sets.join(postings, ["page_id", "_cls"]).groupBy("page_id", "_c").agg(F.array_sort(
        F.collect_list("_bits"), lambda a, b: F.size(a) - F.size(b)).alias("_all"))
    left = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), lambda a, b: F.map_filter(
        F.transform_values(a, lambda w, x: F.coalesce(x.bitwiseAND(F.try_element_at(b, w)), F.lit(0).cast("long"))), lambda _, x: x != 0))
    n = F.aggregate(F.map_values(left), F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))
    return met.select("page_id", F.array_join("_c", ".").alias("class_key"), n.alias("n_containing"))


def with_css_levels(elements: DataFrame) -> DataFrame:
    """Adds ``css_levels``, the ``css`` of an element whose classes don't make it unique: ``#id``, else its
    levels. It needs the element's own row only, so whoever drops ``anc`` after it moves no paths."""
    n = F.size("anc")
    start = F.greatest(n - (CSS_MAX_LEVELS - 1), F.lit(1))
    window = F.sequence(start, n)
    id_pos = F.array_max(F.filter(window, lambda p: F.coalesce(F.col("anc")[p - 1]["id"], F.lit("")) != ""))
    first = F.coalesce(id_pos, start)

    def level(p):
        a = F.col("anc")[p - 1]
        plain = F.concat(a["tag"], F.when(a["nth_tag"] > 1, F.concat(F.lit(":nth-child("), a["nth_tag"].cast("string"),
                                                                       F.lit(")"))).otherwise(F.lit("")))
        # from the first level on only that one can have an id
        return F.when(F.coalesce(a["id"], F.lit("")) != "", F.concat(F.lit("#"), a["id"])).otherwise(plain)

    path = F.array_join(F.transform(F.sequence(first, n), level), " > ")
    has_id = F.coalesce(F.col("id"), F.lit("")) != ""
    return elements.withColumn("css_levels", F.when(has_id, F.concat(F.lit("#"), F.col("id"))).otherwise(path))


def css_selector(elements: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``#id``; else ``.a.b`` when exactly one element of the page has
    all those classes; else up to 4 levels of ``tag`` /
    ``tag:nth-child(n)`` (n counts same-tag siblings, written when > 1)
    joined by `` > ``, stopping at (and including) an ancestor with an id.
    Adds column ``css`` to ``targets`` (default: every element); class
    uniqueness is always counted over all ``elements`` of the page. Without ``targets``, elements that have
    an id or no class meet no count and cross no exchange. Elements that have ``css_levels`` need no ``anc``. Where
    the parse has counted (``n_class``; for pages that are alone under their page_id), nothing is counted or joined."""
    el = elements if targets is None else targets
    out = [*(c for c in el.columns if c not in ("css_levels", "n_class")), "css"]
    if "css_levels" not in el.columns:
        el = with_css_levels(el)
    asks = (F.coalesce(F.col("id"), F.lit("")) == "") & (F.size(classes(F.col("class"))) > 0)
    unique = F.concat(F.lit("."), F.array_join(classes(F.col("class")), "."))
    if "n_class" in el.columns:
        alone = (F.coalesce(F.col("id"), F.lit("")) == "") & (F.col("n_class") == 1)
        return el.withColumn("css", F.when(alone, unique).otherwise(F.col("css_levels"))).select(*out)
    counts = class_superset_counts(elements)
    if targets is None:
        rest = el.filter(~asks).withColumn("css", F.col("css_levels")).select(*out)
        el = el.filter(asks)
    el = el.withColumn("class_key", F.when(asks, class_key(F.col("class")))).join(counts, ["page_id", "class_key"], "left")
    el = el.withColumn("css", F.when(F.col("n_containing") == 1, unique).otherwise(F.col("css_levels"))).select(*out)
    return el if targets is not None else el.unionByName(rest)


def add_xpaths(elements: DataFrame) -> DataFrame:
    """Columns ``xpath`` (id shortcut form), ``xpath_soup`` and
    ``full_xpath``."""
    return (elements.withColumn("xpath", xpath_id(F.col("anc"), F.col("id")))
            .withColumn("xpath_soup", xpath_soup(F.col("anc")))
            .withColumn("full_xpath", xpath_full(F.col("anc"))))


def data_attributes(attrs: Column) -> Column:
    """``data-a-b`` -> key ``a_b`` for non-empty values."""
    kept = F.map_filter(attrs, lambda k, v: k.startswith("data-") & (v != ""))
    return F.transform_keys(kept, lambda k, v: F.replace(F.replace(k, F.lit("data-"), F.lit("")),
                                                         F.lit("-"), F.lit("_")))


def _contains(c: Column, s: str) -> Column:
    return F.coalesce(c.contains(s), F.lit(False))


def category_simple(tag: Column, cls: Column) -> Column:
    """H23, first rule set (no layout: position rules fall to その他)."""
    c = F.lower(F.coalesce(cls, F.lit("")))
    return (F.when(_contains(c, "navbar") | _contains(c, "nav-") | (tag == "nav"), F.lit(CAT_NAV))
            .when(_contains(c, "sidebar") | _contains(c, "side-"), F.lit(CAT_SIDE))
            .when(_contains(c, "btn") | (tag == "button"), F.lit(CAT_BUTTON))
            .when(tag == "a", F.lit(CAT_LINK))
            .when(_contains(c, "tab"), F.lit(CAT_TAB))
            .when(_contains(c, "menu"), F.lit(CAT_MENU))
            .when(_contains(c, "header"), F.lit(CAT_HEADER))
            .when(_contains(c, "footer"), F.lit(CAT_FOOTER))
            .otherwise(F.lit(CAT_OTHER)))


def category_detailed(tag: Column, cls: Column, el_id: Column, parent_cls: Column,
                      container: Column | None = None) -> Column:
    """H23, second rule set (container region, class / id keywords, parent
    class for links and menu items)."""
    c = F.lower(F.coalesce(cls, F.lit("")))
    i = F.lower(F.coalesce(el_id, F.lit("")))
    pc = F.lower(F.coalesce(parent_cls, F.lit("")))
    cont = F.coalesce(container, F.lit("unknown")) if container is not None else F.lit("unknown")

    def any_of(*words):
        out = F.lit(False)
        for w in words:
            out = out | _contains(c, w) | _contains(i, w)
        return out

    navish = any_of("nav", "header", "menu")
    return (F.when(cont == "top_bar", F.lit(CAT_TOP))
            .when(cont == "side_bar", F.lit(CAT_SIDE))
            .when(cont == "navigation", F.lit(CAT_NAV))
            .when(_contains(c, "menu-item") | _contains(c, "menu-nav") | _contains(i, "menu-item"),
                  F.when(_contains(pc, "submenu") | _contains(pc, "sub-menu") | _contains(pc, "dropdown"),
                         F.lit(CAT_SUB)).otherwise(F.lit(CAT_SIDE)))
            .when(navish,
                  F.when(_contains(c, "top") | _contains(c, "header") | _contains(c, "main-nav"), F.lit(CAT_TOP))
                  .when(_contains(c, "sub") | _contains(i, "sub"), F.lit(CAT_SUB))
                  .when(_contains(c, "side") | _contains(i, "side"), F.lit(CAT_SIDE))
                  .otherwise(F.lit(CAT_NAV)))
            .when(any_of("sidebar", "side-bar", "sidenav"), F.lit(CAT_SIDE))
            .when(tag.isin("table", "tr", "td", "th") | any_of("table"), F.lit(CAT_TABLE))
            .when(tag.isin("form", "input", "select", "textarea") | any_of("form"), F.lit(CAT_FORM))
            .when((tag == "button") | _contains(c, "btn") | _contains(c, "button") | _contains(c, "submit")
                  | _contains(i, "btn"), F.lit(CAT_BUTTON))
            .when(tag == "a", F.when(_contains(pc, "menu"), F.lit(CAT_SIDE))
                  .when(_contains(pc, "navbar") | _contains(pc, "nav") | _contains(pc, "header"), F.lit(CAT_TOP))
                  .otherwise(F.lit(CAT_LINK)))
            .when(any_of("content", "main", "body"), F.lit(CAT_CONTENT))
            .otherwise(F.lit(CAT_OTHER)))


def parent_class(anc: Column) -> Column:
    return F.when(F.size(anc) > 1, anc[F.size(anc) - 2]["class"])


def element_category(elements: DataFrame) -> DataFrame:
    """Both rule sets as columns ``category`` and ``category_detailed``."""
    return (elements.withColumn("category", category_simple(F.col("tag"), F.col("class")))
            .withColumn("category_detailed",
                        category_detailed(F.col("tag"), F.col("class"), F.col("id"), parent_class(F.col("anc")))))


def reliable_selectors(tag: Column, text: Column, el_id: Column, cls: Column, data: Column) -> Column:
    """Ordered [{type, value}]: data attributes, id, class (< 3
    names), text xpath (< 50 chars)."""
    data_sel = F.transform(F.map_entries(F.map_filter(data, lambda k, v: v != "")),
                           lambda e: F.struct(F.lit("css").alias("type"),
                                              F.concat(tag, F.lit("["), e["key"], F.lit("='"), e["value"], F.lit("']"))
                                              .alias("value")))
    cls_s = F.coalesce(cls, F.lit(""))
    n_cls = F.size(F.filter(F.split(cls_s, " "), lambda x: x != ""))
    singles = F.array(
        F.when(F.coalesce(el_id, F.lit("")) != "",
               F.struct(F.lit("css").alias("type"), F.concat(F.lit("#"), el_id).alias("value"))),
        F.when((cls_s != "") & (n_cls < RELIABLE_CLASS_MAX),
               F.struct(F.lit("css").alias("type"), F.concat(F.lit("."), F.replace(cls_s, F.lit(" "), F.lit("."))).alias("value"))),
        F.when((F.coalesce(text, F.lit("")) != "") & (F.length(text) < RELIABLE_TEXT_MAX),
               F.struct(F.lit("xpath").alias("type"),
                        F.concat(F.lit("//"), tag, F.lit("[text()='"), F.replace(text, F.lit("'"), F.lit("\\'")),
                                 F.lit("']")).alias("value"))),
    )
    return F.concat(data_sel, F.filter(singles, lambda s: s.isNotNull()))


def element_selectors(el: DataFrame) -> DataFrame:
    """Id / css / css_simple / xpath / full_xpath with the fallback
    order of the element record, plus its reliable-selector list. Needs the
    ``css``, ``xpath``, ``full_xpath`` columns (H16, H18)."""
    eid = F.coalesce(F.col("id"), F.lit(""))
    has_id = strip_ws(eid) != ""
    cls = F.coalesce(F.col("class"), F.lit(""))
    has_cls = strip_ws(cls) != ""
    css_simple = F.when(has_cls, F.concat(F.lit("."), F.replace(cls, F.lit(" "), F.lit(".")))).otherwise(F.col("tag"))
    # Without a generated path: first data attribute, else up to two
    # important classes, else the first class, else the simple form.
    data = F.map_entries(F.map_filter(F.col("attrs"), lambda k, v: k.startswith("data-") & (strip_ws(v) != "")))
    first_data = F.try_element_at(data, F.lit(1))
    data_sel = F.concat(F.col("tag"), F.lit("["), first_data["key"], F.lit("='"),
                        F.replace(first_data["value"], F.lit("'"), F.lit("\\'")), F.lit("']"))
    cls_list = F.filter(F.split(cls, r"[ \t\n\f\r]+"), lambda c: c != "")
    important = F.filter(cls_list, lambda c: c.rlike(IMPORTANT_CLASS_RE) | c.isin(*IMPORTANT_CLASSES))
    by_class = (F.when(F.size(important) > 0,
                       F.concat(F.col("tag"), F.lit("."), F.array_join(F.slice(important, 1, 2), ".")))
                .when(F.size(cls_list) > 0, F.concat(F.col("tag"), F.lit("."), cls_list[0])))
    fallback = F.coalesce(F.when(first_data.isNotNull(), data_sel), F.when(has_cls, by_class), css_simple)
    css = F.when(F.coalesce(F.col("css"), F.lit("")) != "", F.col("css")) \
        .when(has_id, F.concat(F.lit("#"), eid)).otherwise(fallback)
    xp = F.coalesce(F.nullif(F.col("xpath"), F.lit("")), F.concat(F.lit("//"), F.col("tag")))
    full = F.coalesce(F.nullif(F.col("full_xpath"), F.lit("")), xp)
    text = strip_ws(F.coalesce(F.col("text"), F.lit("")))
    cand = F.array(
        F.when(has_id, F.struct(F.lit("css").alias("type"), F.concat(F.lit("#"), eid).alias("value"))),
        F.when(~has_id & (css != F.col("tag")), F.struct(F.lit("css").alias("type"), css.alias("value"))),
        F.when(~has_id & (text != ""), F.struct(F.lit("xpath").alias("type"),
                                                F.concat(F.lit("//"), F.col("tag"), F.lit("[text()='"),
                                                         F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("']"))
                                                .alias("value"))),
        F.when(~has_id & (xp != F.concat(F.lit("//"), F.col("tag"))),
               F.struct(F.lit("xpath").alias("type"), xp.alias("value"))),
        F.when(~has_id & (full != xp) & (full != F.concat(F.lit("//"), F.col("tag"))),
               F.struct(F.lit("xpath").alias("type"), full.alias("value"))),
    )
    rel = F.array_distinct(F.filter(cand, lambda s: s.isNotNull()))
    rel = F.when(F.size(rel) > 0, rel).otherwise(F.array(F.struct(F.lit("css").alias("type"),
                                                                 F.col("tag").alias("value"))))
    return el.select("page_id", "idx", "tag", eid.alias("id"), cls.alias("class"), css_simple.alias("css_simple"),
                     css.alias("css"), xp.alias("xpath"), full.alias("full_xpath"), rel.alias("reliable_selectors"))


def best_selector(el: DataFrame) -> DataFrame:
    """Candidate selectors by_id, by_data_attr, by_xpath, by_text,
    by_css; ``best`` is the first present in that priority, ``selector_list``
    the candidates as (type, value) rows."""
    eid = F.coalesce(F.col("id"), F.lit(""))
    data = data_attributes(F.col("attrs"))
    first_data = F.try_element_at(F.map_entries(data), F.lit(1))
    text = strip_ws(F.coalesce(F.col("text"), F.lit("")))
    cands = F.array(
        F.when(eid != "", F.struct(F.lit("by_id").alias("kind"), F.lit("id").alias("type"), eid.alias("value"))),
        F.when(first_data.isNotNull(),
               F.struct(F.lit("by_data_attr").alias("kind"), F.lit("css").alias("type"),
                        F.concat(F.col("tag"), F.lit("[data-"), F.replace(first_data["key"], F.lit("_"), F.lit("-")),
                                 F.lit("='"), first_data["value"], F.lit("']")).alias("value"))),
        F.when(F.col("xpath") != "", F.struct(F.lit("by_xpath").alias("kind"), F.lit("xpath").alias("type"),
                                              F.col("xpath").alias("value"))),
        F.when(text != "", F.struct(F.lit("by_text").alias("kind"), F.lit("xpath").alias("type"),
                                    F.concat(F.lit("//*[contains(text(), '"), text, F.lit("')]")).alias("value"))),
        F.when(F.col("css") != "", F.struct(F.lit("by_css").alias("kind"), F.lit("css").alias("type"),
                                            F.col("css").alias("value"))),
    )
    present = F.filter(cands, lambda s: s.isNotNull())
    return el.select("page_id", "idx", F.element_at(present, 1).alias("best"), present.alias("selector_list"))


def selector_table(elements: DataFrame, group: str = GROUP_DEFAULT, lists=None) -> DataFrame:
    """Clickable rows ``clickable_{i}`` then input rows ``input_{i}`` with
    text, id, class, css, xpaths, kind, category and data attributes (``data``
    map; the export spreads it into columns). ``lists`` are the selector
    lists (default: those of the page tool). An element that several
    selectors of its kind match is listed once, at the first; i counts the
    listed elements per page and kind in selector, then document order."""
    el = elements if "css_levels" in elements.columns else with_css_levels(elements)
    if "xpath" not in el.columns:
        el = add_xpaths(el)
    hits = interactive(el.filter(F.col("page_id").isNotNull()), ("clickable", "input"), lists=lists or page_tool_selectors(),
                       keep=("id", "class", "attrs", "css_levels", "xpath", "full_xpath", *(["n_class"] if "n_class" in el.columns else [])))
    # of its hits in a kind only an element's first can be listed: paths and attributes are
    # gathered for the elements listed, and class sets still counted over the whole page
    found = hits.drop("type", "name", "src").withColumn("order", F.struct("selector", "idx"))
    once = dedup_elements(found, key="xpath", order="order", kind="kind")
    w = Window.partitionBy("page_id", "kind").orderBy("order")
    j = css_selector(elements, once.withColumn("_i", F.row_number().over(w)))
    is_click = F.col("kind") == "clickable"
    text_value = F.when(is_click, F.col("text")).otherwise(
        F.coalesce(F.nullif(F.coalesce(attr("placeholder"), F.lit("")), F.lit("")), attr("value"), F.lit("")))
    data = data_attributes(F.col("attrs"))
    return j.select(
        "page_id", "kind", F.col("_i").alias("ordinal"),
        F.lit(group).alias("group"),
        F.concat(F.when(is_click, F.lit("clickable_")).otherwise(F.lit("input_")), F.col("_i").cast("string")).alias("name"),
        text_value.alias("text_value"),
        F.coalesce(F.col("id"), F.lit("")).alias("id"), F.coalesce(F.col("class"), F.lit("")).alias("class"),
        "css", "xpath", "full_xpath",
        F.when(is_click, F.lit(KIND_CLICKABLE)).otherwise(F.lit(KIND_INPUT)).alias("element_type"),
        F.when(is_click, category_simple(F.col("tag"), F.col("class"))).otherwise(F.lit(CATEGORY_FORM)).alias("category"),
        F.when(is_click, data).otherwise(F.create_map().cast("map<string,string>")).alias("data"),
        F.when(is_click, reliable_selectors(F.col("tag"), F.col("text"), F.col("id"), F.col("class"),
                                            F.map_filter(F.col("attrs"), lambda k, v: k.startswith("data-"))))
         .alias("reliable_selectors"),
    )


# ---- H17, H19 ------------------------------------------------------------------------

# Patterns and lists of the structural selectors.
SIGNIFICANT_CLASS_RE = r"^(nav|menu|btn|button|tab|header|footer|main|content|row|container|active|selected|primary|navbar)"
KEY_ATTRS = ("data-rb-event-key", "data-testid", "data-id", "role", "name")
CSS_CHILD_TAGS = ("div", "span", "img", "i", "em", "strong")
XPATH_CHILD_TAGS = ("div", "span")
XPATH_HINT_TAGS = ("div", "span", "img")
CSS_PATH_LEVELS = 5


def _has_text() -> Column:
    return strip_ws(F.coalesce(F.col("text"), F.lit(""))) != ""


def child_hints(elements: DataFrame) -> DataFrame:
    """Per element (page_id, idx) with such a child: the tag of its first child that has text
    or is one of the CSS child tags, the same for the XPath child tags, and
    whether any child has text or is a div/span/img. Children that can't be a hint aren't
    sorted. ``has_text``, where the elements have it, stands for their ``text``."""
    if "has_text" not in elements.columns:
        elements = elements.withColumn("has_text", _has_text())
    has_text = F.col("has_text")
    kids = elements.filter(F.col("parent_idx").isNotNull() & (has_text | tag_is(*CSS_CHILD_TAGS)))
    return kids.groupBy("page_id", F.col("parent_idx").alias("idx")).agg(
        F.min_by("tag", "idx").alias("css_child"),
        F.min_by("tag", F.when(has_text | tag_is(*XPATH_CHILD_TAGS), F.col("idx"))).alias("xpath_child"),
        F.max(has_text | tag_is(*XPATH_HINT_TAGS)).alias("xpath_hint"))


def with_child_hints(elements: DataFrame) -> DataFrame:
    """Adds ``css_child``, ``xpath_child`` and ``xpath_hint`` of ``child_hints`` to the elements: from their own rows
    where the parse gave their children (``kids``; for pages that are alone under their page_id), else by a join."""
    if "kids" not in elements.columns:
        return elements.join(child_hints(elements), ["page_id", "idx"], "left")

    def those(tags):
        return F.filter("kids", lambda k: k["has_text"] | k["tag"].isin(*tags))
    return (elements.withColumn("css_child", F.get(those(CSS_CHILD_TAGS), F.lit(0))["tag"])
            .withColumn("xpath_child", F.get(those(XPATH_CHILD_TAGS), F.lit(0))["tag"])
            .withColumn("xpath_hint", F.exists("kids", lambda k: k["has_text"] | k["tag"].isin(*XPATH_HINT_TAGS))))


def _key_attr(a: Column) -> Column:
    """First non-empty of the key attributes as ``[attr='value']``."""
    vals = [F.element_at(a["data"], F.lit(k)) if k.startswith("data-") else a[k] for k in KEY_ATTRS]
    out = F.lit(None).cast("string")
    for k, v in reversed(list(zip(KEY_ATTRS, vals))):
        out = F.when(v.isNotNull() & (strip_ws(v) != ""),
                     F.concat(F.lit(f"[{k}='"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("']"))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _css_piece(a: Column) -> Column:
    cls = classes(a["class"])
    sig = F.filter(cls, lambda c: c.rlike(SIGNIFICANT_CLASS_RE))
    # most steps have no class: those split nothing
    cls_part = F.when(a["class"].isNull(), F.lit("")).otherwise(F.coalesce(
        F.concat(F.lit("."), F.get(sig, F.lit(0))),
        F.when(F.size(F.map_keys(a["data"])) == 0, F.concat(F.lit("."), F.get(cls, F.lit(0)))), F.lit("")))
    nth = F.when(a["n_child"] > 1, F.concat(F.lit(":nth-child("), a["nth_child"].cast("string"), F.lit(")"))) \
        .otherwise(F.lit(""))
    return F.concat(a["tag"], nth, cls_part, _key_attr(a))


def with_css_steps(elements: DataFrame) -> DataFrame:
    """Adds ``css_steps`` (the ``css_path`` without the child) and, unless the elements have ``kids``, ``has_text``, from
    the element's own row."""
    n = F.size("anc")
    lo = F.greatest(n - (CSS_PATH_LEVELS - 1), F.lit(1))
    id_lo = F.greatest(n - CSS_PATH_LEVELS, F.lit(1))
    idp = F.array_max(F.filter(F.sequence(id_lo, F.greatest(n - 1, id_lo)),
                               lambda p: (p < n) & (F.coalesce(F.col("anc")[p - 1]["id"], F.lit("")) != "")))
    first = F.coalesce(idp + 1, lo)
    body = F.array_join(F.transform(F.sequence(first, n), lambda p: _css_piece(F.col("anc")[p - 1])), " > ")
    path = F.when(idp.isNotNull(), F.concat(F.lit("#"), F.col("anc")[idp - 1]["id"], F.lit(" > "), body)) \
        .otherwise(body)
    out = elements.withColumn("css_steps", path)
    return out if "kids" in out.columns else out.withColumn("has_text", _has_text())


def css_path(elements: DataFrame) -> DataFrame:
    """``#id``; else up to 5 levels of ``tag:nth-child(i)`` (position
    among all element siblings, when there are several) with one
    significant class (else the first class when the element has no data
    attributes) and one key attribute, joined by `` > ``; the first
    important child is appended to the element's own level; a parent with
    an id ends the path as ``#id``. Adds column ``css_path``. Elements that have
    ``css_steps`` and ``has_text`` (or ``kids``) need no ``anc`` and no ``text``."""
    out = [*(c for c in elements.columns if c not in ("css_steps", "has_text", "kids")), "css_path"]
    el = with_child_hints(elements if "css_steps" in elements.columns else with_css_steps(elements))
    child = F.when(F.col("css_child").isNotNull(), F.concat(F.lit(" > "), F.col("css_child"))).otherwise(F.lit(""))
    has_id = strip_ws(F.coalesce(F.col("id"), F.lit(""))) != ""
    return el.withColumn("css_path", F.when(has_id, F.concat(F.lit("#"), F.col("id"))).otherwise(
        F.concat(F.col("css_steps"), child))).select(*out)


def with_xpath_steps(elements: DataFrame) -> DataFrame:
    """Adds ``unified_steps`` (the ``xpath_unified`` of an element without an id, without the child) and, unless
    the elements have ``kids``, ``has_text``, from the element's own row."""
    n = F.size("anc")
    stop = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                lambda p: (p < n) & (F.col("anc")[p - 1]["tag"].isin("body", "html")
                                                     | (F.coalesce(F.col("anc")[p - 1]["id"], F.lit("")) != ""))))
    stop_is_id = F.coalesce(~F.col("anc")[stop - 1]["tag"].isin("body", "html"), F.lit(False))
    first = F.coalesce(stop + 1, F.lit(1))

    def step(p):
        a = F.col("anc")[p - 1]
        return F.concat(F.lit("/"), a["tag"], F.when(a["n_same"] > 1, F.concat(F.lit("["), a["nth_tag"].cast("string"),
                                                                               F.lit("]"))).otherwise(F.lit("")))

    steps = F.array_join(F.transform(F.sequence(first, n), step), "")
    anchored = F.concat(F.lit('//*[@id="'), F.col("anc")[stop - 1]["id"], F.lit('"]'), steps)
    path = F.when(stop_is_id, anchored).otherwise(F.concat(F.lit("/"), steps))
    out = elements.withColumn("unified_steps", path)
    return out if "kids" in out.columns else out.withColumn("has_text", _has_text())


def xpath_unified(elements: DataFrame) -> DataFrame:
    """``//*[@id="x"]`` for an element with an id; else the steps up
    to (not including) body/html, stopping at an ancestor with an id
    (``//*[@id="a"]/div/a``); an index only when several same-tag
    siblings exist; a hint child step appended to the element's own step.
    Paths without an id anchor start with ``//``. Adds ``xpath_unified``. Elements that
    have ``unified_steps`` and ``has_text`` (or ``kids``) need no ``anc`` and no ``text``."""
    out = [*(c for c in elements.columns if c not in ("unified_steps", "has_text", "kids")), "xpath_unified"]
    el = with_child_hints(elements if "unified_steps" in elements.columns else with_xpath_steps(elements))
    extra = F.when(F.coalesce(F.col("xpath_hint"), F.lit(False)) & F.col("xpath_child").isNotNull(),
                   F.concat(F.lit("/"), F.col("xpath_child"))).otherwise(F.lit(""))
    has_id = F.coalesce(F.col("id"), F.lit("")) != ""
    return el.withColumn("xpath_unified", F.when(has_id, F.concat(F.lit('//*[@id="'), F.col("id"), F.lit('"]')))
                         .otherwise(F.concat(F.col("unified_steps"), extra))).select(*out)
