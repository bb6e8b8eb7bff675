"""H1-H31 on a hand-written form page and malformed markup."""

from pyspark.sql import functions as F

from quarry.functions.html import parse_elements
from quarry.operators import page_elements as pe
from quarry.operators import selectors as sl
from quarry.sources.pages import extract_elements

FORM_PAGE = """<!DOCTYPE html><html><head><title> Form page </title>
<meta name="viewport" content="width=device-width"><meta charset="utf-8"><meta property="og:t" content="x"></head>
<body><h1>Registration</h1><h2>Personal</h2><form id="testForm" method="post" action="/submit">
<input type="text" name="u" id="username" placeholder="User" required>
<input type="email" name="e"><input type="password" name="p"><input name="n">
<input type="radio" name="g" value="m"><input type="radio" name="g" value="f"><input type="radio" name="g" value="o">
<input type="checkbox" name="c1"><input type="checkbox" name="c2"><input type="checkbox" name="c3">
<input type="checkbox" name="c4"><input type="checkbox" name="c5">
<select name="s"><option>1<option>2<option>3<option>4<option>5<option>6</select>
<textarea name="t"></textarea><h2>Done</h2><button id="submitBtn" type="submit">Send</button></form>
<div class="alert alert-danger">Bad input</div></body></html>"""


def _elements(spark, html, url="https://x.example.com/a/b"):
    return extract_elements(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))


def test_form_page_counts(spark):
    el = _elements(spark, FORM_PAGE)
    s = pe.page_summary(el).collect()[0]
    assert (s.n_forms, s.n_inputs, s.n_headings, s.n_links, s.n_tables) == (1, 14, 3, 0, 0)
    assert s.title == "Form page"
    f = pe.forms(el).collect()[0]
    assert (f.form_id, f.method, f.action) == ("testForm", "POST", "/submit")
    inputs = pe.form_inputs(el).collect()
    assert len(inputs) == 14
    kinds = [r.type for r in inputs]
    assert kinds.count("radio") == 3 and kinds.count("checkbox") == 5
    sel = [r for r in pe.inputs(el).collect() if r.tag == "select"][0]
    assert sel.n_options == 6
    assert [r.id for r in pe.buttons(el).collect()] == ["submitBtn"]
    meta = {r.name: r.content for r in pe.meta_tags(el).collect()}
    assert meta == {"viewport": "width=device-width", "og:t": "x"}
    heads = sorted((r.level, r.text) for r in pe.headings(el).collect())
    assert heads == [(1, "Registration"), (2, "Done"), (2, "Personal")]
    errs = pe.error_messages(el).collect()
    assert {r.selector for r in errs} == {1, 2, 6} and {r.text for r in errs} == {"Bad input"}


def test_malformed_markup():
    rows = parse_elements("<p><b>bold<p>next</p><ul><li>a<li>b</ul></div><td>x")
    tags = [(r[3], r[1]) for r in rows]
    assert tags[0] == ("p", None) and tags[1] == ("b", 0)
    assert tags[2] == ("p", None)  # second <p> closes the first (and the <b> inside it)
    lis = [r for r in rows if r[3] == "li"]
    assert len(lis) == 2 and lis[0][1] == lis[1][1]


def test_selectors(spark):
    el = sl.add_xpaths(sl.css_selector(_elements(spark, FORM_PAGE)))
    by = {(r.tag, r.id or r.attrs.get("name")): r for r in el.collect()}
    assert by[("button", "submitBtn")].css == "#submitBtn"
    assert by[("input", "e")].css == "#testForm > input:nth-child(2)"
    assert by[("input", "e")].xpath == "/html/body/form/input[2]"
    assert by[("input", "e")].full_xpath == "//*/html/body/form/input[2]"
    assert by[("div", None)].css == ".alert.alert-danger"  # the class set is unique in the page
    h2 = {r.own_text: r.css for r in el.collect() if r.tag == "h2"}
    assert h2 == {"Personal": "html > body > h2", "Done": "#testForm > h2"}


def test_slug_and_alert(spark):
    df = spark.createDataFrame([("https://example.com/path/to/page?x=1", "続けますか?"),
                                ("https://example.com/", "入力してください")], "u string, t string")
    r = df.select(pe.page_slug(F.col("u")).alias("s"), pe.alert_kind(F.col("t")).alias("k")).collect()
    assert [x.s for x in r] == ["example.com_path_to_page", "example.com"]
    assert [x.k for x in r] == ["confirm", "prompt"]


def test_element_selector_fallbacks(spark):
    html = ("<html><body><div class='x nav-main active y' data-k=\"v'1\">a</div>"
            "<span class='foo bar'>b</span><p>c</p></body></html>")
    el = _elements(spark, html).withColumn("css", F.lit(None).cast("string")) \
        .withColumn("xpath", F.lit("")).withColumn("full_xpath", F.lit(""))
    got = {r.tag: r.css for r in sl.element_selectors(el).collect()}
    assert got["div"] == "div[data-k='v\\'1']"
    assert got["span"] == "span.foo"
    assert got["p"] == "p"
    el2 = el.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.startswith("data-")))
    got2 = {r.tag: r.css for r in sl.element_selectors(el2).collect()}
    assert got2["div"] == "div.nav-main.active"


def test_registry_csv_later_row_wins(spark, tmp_path):
    from quarry.operators import registry as rg
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg" / "selectors.csv").write_text(
        "group,name,selector_type,selector_value,description\n"
        "login,user,id,u1,first\nlogin,user,css,#u2,\nlogin,pass,id,p,pw\n")
    reg = rg.registry_load(rg.read_registry_csv(spark, str(tmp_path / "reg")))
    got = {(r.group, r.name): (r.selector_type, r.selector_value, r.description) for r in reg.collect()}
    assert got[("login", "user")] == ("css", "#u2", "")
    req = spark.createDataFrame([("login", "user"), ("login", "nope"), ("x", "user")], "group string, name string")
    st = [r.status for r in rg.registry_lookup(req, reg).orderBy("group", "name").collect()]
    assert st == ["no_name", "found", "no_group"]


def test_grouped_headings_tables_and_changes(spark):
    html = ("<html><body><h2>b</h2><h1>a</h1><h2>c</h2>"
            "<table id='t'><tr><th>x<th>y</tr><tr><td>1<td>2</tr></table>"
            "<table><tr><td>1<td>2<td>3</tr></table></body></html>")
    el = _elements(spark, html)
    g = pe.headings_grouped(el).collect()[0].headings
    assert g == {"h1": ["a"], "h2": ["b", "c"]}
    t = sorted((r.table_id, list(r.headers), r.n_rows, r.n_columns) for r in pe.html_tables(el).collect())
    assert t == [("t", ["x", "y"], 2, 2), ("unnamed_table_1", [], 1, 3)]
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    after = spark.createDataFrame([(1, "u", html.replace("</body>", "<p>" + "z" * 30 + "</p></body>"))],
                                  "page_id long, url string, html string")
    ch = pe.page_changes(pe.page_metrics(pages, extract_elements(pages)),
                         pe.page_metrics(after, extract_elements(after))).collect()[0]
    assert ch.source_changed and ch.d_elements == 1 and ch.d_text == 30 and ch.changed


def test_dedup_and_structure(spark):
    html = ("<html><body><header>h</header><nav role='navigation'>n</nav><div class='content'>"
            "<a class='btn' href='#'>x</a></div></body></html>")
    el = sl.add_xpaths(_elements(spark, html))
    regions = {r.region: r.tag for r in pe.page_structure(el).collect()}
    assert regions == {"top_bar": "header", "navigation": "nav", "main_content": "div"}
    cand = pe.interactive(el, ("clickable",)).join(el.select("page_id", "idx", "xpath"), ["page_id", "idx"]) \
        .withColumn("order", F.col("selector") * 1000 + F.col("idx"))
    assert cand.count() == 2  # the link matches "a" and "[class*='btn']"
    assert pe.dedup_elements(cand).count() == 1


def test_visibility(spark):
    html = ("<html><head><title>t</title></head><body><div hidden><a href='/x'>x</a></div>"
            "<p style='display: none'><button>b</button></p><a href='/y'>y</a>"
            "<input type='hidden' name='h'><button>c</button></body></html>")
    el = _elements(spark, html)
    s_all = pe.page_summary(el).collect()[0]
    s_vis = pe.page_summary(el, check_visibility=True).collect()[0]
    assert (s_all.n_links, s_all.n_buttons) == (2, 2)
    assert (s_vis.n_links, s_vis.n_buttons) == (1, 1)
    assert [r.href for r in pe.links(el, check_visibility=True).collect()] == ["/y"]
    assert sorted(r.text for r in pe.interactive(el, ("clickable",), check_visibility=True).collect()) == ["c", "y"]


def test_class_uniqueness_with_many_classes(spark):
    many = " ".join(f"c{i}" for i in range(14))
    html = (f"<html><body><div class='{many}'>a</div><span class='c1 c2'>b</span>"
            f"<p class='c1 c2 c3'>c</p><i class='solo'>d</i></body></html>")
    el = sl.css_selector(_elements(spark, html))
    css = {r.tag: r.css for r in el.collect()}
    assert css["div"] == "." + ".".join(f"c{i}" for i in range(14))  # only the div has all 14
    assert css["span"] == "html > body > span"                       # div and p also hold c1 c2
    assert css["p"] == "html > body > p"                             # div holds c1 c2 c3 as well
    assert css["i"] == ".solo"
    counts = {r.class_key: r.n_containing for r in sl.class_superset_counts(_elements(spark, html)).collect()}
    assert counts["c1.c2"] == 3 and counts["c1.c2.c3"] == 2


def test_selector_lists(spark):
    html = ("<html><body><input type='checkbox'><input type='radio'><a class='btn' role='button' onclick='x()'>a</a>"
            "<input type='email'><input></body></html>")
    el = _elements(spark, html)

    def picks(lists):
        return sorted((r.kind, r.selector, r.tag, r.type) for r in pe.interactive(el, ("clickable", "input"), lists=lists).collect())
    tool = picks(pe.page_tool_selectors())
    assert [x for x in tool if x[0] == "clickable"] == [
        ("clickable", 0, "a", "a"), ("clickable", 4, "a", "a"), ("clickable", 5, "a", "a"), ("clickable", 6, "a", "a"),
        ("clickable", 7, "input", "checkbox"), ("clickable", 8, "input", "radio")]
    assert len([x for x in tool if x[0] == "input"]) == 4
    analyzer = picks(pe.page_analyzer_selectors())
    assert [x[1:] for x in analyzer if x[0] == "input"] == [(1, "input", "email")]
    assert ("clickable", 4, "input", "checkbox") in analyzer and ("clickable", 5, "input", "radio") in analyzer
    names = [r.name for r in sl.selector_table(el).orderBy("name").collect()]
    assert names == ["clickable_1", "clickable_2", "clickable_3", "input_1", "input_2", "input_3", "input_4"]


def test_summary_keeps_pages_without_elements(spark):
    pages = spark.createDataFrame([(1, "u1", "<html><body><a>x</a></body></html>"), (2, "u2", ""), (3, "u3", "only text"), (4, "u4", None)],
                                  "page_id long, url string, html string")
    rows = pe.page_summary(extract_elements(pages), pages=pages).collect()
    assert sorted((r.page_id, r.n_links, r.title) for r in rows) == [(1, 1, ""), (2, 0, ""), (3, 0, ""), (4, 0, "")]


def test_class_lookup_is_linear_in_elements(spark):
    """Elements that share all but one class are not paired with each other:
    each set is looked up by the class that only it holds."""
    shared = " ".join(f"s{i}" for i in range(12))
    html = "<html><body>" + "".join(f"<p class='{shared} own{i}'>x</p>" for i in range(400)) + "</body></html>"
    el = _elements(spark, html)
    counts = sl.class_superset_counts(el)
    assert {r.n_containing for r in counts.collect()} == {1} and counts.count() == 400
    assert sl.css_selector(el).filter((F.col("tag") == "p") & F.col("css").startswith(".")).count() == 400


def test_page_changes_of_repeated_urls(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>")], "page_id long, url string, html string")
    m = pe.page_metrics(pages, extract_elements(pages))
    assert "html" not in m.columns
    assert [(r.url, r.changed) for r in pe.page_changes(m, m).collect()] == [("u", False)]
