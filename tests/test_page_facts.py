"""Facts of a page that its parse gives (class counts, children), rows for possible hits only, and queries that move no elements."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as ht
from quarry.operators import page_elements as pe
from quarry.operators import selectors as sl
from quarry.plans import catalog
from quarry.session import materialize
from quarry.sources.pages import ELEMENT_SCHEMA, extract_elements

PIECES = ["<div>", "</div>", "<p class='a b'>", "<p class=' b\ta a'>", "<span class='c'>", "</span>", "<a class='btn x'>", "</a>", "<i class=''>", "</i>",
          "<img>", "<div role='button' id='k'>", "<b onclick='f()'>", "</b>", "<em contenteditable='true'>", "</em>", "<input type='submit'>",
          "<input type='HIDDEN'>", "<video>", "</video>", " 　\n", "text", "&nbsp;", "<div class='row main' name='n' data-id='d'>"]


def _random_pages(spark, tmp_dir, n=60):
    rng = random.Random(11)
    rows = [(i if i % 9 else None, "u", "<html><body>" + "".join(rng.choice(PIECES) for _ in range(30))) for i in range(1, n)]
    spark.createDataFrame([*rows, (n, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_dir}/pages")
    return spark.read.parquet(f"{tmp_dir}/pages")


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_facts_of_the_parse_give_what_the_joins_give(spark, tmp_dir):
    pages = _random_pages(spark, tmp_dir).filter("page_id is not null")
    plain = materialize(extract_elements(pages))
    facts = extract_elements(pages, columns=[*ELEMENT_SCHEMA.fieldNames(), "n_class", "kids"])
    for op, fact, other in ((sl.css_selector, "n_class", "kids"), (sl.css_path, "kids", "n_class"), (sl.xpath_unified, "kids", "n_class")):
        cols = ["page_id", "idx", op.__name__ if op is not sl.css_selector else "css"]
        assert _sorted(op(facts.drop(other)).select(cols)) == _sorted(op(plain).select(cols)), op
        assert fact not in op(facts.drop(other)).columns
    want = {(r.page_id, r.class_key): r.n_containing for r in sl.class_superset_counts(plain).collect()}
    got = facts.select("page_id", sl.class_key(F.col("class")).alias("k"), "n_class").filter("k != ''").distinct().collect()
    assert {(r.page_id, r.k): r.n_class for r in got} == want and len(want) > 50


def test_parse_for_interactive_gives_every_element_a_list_can_match(spark, tmp_dir):
    pages = _random_pages(spark, tmp_dir)
    few = extract_elements(pages, columns=catalog.SHOWN, tags=pe.INTERACTIVE_TAGS, having=pe.INTERACTIVE_ATTRS)
    whole = materialize(extract_elements(pages))
    named = {"browser": pe.browser_selectors(), "page_tool": pe.page_tool_selectors(), "page_analyzer": pe.page_analyzer_selectors()}
    got = pe.interactive(few, named=named)
    apart = [pe.interactive(whole, list(lists), lists=lists).select(F.lit(n).alias("lists"), "*") for n, lists in named.items()]
    assert _sorted(got) == _sorted(apart[0].unionByName(apart[1]).unionByName(apart[2])) and got.count() > 300
    assert few.count() < whole.count()


def test_more_hits_than_one_number_holds(spark):
    el = extract_elements(spark.createDataFrame([(1, "u", "<a>x</a><b onclick='y'>z</b>")], "page_id long, url string, html string"))
    lists = {"k": [pe.tag_is("a") if i % 2 else pe.has_attr("onclick") for i in range(130)]}
    got = sorted((r.selector, r.tag) for r in pe.interactive(el, ["k"], lists=lists).collect())
    assert got == [(i, "a" if i % 2 else "b") for i in range(130)]


def test_counting_classes_is_by_bits_not_pairs():
    attrs = [{"class": f"c{i % 50} all"} for i in range(3000)] + [{"class": "all"}, {}, {"class": " \t"}]
    counts = ht._alike(attrs)
    assert counts[0] == 60 and counts[3000:] == [3001, None, None]


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("facts")
    rows = [(0, -5.0), (1, 3.0), (2, 4.0), (3, -1.0), (3, 2.0), (9, 7.0), (9, 7.0), (None, 8.0)]
    rows = [(k, f"Customer#{i}", i % 25, bal, "BUILDING") for i, (k, bal) in enumerate(rows)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return str(at)


@pytest.mark.parametrize("name,op", [("css_selector", "css"), ("css_path", "css_path"), ("xpath_unified", "xpath_unified")])
def test_pages_that_share_an_id_go_by_the_joins(spark, customers, name, op):
    el = materialize(catalog._rt_elements(spark, customers))
    want = getattr(sl, name)(el).select("page_id", "tag", op)
    assert _sorted(catalog.QUERIES[name](spark, customers).select("page_id", "tag", op)) == _sorted(want)


@pytest.mark.parametrize("name", ["best_selector_all", "element_selectors", "css_path", "css_selector", "xpath_unified", "selector_table"])
def test_elements_of_lone_pages_are_neither_written_nor_joined(spark, customers, name, monkeypatch):
    written = []
    monkeypatch.setattr(catalog, "materialize", lambda df: written.append(df) or materialize(df))
    out = catalog.QUERIES[name](spark, customers)
    assert {r.page_id for df in written for r in df.select("page_id").distinct().collect()} <= {3, 9, None}
    assert {0, 1, 2} <= {r.page_id for r in out.select("page_id").distinct().collect()}


@pytest.mark.parametrize("name", ["interactive", "dedup_elements"])
def test_elements_are_parsed_once_and_pages_are_not_shuffled(spark, customers, name):
    plan = catalog.QUERIES[name](spark, customers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    moved = plan.split("RepartitionByExpression")[1]
    assert "DOCTYPE" not in moved and "html#" not in moved
