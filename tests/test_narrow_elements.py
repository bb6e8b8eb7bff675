"""The plain-markup tokenizer, shared ancestor entries, and queries that carry no more than they ask for."""

import random

import pytest

from quarry.functions import html as ht
from quarry.plans import catalog
from quarry.sources import pages as pg

FRAGMENTS = ["<div>", "</div>", "<P class='a b'>", "</p>", "<br/>", '<img src="a" alt=\'x\' />', '<a href="x?a&amp;b">', "</A >", '<a b c="d" >',
             "<td>", "<tr>", "<table>", "</table>", "<li>", "text", "&amp;", "&lt", "&", "é", "<", "< x", "<!-- c -->", "<!DOCTYPE html>", "<?pi x>",
             "<script>", "if (a<b) {}", "</script>", "<title>", "</title>", "<textarea>", "<a\nb=\"1\"\n>", "<a b=1>", '<a b="x>y" B="2">', "<x-y>",
             '<a b="1"c="2">', "</>", "<a/b>", "\n", '"', "/>"]


def standard(html):
    p = ht._Tree()
    p.feed(html)
    p.close()
    p.finish()
    return p


def test_plain_markup_gives_the_standard_tokenizers_tree():
    rng = random.Random(3)
    for _ in range(4000):
        html = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 20)))
        a, b = standard(html), ht.parse_tree(html)
        assert (a.tags, a.attrs, a.parent, a.own, a.chunks, a.end, a.text_from, a.text_to) == (
            b.tags, b.attrs, b.parent, b.own, b.chunks, b.end, b.text_from, b.text_to), html
    plain = '<!DOCTYPE html><html><body class="a"><p id=\'x\'>one &amp; two<br/></p></body></html>'
    assert ht._feed_plain(ht._Tree(), plain) == len(plain)


def test_batches_cut_inside_a_page_keep_the_paths(spark, monkeypatch):
    html = "<html><body>" + "<div data-k='v' role='r'><p id='i'>x</p></div>" * 30 + "</body></html>"
    rows = [(1, "u", html), (1, "u", html), (2, "u", ""), (None, "u", "<a name='n'>y</a>")]
    import pyarrow as pa
    rb = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])
    monkeypatch.setattr(pg, "FLUSH_BYTES", 3000)
    got = [r for b in pg._extract(["page_id", "idx", "anc"], None)([rb]) for r in b.to_pylist()]
    want = [(pid, e[0], [(*a[:9], list(a[9].items())) for a in e[13]]) for pid, _, h in rows for e in ht.parse_elements(h)]
    assert [(r["page_id"], r["idx"], [(*(a[f] for f in pg.ANC.fieldNames()[:-1]), a["data"]) for a in r["anc"]]) for r in got] == [
        (p, i, [(*a[:9], a[9]) for a in anc]) for p, i, anc in want]
    assert max(r["idx"] for r in got) > 50


def test_parse_is_spread_over_several_tasks_a_core(spark, tmp_dir):
    rows = spark.createDataFrame([(i, "u", "<p>x</p>") for i in range(100)], "page_id long, url string, html string")
    rows.write.parquet(f"{tmp_dir}/pages")
    el = pg.extract_elements(spark.read.parquet(f"{tmp_dir}/pages"), columns=["page_id", "tag"])
    assert el.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("narrow")
    rows = [(i, f"Customer#{i}", i % 25, -5.5 + i, "BUILDING") for i in (0, 1, 2, 3, 3, 9)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["xpath_unified", "css_selector", "selector_table", "login_error_message", "dedup_elements", "interactive",
                                  "inputs", "best_selector", "element_selectors", "css_path"])
def test_no_ancestor_paths_cross_an_exchange_or_are_read_again(spark, customers, name):
    df = catalog.QUERIES[name](spark, customers)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Join" not in above or "anc#" not in above.split("Join", 1)[1]
    assert "anc#" not in plan or "MapInArrow" in plan
    assert df.count() > 0


@pytest.mark.parametrize("name", ["login_error_message", "interactive", "form_inputs", "inputs", "selector_export"])
def test_parse_builds_what_the_query_reads(spark, customers, name, monkeypatch):
    asked = []
    parse = catalog.extract_elements
    monkeypatch.setattr(catalog, "extract_elements", lambda *a, **k: asked.append(k) or parse(*a, **k))
    catalog.QUERIES[name](spark, customers)
    assert asked and all(k["columns"] is not None and "own_text" not in set(k["columns"]) - ({"own_text"} if name == "login_error_message" else set())
                         for k in asked)
