"""The interval-encoded element table, the pruned parse and the class bitmaps."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry.functions.html import page_text, parse_elements
from quarry.operators import page_elements as pe
from quarry.operators import selectors as sl
from quarry.sources import pages as pg


def messy(rng):
    """Unclosed, stray and crossing tags, void elements, entities and attributes."""
    parts = []
    for _ in range(rng.randint(5, 60)):
        tag = rng.choice(["div", "p", "ul", "li", "b", "a", "table", "tr", "td", "span", "script", "br", "img", "option"])
        parts.append(rng.choice([f"<{tag}>", f"<{tag} class='c{rng.randint(0, 4)} d' id='i{rng.randint(0, 3)}' data-k='v' role=x>", f"</{tag}>",
                                 f"<{tag}/>", "text ", "&amp;é ", "<!-- no -->"]))
    return "<html><body>" + "".join(parts)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    rows = [(i, f"u{i}", messy(rng)) for i in range(40)] + [(100, "u", ""), (101, "u", None), (102, "u", "only text")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_intervals_hold_descendants_and_text(pages):
    for _, _, html in pages[0]:
        rows, text = parse_elements(html), page_text(html)
        for r in rows:
            inside = [x for x in rows if r[0] in [a[0] for a in up(rows, x)]]
            assert [x[0] for x in inside] == list(range(r[0], r[15]))
            assert r[8] == text[r[16]:r[17]]


def up(rows, r):
    out = [r]
    while out[-1][1] is not None:
        out.append(rows[out[-1][1]])
    return out


def test_texts_and_paths_from_the_compact_table(spark, pages):
    whole = {(r.page_id, r.idx): r for r in pg.extract_elements(pages[1]).collect()}
    compact = pg.extract_elements(pages[1], columns=pg.COMPACT)
    assert "anc" not in compact.columns and "text" not in compact.columns
    got = pg.with_text(pg.with_ancestors(compact, compact), pg.page_texts(pages[1])).collect()
    assert len(got) == len(whole)
    for r in got:
        assert r.anc == whole[r.page_id, r.idx].anc and r.text == whole[r.page_id, r.idx].text
    some = pg.with_ancestors(compact.filter("tag = 'li'"), compact).collect()
    assert {(r.page_id, r.idx): r.anc for r in some} == {k: w.anc for k, w in whole.items() if w.tag == "li"}


def test_table_of_a_deep_page_is_linear(spark):
    def size(depth, columns):
        html = "<html><body>" + "<div class='x'>t " * depth
        rows = pg.extract_elements(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), columns=columns)
        return rows.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert size(800, pg.COMPACT) < 2.2 * size(400, pg.COMPACT)
    assert size(800, None) > 3 * size(400, None)  # texts and paths copied into every row


def test_pruned_parse(spark, pages):
    whole = pg.extract_elements(pages[1])
    part = pg.extract_elements(pages[1], columns=["page_id", "idx", "nth_tag", "text"], tags=["li", "a"])
    assert part.columns == ["page_id", "idx", "text", "nth_tag"]
    want = whole.filter(F.col("tag").isin("li", "a")).select(*part.columns)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect()))
    links = pe.links(pg.extract_elements(pages[1], columns=[*pg.COMPACT, "text"], tags=["a"]))
    assert sorted(map(str, links.collect())) == sorted(map(str, pe.links(whole).collect()))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "anc#" not in plan


def test_class_bitmaps(spark):
    rng = random.Random(8)
    sets = rng.sample(list(combinations([f"k{i}" for i in range(13)], 6)), 120) + [("k0",), ("k0", "k1"), ("k2", "k3", "k4")]
    html = "<html><body>" + "".join(f"<p class='{' '.join(s)}'>x</p>" for s in sets * 2 + sets[:20])
    el = pg.extract_elements(spark.createDataFrame([(1, "u", html), (2, "u", html[:400])], "page_id long, url string, html string"))
    got = {(r.page_id, r.class_key): r.n_containing for r in sl.class_superset_counts(el).collect()}
    held = {}
    for r in el.select("page_id", "class").filter("class is not null").collect():
        held.setdefault(r.page_id, []).append(frozenset(r["class"].split()))
    assert got == {(p, ".".join(sorted(s))): sum(s <= x for x in all_) for p, all_ in held.items() for s in set(all_)}
