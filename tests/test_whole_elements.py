"""The ``*_all`` queries return every element of their tables; each selector
against a plain Python version over the parsed elements."""

import json
import re

import pytest

from quarry.functions.html import parse_elements
from quarry.operators import selectors as sl
from quarry.plans import fixtures as fx
from quarry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
KEYS = ["xpath_all", "element_selectors_all", "reliable_selectors_all", "best_selector_all", "element_category_all",
        "css_path_all", "xpath_unified_all"]


class Page:
    def __init__(self, html):
        self.rows = parse_elements(html)
        self.tag, self.id, self.cls, self.attrs, self.text = ([r[k] or "" if k != 6 else r[k] for r in self.rows] for k in (3, 4, 5, 6, 8))
        self.parent = [r[1] for r in self.rows]
        self.kids = {}
        for i, p in enumerate(self.parent):
            self.kids.setdefault(p, []).append(i)

    def line(self, i):
        return [] if i is None else self.line(self.parent[i]) + [i]

    def same(self, i):
        return [j for j in self.kids[self.parent[i]] if self.tag[j] == self.tag[i]]

    def nth(self, i):
        return self.same(i).index(i) + 1

    def data(self, i):
        return {k: v for k, v in self.attrs[i].items() if k.startswith("data-")}

    def steps(self, i):
        return "/".join(self.tag[j] + (f"[{self.nth(j)}]" if self.nth(j) > 1 else "") for j in self.line(i))

    def xpaths(self, i):
        own = f"//*[@id='{self.id[i]}']" if self.id[i] else "/" + self.steps(i)
        return own, "//" + self.steps(i), "//*/" + self.steps(i)

    def css(self, i):
        if self.id[i]:
            return "#" + self.id[i]
        mine = set(self.cls[i].split())
        if mine and sum(mine <= set(c.split()) for c in self.cls) == 1:
            return "." + ".".join(self.cls[i].split())
        out = []
        for j in reversed(self.line(i)[-4:]):
            out.insert(0, f"#{self.id[j]}" if self.id[j] else self.tag[j] + (f":nth-child({self.nth(j)})" if self.nth(j) > 1 else ""))
            if self.id[j]:
                break
        return " > ".join(out)

    def element_selectors(self, i):
        tag, css, (xp, _, full), text = self.tag[i], self.css(i), self.xpaths(i), self.text[i].strip()
        if self.id[i]:
            rel = [("css", "#" + self.id[i])]
        else:
            rel = [("css", css)] * (css != tag) + [("xpath", f"//{tag}[text()='" + text.replace("'", "\\'") + "']")] * bool(text)
            rel += [("xpath", xp), ("xpath", full)]
        simple = "." + self.cls[i].replace(" ", ".") if self.cls[i] else tag
        return (tag, self.id[i], self.cls[i], simple, css, xp, full, rel)

    def reliable(self, i):
        tag, text = self.tag[i], self.text[i]
        out = [("css", f"{tag}[{k}='{v}']") for k, v in self.data(i).items() if v]
        out += [("css", "#" + self.id[i])] * bool(self.id[i])
        out += [("css", "." + self.cls[i].replace(" ", "."))] * (0 < len(self.cls[i].split()) < 3)
        return out + [("xpath", f"//{tag}[text()='" + text.replace("'", "\\'") + "']")] * (0 < len(text) < 50)

    def candidates(self, i):
        data, text = [(k, v) for k, v in self.data(i).items() if v], self.text[i].strip()
        out = [("by_id", "id", self.id[i])] * bool(self.id[i])
        out += [("by_data_attr", "css", f"{self.tag[i]}[{k}='{v}']") for k, v in data[:1]]
        out += [("by_xpath", "xpath", self.xpaths(i)[0])]
        out += [("by_text", "xpath", f"//*[contains(text(), '{text}')]")] * bool(text)
        return out + [("by_css", "css", self.css(i))]

    def categories(self, i):
        tag, c, e = self.tag[i], self.cls[i].lower(), self.id[i].lower()
        pc = self.cls[self.parent[i]].lower() if self.parent[i] is not None else ""

        def has(*words):
            return any(w in c or w in e for w in words)
        simple = next(x for ok, x in [("navbar" in c or "nav-" in c or tag == "nav", sl.CAT_NAV), ("sidebar" in c or "side-" in c, sl.CAT_SIDE),
                                      ("btn" in c or tag == "button", sl.CAT_BUTTON), (tag == "a", sl.CAT_LINK), ("tab" in c, sl.CAT_TAB),
                                      ("menu" in c, sl.CAT_MENU), ("header" in c, sl.CAT_HEADER), ("footer" in c, sl.CAT_FOOTER),
                                      (True, sl.CAT_OTHER)] if ok)
        if "menu-item" in c or "menu-nav" in c or "menu-item" in e:
            return simple, sl.CAT_SUB if any(w in pc for w in ("submenu", "sub-menu", "dropdown")) else sl.CAT_SIDE
        if has("nav", "header", "menu"):
            if any(w in c for w in ("top", "header", "main-nav")):
                return simple, sl.CAT_TOP
            return simple, sl.CAT_SUB if has("sub") else sl.CAT_SIDE if has("side") else sl.CAT_NAV
        if has("sidebar", "side-bar", "sidenav"):
            return simple, sl.CAT_SIDE
        if tag in ("table", "tr", "td", "th") or has("table"):
            return simple, sl.CAT_TABLE
        if tag in ("form", "input", "select", "textarea") or has("form"):
            return simple, sl.CAT_FORM
        if tag == "button" or any(w in c for w in ("btn", "button", "submit")) or "btn" in e:
            return simple, sl.CAT_BUTTON
        if tag == "a":
            return simple, sl.CAT_SIDE if "menu" in pc else sl.CAT_TOP if "nav" in pc or "header" in pc else sl.CAT_LINK
        return simple, sl.CAT_CONTENT if has("content", "main", "body") else sl.CAT_OTHER

    def hint(self, i, tags):
        return next((self.tag[j] for j in self.kids.get(i, []) if self.text[j].strip() or self.tag[j] in tags), None)

    def css_path(self, i):
        if self.id[i].strip():
            return "#" + self.id[i]
        out = []
        for j in reversed(self.line(i)):
            if j != i and self.id[j]:
                out.insert(0, "#" + self.id[j])
                break
            if len(out) == 5:
                break
            names, sibs = self.cls[j].split(), self.kids[self.parent[j]]
            cls = [c for c in names if re.match(sl.SIGNIFICANT_CLASS_RE, c)] or ([] if self.data(j) else names)
            key = next((f"[{k}='" + self.attrs[j][k].replace("'", "\\'") + "']" for k in sl.KEY_ATTRS if self.attrs[j].get(k, "").strip()), "")
            piece = self.tag[j] + (f":nth-child({sibs.index(j) + 1})" if len(sibs) > 1 else "") + "".join("." + c for c in cls[:1]) + key
            child = self.hint(j, sl.CSS_CHILD_TAGS) if j == i else None
            out.insert(0, piece + (f" > {child}" if child else ""))
        return " > ".join(out)

    def xpath_unified(self, i):
        if self.id[i]:
            return f'//*[@id="{self.id[i]}"]'
        out, top = "", "/"
        for j in reversed(self.line(i)):
            if j != i and (self.id[j] or self.tag[j] in ("body", "html")):
                top = f'//*[@id="{self.id[j]}"]' if self.tag[j] not in ("body", "html") else "/"
                break
            out = f"/{self.tag[j]}" + (f"[{self.nth(j)}]" if len(self.same(j)) > 1 else "") + out
        child = self.hint(i, sl.XPATH_CHILD_TAGS)
        return top + out + (f"/{child}" if child else "")


@pytest.fixture(scope="module")
def pages(spark):
    def load(df):
        return {r.page_id: Page(r.html) for r in df.collect()}
    return (load(spark.read.parquet(f"{SF}/pages.parquet")), load(fx.customer_pages(spark.read.parquet(f"{SF}/customer.parquet"))))


def _pairs(text):
    return [(x["type"], x["value"]) for x in json.loads(text)]


@pytest.mark.parametrize("key", KEYS)
def test_every_element(spark, pages, key):
    real, shop = pages
    held = real if key == "xpath_all" else shop
    rows = QUERIES[key](spark, SF).collect()
    each = {(p, i): (page, i) for p, page in held.items() for i in range(len(page.rows))}
    assert len({page.tag[i] for page, i in each.values()}) > 15
    if key == "reliable_selectors_all":
        got = sorted((r.page_id, r.idx, r.pos, r.tag, r.type, r.value) for r in rows)
        assert got == sorted((*at, k, page.tag[i], *x) for at, (page, i) in each.items() for k, x in enumerate(page.reliable(i)))
        return
    got = {(r.page_id, r.idx): r for r in rows}
    assert len(rows) == len(got) and got.keys() == each.keys()
    want = {
        "xpath_all": lambda r, p, i: ((r.tag, r.xpath, r.xpath_soup, r.full_xpath), (p.tag[i], *p.xpaths(i))),
        "element_selectors_all": lambda r, p, i: ((*r[2:9], _pairs(r.reliable_selectors)), p.element_selectors(i)),
        "best_selector_all": lambda r, p, i: (((r.kind, r.type, r.value), [(x["kind"], x["type"], x["value"]) for x in json.loads(r.selector_list)]),
                                              (p.candidates(i)[0], p.candidates(i))),
        "element_category_all": lambda r, p, i: ((r.tag, r.category, r.category_detailed), (p.tag[i], *p.categories(i))),
        "css_path_all": lambda r, p, i: ((r.tag, r.css_path), (p.tag[i], p.css_path(i))),
        "xpath_unified_all": lambda r, p, i: ((r.tag, r.xpath_unified), (p.tag[i], p.xpath_unified(i))),
    }[key]
    for at, (page, i) in each.items():
        a, b = want(got[at], page, i)
        assert a == b, at
