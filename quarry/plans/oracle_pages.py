"""DuckDB SQL for whole element tables: every element, attribute, text, ancestor and selector.

Two sources. The ``pages`` table is parsed by SQL itself: tags in order, each one's parent the
last open element of the kind its place in these pages calls for, texts and ancestors along
the paths. The rendered customer pages come in eight shapes (negative balance, even key, key
divisible by 3); for each shape the elements are written out here as text with marks for the
customer's values, selectors are derived from that tree in plain Python, and the SQL fills in the marks.
"""

from __future__ import annotations

import json
import re

MARKS = {"⟨k⟩": "k", "⟨name⟩": "c_name", "⟨seg⟩": "c_mktsegment", "⟨bal⟩": "bal", "⟨nat⟩": "CAST(c_nationkey AS VARCHAR)"}

# Labels and patterns that category and selector rules use.
NAV, SIDE, BUTTON, LINK, TAB, MENU, HEADER, FOOTER, OTHER = (
    "ナビゲーションバー", "サイドバー", "ボタン", "リンク", "タブ", "メニュー", "ヘッダー", "フッター", "その他")
TOP, SUB, TABLE, FORM, CONTENT = "トップバー", "サブメニュー", "テーブル", "フォーム", "コンテンツ本体"
SIGNIFICANT = r"^(nav|menu|btn|button|tab|header|footer|main|content|row|container|active|selected|primary|navbar)"
KEYS = ("data-rb-event-key", "data-testid", "data-id", "role", "name")


def page_shape(neg: bool, even: bool, by3: bool) -> tuple:
    """(tag, attributes, own text, children) of a rendered customer page."""
    def e(tag, text="", kids=(), **attrs):
        return tag, {k.rstrip("_").replace("_", "-"): v for k, v in attrs.items()}, text, list(kids)

    def cells(kind, *texts):
        return e("tr", kids=[e(kind, t) for t in texts])
    form = {"id": "f⟨k⟩", "action": "/save/⟨k⟩", "method": "post"} if even else {"action": "/save/⟨k⟩"}
    main = [
        e("h2", "⟨name⟩"),
        e("form", kids=[
            e("input", type="text", name="name", id="name⟨k⟩", placeholder="Name", required=""),
            e("input", type="hidden", name="k", value="⟨k⟩"), e("input", name="bal", value="⟨bal⟩"),
            e("select", kids=[e("option", "A"), e("option", "B"), e("option", "⟨seg⟩")], name="seg"), e("textarea", name="note"),
            e("button", "Save", type="submit", id="submit⟨k⟩"), e("input", type="button", value="Cancel")], **form),
        e("table", kids=[cells("th", "Key", "Balance"), cells("td", "⟨k⟩", "⟨bal⟩")], **({"id": "t⟨k⟩"} if by3 else {})),
        e("table", kids=[cells("td", "a", "b", "c"), cells("td", "d")]),
        e("img", src="/img/⟨k⟩.png", alt="⟨name⟩", width="⟨nat⟩")]
    if neg:
        main += [e("div", "Error ⟨k⟩: invalid balance", class_="alert alert-danger", role="alert"), e("p", "failed to save ⟨k⟩", class_="error-message")]
    main += [e("a", "Go", class_="btn", href="#"), e("a", "Act", role="button")]
    head = [e("meta", charset="utf-8"), e("title", "⟨name⟩"), e("meta", name="segment", content="⟨seg⟩"),
            e("meta", property="og:id", content="⟨k⟩"), e("meta", content="none")]
    body = [e("header", kids=[e("a", "Home", class_="btn nav-link", href="/home")], class_="navbar top"),
            e("div", kids=[e("a", "Ext ⟨k⟩", href="https://ext.example.com/c/⟨k⟩", data_track_id="⟨k⟩", data_empty="")], id="sidebar", class_="sidebar menu"),
            e("main", kids=main, class_="content")]
    return e("html", kids=[e("head", kids=head), e("body", kids=body)])


class Shape:
    """A page's elements in document order, and what the operators derive from each."""

    def __init__(self, root: tuple):
        self.tag, self.attrs, self.own, self.parent, self.kids = [], [], [], [], []
        self._add(root, None)

    def _add(self, node, parent):
        i = len(self.tag)
        tag, attrs, own, kids = node
        for column, x in ((self.tag, tag), (self.attrs, attrs), (self.own, own), (self.parent, parent), (self.kids, [])):
            column.append(x)
        for kid in kids:
            self.kids[i].append(len(self.tag))
            self._add(kid, i)

    def __len__(self):
        return len(self.tag)

    def text(self, i):
        return self.own[i] + "".join(self.text(j) for j in self.kids[i])

    def id(self, i):
        return self.attrs[i].get("id", "")

    def cls(self, i):
        return self.attrs[i].get("class", "")

    def up(self, i):
        """The line from the root to the element."""
        return ([] if self.parent[i] is None else self.up(self.parent[i])) + [i]

    def siblings(self, i):
        return [i] if self.parent[i] is None else self.kids[self.parent[i]]

    def alike(self, i):
        return [j for j in self.siblings(i) if self.tag[j] == self.tag[i]]

    def place(self, i):
        return self.alike(i).index(i) + 1

    def data(self, i):
        return {k: v for k, v in self.attrs[i].items() if k.startswith("data-")}

    def ancestors(self, i):
        out = []
        for j in self.up(i):
            a = {"tag": self.tag[j], "id": self.attrs[j].get("id"), "class": self.attrs[j].get("class"), "nth_tag": self.place(j),
                 "n_same": len(self.alike(j)), "nth_child": self.siblings(j).index(j) + 1, "n_child": len(self.siblings(j)),
                 "role": self.attrs[j].get("role"), "name": self.attrs[j].get("name"), "data": self.data(j)}
            out.append({k: v for k, v in a.items() if v is not None})
        return out

    def steps(self, i):
        return "/".join(self.tag[j] + (f"[{self.place(j)}]" if self.place(j) > 1 else "") for j in self.up(i))

    def xpath(self, i):
        return f"//*[@id='{self.id(i)}']" if self.id(i) else "/" + self.steps(i)

    def css(self, i):
        if self.id(i):
            return "#" + self.id(i)
        names = set(self.cls(i).split())
        if names and [names <= set(self.cls(j).split()) for j in range(len(self))].count(True) == 1:
            return "." + ".".join(self.cls(i).split())
        levels = self.up(i)[-4:]
        for at in range(len(levels) - 1, -1, -1):
            if self.id(levels[at]):
                levels = levels[at:]
                break
        return " > ".join("#" + self.id(j) if self.id(j) else self.tag[j] + (f":nth-child({self.place(j)})" if self.place(j) > 1 else "") for j in levels)

    def record(self, i):
        """(css_simple, css, xpath, full_xpath, reliable list)"""
        tag, css, xp, full, text = self.tag[i], self.css(i), self.xpath(i), "//*/" + self.steps(i), self.text(i)
        if self.id(i):
            rel = [("css", "#" + self.id(i))]
        else:
            rel = ([("css", css)] if css != tag else []) + ([("xpath", f"//{tag}[text()='{text}']")] if text else []) + [("xpath", xp), ("xpath", full)]
        return "." + self.cls(i).replace(" ", ".") if self.cls(i) else tag, css, xp, full, rel

    def reliable(self, i):
        out = [("css", f"{self.tag[i]}[{k}='{v}']") for k, v in self.data(i).items() if v]
        if self.id(i):
            out.append(("css", "#" + self.id(i)))
        if 0 < len(self.cls(i).split()) < 3:
            out.append(("css", "." + ".".join(self.cls(i).split(" "))))
        return out + ([("xpath", f"//{self.tag[i]}[text()='{self.text(i)}']")] if self.text(i) else [])

    def candidates(self, i):
        data = [(k, v) for k, v in self.data(i).items() if v]
        out = [("by_id", "id", self.id(i))] if self.id(i) else []
        out += [("by_data_attr", "css", f"{self.tag[i]}[{k}='{v}']") for k, v in data[:1]] + [("by_xpath", "xpath", self.xpath(i))]
        out += [("by_text", "xpath", f"//*[contains(text(), '{self.text(i)}')]")] if self.text(i) else []
        return out + [("by_css", "css", self.css(i))]

    def categories(self, i):
        tag, c, e = self.tag[i], self.cls(i).lower(), self.id(i).lower()
        above = self.cls(self.parent[i]).lower() if self.parent[i] is not None else ""

        def either(*words):
            return any(w in x for w in words for x in (c, e))

        def classes(*words):
            return any(w in c for w in words)
        first = (NAV if classes("navbar", "nav-") or tag == "nav" else SIDE if classes("sidebar", "side-") else BUTTON if classes("btn") or tag == "button"
                 else LINK if tag == "a" else TAB if classes("tab") else MENU if classes("menu") else HEADER if classes("header")
                 else FOOTER if classes("footer") else OTHER)
        if classes("menu-item", "menu-nav") or "menu-item" in e:
            return first, SUB if any(w in above for w in ("submenu", "sub-menu", "dropdown")) else SIDE
        if either("nav", "header", "menu"):
            return first, TOP if classes("top", "header", "main-nav") else SUB if either("sub") else SIDE if either("side") else NAV
        if either("sidebar", "side-bar", "sidenav"):
            return first, SIDE
        if tag in ("table", "tr", "td", "th") or either("table"):
            return first, TABLE
        if tag in ("form", "input", "select", "textarea") or either("form"):
            return first, FORM
        if tag == "button" or classes("btn", "button", "submit") or "btn" in e:
            return first, BUTTON
        if tag == "a":
            return first, SIDE if "menu" in above else TOP if "nav" in above or "header" in above else LINK
        return first, CONTENT if either("content", "main", "body") else OTHER

    def first_child(self, i, kinds):
        return next((self.tag[j] for j in self.kids[i] if self.text(j) or self.tag[j] in kinds), None)

    def css_path(self, i):
        if self.id(i):
            return "#" + self.id(i)
        line, out = self.up(i), []
        for j in line[::-1]:
            if j != i and self.id(j):
                out.append("#" + self.id(j))
                break
            if len(out) == 5:
                break
            names = self.cls(j).split()
            shown = [n for n in names if re.match(SIGNIFICANT, n)] or ([] if self.data(j) else names)
            key = [f"[{k}='{self.attrs[j][k]}']" for k in KEYS if self.attrs[j].get(k)]
            nth = f":nth-child({self.siblings(j).index(j) + 1})" if len(self.siblings(j)) > 1 else ""
            kid = self.first_child(j, ("div", "span", "img", "i", "em", "strong")) if j == i else None
            out.append(self.tag[j] + nth + "".join("." + n for n in shown[:1]) + "".join(key[:1]) + (" > " + kid if kid else ""))
        return " > ".join(out[::-1])

    def xpath_unified(self, i):
        if self.id(i):
            return f'//*[@id="{self.id(i)}"]'
        steps, top = [], "/"
        for j in self.up(i)[::-1]:
            if j != i and self.tag[j] in ("body", "html"):
                break
            if j != i and self.id(j):
                top = f'//*[@id="{self.id(j)}"]'
                break
            steps.append("/" + self.tag[j] + (f"[{self.place(j)}]" if len(self.alike(j)) > 1 else ""))
        kid = self.first_child(i, ("div", "span"))
        return top + "".join(steps[::-1]) + ("/" + kid if kid else "")


SHAPES = {neg * 4 + even * 2 + by3: Shape(page_shape(neg, even, by3)) for neg in (0, 1) for even in (0, 1) for by3 in (0, 1)}


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _typed(pairs, names=("type", "value")) -> str:
    return _json([dict(zip(names, p)) for p in pairs])


def _filled(column: str) -> str:
    out = column
    for mark, value in MARKS.items():
        out = f"replace({out}, '{mark}', {value})"
    return out


def rendered(customer_page: str, columns: dict, where: str = "") -> str:
    """SQL of one row per element (or more): ``columns`` maps a name to (type, function of (shape, i) giving
    its value, or a list of values for several rows at their positions ``pos``)."""
    rows = []
    for v, s in SHAPES.items():
        for i in range(len(s)):
            got = [f(s, i) for _, f in columns.values()]
            lists = [x for x in got if isinstance(x, list)]
            for at in range(len(lists[0]) if lists else 1):
                cells = [x[at] if isinstance(x, list) else x for x in got]
                text = ["NULL" if c is None else str(c) if isinstance(c, int) else "'" + c.replace("'", "''") + "'" for c in cells]
                rows.append(f"({v}, {', '.join(text)})")
    select = ", ".join(f"{_filled(f't.\"{n}\"') if t == 'VARCHAR' else f't.\"{n}\"::{t}'} AS \"{n}\"" for n, (t, _) in columns.items())
    names = ", ".join(f'"{n}"' for n in columns)
    return (f"WITH {customer_page}\nSELECT page_id, {select}\nFROM c JOIN (VALUES {', '.join(rows)}) t(shape, {names})\n"
            f"ON t.shape = c.neg::INTEGER * 4 + c.even::INTEGER * 2 + c.by3::INTEGER{where}")


_IDX = {"idx": ("INTEGER", lambda s, i: i)}
_TAG = {"tag": ("VARCHAR", lambda s, i: s.tag[i])}


def _var(f):
    return "VARCHAR", f


def rendered_queries(customer_page: str) -> dict[str, str]:
    """SQL by query name over the rendered customer pages."""
    one = {
        "elements_rt": {**_IDX, "parent_idx": ("INTEGER", lambda s, i: s.parent[i]), "depth": ("INTEGER", lambda s, i: len(s.up(i)) - 1), **_TAG,
                        "id": _var(lambda s, i: s.attrs[i].get("id")), "class": _var(lambda s, i: s.attrs[i].get("class")),
                        "attrs": _var(lambda s, i: _json(s.attrs[i])), "own_text": _var(lambda s, i: s.own[i]),
                        "text": _var(lambda s, i: s.text(i)), "anc": _var(lambda s, i: _json(s.ancestors(i)))},
        "element_selectors": {**_IDX, **_TAG, "id": _var(lambda s, i: s.id(i)), "class": _var(lambda s, i: s.cls(i)),
                              **{n: _var(lambda s, i, at=at: s.record(i)[at]) for at, n in enumerate(("css_simple", "css", "xpath", "full_xpath"))},
                              "reliable_selectors": _var(lambda s, i: _typed(s.record(i)[4]))},
        "best_selector": {**_IDX, **{n: _var(lambda s, i, at=at: s.candidates(i)[0][at]) for at, n in enumerate(("kind", "type", "value"))},
                          "selector_list": _var(lambda s, i: _typed(s.candidates(i), ("kind", "type", "value")))},
        "element_category": {**_IDX, **_TAG, "category": _var(lambda s, i: s.categories(i)[0]), "category_detailed": _var(lambda s, i: s.categories(i)[1])},
        "css_path": {**_IDX, **_TAG, "css_path": _var(lambda s, i: s.css_path(i))},
        "xpath_unified": {**_IDX, **_TAG, "xpath_unified": _var(lambda s, i: s.xpath_unified(i))},
        "css_selector": {**_TAG, "css": _var(lambda s, i: s.css(i))},
    }
    out = {name: rendered(customer_page, columns) for name, columns in one.items()}
    # a text step is listed for texts under 50 letters
    rel = rendered(customer_page, {**_IDX, **_TAG, "pos": ("INTEGER", lambda s, i: list(range(len(s.reliable(i))))),
                                   "type": _var(lambda s, i: [t for t, _ in s.reliable(i)]), "value": _var(lambda s, i: [x for _, x in s.reliable(i)])})
    out["reliable_selectors"] = f"SELECT * FROM ({rel}) WHERE type = 'css' OR length(value) - length('//[text()='''']') - length(tag) < 50"
    return out


def parsed_pages(clean_html: str, unescape) -> str:
    """Common table expressions that parse ``pages`` into ``el``: one row per element with attributes, texts, sibling
    counts and its ancestors' steps and JSON."""
    parent = ("CASE WHEN tag IN ('head', 'body') THEN 'html' WHEN tag IN ('meta', 'title', 'style', 'script') THEN 'head' "
              "WHEN tag IN ('nav', 'div', 'article', 'footer') THEN 'body' WHEN tag = 'ul' THEN 'nav' WHEN tag = 'li' THEN 'ul' "
              "WHEN tag = 'a' THEN 'li' WHEN tag IN ('h1', 'p') THEN 'article' WHEN tag = 'b' THEN 'p' WHEN tag = 'br' THEN 'b' END")
    return f"""
pg AS (SELECT page_id, regexp_extract_all({clean_html}, '<[a-zA-Z][^>]*>[^<]*') AS toks FROM pages),
tk AS (SELECT page_id, unnest(toks) AS tok, unnest(range(len(toks))) AS idx FROM pg),
op AS (SELECT page_id, CAST(idx AS INTEGER) AS idx, lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) AS tag,
              regexp_extract_all(regexp_extract(tok, '^<[^>]*>'), '([a-zA-Z-]+)="[^"]*"', 1) AS names,
              regexp_extract_all(regexp_extract(tok, '^<[^>]*>'), '[a-zA-Z-]+="([^"]*)"', 1) AS vals,
              {unescape("regexp_extract(tok, '>([^<]*)$', 1)")} AS own_text FROM tk),
li AS (SELECT *, {parent} AS above FROM op),
pa AS (SELECT c.page_id, c.idx, max(p.idx) AS parent_idx FROM li c JOIN li p ON p.page_id = c.page_id AND p.tag = c.above AND p.idx < c.idx GROUP BY ALL),
si AS (SELECT li.*, pa.parent_idx, names[list_position(names, 'class')] IS NOT NULL AS has_class,
              vals[list_position(names, 'id')] AS id, vals[list_position(names, 'class')] AS class,
              '{{' || array_to_string(list_transform(list_zip(names, vals), lambda z: '"' || z[1] || '":"' || z[2] || '"'), ',') || '}}' AS attrs,
              row_number() OVER w AS nth_child, count(*) OVER (PARTITION BY li.page_id, pa.parent_idx) AS n_child,
              row_number() OVER (PARTITION BY li.page_id, pa.parent_idx, tag ORDER BY li.idx) AS nth_tag,
              count(*) OVER (PARTITION BY li.page_id, pa.parent_idx, tag) AS n_same
       FROM li LEFT JOIN pa ON pa.page_id = li.page_id AND pa.idx = li.idx
       WINDOW w AS (PARTITION BY li.page_id, pa.parent_idx ORDER BY li.idx)),
me AS (SELECT *, '{{"tag":"' || tag || '"' || coalesce(',"id":"' || id || '"', '') || coalesce(',"class":"' || class || '"', '')
              || ',"nth_tag":' || nth_tag || ',"n_same":' || n_same || ',"nth_child":' || nth_child || ',"n_child":' || n_child || ',"data":{{}}}}' AS json,
              tag || CASE WHEN nth_tag > 1 THEN '[' || nth_tag || ']' ELSE '' END AS step FROM si),
down AS (SELECT page_id, idx, 0 AS depth, [idx] AS line, step AS steps, json AS anc FROM me WHERE parent_idx IS NULL
         UNION ALL
         SELECT m.page_id, m.idx, d.depth + 1, list_append(d.line, m.idx), d.steps || '/' || m.step, d.anc || ',' || m.json
         FROM down d JOIN me m ON m.page_id = d.page_id AND m.parent_idx = d.idx),
tx AS (SELECT page_id, top AS idx, string_agg(own_text, '' ORDER BY x.idx) AS text
       FROM (SELECT d.page_id, unnest(d.line) AS top, d.idx, m.own_text FROM down d JOIN me m ON m.page_id = d.page_id AND m.idx = d.idx) x
       GROUP BY page_id, top),
el AS (SELECT m.*, d.depth, d.steps, '[' || d.anc || ']' AS anc, tx.text FROM me m JOIN down d ON d.page_id = m.page_id AND d.idx = m.idx
       JOIN tx ON tx.page_id = m.page_id AND tx.idx = m.idx)"""


def parsed_queries(clean_html: str, unescape) -> dict[str, str]:
    """SQL by query name over the parsed ``pages``."""
    base = "WITH RECURSIVE " + parsed_pages(clean_html, unescape).strip()
    return {
        "elements": f"{base}\nSELECT page_id, idx, parent_idx, depth, tag, id, class, attrs, own_text, text, anc FROM el",
        "elements_compact": f"""{base},
ranges AS (SELECT page_id, top AS idx, max(low) + 1 AS end_idx FROM (SELECT page_id, unnest(line) AS top, idx AS low FROM down) GROUP BY ALL),
starts AS (SELECT page_id, idx, coalesce(sum(length(own_text)) OVER (PARTITION BY page_id ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS text_from FROM me)
SELECT el.page_id, el.idx, CAST(r.end_idx AS INTEGER) AS end_idx, parent_idx, depth, tag, attrs, own_text,
       CAST(s.text_from AS INTEGER) AS text_from, CAST(s.text_from + length(text) AS INTEGER) AS text_to
FROM el JOIN ranges r ON r.page_id = el.page_id AND r.idx = el.idx JOIN starts s ON s.page_id = el.page_id AND s.idx = el.idx""",
        "element_paths": f"{base}\nSELECT page_id, idx, tag, text, anc FROM el",
        "xpath": f"{base}\nSELECT page_id, idx, tag, CASE WHEN coalesce(id, '') <> '' THEN '//*[@id=''' || id || ''']' ELSE '/' || steps END AS xpath, "
                 "'//' || steps AS xpath_soup, '//*/' || steps AS full_xpath FROM el",
    }
