"""H1 helper: tolerant HTML -> flat element rows for one page.

Runs inside ``mapInArrow`` tasks (see ``quarry.sources.pages``); it is the
only per-row Python on the page path. Uses the standard library tokenizer,
a void-element list and the common implied-end-tag rules, so malformed
pages (unclosed ``<b>``/``<p>``, stray end tags) still give a tree. Text of
``script``/``style`` is not element text; entities are decoded.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

# Elements without content, and the implied-end-tag rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# tag -> tags that an open element of that kind is closed by (when it is the
# nearest such element below a scope boundary)
IMPLIED = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "optgroup": frozenset({"optgroup"}),
    "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "thead": frozenset({"tbody", "tfoot"}),
    "tbody": frozenset({"tbody", "tfoot"}),
}
SCOPE = frozenset("html body table td th ul ol div article section nav form button".split())
RAW_TEXT = frozenset({"script", "style"})
CLOSERS = frozenset().union(*IMPLIED.values())
CLOSING = CLOSES_P | CLOSERS  # a start tag of another kind closes nothing
# text and the plainest markup after it: a doctype, an end tag, or a start tag whose
# attributes are quoted and hold no references
_PLAIN = re.compile(
    r'''([^<]*)<(?:![dD][oO][cC][tT][yY][pP][eE][^>]*>|/([a-zA-Z][a-zA-Z0-9]*)>'''
    r'''|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-\w:]*(?:="[^"&]*"|='[^'&]*')?)*)[ \t\n]*(/?)>)''', re.ASCII)
_PLAIN_ATTR = re.compile(r'''([a-zA-Z][-\w:]*)(?:="([^"]*)"|='([^']*)')?''', re.ASCII)
# elements whose content the standard tokenizer may read in a mode of its own
_OWN_MODE = frozenset({*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"})
# Elements a browser never renders; with the hidden attribute, a hidden
# input or an inline display:none / visibility:hidden they make an element
# (and its subtree) not displayed.
NOT_RENDERED = frozenset("head title meta link base script style template noscript".split())
_NOT_SPACE = re.compile(r"\S")
_CLASS_GAP = re.compile(r"[ \t\n\f\r]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.own: list[list[str]] = []
        self.stack: list[int] = []
        self.chunks: list[str] = []  # text in document order
        self.length = 0
        # what an element holds: elements [i, end[i]) and the page text [text_from[i], text_to[i])
        self.end: list[int] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []

    def _close(self, elements: list[int]) -> None:
        for i in elements:
            self.end[i], self.text_to[i] = len(self.tags), self.length

    def _cut(self, pos: int) -> None:
        """Close the open elements from a place in the stack on."""
        self._close(self.stack[pos:])
        del self.stack[pos:]

    def finish(self) -> None:
        self._cut(0)

    def _pop_to(self, i: int) -> None:
        self._cut(self.stack.index(i))

    def _close_implied(self, tag: str) -> None:
        if tag in CLOSES_P:
            for pos in range(len(self.stack) - 1, -1, -1):
                t = self.tags[self.stack[pos]]
                if t == "p":
                    self._pop_to(self.stack[pos])
                    break
                if t in SCOPE:
                    break
        closed = tag in CLOSERS
        while closed:
            closed = False
            for pos in range(len(self.stack) - 1, -1, -1):
                t = self.tags[self.stack[pos]]
                closers = IMPLIED.get(t)
                if closers is not None and tag in closers:
                    self._pop_to(self.stack[pos])
                    closed = True
                    break
                if t in SCOPE or t in IMPLIED:
                    break

    def handle_starttag(self, tag, attrs):
        d: dict[str, str] = {}
        for k, v in attrs:
            if k not in d:
                d[k] = "" if v is None else v
        self.open_element(tag, d)

    def open_element(self, tag: str, d: dict[str, str]) -> None:
        if tag in CLOSING:
            self._close_implied(tag)
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(d)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.own.append([])
        self.end.append(i + 1)
        self.text_from.append(self.length)
        self.text_to.append(self.length)
        if tag not in VOID:
            self.stack.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self._close_empty(tag)

    def open_and_close(self, tag: str, d: dict[str, str]) -> None:
        self.open_element(tag, d)
        self._close_empty(tag)

    def _close_empty(self, tag: str) -> None:
        if tag not in VOID and self.stack and self.tags[self.stack[-1]] == tag:
            self._cut(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.tags[self.stack[pos]] == tag:
                self._cut(pos)
                return

    def handle_data(self, data):
        if not self.stack:
            return
        cur = self.stack[-1]
        if self.tags[cur] in RAW_TEXT:
            return
        self.own[cur].append(data)
        self.chunks.append(data)
        self.length += len(data)


def _feed_plain(p: _Tree, html: str) -> int:
    """Hands over the page's tags and texts as far as they are plain markup; returns where the
    standard tokenizer has to go on (it does the same events several times slower)."""
    at, n = 0, len(html)
    match, attributes = _PLAIN.match, _PLAIN_ATTR.findall
    start, start_end, end, data_of = p.open_element, p.open_and_close, p.handle_endtag, p.handle_data
    while at < n:
        m = match(html, at)
        if m is None:
            break
        data, end_tag, tag, attrs, empty = m.groups()
        if tag is not None:
            tag = tag.lower()
            if tag in _OWN_MODE:
                break
        if data:
            data_of(unescape(data) if "&" in data else data)
        if tag is not None:
            d: dict[str, str] = {}
            if attrs:
                for k, a, b in attributes(attrs):
                    d.setdefault(k.lower(), a or b)
            (start_end if empty else start)(tag, d)
        elif end_tag is not None:
            end(end_tag.lower())
        at = m.end()
    return at


def parse_tree(html: str) -> _Tree:
    p = _Tree()
    try:
        at = _feed_plain(p, html)
        if at < len(html):
            p.feed(html[at:] if at else html)
        p.close()
    except Exception:  # noqa: BLE001 - a broken tail keeps what was parsed
        pass
    p.finish()
    return p


def page_text(html: str | None) -> str:
    """The text of all elements in document order, which ``text_from`` and ``text_to`` count in."""
    return "".join(parse_tree(html).chunks) if html else ""


def parse_elements(html: str | None, tags: frozenset[str] | None = None, text: bool = True, ancestors: bool = True) -> list[tuple]:
    """Element rows of one page:
    (idx, parent_idx, depth, tag, id, class, attrs, own_text, text,
     nth_child, n_child, nth_tag, n_same, anc, visible, end_idx, text_from, text_to)
    ``anc`` lists (tag, id, class, nth_tag, n_same, nth_child, n_child, role,
    name, data-* attributes) from the root down to the element itself. Only
    elements of ``tags`` get a row, where given; ``text`` and ``anc`` are built only
    where asked for (None otherwise). An element's descendants are those with idx below
    its ``end_idx``, and its text is the page text from ``text_from`` to ``text_to``.
    """
    rows, step = parse_paths(html, tags, text, ancestors)
    if not ancestors:
        return rows
    steps: dict[int, tuple] = {}
    for r in rows:
        for i in r[13]:
            if i not in steps:
                steps[i] = step(i)
    return [(*r[:13], [steps[i] for i in r[13]], *r[14:]) for r in rows]


def parse_paths(html: str | None, tags: frozenset[str] | None = None, text: bool = True, ancestors: bool = True,
                having: frozenset[str] | None = None, facts: bool = True, page_facts: frozenset[str] = frozenset()):
    """The rows of ``parse_elements`` with places in ``anc``, the idx of each element on the
    path, and the function that gives the entry of a place: a page's elements share their ancestors.
    With ``having`` elements that hold one of these attributes get a row too, besides those of ``tags``. Without
    ``facts`` the places among the siblings and ``visible`` aren't worked out (None). ``page_facts`` adds
    to each row, in this order, ``n_class`` and ``kids`` (None where not asked for)."""
    if not html:
        return [], None
    p = parse_tree(html)
    n = len(p.tags)
    tag_of, parent, attrs_of = p.tags, p.parent, p.attrs
    places = facts or ancestors
    if places:
        nth_child, nth_tag, n_child, n_same = [0] * n, [0] * n, {}, {}
        for i in range(n):
            par = parent[i]
            nth_child[i] = n_child[par] = n_child.get(par, 0) + 1
            key = (par, tag_of[i])
            nth_tag[i] = n_same[key] = n_same.get(key, 0) + 1
    whole = "".join(p.chunks) if text or "kids" in page_facts else ""
    depth = [0] * n
    visible = [True] * n

    def step(i):
        a = attrs_of[i]
        return (tag_of[i], a.get("id"), a.get("class"), nth_tag[i], n_same[parent[i], tag_of[i]], nth_child[i], n_child[parent[i]],
                a.get("role"), a.get("name"), {k: v for k, v in a.items() if k.startswith("data-")})

    def line(i):
        out = []
        while i >= 0:
            out.append(i)
            i = parent[i]
        return out[::-1]

    alike = _alike(attrs_of) if "n_class" in page_facts else None
    kids = _kids(p, whole) if "kids" in page_facts else None
    rows = []
    for i in range(n):
        par = parent[i]
        a = attrs_of[i]
        tag = tag_of[i]
        depth[i] = depth[par] + 1 if par >= 0 else 0
        if facts:
            hidden = ("hidden" in a or tag in NOT_RENDERED
                      or (tag == "input" and a.get("type", "").lower() == "hidden")
                      or ("style" in a and bool(_HIDDEN_STYLE.search(a["style"]))))
            visible[i] = (visible[par] if par >= 0 else True) and not hidden
        if tags is None or tag in tags or (having is not None and a and not having.isdisjoint(a)):
            at, to = p.text_from[i], p.text_to[i]
            row = (i, par if par >= 0 else None, depth[i], tag, a.get("id"), a.get("class"), a, "".join(p.own[i]),
                   whole[at:to] if text else None,
                   *((nth_child[i], n_child[par], nth_tag[i], n_same[par, tag]) if places else (None, None, None, None)),
                   line(i) if ancestors else None, visible[i] if facts else None, p.end[i], at, to)
            if page_facts:
                row += (alike[i] if alike is not None else None, kids[i] if kids is not None else None)
            rows.append(row)
    return rows, step


def _alike(attrs: list[dict]) -> list[int | None]:
    """For each element that has classes: how many elements of the page have all of them. A class's
    elements are the bits of a number, and the numbers of an element's classes are intersected."""
    held = [frozenset(filter(None, _CLASS_GAP.split(a["class"]))) if a.get("class") else frozenset() for a in attrs]
    bits: dict[str, int] = {}
    for i, names in enumerate(held):
        for c in names:
            bits[c] = bits.get(c, 0) | 1 << i
    counts: dict[frozenset, int | None] = {frozenset(): None}
    for names in held:
        if names not in counts:
            first, *rest = (bits[c] for c in names)
            for b in rest:
                first &= b
            counts[names] = first.bit_count()
    return [counts[names] for names in held]


def _kids(p: _Tree, whole: str) -> list[list[tuple[str, bool]]]:
    """For each element its children in order: (tag, whether it holds any text but white space)."""
    out: list[list[tuple[str, bool]]] = [[] for _ in p.tags]
    for i, par in enumerate(p.parent):
        if par >= 0:
            out[par].append((p.tags[i], _NOT_SPACE.search(whole, p.text_from[i], p.text_to[i]) is not None))
    return out
