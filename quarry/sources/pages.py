"""H1: the ``pages(page_id, url, html)`` table -> ``elements`` table.

One row per element, with its ancestor path, so every later page operator
is plain DataFrame work partitioned by ``page_id``. Parsing runs in
``mapInArrow`` tasks over the page partitions (no shuffle); output batches
are flushed every few hundred pages so a partition of large pages never
sits in memory at once.

An operator that reads few columns, or elements of few kinds, asks the parse for just
those (``columns``, ``tags``): texts and ancestor paths are then not even built.

``COMPACT`` columns encode the tree by intervals: an element's descendants are the
elements [idx, end_idx), its text the page text [text_from, text_to). Such a table is linear in the
page however deep it is nested (texts and ancestors copied into every row are not);
``with_text`` and ``with_ancestors`` give them back to the elements that need them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.html import page_text, parse_paths
from quarry.session import ship_package, spread

ANC = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("class", T.StringType()), T.StructField("nth_tag", T.IntegerType()),
    T.StructField("n_same", T.IntegerType()), T.StructField("nth_child", T.IntegerType()),
    T.StructField("n_child", T.IntegerType()), T.StructField("role", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])
ELEMENT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("idx", T.IntegerType()), T.StructField("parent_idx", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("own_text", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("nth_child", T.IntegerType()), T.StructField("n_child", T.IntegerType()),
    T.StructField("nth_tag", T.IntegerType()), T.StructField("n_same", T.IntegerType()),
    T.StructField("anc", T.ArrayType(ANC)),
    T.StructField("visible", T.BooleanType()),
    T.StructField("end_idx", T.IntegerType()), T.StructField("text_from", T.IntegerType()), T.StructField("text_to", T.IntegerType()),
])
# facts of an element's place in its page that are built only where asked for by name: how many
# elements of the page have all its classes (null: it has none); its children's tags, and whether they hold text
PAGE_FACTS = T.StructType([
    T.StructField("n_class", T.IntegerType()),
    T.StructField("kids", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("has_text", T.BooleanType())]))),
])
COMPACT = [c for c in ELEMENT_SCHEMA.fieldNames() if c not in ("text", "anc")]

_ANC_ARROW = pa.struct([("tag", pa.string()), ("id", pa.string()), ("class", pa.string()),
                        ("nth_tag", pa.int32()), ("n_same", pa.int32()), ("nth_child", pa.int32()),
                        ("n_child", pa.int32()), ("role", pa.string()), ("name", pa.string()),
                        ("data", pa.map_(pa.string(), pa.string()))])
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("idx", pa.int32()), ("parent_idx", pa.int32()),
    ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("class", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string()),
    ("nth_child", pa.int32()), ("n_child", pa.int32()), ("nth_tag", pa.int32()), ("n_same", pa.int32()),
    ("anc", pa.list_(_ANC_ARROW)), ("visible", pa.bool_()), ("end_idx", pa.int32()), ("text_from", pa.int32()), ("text_to", pa.int32()),
    ("n_class", pa.int32()), ("kids", pa.list_(pa.struct([("tag", pa.string()), ("has_text", pa.bool_())]))),
])
# a batch is sent on when its rows hold about so many bytes
FLUSH_BYTES = 8 << 20
ROW_BYTES, ANCESTOR_BYTES = 200, 150
# tasks a core where the parse's input is spread: none of them gets long
TASKS_A_CORE = 4


def _maps(dicts) -> pa.Array:
    """A map column of text by text, built from its flat keys and values."""
    keys, values, ends = [], [], [0]
    for d in dicts:
        keys += d
        values += d.values()
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _kid_lists(lists) -> pa.Array:
    ends = [0, *accumulate(map(len, lists))]
    flat = [k for kids in lists for k in kids]
    tags, texts = zip(*flat) if flat else ((), ())
    each = pa.StructArray.from_arrays([pa.array(tags, pa.string()), pa.array(texts, pa.bool_())], names=["tag", "has_text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def _extract(columns: list[str], tags: frozenset[str] | None, steps: Sequence[str] | None = None,
             having: frozenset[str] | None = None):
    kept = [k for k, f in enumerate(ANC.fieldNames()) if steps is None or f in steps]
    fields = [_ANC_ARROW.field(k) for k in kept]
    schema = pa.schema([_ARROW.field(c) if c != "anc" else pa.field(c, pa.list_(pa.struct(fields))) for c in columns])
    data_at = ANC.fieldNames().index("data")
    at = [_ARROW.get_field_index(c) for c in columns]
    anc_at = _ARROW.get_field_index("anc")
    text, anc = "text" in columns, "anc" in columns
    facts = not {"nth_child", "n_child", "nth_tag", "n_same", "visible"}.isdisjoint(columns)
    page_facts = frozenset(PAGE_FACTS.fieldNames()) & frozenset(columns)

    def paths(rows_of_places, entries):
        """The ancestor column: each entry is converted once, however many paths share it."""
        each = [pa.array(c, type=f.type) for c, f in zip(zip(*entries), fields)]
        ends = [0, *accumulate(map(len, rows_of_places))]
        places = pa.array([k for row in rows_of_places for k in row], pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, fields=fields).take(places))

    def column(f, values, entries):
        if f.name == "anc":
            return paths(values, entries)
        return _maps(values) if f.name == "attrs" else _kid_lists(values) if f.name == "kids" else pa.array(values, type=f.type)

    def batch(rows, entries):
        return pa.RecordBatch.from_arrays([column(f, c, entries) for f, c in zip(schema, zip(*rows))], schema=schema)

    def run(batches):
        rows, held, entries = [], 0, []
        for rb in batches:
            pid_col, url_col, html_col = (rb.column(c) for c in ("page_id", "url", "html"))
            for i in range(rb.num_rows):  # one page's Python objects at a time
                pid, url, html = pid_col[i].as_py(), url_col[i].as_py(), html_col[i].as_py()
                found, step = parse_paths(html, tags, text, anc, having, facts, page_facts)
                place = {}  # of this page's elements among the batch's entries
                for r in found:
                    row = [pid, url, *r]
                    if anc:
                        for k in r[13]:
                            if k not in place:
                                place[k] = len(entries)
                                entry = step(k)
                                entries.append([list(entry[f].items()) if f == data_at else entry[f] for f in kept])
                        row[anc_at] = [place[k] for k in r[13]]
                    rows.append([row[k] for k in at])
                    held += ROW_BYTES + (ANCESTOR_BYTES * len(r[13]) if anc else 0) + len(r[7]) + (len(r[8]) if text else 0)
                    if held >= FLUSH_BYTES:
                        yield batch(rows, entries)
                        rows, held, entries, place = [], 0, [], {}
        if rows:
            yield batch(rows, entries)
    return run


def _source(pages: DataFrame, page_id: str, url: str, html: str, spread_out: bool = True) -> DataFrame:
    ship_package(pages.sparkSession)
    src = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"),
                       pages[html].alias("html"))
    return spread(src, "page_id", per_core=TASKS_A_CORE) if spread_out else src


def extract_elements(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                     columns: Sequence[str] | None = None, tags: Sequence[str] | None = None,
                     steps: Sequence[str] | None = None, having: Sequence[str] | None = None,
                     spread_out: bool = True) -> DataFrame:
    """H1: element table (schema ``ELEMENT_SCHEMA``); with ``columns`` only those (``PAGE_FACTS`` among
    them, where named), with ``tags`` only elements of those kinds and, with ``having``, those that hold one of these
    attributes (their places among their siblings still count all), with ``steps``
    only those fields of the ancestors in ``anc``. Pages that lie in many short partitions already needn't be
    ``spread_out``."""
    names = ELEMENT_SCHEMA.fieldNames()
    columns = names if columns is None else [c for c in (*names, *PAGE_FACTS.fieldNames()) if c in set(columns)]
    anc = T.StructField("anc", T.ArrayType(T.StructType([f for f in ANC if steps is None or f.name in steps])))
    field = {f.name: f for f in (*ELEMENT_SCHEMA, *PAGE_FACTS, anc)}
    schema = T.StructType([field[c] for c in columns])
    parse = _extract(columns, frozenset(tags) if tags is not None else None, steps, frozenset(having) if having is not None else None)
    return _source(pages, page_id, url, html, spread_out).mapInArrow(parse, schema)


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, page_text): what the elements' ``text_from`` and ``text_to`` count in."""
    def run(batches):
        for rb in batches:
            for i in range(rb.num_rows):
                yield pa.record_batch([rb.column("page_id").slice(i, 1), pa.array([page_text(rb.column("html")[i].as_py())], pa.string())],
                                      names=["page_id", "page_text"])
    return _source(pages, page_id, url, html).mapInArrow(run, "page_id long, page_text string")


def with_text(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``text`` to (some) rows of a compact element table, from their pages' texts."""
    return elements.join(texts, "page_id").withColumn("text", F.substring("page_text", F.col("text_from") + 1, F.col("text_to") - F.col("text_from"))) \
        .drop("page_text")


def with_ancestors(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds ``anc`` to (some) rows of a compact element table. The ancestor at a depth is the last
    element of that depth at or before the target in document order, as intervals nest: targets, once per
    depth above them, and elements are put in one order per page and depth, and each target takes
    the last element before it. That is as many rows as the paths have steps, and no pairs."""
    data = F.map_filter("attrs", lambda k, _: F.startswith(k, F.lit("data-")))
    me = F.struct("tag", "id", "class", "nth_tag", "n_same", "nth_child", "n_child", F.element_at("attrs", F.lit("role")).alias("role"),
                  F.element_at("attrs", F.lit("name")).alias("name"), data.alias("data"))
    nodes = elements.select("page_id", F.col("depth").alias("_d"), "idx", F.lit(0).alias("_ask"), me.alias("_me"))
    asks = targets.select("page_id", F.explode(F.sequence(F.lit(0), "depth")).alias("_d"), "idx", F.lit(1).alias("_ask"),
                          F.lit(None).cast(nodes.schema["_me"].dataType).alias("_me"))
    order = Window.partitionBy("page_id", "_d").orderBy("idx", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = nodes.unionByName(asks).withColumn("_me", F.last("_me", ignorenulls=True).over(order)).filter("_ask = 1")
    paths = found.groupBy("page_id", "idx").agg(F.array_sort(F.collect_list(F.struct("_d", "_me")),
                                                             lambda a, b: F.signum(a["_d"] - b["_d"]).cast("int")).alias("_p"))
    return targets.join(paths.select("page_id", "idx", F.transform("_p", lambda x: x["_me"]).alias("anc")), ["page_id", "idx"])
