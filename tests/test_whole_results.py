"""Queries that return whole records: elements, schema document, newest files."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.html import parse_elements
from quarry.operators import schema_infer as si
from quarry.plans import fixtures as fx
from quarry.plans.catalog import QUERIES, report
from quarry.sources import reports as rpt

SF = "/root/testdata/sf0.001"
ANC = ("tag", "id", "class", "nth_tag", "n_same", "nth_child", "n_child", "role", "name", "data")


@pytest.mark.parametrize("key", ["elements_all", "elements_rt_all"])
def test_whole_elements(spark, key):
    pages = (spark.read.parquet(f"{SF}/pages.parquet") if key == "elements_all"
             else fx.customer_pages(spark.read.parquet(f"{SF}/customer.parquet")))
    want = {(p.page_id, r[0]): r for p in pages.collect() for r in parse_elements(p.html)}
    rows = QUERIES[key](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.page_id, r.idx]
        assert (r.parent_idx, r.depth, r.tag, r.id, r["class"], json.loads(r.attrs), r.own_text, r.text) == w[1:9]
        assert json.loads(r.anc) == [{k: v for k, v in zip(ANC, a) if v is not None} for a in w[13]]


def test_both_parts_of_the_schema_document(spark):
    want = si.schema_table(report(spark, SF, "orders", "o_orderkey")).orderBy("col_pos").collect()
    got = QUERIES["schema_document"](spark, SF).orderBy("pos").collect()
    assert len(got) == len(want) > 5
    for g, w in zip(got, want):
        assert (g.result_column, g.result_type, g.result_rate, g.result_count) == (
            w.COLUMN_ORIGIN_NAME, w.DATA_TYPE, w.CONSISTENCY_RATE, w.INCONSISTENT_COUNT)
        assert g.SAMPLE_DATA == w.SAMPLE_DATA and g.INCONSISTENT_SAMPLES == "|".join(w.INCONSISTENT_SAMPLES)


def test_newest_of_several_files(spark):
    parts = {r.part for r in spark.read.parquet(f"{SF}/orders.parquet").select(
        F.floor(F.col("o_orderkey") / fx.ORDER_REPORT_FILE_ROWS).cast("long").alias("part")).distinct().collect()}
    got = QUERIES["latest_file"](spark, SF).collect()
    assert sorted(r.part for r in got) == sorted(p for p in parts if p % 3 != 1) and all(r.length > 0 for r in got)


def test_empty_files_are_listed(spark, tmp_dir):
    import os
    for name, text in (("a b.csv", "x"), ("e%20.csv", ""), ("sub/f.csv", ""), ("é.csv", "")):
        os.makedirs(os.path.dirname(f"{tmp_dir}/l/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/l/{name}", "w") as f:
            f.write(text)
    got = {r.name: (r.length, r.modificationTime.timestamp()) for r in rpt.list_files(spark, f"{tmp_dir}/l").collect()}
    assert {n: x for n, (x, _) in got.items()} == {"a b.csv": 1, "e%20.csv": 0, "f.csv": 0, "é.csv": 0}
    assert abs(got["é.csv"][1] - os.path.getmtime(f"{tmp_dir}/l/é.csv")) < 1
    assert rpt.list_files(spark, f"{tmp_dir}/l/sub").collect()[0].length == 0
