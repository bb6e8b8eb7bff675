"""End-to-end flows (E1 profile, E2 pages, E3 landing)."""

import json
import os

from quarry.plans import flows
from quarry.sources import reports as rpt


def _write(path, text, enc="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def test_profile_flow(spark, tmp_dir):
    _write(f"{tmp_dir}/in/r.csv", "コード,価格,日付\nA1,100,2022/01/15\nA2,x,2022/01/16\nA3,300,2022/01/17\n", "cp932")
    res = flows.profile_report(spark, f"{tmp_dir}/in", f"{tmp_dir}/out")
    types = {r.COLUMN_ORIGIN_NAME: r.DATA_TYPE for r in res["schema"].collect()}
    assert types == {"コード": "STR", "価格": "INT", "日付": "DATE"}
    doc = json.loads(spark.read.text(f"{tmp_dir}/out/document").collect()[0][0])
    assert len(doc["schema"]) == 3
    assert [r.COLUMN_ORIGIN_NAME for r in res["low_consistency"].collect()] == ["価格"]


def test_pages_flow(spark, tmp_dir):
    html = ("<html><body><a class='btn' href='/a'>A</a><input type='button' value='B'>"
            "<input name='q' placeholder='Search'></body></html>")
    pages = spark.createDataFrame([(1, "https://x.example.com/", html)], "page_id long, url string, html string")
    res = flows.analyze_pages(spark, pages, f"{tmp_dir}/sel")
    names = sorted(r.name for r in res["selectors"].collect())
    # an element counts once per kind (the link matches two clickable
    # selectors), and the button input is listed as both kinds
    assert names == ["clickable_1", "clickable_2", "input_1", "input_2"]
    assert spark.read.option("header", True).csv(f"{tmp_dir}/sel/csv").count() == 4


def test_landing_flow(spark, tmp_dir):
    _write(f"{tmp_dir}/dl/old_report.csv", "day,traffic,n\n2024-01-01,all,1\n")
    before = rpt.list_files(spark, f"{tmp_dir}/dl")
    _write(f"{tmp_dir}/dl/new_report.csv", "day,traffic,n\n2024-01-19,organic,5\n2024-01-02,organic,6\n")
    _write(f"{tmp_dir}/dl/other.csv", "day,traffic,n\n2024-01-19,organic,7\n")
    _write(f"{tmp_dir}/dl/empty_report.csv", "day,traffic,n\n")
    res = flows.land_reports(spark, before, f"{tmp_dir}/dl", f"{tmp_dir}/landed", "2024-01-20", "20240120T000000",
                             pattern="report", date_column="day", start="2024-01-10", end="2024-01-20")
    rows = [(r["日付"], r.n) for r in res["rows"].collect()]
    assert rows == [("2024-01-19", "5")]
    out = res["outcome"].collect()[0]
    assert (out.total, out.success) == (2, 1)  # the header-only file has not landed


def test_profile_flow_over_several_files(spark, tmp_dir):
    _write(f"{tmp_dir}/in/x1.csv", "v,w\nzeta,1\n")
    _write(f"{tmp_dir}/in/x2.csv", "v,w\nalpha,2\nalpha,x\n")
    res = flows.profile_report(spark, f"{tmp_dir}/in", f"{tmp_dir}/out")
    assert {r.COLUMN_ORIGIN_NAME: r.SAMPLE_DATA for r in res["schema"].collect()} == {"v": "zeta", "w": "1"}
