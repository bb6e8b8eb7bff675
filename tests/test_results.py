"""S4, A1-A6 on mixed result values and both document layouts."""

from quarry.operators import results as rs
from quarry.sources.results_json import parse_result_documents

NESTED = ('{"test_timestamp": "t", "category": "CSV", "test_file": "tests/test_file/file/test_csv.py", '
          '"results": {"a::test_one": {"passed": true, "description": "d1", "execution_time": 1.5}, '
          '"a::test_two": {"passed": false}, "b": true, "c": 0, "d": 1.5, "e": "x"}}')
FLAT = '{"test_timestamp": "t", "category": "Flat", "f::test_three": {"passed": true, "execution_time": 3.0}}'
LATER = '{"results": {"b": false}}'


def test_results_roundtrip(spark):
    docs = spark.createDataFrame([("p1", 1, NESTED), ("p2", 2, FLAT), ("p3", 3, LATER)],
                                 "path string, file_order long, content string")
    res = rs.normalize_results(parse_result_documents(docs))
    got = {r.test_key: r for r in res.collect()}
    assert got["a::test_one"].status == "PASS" and got["a::test_one"].category == "CSV"
    assert got["a::test_one"].source_file == "src/file/csv.py" and got["a::test_one"].method == "a::test_one"
    assert got["a::test_two"].status == "FAIL"
    assert got["b"].status == "FAIL"  # later document wins
    assert got["c"].status == "FAIL" and got["d"].status == "PASS" and got["e"].status == "ERROR"
    assert got["f::test_three"].category == "Flat"
    st = rs.pass_stats(res).collect()[0]
    assert (st.total, st.passed, st.failed) == (7, 3, 4)
    t = rs.timing_stats(res).collect()[0]
    assert t.longest_test == "f::test_three" and t.max_time == 3.0
    lst = {r.test_key: r.display_name for r in rs.summary_listing(res).collect()}
    assert lst["a::test_one"] == "a > test_one"


def test_outcome_rules(spark):
    df = spark.createDataFrame([(True,), (False,)], "success boolean")
    assert rs.outcome_summary(df, rule="batch").collect()[0].ok is False
    assert rs.outcome_summary(df, rule="report").collect()[0].ok is True
    empty = spark.createDataFrame([], "success boolean")
    r = rs.pass_stats(empty.withColumnRenamed("success", "passed")).collect()[0]
    assert (r.total, r.pass_rate) == (0, 0.0)


def test_read_result_files(spark, tmp_path):
    import os
    import time
    from quarry.sources.results_json import read_result_files
    d = tmp_path / "results"
    os.makedirs(d / "report_20240101")
    (d / "test_csv_results.json").write_text('{"category": "C", "results": {"t1": {"passed": false}}}')
    time.sleep(1.1)
    (d / "test_more_results.json").write_text('{"results": {"t1": {"passed": true}, "t2": true}}')
    (d / "report_20240101" / "test_old_results.json").write_text('{"results": {"t3": true}}')
    (d / "other.json").write_text('{"results": {"t4": true}}')
    docs = read_result_files(spark, str(d))
    res = {r.test_key: r for r in rs.normalize_results(parse_result_documents(docs)).collect()}
    assert set(res) == {"t1", "t2"}
    assert res["t1"].status == "PASS"  # the later file wins


def test_category_rollup_and_detail(spark):
    docs = spark.createDataFrame([("p1", 1, NESTED), ("p2", 2, FLAT)], "path string, file_order long, content string")
    res = rs.normalize_results(parse_result_documents(docs))
    roll = {r.category: (r.n_passed, r.n_total) for r in rs.category_rollup(res).collect()}
    assert roll["CSV"] == (1, 2) and roll["Flat"] == (1, 1) and roll["その他"] == (2, 4)
    detail = [(r.category, r.test_key) for r in rs.category_detail(res).collect()]
    assert ("CSV", "a::test_one") in detail and all(c != "CSV" or k != "a::test_two" for c, k in detail)


def test_result_files_of_several_lines(spark, tmp_dir):
    """A file is one document, however many lines it has; files in report folders are skipped."""
    import json
    import os

    from quarry.sources.results_json import parse_result_documents, read_result_files
    for folder, name in (("a", "t1"), ("report_1", "t2")):
        os.makedirs(f"{tmp_dir}/{folder}")
        with open(f"{tmp_dir}/{folder}/test_x_results.json", "w") as f:
            json.dump({"test_file": "tests/test_file/x/test_x.py", "results": {name: {"passed": True}}}, f, indent=2)
    files = read_result_files(spark, tmp_dir)
    assert files.count() == 1
    assert [r.test_key for r in parse_result_documents(files).collect()] == ["t1"]
