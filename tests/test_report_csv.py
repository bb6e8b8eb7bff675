"""Report CSV with header on line 2, encodings, row numbers."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import schema_infer as si
from quarry.sources import reports as rpt


def _write(path, text, enc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def _decodes(data, encoding):
    try:
        data.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def test_header_on_line_two(spark, tmp_dir):
    _write(f"{tmp_dir}/r/a.csv", "dummy1,dummy2,dummy3\nID,Name,Age\n1,Alice,30\n2,Bob,25\n", "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/r", "utf-8", header_row=2)
    assert df.columns[2:] == ["ID", "Name", "Age"]
    rows = df.orderBy("rn").select("rn", "ID", "Name").collect()
    assert [tuple(r) for r in rows] == [(1, "1", "Alice"), (2, "2", "Bob")]
    s = {r.COLUMN_ORIGIN_NAME: r for r in si.schema_table(df.drop("source_file")).collect()}
    assert s["ID"].DATA_TYPE == "BOOLEAN" and s["ID"].CONSISTENCY_RATE == 0.5
    assert s["ID"].INCONSISTENT_SAMPLES == ["2"] and s["ID"].SAMPLE_DATA == "1"
    assert s["Name"].DATA_TYPE == "STR" and s["Age"].DATA_TYPE == "INT" and s["Age"].SAMPLE_DATA == "30"


def test_cp932_and_detection(spark, tmp_dir):
    text = "コード,商品名,価格\nA001,商品A,1000\nA002,商品B,\n"
    _write(f"{tmp_dir}/c/x.csv", text, "cp932")
    _write(f"{tmp_dir}/u/x.csv", text, "utf-8")
    _write(f"{tmp_dir}/e/x.csv", text, "euc_jp")
    _write(f"{tmp_dir}/z/x.csv", "", "utf-8")
    enc = {os.path.basename(os.path.dirname(r.path)): r.encoding
           for r in rpt.file_encoding(spark, tmp_dir + "/*/x.csv").collect()}
    assert enc["c"] == "cp932" and enc["u"] == "utf-8"
    assert "z" not in enc  # zero-byte files are not listed by Spark's file sources
    # the trial decoding of utf-8, cp932, euc_jp in this order, on the whole text
    trial = next(e for e in ("cp932", "euc_jp") if _decodes(text.encode("euc_jp"), e))
    assert enc["e"] == trial
    df = rpt.read_report_csv(spark, f"{tmp_dir}/c", "cp932")
    assert df.columns[2:] == ["コード", "商品名", "価格"]
    assert df.filter(F.col("rn") == 2).select("価格").collect()[0][0] is None


def test_rows_numbered_across_files(spark, tmp_dir):
    for i in range(3):
        _write(f"{tmp_dir}/m/f{i}.csv", "a,b\n" + "".join(f"{i},{j}\n" for j in range(50)), "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/m", "utf-8")
    bad = df.filter(F.col("rn") != F.col("b").cast("int") + 1).count()
    assert df.count() == 150 and bad == 0


def test_latest_and_new_files(spark, tmp_dir):
    import time
    _write(f"{tmp_dir}/d/old.csv", "x\n1\n", "utf-8")
    time.sleep(1.1)
    _write(f"{tmp_dir}/d/new.csv", "", "utf-8")
    _write(f"{tmp_dir}/d/partial.csv.crdownload", "x\n", "utf-8")
    listing = rpt.list_files(spark, f"{tmp_dir}/d")
    latest = rpt.latest_file(listing, extensions=[".csv"]).collect()
    assert [r.name for r in latest] == ["old.csv"]  # newest is empty -> second newest
    _write(f"{tmp_dir}/d/NEW_report.csv", "x\n2\n", "utf-8")
    after = rpt.list_files(spark, f"{tmp_dir}/d")
    fresh = rpt.new_files(listing, after, pattern="new").collect()
    assert [r.name for r in fresh] == ["NEW_report.csv"]


def test_auto_encoding_mixed_folder(spark, tmp_dir):
    _write(f"{tmp_dir}/mix/a.csv", "名前,値\n山田,1\n", "cp932")
    _write(f"{tmp_dir}/mix/b.csv", "名前,値\n佐藤,2\n", "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/mix", encoding="auto")
    assert sorted((r["名前"], r["値"]) for r in df.collect()) == [("佐藤", "2"), ("山田", "1")]


def test_multiline_quoted_fields(spark, tmp_dir):
    _write(f"{tmp_dir}/ml/a.csv", 'junk\nid,note\n1,"two\nlines"\n2,plain\n', "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/ml", "utf-8", header_row=2)
    rows = [(r.rn, r.id, r.note) for r in df.orderBy("rn").collect()]
    assert rows == [(1, "1", "two\nlines"), (2, "2", "plain")]


def test_late_bytes_of_another_encoding(spark, tmp_dir):
    rows = "".join(f"{i},plain\n" for i in range(20)) + "20,商品\n"
    _write(f"{tmp_dir}/late/a.csv", "id,name\n" + rows, "cp932")
    got = {r.id: r.name for r in rpt.read_report_csv(spark, f"{tmp_dir}/late", "auto").collect()}
    assert got["20"] == "商品" and len(got) == 21
    labels = [r.encoding for r in rpt.file_encoding(spark, f"{tmp_dir}/late").collect()]
    assert labels == ["utf-8"]  # the sample is ASCII
    assert [r.encoding for r in rpt.file_encoding(spark, f"{tmp_dir}/late", sample_lines=None).collect()] == ["cp932"]


def test_long_first_line_is_not_cut_inside_a_character(spark, tmp_dir):
    _write(f"{tmp_dir}/long/a.csv", "あ" * 30000 + ",b\n1,2\n", "utf-8")
    assert [r.encoding for r in rpt.file_encoding(spark, f"{tmp_dir}/long").collect()] == ["utf-8"]


def test_every_file_by_its_own_header(spark, tmp_dir):
    _write(f"{tmp_dir}/h/1.csv", "a,b\n1,2\n", "utf-8")
    _write(f"{tmp_dir}/h/2.csv", "b,a,c\n3,4,5\n", "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/h", "utf-8")
    assert sorted((r.a, r.b, r.c) for r in df.collect()) == [("1", "2", None), ("4", "3", "5")]


def test_repeated_names_and_extra_fields(spark, tmp_dir):
    _write(f"{tmp_dir}/r/1.csv", "a,a,\n1,2,3\n", "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/r", "utf-8")
    assert df.columns[2:] == ["a", "a.1", "Unnamed: 2"]
    assert [tuple(r)[2:] for r in df.collect()] == [("1", "2", "3")]
    _write(f"{tmp_dir}/x/1.csv", "a,b\n1,2,3\n", "utf-8")
    with pytest.raises(Exception, match="expected 2 fields"):
        rpt.read_report_csv(spark, f"{tmp_dir}/x", "utf-8").collect()


def test_multiline_through_auto(spark, tmp_dir):
    _write(f"{tmp_dir}/ma/a.csv", '名,note\n一,"two\nlines"\n', "cp932")
    _write(f"{tmp_dir}/ma/b.csv", '名,note\n二,plain\n', "utf-8")
    df = rpt.read_report_csv(spark, f"{tmp_dir}/ma", "auto")
    assert sorted((r["名"], r.note) for r in df.collect()) == [("一", "two\nlines"), ("二", "plain")]


def test_new_files_by_path(spark, tmp_dir):
    _write(f"{tmp_dir}/n/a/report.csv", "x\n1\n", "utf-8")
    before = rpt.list_files(spark, f"{tmp_dir}/n")
    _write(f"{tmp_dir}/n/b/report.csv", "x\n2\n", "utf-8")
    assert [r.dir.rsplit("/", 1)[1] for r in rpt.new_files(before, rpt.list_files(spark, f"{tmp_dir}/n")).collect()] == ["b"]
