"""T1-T7 against the pinned and derived cases of the fixture notes."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.celltype import cell_type
from quarry.operators import schema_infer as si

CASES = [
    ("0", "BOOLEAN"), ("YES", "BOOLEAN"), ("1,234", "INT"), ("1,2,3", "INT"), ("1e5", "INT"),
    ("1e-5", "FLOAT"), ("1.0", "FLOAT"), ("-0", "INT"), ("inf", "FLOAT"), ("1_000", "INT"), ("1d", "STR"),
    ("2022-99-99", "DATE"), ("2022-1-2T3:4", "TIMESTAMP"), ("2022-01-01 10:00 JST", "TIMESTAMP"),
    ("2022.02.20", "STR"), ("   ", "STR"), (None, "STR"), ("", "STR"), ("１２３", "INT"), ("1e400", "FLOAT"),
    ("2022/01/15", "DATE"), ("2022/05/01 09:30", "TIMESTAMP"), ("true", "BOOLEAN"), (" no ", "BOOLEAN"),
    ("1.", "FLOAT"), (".5", "FLOAT"), ("nan", "FLOAT"), ("20e-1", "INT"), ("25e-1", "FLOAT"), ("1__0", "STR"),
]


def test_cell_type_cases(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES], "v string")
    got = [r[0] for r in df.select(cell_type(F.col("v"))).collect()]
    assert got == [t for _, t in CASES]


def _schema(spark, header, rows):
    data = [(i + 1, *r) for i, r in enumerate(rows)]
    ddl = "rn long, " + ", ".join(f"`{h}` string" for h in header)
    df = spark.createDataFrame(data, ddl)
    return {r["COLUMN_ORIGIN_NAME"]: r for r in si.schema_table(df).collect()}


def test_typed_csv_cp932_table(spark):
    header = ["ID", "名前", "年齢", "入社日", "更新日時", "有効フラグ"]
    rows = [(str(i), n, str(a), d, ts, f) for i, n, a, d, ts, f in [
        (1, "山田太郎", 25, "2020-04-01", "2022-05-15 10:30:00", "true"),
        (2, "佐藤花子", 31, "2019-10-01", "2022-05-16 11:00:00", "false"),
        (3, "鈴木一郎", 45, "2015-04-01", "2022-05-17 09:15:00", "true"),
        (4, "田中美咲", 28, "2021-07-01", "2022-05-18 14:45:00", "true"),
        (5, "伊藤健太", 38, "2018-01-15", "2022-05-19 16:20:00", "false")]]
    s = _schema(spark, header, rows)
    assert [s[h]["DATA_TYPE"] for h in header] == ["INT", "STR", "INT", "DATE", "TIMESTAMP", "BOOLEAN"]
    assert s["ID"]["CONSISTENCY_RATE"] == pytest.approx(0.8)
    assert s["ID"]["INCONSISTENT_SAMPLES"] == ["1"]


def test_edge_cases(spark):
    header = ["空列", "数値と文字混在", "特殊日付", "空と数値", "真偽値混在"]
    rows = [(None, "1", "2022年01月15日", "", "はい"), (None, "2", "2022.02.20", "10", "いいえ"),
            (None, "三", "22/3/25", None, "1"), (None, "4", "2022-4-10", "20", "0"),
            (None, "五", "05/05/2022", "", "true")]
    s = _schema(spark, header, rows)
    assert s["空列"]["DATA_TYPE"] == "STR" and s["空列"]["CONSISTENCY_RATE"] == 1.0
    assert s["数値と文字混在"]["DATA_TYPE"] == "INT"
    assert s["数値と文字混在"]["CONSISTENCY_RATE"] == pytest.approx(0.4)
    assert s["特殊日付"]["DATA_TYPE"] == "STR" and s["特殊日付"]["CONSISTENCY_RATE"] == pytest.approx(0.8)
    assert s["空と数値"]["DATA_TYPE"] == "STR" and s["空と数値"]["CONSISTENCY_RATE"] == pytest.approx(0.6)
    assert s["真偽値混在"]["DATA_TYPE"] == "BOOLEAN" and s["真偽値混在"]["CONSISTENCY_RATE"] == pytest.approx(0.6)


def test_headers_only(spark):
    s = _schema(spark, ["a", "b", "c"], [])
    assert {r["DATA_TYPE"] for r in s.values()} == {"STR"}
    assert all(r["CONSISTENCY_RATE"] == 1.0 and r["SAMPLE_DATA"] == "" for r in s.values())


def test_table_profile_and_census(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "2", "y"), (3, "z", "3")], "rn long, a string, b string")
    prof = si.table_profile(df).collect()[0]
    assert (prof.header_count, prof.record_count) == (2, 3)
    census = {r.DATA_TYPE: r.n_columns for r in si.type_census(si.schema_table(df)).collect()}
    assert census == {"BOOLEAN": 1, "STR": 1}


def test_capped_samples_on_a_hot_column(spark):
    # 600 rows: INT dominates (every 5th row), STR and FLOAT spread across
    # all salt buckets; the first 10 bad cells in row order must come back
    rows = []
    for i in range(1, 601):
        v = str(i) if i % 5 == 0 or i % 5 == 1 or i % 5 == 2 else (f"x{i}" if i % 2 else f"{i}.5")
        rows.append((i, v))
    df = spark.createDataFrame(rows, "rn long, v string")
    r = si.schema_table(df).collect()[0]
    bad = [v for _, v in rows if not v.isdigit() or v in ("0", "1")]
    assert r.DATA_TYPE == "INT"
    assert r.INCONSISTENT_COUNT == len(bad)
    assert list(r.INCONSISTENT_SAMPLES) == bad[:10]
    assert [x.value for x in si.inconsistent_cells(df, cap=10).orderBy("rn").collect()] == bad[:10]
