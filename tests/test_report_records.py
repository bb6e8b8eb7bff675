"""Quoted line breaks over splits, and one scan for many headers, against pandas."""

import os
import random

import pandas as pd
import pytest

from quarry.plans import flows
from quarry.sources import records as rec
from quarry.sources import reports as rpt


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that records cross them."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def by_pandas(path, encoding="utf-8", header_row=1):
    df = pd.read_csv(path, encoding=encoding, header=header_row - 1, dtype=str)
    return [tuple(None if x is None or x != x else x for x in r) for r in df.itertuples(index=False)]


def by_spark(spark, path, **kw):
    rows = rpt.read_report_csv(spark, path, **kw).drop("source_file").collect()
    got = sorted(tuple(r) for r in rows)
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    return [r[1:] for r in got]


@pytest.mark.parametrize("encoding", ["utf-8", "auto"])
def test_line_break_in_quotes(spark, tmp_dir, encoding):
    write(f"{tmp_dir}/q/a.csv", b'a,b\n1,"x\ny"\n2,z\n')
    assert by_spark(spark, f"{tmp_dir}/q", encoding=encoding) == [("1", "x\ny"), ("2", "z")]


def report(rng, n, newline):
    """A report whose cells hold separators, doubled quotes, blank lines, carriage returns and literal quotes."""
    cells = ["plain", "", "a,b", 'say ""hi""', "two\nlines", "three\n\n\nlines", "crlf\r\nin it", "日本", " spaced ", "line\n,\"\"\n,\n", "x" * 70, "1.5", "NA"]
    lines = ["id,note,more,last"]
    for i in range(n):
        row = [str(i)]
        for _ in range(3):
            c = rng.choice(cells)
            quoted = any(x in c for x in ',"\n\r') or rng.random() < 0.3
            row.append(f'"{c}"' if quoted else c)
        if rng.random() < 0.1:
            row[2] = 'inch 5" tall'  # a quote inside an unquoted field is a letter
        lines.append(",".join(row))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "  ", "\t"]))
    return newline.join(lines) + (newline if rng.random() < 0.5 else "")


@pytest.mark.parametrize("newline,encoding,seed", [("\n", "utf-8", 1), ("\r\n", "auto", 2), ("\n", "cp932", 3), ("\r", "utf-8", 4), ("\n", "auto", 5)])
def test_many_splits_equal_pandas(spark, tmp_dir, small_splits, newline, encoding, seed):
    rng = random.Random(seed)
    text = report(rng, 120, newline)
    real = "cp932" if encoding == "cp932" or seed == 5 else "utf-8"
    write(f"{tmp_dir}/p/a.csv", text.encode(real))
    assert len(text) > 2000
    assert by_spark(spark, f"{tmp_dir}/p", encoding=encoding) == by_pandas(f"{tmp_dir}/p/a.csv", real)


def test_header_over_lines_and_preamble(spark, tmp_dir, small_splits):
    data = b'junk "x\n\n"pre\namble",1\nid,"no\nte"\n1,"two\nlines"\n2,plain\n'
    write(f"{tmp_dir}/h/a.csv", data)
    df = rpt.read_report_csv(spark, f"{tmp_dir}/h", "utf-8", header_row=3)
    assert df.columns[2:] == ["id", "no\nte"]
    assert sorted(tuple(r)[2:] for r in df.collect()) == [("1", "two\nlines"), ("2", "plain")]


def test_unclosed_quote_is_an_error(spark, tmp_dir):
    write(f"{tmp_dir}/u/a.csv", b'a,b\n1,"x\n2,z\n')
    with pytest.raises(Exception, match="not closed"):
        rpt.read_report_csv(spark, f"{tmp_dir}/u", "utf-8").collect()
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(f"{tmp_dir}/u/a.csv")


def test_mixed_folder_of_whole_and_broken_lines(spark, tmp_dir, small_splits):
    rng = random.Random(9)
    want = []
    for i in range(6):
        text = "id,note\n" + "".join(f"{i}-{j},plain {j}\n" for j in range(40)) if i % 2 else report(rng, 30, "\n").replace("id,note,more,last", "id,note,more,last")
        write(f"{tmp_dir}/m/f{i}.csv", text.encode("cp932" if i % 3 == 0 else "utf-8"))
        want += [(f"f{i}.csv", n, *(r + (None, None))[:4]) for n, r in enumerate(by_pandas(f"{tmp_dir}/m/f{i}.csv", "cp932" if i % 3 == 0 else "utf-8"), 1)]
    df = rpt.read_report_csv(spark, f"{tmp_dir}/m", "auto")
    got = [(r.source_file.rsplit("/", 1)[1], r.rn, r.id, r.note, r.more, r["last"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_scan_however_many_headers(spark, tmp_dir):
    for i in range(12):
        cols = ["a", "b", f"c{i % 6}"][:: 1 if i % 2 else -1]
        write(f"{tmp_dir}/s/f{i}.csv", (",".join(cols) + "\n" + "".join(",".join(f"{c}{j}" for c in cols) + "\n" for j in range(3))).encode())
    df = rpt.read_report_csv(spark, f"{tmp_dir}/s", "utf-8")
    assert df.count() == 36 and set(df.columns) == {"rn", "source_file", "a", "b", *[f"c{i}" for i in range(6)]}
    for r in df.collect():
        assert r.a == f"a{r.rn - 1}" and sum(r[f"c{i}"] is not None for i in range(6)) == 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1, plan


def test_leaves_open(spark):
    lines = ['a,b', '1,"x', '"', '""', '"""', 'a"b', 'a,"b""', 'a,"b"x"', ',"', '"a","b', 'x",', '', '"a"b,"', "日\",\"", '""""""']

    def model(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closing" if c == '"' else state
            elif state == "closing":
                state = {'"': "quoted", ",": "start"}.get(c, "field")
            elif c == '"' and state == "start":
                state = "quoted"
            else:
                state = "start" if c == "," else "field"
        return state == "quoted"
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for inside in (False, True):
        got = {r.line: r.o for r in df.withColumn("o", rec.leaves_open(df.line, ",", inside)).collect()}
        assert got == {x: model(x, inside) for x in lines}


def test_order_rows_over_many_files(spark, tmp_dir):
    for i in range(30):
        write(f"{tmp_dir}/o/f{i:02d}.csv", ("a\n" + "".join(f"{i}-{j}\n" for j in range(i % 4))).encode())
    df = rpt.order_rows(rpt.read_report_csv(spark, f"{tmp_dir}/o", "utf-8"))
    got = [r.a for r in sorted(df.collect(), key=lambda r: r.rn)]
    assert got == [f"{i}-{j}" for i in range(30) for j in range(i % 4)]
    assert sorted(r.rn for r in df.collect()) == list(range(1, len(got) + 1))


def test_profile_report_with_line_breaks(spark, tmp_dir):
    write(f"{tmp_dir}/f/a.csv", b'id,note\n1,"x\ny"\n2,z\n3,w\n')
    out = flows.profile_report(spark, f"{tmp_dir}/f", f"{tmp_dir}/doc")
    got = {r.COLUMN_ORIGIN_NAME: r.SAMPLE_DATA for r in out["schema"].collect()}
    assert got["note"] == "x\ny"
