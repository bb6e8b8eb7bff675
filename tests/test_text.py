"""Sensitive scan parity with Python re, text structuring."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import textscan as sc

SECRET_TEXT = (
    "# settings\n"
    "api_key = \"abcdefghijklmnop1234\"\n"
    "password: 'hunter2pass'\n"
    "mail someone.name@example.org today\n"
    "id 123-45-6789 card 1234-5678-9012-3456\n"
    "Authorization: \"Bearer abcdefghij12345\"\n"
    "-----BEGIN CERTIFICATE-----\n"
    "access_key =\n  \"ABCDEFGHIJKLMNOPQRST\"\n"
)


def _python_scan(text):
    out = []
    for pid, (cat, p) in enumerate(sc.PATTERNS):
        for m in re.finditer(p, text, re.IGNORECASE):
            line = text[:m.start()].count("\n") + 1
            out.append((pid, cat, line, m.group(0), text.split("\n")[line - 1]))
    return sorted(out)


def test_scan_matches_python(spark):
    rng = random.Random(7)
    words = ["api_key=", "\"", "password", ":", "'", "x" * 17, "ABCDEF1234567890ab", "\n", " ", "bearer",
             "a.b@c.io", "123-45-6789", "-----BEGIN RSA PRIVATE KEY-----", "é", "Ａ", "sk-" + "a" * 48, "pwd=xyz'"]
    docs = [(0, SECRET_TEXT)] + [(i, "".join(rng.choice(words) for _ in range(60))) for i in range(1, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.pattern_id, r.type, r.line, r.match, r.context)
                 for r in sc.sensitive_scan(df).collect())
    want = sorted((d, *x) for d, t in docs for x in _python_scan(t))
    assert got == want
    summ = {r.doc_id: r for r in sc.sensitive_summary(df).collect()}
    assert not summ[0].safe and summ[0].n_issues == sum(1 for x in want if x[0] == 0)


def test_list_items_and_sections(spark):
    df = spark.createDataFrame([("- a\n* b\n1. c\nplain",), ("para one\n\n  para two  \n\n",)], "t string")
    items = [r[0] for r in df.select(tx.list_items(F.col("t"))).collect()]
    assert items == [["a", "b", "c"], ["para one", "para two"]]
    sec = spark.createDataFrame([("## Summary\nfine\n## Risks\n- r1\n- r2\n## Ideas\n1. s1",)], "t string")
    r = sec.select(tx.section_parts(F.col("t")).alias("s")).collect()[0].s
    # as with re.split, the numbered line starts a section of its own
    assert r.summary == "Summary\nfine" and r.risks == ["r1", "r2"] and r.suggestions == ["Ideas"]


def test_code_slug_url_clean(spark):
    df = spark.createDataFrame([
        ("intro\n```python\nprint(1)\n```\nafter", "Add user login feature now", "https://github.com/o/r/pull/12",
         "\"コミットメッセージ: fix bug`")], "t string, d string, u string, m string")
    r = df.select(tx.code_block(F.col("t")).alias("c"), tx.outside_code(F.col("t")).alias("e"),
                  tx.file_slug(F.col("d"), F.lit("Python")).alias("f"), tx.review_url(F.col("u")).alias("u"),
                  tx.clean_message(F.col("m")).alias("m")).collect()[0]
    assert r.c == "print(1)\n" and r.e == "intro\n\nafter"
    assert r.f == "add_user_login_feature_now.py"
    assert (r.u.owner, r.u.repo, r.u.number, r.u.error) == ("o", "r", "12", None)
    assert r.m == "fix bug"


def test_scan_context_crlf(spark):
    text = "first\r\npassword: 'abc123'\r\nlast\r\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sc.sensitive_scan(df).collect()
    assert [(r.line, r.context) for r in rows] == [(2, text.splitlines()[1])]


def test_sensitive_scan_null_and_repeated_keys(spark):
    """Findings stay with their own row: a null key is scanned, and two texts under one id don't mix."""
    rows = [(None, "password: 'abcdef' "), (1, "x\npassword: 'first1' "), (1, "a\nb\r\npassword: 'second2' \r\nz"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.line, r.context) for r in sc.sensitive_scan(df).collect()), key=str)
    assert got == sorted([(None, 1, "password: 'abcdef' "), (1, 2, "password: 'first1' "), (1, 3, "password: 'second2' ")], key=str)
    summary = sorted(((r.doc_id, r.n_issues, r.safe) for r in sc.sensitive_summary(df).collect()), key=str)
    assert summary == sorted([(None, 1, False), (1, 1, False), (1, 1, False), (2, 0, True), (3, 0, True)], key=str)


def test_sensitive_scan_many_matches_and_marker_characters(spark):
    text = "\ue000\n".join(f"password: 'value{i}' " for i in range(500))
    got = [(r.line, r.match) for r in sc.sensitive_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert sorted(n for n, _ in got) == list(range(1, 501))
    assert all(f"value{n - 1}'" in m for n, m in got)


def test_plan_of_the_schema_table(spark, tmp_dir):
    """No job runs while the plan is built, and the executed plan reads the table twice."""
    from quarry.operators import schema_infer as si
    spark.createDataFrame([(i, str(i % 7), "x" if i % 3 else "2024-01-01") for i in range(500)], "rn long, a string, b string") \
        .write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-build", "schema table")
    table = si.schema_table(df)
    assert list(tracker.getJobIdsForGroup("plan-build")) == []
    table.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan parquet") <= 2
