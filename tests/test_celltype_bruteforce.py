"""T1 against a direct Python statement of the type rules on random cells
(hypothesis), and T2-T7 against a brute-force profile of small tables."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.celltype import cell_type
from quarry.operators import schema_infer as si

_DATE = re.compile(r"\d{4}[/-]\d{1,2}[/-]\d{1,2}")
_TS = re.compile(r"\d{4}[/-]\d{1,2}[/-]\d{1,2}[T\s]\d{1,2}:\d{1,2}")


def rule_type(v):
    """The documented rule order, evaluated with Python's own parsers."""
    if v is None or v == "":
        return "STR"
    s = v.strip()
    if s.lower() in ("true", "false", "0", "1", "yes", "no"):
        return "BOOLEAN"
    try:
        x = float(s.replace(",", ""))
    except ValueError:
        x = None
    if x is not None:
        return "INT" if x.is_integer() and "." not in s else "FLOAT"
    if _DATE.fullmatch(s):
        return "DATE"
    if _TS.match(s):
        return "TIMESTAMP"
    return "STR"


ALPHABET = list("0123456789,._-+eE /:Tabyesnotrufl ") + ["　", "\xa0", "\t", "１", "٣", "inf", "nan", "2022-01-0",
                                                            "\x85", "\x1c", "\x0b", "\x1f"]
cells = st.lists(st.sampled_from(ALPHABET), min_size=0, max_size=8).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cells, min_size=1, max_size=60))
def test_cell_type_matches_rules(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(cell_type(F.col("v"))).collect()]
    assert got == [rule_type(v) for v in values]


def brute_profile(rows, ncols):
    out = []
    for c in range(ncols):
        col = [r[c] for r in rows]
        counts, first = {}, {}
        for i, v in enumerate(col):
            t = rule_type(v)
            counts[t] = counts.get(t, 0) + 1
            first.setdefault(t, i)
        dom = max(counts, key=lambda t: (counts[t], -first[t])) if counts else "STR"
        bad = [v for v in col if not (v is None or v == "") and rule_type(v) != dom]
        rate = 1.0 - len(bad) / len(col) if col else 1.0
        sample = next((v for v in col if v is not None and v.strip() != ""), "")
        out.append((dom, rate, len(bad), bad[:10], sample))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), cells), st.one_of(st.none(), cells)), min_size=0, max_size=40))
def test_schema_table_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(rows)], "rn long, a string, b string")
    got = [(r.DATA_TYPE, r.CONSISTENCY_RATE, r.INCONSISTENT_COUNT, list(r.INCONSISTENT_SAMPLES), r.SAMPLE_DATA)
           for r in si.schema_table(df).collect()]
    want = brute_profile(rows, 2)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [round(g[1], 12) for g in got] == [round(w[1], 12) for w in want]
    assert [g[2:] for g in got] == [w[2:] for w in want]
