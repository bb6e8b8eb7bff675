"""Cells as pandas hands them on, and the schema table over them."""

import io
import random

import pandas as pd
import pytest

from quarry.operators import schema_infer as si
from quarry.operators.coerce import as_pandas
from quarry.sources import reports as rpt

NUMBERS = ["10", "0", "-3", "+7", "007", "123456789012"]
DECIMALS = ["1.5", ".5", "2.", "1e5", "1E-7", "12345678.25", "0.0001", "0.00012", "1e16", "1.5e300", "-0.0", "123456789.125"]


def columns():
    rng = random.Random(2)
    out = {}
    for k in range(14):
        pool = [NUMBERS, NUMBERS + [""], NUMBERS + DECIMALS, DECIMALS + ["", "NA"], NUMBERS + ["x"], NUMBERS + ["1_000"], ["", "NA"]][k % 7]
        out[f"c{k}"] = [rng.choice(pool) for _ in range(40)]
    return out


def test_cells_equal_pandas(spark, tmp_dir):
    cols = columns()
    text = ",".join(cols) + "\n" + "".join(",".join(r) + "\n" for r in zip(*cols.values()))
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write(text)
    df = rpt.read_report_csv(spark, f"{tmp_dir}/a.csv").drop("source_file")
    got = sorted(tuple(r) for r in as_pandas(df).collect())
    want = pd.read_csv(io.StringIO(text))
    for n, (g, w) in enumerate(zip(got, want.values.tolist()), 1):
        # mixed columns keep each cell as it is in the frame
        assert g == (n, *[None if x != x else str(x) for x in w])
    # blanks make whole numbers floats
    table = {r.COLUMN_ORIGIN_NAME: (r.DATA_TYPE, r.SAMPLE_DATA) for r in si.schema_table(df, coerce="pandas").collect()}
    assert table["c1"][0] == "FLOAT" and table["c1"][1].endswith(".0")
    assert {r.COLUMN_ORIGIN_NAME: r.DATA_TYPE for r in si.schema_table(df).collect()}["c1"] != "FLOAT"


def test_other_names_raise(spark):
    with pytest.raises(ValueError):
        si.schema_table(spark.createDataFrame([(1, "a")], "rn long, a string"), coerce="polars")
