"""ST1: each landed file is processed once; ST2: change rows."""

import os

from pyspark.sql import types as T

from quarry.streaming.arrivals import arrivals, land_arrivals


def test_arrivals_once(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    with open(f"{src}/r1.csv", "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    with open(f"{src}/r1.csv.crdownload", "w") as f:
        f.write("a,b\n9,z\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    sink, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    land_arrivals(arrivals(spark, src, schema, run_date="2024-03-02"), sink, ck).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    with open(f"{src}/r2.csv", "w") as f:
        f.write("a,b\n3,z\n")
    land_arrivals(arrivals(spark, src, schema, run_date="2024-03-02"), sink, ck).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 3 and {r[0] for r in out.select("日付").collect()} == {"2024-03-01"}


def test_arrivals_cp932(spark, tmp_dir):
    src = f"{tmp_dir}/in932"
    os.makedirs(src)
    with open(f"{src}/r.csv", "wb") as f:
        f.write("名前,値\n山田,1\n".encode("cp932"))
    schema = T.StructType([T.StructField("名前", T.StringType()), T.StructField("値", T.StringType())])
    sink = f"{tmp_dir}/out932"
    land_arrivals(arrivals(spark, src, schema, encoding="cp932"), sink, sink + "-ck").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(sink).select("名前", "値").collect()] == [("山田", "1")]
