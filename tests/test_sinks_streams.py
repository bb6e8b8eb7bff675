"""S7/S8/S9 sinks and the ST2 page-change stream."""

import json
import os

import pytest

from pyspark.sql import functions as F

from quarry.operators import schema_infer as si
from quarry.sources import reports as rpt
from quarry.sources import sinks as sk
from quarry.streaming.page_changes import page_change_stream, stream_metrics


def test_schema_document_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "5", "x"), (2, "a", "y"), (3, "3", "z")], "rn long, n string, s string")
    schema = si.schema_table(df)
    sk.write_schema_document(schema, si.inconsistent_cells(df), f"{tmp_dir}/doc")
    text = spark.read.text(f"{tmp_dir}/doc/document").collect()[0][0]
    doc = json.loads(text)
    assert [c["COLUMN_ORIGIN_NAME"] for c in doc["schema"]] == ["n", "s"]
    assert doc["schema"][0]["INCONSISTENT_SAMPLES"] == ["a"]
    assert doc["consistency_results"][0]["inconsistent_count"] == 1
    cells = spark.read.json(f"{tmp_dir}/doc/inconsistent_cells").collect()
    assert [(r.column_name, r.row, r.value) for r in cells] == [("n", 2, "a")]


def test_selector_export(spark, tmp_dir):
    rows = [("g", "clickable_1", "t\nx", "", "", "#a", '//a[@x=\\"1\\"]', "//*/a", "k", "c", {"track_id": "1"}),
            ("g", "input_1", "v", "", "", "#b", "//b", "//*/b", "k", "c", {"zz": "2"})]
    df = spark.createDataFrame(rows, "group string, name string, text_value string, id string, class string, "
                                     "css string, xpath string, full_xpath string, element_type string, "
                                     "category string, data map<string,string>")
    sk.write_selector_exports(df, f"{tmp_dir}/sel")
    out = spark.read.option("header", True).csv(f"{tmp_dir}/sel/csv").orderBy("name").collect()
    assert out[0].text_value == "t x" and out[0].xpath == '//a[@x="1"]'
    assert out[0].track_id == "1" and out[1].zz == "2"
    raw = open([f"{tmp_dir}/sel/csv/{f}" for f in os.listdir(f"{tmp_dir}/sel/csv") if f.endswith(".csv")][0]).read()
    assert raw.startswith('"group"')


def test_snapshots_keep_previous(spark, tmp_dir):
    root = f"{tmp_dir}/snap"
    rpt.write_snapshot(spark.createDataFrame([(1,)], "a int"), root, "20240101T000000")
    rpt.write_snapshot(spark.createDataFrame([(2,), (3,)], "a int"), root, "20240102T000000")
    latest = rpt.latest_snapshot(spark, root)
    assert sorted(r.a for r in latest.collect()) == [2, 3]
    assert spark.read.parquet(root).count() == 3
    name = spark.range(1).select(rpt.report_target_name(F.lit("cv_attribute"), "2024-05-06").alias("n")).collect()
    assert name[0].n == "20240506_ebis_conversion_attribute.csv"


def test_page_change_stream(spark, tmp_dir):
    src = f"{tmp_dir}/snaps"
    base = "<html><body><p>hello world</p></body></html>"
    more = "<html><body><p>hello world</p>" + "<i>x</i>" * 7 + "</body></html>"
    spark.createDataFrame([("u1", 1, base), ("u2", 1, base)], "url string, snapshot long, html string") \
        .write.parquet(f"{src}/a")
    spark.createDataFrame([("u1", 2, base), ("u2", 2, more)], "url string, snapshot long, html string") \
        .write.parquet(f"{src}/b")
    schema = spark.read.parquet(f"{src}/a").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    sink = f"{tmp_dir}/changes"
    q = (page_change_stream(stream_metrics(stream)).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", sink + "-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {(r.url, r.snapshot): r for r in spark.read.parquet(sink).collect()}
    assert rows[("u1", 1)].first_seen and rows[("u2", 1)].first_seen
    assert ("u1", 2) not in rows  # unchanged page emits nothing
    assert rows[("u2", 2)].changed and rows[("u2", 2)].d_elements == 7


def test_snapshot_rerun_is_idempotent(spark, tmp_dir):
    root = f"{tmp_dir}/snap2"
    rpt.write_snapshot(spark.createDataFrame([(1,)], "a int"), root, "s1")
    rpt.write_snapshot(spark.createDataFrame([(2,)], "a int"), root, "s2")
    rpt.write_snapshot(spark.createDataFrame([(2,)], "a int"), root, "s2")  # re-run of a landing
    assert sorted((r.snapshot_ts, r.a) for r in spark.read.parquet(root).collect()) == [("s1", 1), ("s2", 2)]


def test_many_data_attributes_stay_in_one_column(spark):
    rows = [("g", f"n{i}", {f"k{i}": str(i), f"m{i}": "x\ny"}) for i in range(4)]
    df = spark.createDataFrame(rows, "group string, name string, data map<string,string>")
    for c in sk.SELECTOR_CSV_COLUMNS[2:]:
        df = df.withColumn(c, F.lit(""))
    out = sk.selector_csv_frame(df, max_columns=3)
    assert out.columns[len(sk.SELECTOR_CSV_COLUMNS):] == ["k0", "k1", "k2", "data_other"]
    got = {r.name: (r.k0, r.k1, r.k2, json.loads(r.data_other)) for r in out.collect()}
    assert got["n1"] == ("", "1", "", {"m1": "x\ny"}) and got["n3"] == ("", "", "", {"k3": "3", "m3": "x\ny"})
    assert sk.selector_csv_frame(df).columns[-1] == "m3"


def test_page_change_order_over_batches():
    """Rows of one url that arrive in several Arrow batches, out of order, with a late old snapshot."""
    import pandas as pd

    from quarry.streaming.page_changes import _track

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def batch(*rows):
        return pd.DataFrame(rows, columns=["snapshot", "hash", "n_elements", "text_len"])
    state = State()
    out = pd.concat(_track(("u",), iter([batch((3, "c", 1, 1)), batch((1, "a", 1, 1), (2, "a", 1, 1))]), state))
    assert out[["snapshot", "changed", "first_seen"]].values.tolist() == [[1, True, True], [2, False, False], [3, True, False]]
    late = pd.concat(_track(("u",), iter([batch((2, "z", 9, 9), (4, "c", 1, 1))]), state))
    assert late[["snapshot", "changed"]].values.tolist() == [[4, False]] and state.get[3] == 4


def test_snapshots_of_one_url_beyond_memory(monkeypatch):
    """Sorted runs and their merge give what one sort gives, however the rows arrive."""
    import random

    import pandas as pd

    from quarry.streaming import page_changes as pc

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value
    rng = random.Random(1)
    rows = [(s, rng.choice("abc"), rng.randint(0, 30), rng.randint(0, 90)) for s in rng.sample(range(1000), 700)]
    frames = [pd.DataFrame(rows[at:at + 90], columns=["snapshot", "hash", "n_elements", "text_len"]) for at in range(0, 700, 90)]
    whole = pd.concat(pc._track(("u",), iter(frames), State()))
    monkeypatch.setattr(pc, "RUN_ROWS", 64)
    monkeypatch.setattr(pc, "OUT_ROWS", 50)
    parts = list(pc._track(("u",), iter(frames), State()))
    assert len(parts) == 15 and max(map(len, parts)) == 50
    assert pd.concat(parts).values.tolist() == whole.values.tolist() and whole.snapshot.is_monotonic_increasing


def test_state_of_dead_urls_expires(spark, tmp_dir):
    """After its time a url's state is gone: the next snapshot is seen as the first."""
    import time

    from pyspark.sql import functions as F
    schema = "url string, snapshot long, hash string, n_elements long, text_len long"
    src, sink = f"{tmp_dir}/m", f"{tmp_dir}/out"

    def run(rows, expire):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = (page_change_stream(stream, emit_unchanged=True, expire_after_ms=expire).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", sink + "-ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return {(r.url, r.snapshot): r.first_seen for r in spark.read.parquet(sink).select("*", F.lit(1)).collect()}
    assert run([("u", 1, "a", 1, 1), (None, 1, "a", 1, 1)], 1500) == {("u", 1): True, (None, 1): True}
    time.sleep(2)
    assert run([("u", 2, "a", 1, 1)], 1500)[("u", 2)]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_streaming_landing_is_idempotent(spark, tmp_dir):
    """Files of two encodings and headers land once each; a batch that runs again leaves one snapshot."""
    from quarry.plans import flows
    texts = {"a.csv": ("id,名前\n1,山田\n2,\"x\ny\"\n", "cp932"), "b.csv": ("名前,id,more\n佐藤,3,m\n", "utf-8"), "skip.txt": ("no", "utf-8")}
    os.makedirs(f"{tmp_dir}/in")
    for name, (text, encoding) in texts.items():
        with open(f"{tmp_dir}/in/{name}", "wb") as f:
            f.write(text.encode(encoding))
    landing = flows.StreamLanding(spark, f"{tmp_dir}/out", "2024-01-21", report_date=True)
    landing.run(f"{tmp_dir}/in", f"{tmp_dir}/ck", max_files=1)
    want = {("1", "山田", None), ("2", "x\ny", None), ("3", "佐藤", "m")}
    rows = landing.rows().collect()
    assert {(r.id, r["名前"], r.more) for r in rows} == want and len(rows) == 3 and {r["日付"] for r in rows} == {"2024-01-20"}
    again = spark.createDataFrame([(f"file:{tmp_dir}/in/b.csv",)], "path string")
    kept = {r.snapshot_ts for r in rows if r.id == "3"}.pop()
    landing.land(again, int(kept))
    landing.land(again, int(kept))
    assert {(r.id, r["名前"], r.more) for r in landing.rows().collect()} == want and landing.rows().count() == 3
    with open(f"{tmp_dir}/in/c.csv", "w") as f:
        f.write("id\n4\n")
    landing.run(f"{tmp_dir}/in", f"{tmp_dir}/ck", max_files=1)
    assert sorted(r.id for r in landing.rows().collect()) == ["1", "2", "3", "4"]
    assert landing.outcome().collect()[0].total == 3


def _landing_reads(spark, tmp_dir, monkeypatch, texts):
    """A landing of files of these texts (oldest first), and the number of files of each read of the reader."""
    from quarry.plans import flows
    os.makedirs(f"{tmp_dir}/in")
    for i, (name, text) in enumerate(texts.items()):
        with open(f"{tmp_dir}/in/{name}", "wb") as f:
            f.write(text)
        os.utime(f"{tmp_dir}/in/{name}", (1_700_000_000 + i,) * 2)
    reads, reader = [], flows.rpt.read_report_csv
    monkeypatch.setattr(flows.rpt, "read_report_csv", lambda s, paths, **kw: reads.append(len(paths)) or reader(s, paths, **kw))
    return flows.StreamLanding(spark, f"{tmp_dir}/out", "2024-01-21", report_date=False), reads


def test_streaming_landing_reads_waiting_files_at_once(spark, tmp_dir, monkeypatch):
    """Batches of one file land one snapshot each, but the reader's jobs run once for all that wait; a
    file without a row, other headers, blanks and letters in names, and a file that changed before its batch too."""
    texts = {"a b%20.csv": b"id,x\n1,p\n2,q\n", "b\u8868.csv": "id,y\n3,\u8868\n".encode("cp932"), "c.csv": b"id\n", "d.csv": b"id\n4\n"}
    landing, reads = _landing_reads(spark, tmp_dir, monkeypatch, texts)
    land = landing.land

    def change_then_land(files, batch_id):
        land(files, batch_id)
        if batch_id == 0:
            with open(f"{tmp_dir}/in/d.csv", "w") as f:
                f.write("id\n5\n6\n")
            os.utime(f"{tmp_dir}/in/d.csv", (1_700_000_003,) * 2)
    landing.land = change_then_land
    landing.run(f"{tmp_dir}/in", f"{tmp_dir}/ck", max_files=1)
    assert reads == [4, 1]
    got = {(r.id, r.x, r.y) for r in landing.rows().collect()}
    assert got == {("1", "p", None), ("2", "q", None), ("3", None, "\u8868"), ("5", None, None), ("6", None, None)}
    assert landing.rows().count() == 5 and landing.rows().select("snapshot_ts").distinct().count() == 3
    outcome = spark.read.parquet(f"{tmp_dir}/out/outcome").collect()
    assert {r.path.rsplit("/", 1)[1]: r.n_rows for r in outcome} == {"a b%20.csv": 2, "b\u8868.csv": 1, "c.csv": 0, "d.csv": 2}


def test_streaming_landing_bad_file_fails_its_own_batch(spark, tmp_dir, monkeypatch):
    landing, reads = _landing_reads(spark, tmp_dir, monkeypatch, {"a.csv": b"id\n1\n", "b.csv": b"id\n2,more\n"})
    with pytest.raises(Exception, match="saw more"):
        landing.run(f"{tmp_dir}/in", f"{tmp_dir}/ck", max_files=1)
    assert [r.id for r in landing.rows().collect()] == ["1"] and reads == [2, 1, 1]
    with open(f"{tmp_dir}/in/b.csv", "w") as f:
        f.write("id\n2\n")
    landing.run(f"{tmp_dir}/in", f"{tmp_dir}/ck", max_files=1)
    assert sorted(r.id for r in landing.rows().collect()) == ["1", "2"]
