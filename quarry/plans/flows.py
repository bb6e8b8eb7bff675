"""The three end-to-end flows, composed from the operators.

* ``profile_report``: report CSV -> schema table + consistency -> schema
  document (S1 -> T1..T8 -> S7).
* ``analyze_pages``: pages -> elements -> interactive elements with
  selectors, categories, dedup -> selector exports (H1 -> H13 -> H16..H23 ->
  H25 -> H27 -> S8).
* ``land_reports``: newly landed report files -> date / traffic filters ->
  report date column -> named snapshot -> outcome (ST1/S6 -> S1 -> P2/P3 ->
  P1 -> S9 -> A6).
* ``StreamLanding``: the same landing as a stream of file paths; each batch is
  one snapshot, so a batch that runs again replaces what it wrote.

Each returns the DataFrames it wrote so callers can inspect them.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import report as rp
from quarry.operators import results as rs
from quarry.operators import schema_infer as si
from quarry.operators import selectors as sl
from quarry.session import checkpoint_dir, materialize
from quarry.sources import reports as rpt
from quarry.sources import sinks as sk
from quarry.sources.pages import extract_elements


def profile_report(spark: SparkSession, path: str, out: str, encoding: str | None = "auto",
                   header_row: int = 1) -> dict[str, DataFrame]:
    """Profile a landed report (a file or a folder of files)."""
    df = rpt.order_rows(rpt.read_report_csv(spark, path, encoding=encoding, header_row=header_row))
    schema = materialize(si.schema_table(df)).orderBy("col_pos")
    cells = si.inconsistent_cells(df)
    sk.write_schema_document(schema, cells, out)
    return {"schema": schema, "low_consistency": si.low_consistency(schema),
            "census": si.type_census(schema), "profile": si.table_profile(df)}


def analyze_pages(spark: SparkSession, pages: DataFrame, out: str) -> dict[str, DataFrame]:
    """Selector table of the interactive elements of every page."""
    elements = materialize(extract_elements(pages))
    kept = materialize(sl.selector_table(elements))
    sk.write_selector_exports(kept, out)
    return {"elements": elements, "selectors": kept}


def land_reports(spark: SparkSession, before: DataFrame, folder: str, out: str, run_date, snapshot_ts: str,
                 pattern: str | None = None, date_column: str | None = None, start=None, end=None,
                 traffic_column: str | None = None, traffic_type: str = "all",
                 report_date: bool = True) -> dict[str, DataFrame]:
    """Take the files that appeared in ``folder`` since the ``before``
    listing, read them, filter, add the report date (unless ``report_date`` is
    off: only the detailed report has it) and land them as a new snapshot;
    returns the rows and the outcome summary."""
    after = rpt.list_files(spark, folder)
    fresh = rpt.new_files(before, after, pattern)
    paths = [r.path for r in fresh.select("path").collect()]  # the new-file listing, not data
    if not paths:
        empty = spark.createDataFrame([], "success boolean")
        return {"rows": None, "outcome": rs.outcome_summary(empty, rule="report")}
    df = rpt.read_report_csv(spark, paths, encoding="auto")
    read = df.groupBy(rpt.plain_path("source_file").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    if date_column:
        df = rp.date_range(df, date_column, run_date, start=start, end=end)
    if traffic_column:
        df = rp.traffic_filter(df, traffic_column, traffic_type)
    if report_date:
        df = rp.add_report_date(df, run_date)
    rpt.write_snapshot(df, out, snapshot_ts)
    landed = rpt.latest_snapshot(spark, out)
    # a file has landed when its rows were read (and the write above went through); one
    # without a header or any row has not
    outcome = (fresh.select(rpt.plain_path("path").alias("path")).join(read, "path", "left")
               .select(F.col("n_rows").isNotNull().alias("success")))
    return {"rows": landed, "outcome": rs.outcome_summary(outcome, rule="report")}


def _plain(path: str) -> str:
    """``rpt.plain_path`` of a value."""
    return re.sub("^file:/+", "file:/", path)


FILE_ID = "_file_id"
VERSION = "concat_ws(' ', unix_micros(modificationTime), length) AS version"
# How much of what waits in the folder is read at once, in files and in bytes.
READ_AHEAD_FILES = 4000
READ_AHEAD_BYTES = 4 << 30


class StreamLanding:
    """E3 as a stream (ST1 -> S1 -> P1 -> S9 -> A6): a file stream brings the paths of newly landed reports,
    at most ``max_files`` a batch; a batch reads them in their encodings and by their headers and lands them as
    the snapshot named by its id. The file stream's checkpoint remembers the files, and writing a
    snapshot replaces only that snapshot, so a batch that fails and runs again leaves its rows once.

    A batch of a few files costs as many jobs as one of a thousand, so a batch whose files are not read yet has
    the next waiting ones read with them (``READ_AHEAD_*``) into a shared copy with a folder per file, and the
    batches behind it land theirs from that copy. A file that has changed since is read again, alone."""

    def __init__(self, spark: SparkSession, out: str, run_date, report_date: bool = True, header_row: int = 1):
        self.spark, self.out, self.run_date, self.report_date, self.header_row = spark, out, run_date, report_date, header_row
        self._waiting: deque = deque()  # (path, version, length) of files in the folder, oldest first
        self._read: dict = {}  # path -> (version, schema, folder with its rows, rows); files read and not landed

    def _copy(self, versions: dict) -> None:
        """Read the files of ``versions`` (path -> version) and write their rows, a folder for each file."""
        df = rpt.read_report_csv(self.spark, list(versions), encoding="auto", header_row=self.header_row)
        root, schema = f"{checkpoint_dir(self.spark).rstrip('/')}/quarry-tables/{uuid.uuid4().hex}", df.schema
        file_id = F.sha2(rpt.plain_path("source_file"), 256)
        df.withColumn(FILE_ID, file_id).write.partitionBy(FILE_ID).parquet(root)
        copy = self.spark.read.schema(T.StructType([*schema, T.StructField(FILE_ID, T.StringType())])).parquet(root)
        files = copy.groupBy(FILE_ID, "source_file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per file read at once
        found = {_plain(unquote(r.source_file)): (f"{root}/{FILE_ID}={r[FILE_ID]}", r.n) for r in files}
        if not found.keys() <= {_plain(p) for p in versions}:
            raise ValueError(f"rows of files that were not asked for in {root}")
        self._read.update({p: (v, schema, *found.get(_plain(p), (None, 0))) for p, v in versions.items()})

    def _read_ahead(self, missing: dict) -> None:
        """Read the files of a batch, and with them the next that wait."""
        more, size = {}, 0
        while self._waiting and len(missing) + len(more) < READ_AHEAD_FILES:
            path, version, length = self._waiting[0]
            if path not in missing and path not in self._read:
                size += length
                if size > READ_AHEAD_BYTES:
                    break
                more[path] = version
            self._waiting.popleft()
        if more:
            try:
                return self._copy({**missing, **more})
            except Exception:  # a report that can't be read fails its own batch only: each reads alone from here
                self._waiting.clear()
        self._copy(missing)

    def land(self, files: DataFrame, batch_id: int) -> None:
        """One batch: ``files`` has a column ``path`` (as many rows as a batch has files), and from the
        stream also ``version``."""
        known = "version" in files.columns
        versions = {r[0]: r[1] for r in files.select("path", "version" if known else F.lit(None).cast("string")).collect()}
        if not versions:
            return
        missing = {p: v for p, v in versions.items() if not known or p not in self._read or self._read[p][0] != v}
        if missing:
            self._read_ahead(missing)
        copies: dict = {}
        for p in sorted(versions):
            _, schema, folder, n = self._read[p]
            copies.setdefault(id(schema), (schema, []))[1].extend([folder] if n else [])
        parts = [self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
                 for schema, folders in copies.values()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        outcome = self.spark.createDataFrame(pa.table({"path": [_plain(p) for p in sorted(versions)],
                                                       "n_rows": pa.array([self._read[p][3] for p in sorted(versions)], pa.int64())})).coalesce(1)
        if self.report_date:
            df = rp.add_report_date(df, self.run_date)
        stamp = f"{batch_id:010d}"
        write = inheritable_thread_target(rpt.write_snapshot)
        with ThreadPoolExecutor(2) as pool:  # two small jobs side by side; the batch counts when both are through
            for job in [pool.submit(write, df, f"{self.out}/rows", stamp), pool.submit(write, outcome, f"{self.out}/outcome", stamp)]:
                job.result()
        for p in versions:
            del self._read[p]

    def _list_waiting(self, folder: str, glob: str) -> None:
        """The files of the folder that haven't landed (the new-file listing, not data)."""
        files = (self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
                 .load(folder).select("path", "modificationTime", F.expr(VERSION), "length"))
        try:
            landed = self.spark.read.schema("path string").parquet(f"{self.out}/outcome")
            files = files.withColumn("_p", rpt.plain_path("path")).join(landed.select(F.col("path").alias("_p")), "_p", "left_anti").drop("_p")
        except AnalysisException:  # nothing has landed yet
            pass
        self._waiting = deque((r.path, r.version, r.length) for r in files.orderBy("modificationTime", "path").collect())
        self._read = {}

    def run(self, folder: str, checkpoint: str, glob: str = "*.csv", max_files: int = 1000) -> None:
        """Land what is there and stop; a later run goes on from there."""
        conf, listers = self.spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        before = conf.get(listers)
        conf.set(listers, str(min(int(before), 4 * self.spark.sparkContext.defaultParallelism)))  # else a task for each folder
        try:
            self._list_waiting(folder, glob)
            files = (self.spark.readStream.format("binaryFile")
                     .schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob)
                     .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder).select("path", F.expr(VERSION)))
            q = (files.writeStream.foreachBatch(self.land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
            q.awaitTermination()
        finally:
            conf.set(listers, before)

    def rows(self) -> DataFrame:
        """All landed rows; batches may have other headers. ``snapshot_ts`` is the batch."""
        return self.spark.read.option("mergeSchema", True).schema(self._schema("rows")).parquet(f"{self.out}/rows")

    def _schema(self, name: str):
        schema = self.spark.read.option("mergeSchema", True).parquet(f"{self.out}/{name}").schema
        return T.StructType([T.StructField(f.name, T.StringType()) if f.name == "snapshot_ts" else f for f in schema])

    def outcome(self) -> DataFrame:
        """A6 over the files: one without a header or any row has not landed."""
        files = self.spark.read.parquet(f"{self.out}/outcome").select((F.col("n_rows") > 0).alias("success"))
        return rs.outcome_summary(files, rule="report")
