"""ST1: newly landed report files as a stream.

The polling loop that waits for a download to appear becomes a file
stream: Structured Streaming's file source remembers which files it has
seen in the checkpoint, so each file is picked up exactly once, and a
restarted query continues where it stopped. The name filter is a
``pathGlobFilter``; partial downloads never match the glob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.report import add_report_date


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.csv",
             encoding: str = "utf-8", header: bool = True, run_date=None,
             max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the rows of files landing in ``folder``, with
    the source file name and, when ``run_date`` is given, the report-date
    column (P1)."""
    from quarry.sources.reports import _ensure_charsets
    _ensure_charsets(spark, encoding)
    r = (spark.readStream.schema(schema).option("header", header).option("encoding", encoding)
         .option("pathGlobFilter", glob))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.csv(folder).withColumn("source_file", F.col("_metadata.file_path"))
    return add_report_date(df, run_date) if run_date is not None else df


def land_arrivals(stream: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True):
    """Append arriving rows to a Parquet table; ``availableNow`` processes
    what is there and stops (batch-like runs that still only see new files)."""
    w = stream.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
