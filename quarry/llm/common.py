"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, ship_package

#: rows of one Arrow batch that are turned into Python objects at a time
SLICE_ROWS = 256
#: bytes of one Arrow batch on its way to a Python worker, where the submitter sets nothing
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = "4m"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: lineage is cut and later branches read the copy, also after an
    executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Text columns reach 64 MB a batch by Spark's default, held twice over outside the
    heap for each task (the vectors and the bytes that a worker reads). Unless the
    submitter set a limit, the session gets one of a few megabytes."""
    if BATCH_BYTES not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)


def keyed_texts(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) and the named further columns;
    whatever else the table holds is pruned at the scan."""
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"),
                     *[df[c] for c in more])


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as '')."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that Python objects of at most
    ``rows`` texts live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def buckets_of(spark: SparkSession) -> int:
    """Hash buckets of one exchange: as many as its partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` written once to the shared folder, bucketed by ``key``: a join
    on it brings the other side's rows here and doesn't move these."""
    spark = rows.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    (rows.write.bucketBy(buckets_of(spark), key).option("compression", "zstd")
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}").saveAsTable(name, format="parquet"))
    return spark.table(name)
