"""The corpus pipeline: stages over ``documents``, each calling one operator of
``quarry.llm``. A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next stage's docs; all but the last return the columns of
``documents``.

1. toxicity: the label model is learned from the stage's own input and ``labels``;
   documents that score THRESHOLD or more go.
2. line_dedup: lines on many sites keep their first occurrence only; n_chars follows
   the new text; a document whose lines all go stays, with an empty text.
3. simhash: one document (the smallest id) of each component of near copies stays.
4. decontamination: documents that the benchmark contaminates go.
5. bpe: the rest is encoded and decoded.

Rows with a null doc_id pass every stage that can't tell them apart: the score of a text
decides on it in stage 1 whatever its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, fm_decontam, line_dedup, simhash, toxicity
from quarry.llm.common import crc_mod
from quarry.session import checkpoint_dir, load_table, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, load_table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.keep_civil(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    chars = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_decontam.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the learned classifier, the fingerprints' components nor the encoder
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    ship_package(spark)
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark).rstrip('/')}/llm/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
