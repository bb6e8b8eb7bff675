"""The pipeline against its stages' brute-force versions, on a small table."""

import numpy as np
from edge import awkward, documents

import corpus_pipeline
from quarry.llm import queries
from quarry.llm.common import stage


def write(spark, tmp_dir, rows):
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, " ".join(awkward()[13][1].split()[:16]))], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")


def test_stages(spark, tmp_dir):
    rows = awkward()
    write(spark, tmp_dir, rows)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    names, columns = [], docs.columns
    for name, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, tmp_dir), name)
        names.append(name)
        if name != "bpe":
            assert docs.columns == columns
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    run = corpus_pipeline.run(spark, tmp_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))
    ids = [r.doc_id for r in run.collect()]
    assert 100 in ids and not set(range(200, 206)) & set(ids)
    assert awkward()[13][0] not in ids  # holds a benchmark passage
    assert 7 in ids and 8 in ids  # clean


def test_pipeline_of_nothing(spark, tmp_dir):
    write(spark, tmp_dir, [])
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []


def test_queries_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert np.all([k in queries.QUERIES for k in queries.ORACLE])
