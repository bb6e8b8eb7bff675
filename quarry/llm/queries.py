"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import anchor_lists, bpe, conversation_trie, cover_tree, fm_decontam, langid, lattice_lm, line_dedup, sentencepiece_bpe, simhash, suffix_dedup, token_counts, toxicity
from quarry.llm.common import crc_mod
from quarry.session import load_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle:
            ORACLE[key] = oracle
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return load_table(spark, sf_dir, "documents")


@query("op7_line_dedup", line_dedup.oracle())
def op7(spark, sf_dir):
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "lines_removed")


@query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_bpe")
def op8(spark, sf_dir):
    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir)))


@query("op6_langid")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    out = langid.train_and_identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 4) == 2
    model = toxicity.train(docs, load_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op2_cover_tree", cover_tree.oracle())
def op2(spark, sf_dir):
    ship_package(spark)
    vectors = load_table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


@query("op4_lattice_lm")
def op4(spark, sf_dir):
    held_out = crc_mod("doc_id", 7) == 2
    out = lattice_lm.score_documents(documents(spark, sf_dir), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_fm_decontam", fm_decontam.oracle())
def op3(spark, sf_dir):
    out = fm_decontam.find_contamination(documents(spark, sf_dir), load_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op1_suffix_dedup", suffix_dedup.oracle())
def op1(spark, sf_dir):
    out = suffix_dedup.find_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_sentencepiece")
def op13(spark, sf_dir):
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(documents(spark, sf_dir)))


@query("op12_conversation_trie", conversation_trie.oracle())
def op12(spark, sf_dir):
    ship_package(spark)
    return conversation_trie.prefix_trie(load_table(spark, sf_dir, "conversations"))


@query("op11_hard_negatives", anchor_lists.oracle())
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anchor_lists.hard_negatives(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
