"""D3-D11 as DataFrame operators over any (id..., text) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.session import spread


def list_items(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """D3: one row per list item (1-based ``item_pos``)."""
    df = spread(df, *keys)
    return df.select(*keys, F.posexplode(tx.list_items(F.col(text))).alias("_p", "item")).select(
        *keys, (F.col("_p") + 1).alias("item_pos"), "item")


def sections(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Summary, risks and suggestions per text."""
    df = spread(df, *keys)
    return df.select(*keys, tx.section_parts(F.col(text)).alias("_s")).select(
        *keys, "_s.summary", "_s.risks", "_s.suggestions")


def code_blocks(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """First fenced block (else the text) and the text outside fences."""
    df = spread(df, *keys)
    t = F.col(text)
    return df.select(*keys, tx.code_block(t).alias("code"), tx.outside_code(t).alias("explanation"))


def review_urls(df: DataFrame, keys: Sequence[str], url: str = "url") -> DataFrame:
    """Owner / repo / number, or the error label."""
    return df.select(*keys, F.col(url), tx.review_url(F.col(url)).alias("_r")).select(
        *keys, url, "_r.owner", "_r.repo", "_r.number", "_r.error")


def languages(df: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Extension (lower-cased) and its language label per file."""
    ext = F.lower(tx.extension_of(F.col(path)))
    return df.select(*keys, F.col(path), ext.alias("ext"), tx.language_of(ext).alias("language"))


def main_language(files: DataFrame, group: Sequence[str], path: str = "path", order: str = "pos") -> DataFrame:
    """Per group, the language of the most frequent (lower-cased)
    extension; ties go to the extension seen first. Groups whose files have
    no extension at all still get the language of ''."""
    ext = F.lower(tx.extension_of(F.col(path)))
    counts = (files.select(*group, ext.alias("ext"), F.col(order).alias("pos"))
              .groupBy(*group, "ext").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")))
    best = counts.groupBy(*group).agg(
        F.max_by("ext", F.struct(F.col("n"), -F.col("first_pos"))).alias("main_ext"),
        F.sum("n").alias("n_files"))
    return best.select(*group, "main_ext", "n_files", tx.language_of(F.col("main_ext")).alias("language"))


def file_slugs(df: DataFrame, keys: Sequence[str], text: str = "text", language: str = "language") -> DataFrame:
    """Suggested file name per description."""
    return df.select(*keys, tx.file_slug(F.col(text), F.col(language)).alias("file_name"))


def truncate_texts(df: DataFrame, keys: Sequence[str], text: str = "text", n: int = 4000,
                   marker: str = tx.MARK_DIFF) -> DataFrame:
    """Cut long texts and append the marker."""
    return df.select(*keys, tx.truncate(F.col(text), n, marker).alias("truncated"))


def clean_messages(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Strip quotes and a leading label."""
    return df.select(*keys, tx.clean_message(F.col(text)).alias("message"))
