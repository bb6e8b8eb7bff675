"""Line dedup by distinct-site spread.

A line is boilerplate when it occurs on at least ``min_sites`` different
sites (``source``). One HyperLogLog sketch per line hash, merged by the
aggregate's own partial/final steps, estimates the spread; only lines whose
estimate lies near the threshold get an exact distinct count. Of a
boilerplate line the first occurrence (smallest doc_id, then position) stays,
all others go, so a text copied to many sites keeps one whole copy.

Everything is DataFrame expressions. What crosses an exchange is 16-byte line
hashes, sketches and positions; whole texts move only where removed
positions meet their document. Hot lines are combined map-side by the
aggregate; the spreads near or over the threshold and the boilerplate lines are
written once, so joins back to occurrences are plain sort-merge joins of two
exchanges, whose skewed partitions adaptive execution splits.

Defined cases: a null text has no lines and stays null; blank lines (only
white space) are never boilerplate; a null source counts as one site of its
own; a null doc_id sorts before all others; rows that repeat doc_id and text
count as one document for "first occurrence" and get the same result; an
empty table gives an empty result. Lines are compared after trimming spaces,
tabs and carriage returns at both ends, and are rejoined unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

MIN_SITES = 10
LG_K = 12
#: estimates within this share of the threshold are counted exactly; at
#: lg_k = 12 the sketch's standard error is 1.6 %, so 25 % is over 15 of them
MARGIN = 0.25

TRIM = " \t\r"


def line_occurrences(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: doc key (``doc_id``, ``th``), ``site``, ``pos`` and the line's 128-bit hash."""
    # the text is hashed below the explode: once per document, not once per line
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(docs["text"]).alias("th"),
        F.coalesce(docs["source"].cast("string"), F.lit("\x00null")).alias("site"),
        F.split(docs["text"], "\n").alias("lines"))
    base = texts.select("doc_id", "th", "site", F.posexplode("lines").alias("pos", "line"))
    line = F.btrim("line", F.lit(TRIM))
    return (base.withColumn("line", line).where("line != ''")
            .select("doc_id", "th", "site", "pos",
                    F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))


def boilerplate_lines(occ: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """Hashes of lines on at least ``min_sites`` sites, with their first occurrence."""
    spread = stage(occ.groupBy("h1", "h2")
                   .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
                        F.min(F.struct("doc_id", "th", "pos")).alias("first"))
                   .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
                   .where(F.col("estimate") >= min_sites * (1 - margin)), "spread")
    sure = F.col("estimate") > min_sites * (1 + margin)
    near = spread.where(~sure).select("h1", "h2")
    exact = (occ.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi")
             .distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")))
    return stage(spread.join(exact, ["h1", "h2"], "left")
                 .where(sure | (F.col("sites") >= min_sites)).select("h1", "h2", "first"), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its repeated
    boilerplate lines, and ``lines_removed`` (long; a column of that name in ``docs`` gives way)."""
    occ = line_occurrences(docs)
    boiler = boilerplate_lines(occ, min_sites, margin)
    mine = F.struct("doc_id", "th", "pos")
    removed = (occ.join(boiler, ["h1", "h2"]).where(~mine.eqNullSafe(F.col("first")))
               .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
               .agg(F.collect_set("pos").alias("_gone")))
    gone = removed["_gone"]
    joined = docs.join(removed, docs["doc_id"].cast("long").eqNullSafe(removed["_id"])
                       & (F.xxhash64(docs["text"]) == removed["_th"]), "left")
    # by position, as a difference of sets: linear in the text's lines, which the outer lambda splits once
    left = F.transform(F.array(F.split(docs["text"], "\n")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))
    kept = F.when(gone.isNull(), docs["text"]).otherwise(left[0])
    out = [kept.alias("text") if c == "text" else docs[c] for c in docs.columns if c != "lines_removed"]
    return joined.select(*out, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("lines_removed"))


def oracle(table: str = "documents", min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for ``doc_id, text, lines_removed`` of ``dedup_lines``, for
    tables whose doc_id is unique."""
    return f"""
with l as (
  select doc_id, coalesce(source, chr(1) || 'null') as site, unnest(string_split(text, chr(10))) as raw,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from {table}),
t as (select *, trim(raw, ' ' || chr(9) || chr(13)) as line from l),
b as (select line, min({{'d': doc_id, 'p': pos}}) as first from t where line <> ''
      group by line having count(distinct site) >= {min_sites}),
m as (select t.*, b.line is not null and {{'d': t.doc_id, 'p': t.pos}} <> b.first as gone
      from t left join b on t.line = b.line),
k as (select doc_id, string_agg(raw, chr(10) order by pos) filter (where not gone) as text,
             count(*) filter (where gone) as lines_removed from m group by doc_id)
select d.doc_id as doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
       cast(coalesce(k.lines_removed, 0) as bigint) as lines_removed
from {table} d left join k on d.doc_id = k.doc_id"""
