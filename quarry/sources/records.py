"""Records of report files, where quoted fields may hold line breaks.

Files are read as raw lines in splits, by many tasks. Whether a line starts
inside a quoted field depends on all the text before it, so each line is reduced
to what it does for both entry states (outside and inside of quotes): a
function of one bit. Those functions compose, first along the lines of a
split, for both states of the split's start, then over the splits of a file (one
row each), which fixes every split's true entry state. Record starts are
counted the same way, so lines carry their record's number, and the lines of one record meet by it.

Only files that hold a line that leaves a quoted field open take that path (one
exchange of their text, by split). In all others a line is a record and the text doesn't move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANK = " \t\r"
QUOTE = '"'


def raw_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(line, last, _file, _block): lines as the bytes in the file (a string that need not be valid
    UTF-8), without their line feed; a carriage return inside a line ends one too, and ``last``
    tells whether a line feed ended it."""
    r = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                             F.col("_metadata.file_size").alias("_size"))
    at = F.instr("value", "\r")
    # through ISO-8859-1, which keeps every byte
    cut = F.transform(F.split(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r(?!$)"), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    parts = F.when((at > 0) & (at < F.length("value")), cut).otherwise(F.array("value"))
    return df.select("_file", "_block", "_size", F.posexplode(parts).alias("_k", "line"), F.size(parts).alias("_n")).select(
        "line", (F.col("_k") == F.col("_n") - 1).alias("last"), "_file", "_block", "_size")


def is_blank(line: Column | str) -> Column:
    return F.trim(line, F.lit(BLANK)) == ""


def leaves_open(line: Column, sep: str, inside: bool = False) -> Column:
    """Does a line that starts outside (or ``inside``) of quotes end inside a quoted field? A
    quote opens a field only at the field's start; inside, two stand for one."""
    start, field, quoted, closing = 0, 1, 2, 3

    def after_quote(s):
        return F.when(s == start, F.lit(quoted)).when(s == quoted, F.lit(closing)).when(s == closing, F.lit(quoted)).otherwise(s)

    def after_text(s, t):
        return F.when((t == "") | (s == quoted), s).when(t.endswith(sep), F.lit(start)).otherwise(F.lit(field))

    parts = F.split(line, QUOTE)
    end = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), after_text(F.lit(quoted if inside else start), parts[0]),
                      lambda s, t: after_text(after_quote(s), t))
    return F.when(F.contains(line, F.lit(QUOTE)), end == quoted).otherwise(F.lit(inside))


def split_facts(lines: DataFrame, sep: str) -> DataFrame:
    """One row per split: lines that aren't blank, the position of the first of them in the scan, its text,
    whether a line leaves a field open, and whether all are UTF-8. One pass, one exchange of these rows."""
    kept = lines.filter(~is_blank("line")).withColumn("_mid", F.monotonically_increasing_id())
    return kept.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first_mid"), F.min_by("line", "_mid").alias("first_line"),
        F.bool_or(leaves_open(F.col("line"), sep)).alias("open"), F.bool_and(F.is_valid_utf8("line")).alias("utf8"))


def one_line_records(lines: DataFrame, facts: DataFrame, all_of_them: bool) -> DataFrame:
    """(_file, _line, line): records of the files without an open line, numbered in file order. The
    splits' counts are as many rows as there are splits; a split that the counts don't know is an error."""
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    known = facts.select("_file", "_block", "first_mid", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"),
                         F.bool_or("open").over(whole).alias("open"))
    kept = lines.filter(~is_blank("line")).withColumn("_mid", F.monotonically_increasing_id())
    at = F.col("_mid") - F.col("first_mid")
    known_at = F.when((at >= 0) & (at < F.col("n")), at).otherwise(
        F.raise_error(F.concat(F.lit("the splits of "), "_file", F.lit(" changed between two scans"))).cast("long"))
    out = kept.join(known, ["_file", "_block"], "left")
    if not all_of_them:
        out = out.filter(~F.coalesce("open", F.lit(False)))
    return out.select("_file", (F.col("before") + known_at + 1).alias("_line"), "line")


def _composed(state: Column, const: Column, const_at: Column, swaps: Column) -> Column:
    """The bit after functions of one bit: the last constant one's value (or ``state``), turned
    over by each negation behind it."""
    return F.when(const.isNull(), (state + swaps) % 2).otherwise((const + swaps - const_at) % 2)


def _prefix(rows: DataFrame, part: list[str], order: str, to0: str, to1: str) -> DataFrame:
    """Adds e0 and e1: the state before each row for either state before the partition's first."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    swap = ((F.col(to0) == 1) & (F.col(to1) == 0)).cast("int")
    rows = rows.withColumn("_sw", F.sum(swap).over(up)).withColumn("_c", F.when(F.col(to0) == F.col(to1), F.struct(F.col(to0).alias("v"), F.col("_sw").alias("at"))))
    rows = rows.withColumn("_lc", F.last("_c", ignorenulls=True).over(w)).withColumn("_sb", F.coalesce(F.sum(swap).over(w), F.lit(0)))
    for s in (0, 1):
        rows = rows.withColumn(f"e{s}", _composed(F.lit(s), F.col("_lc.v"), F.col("_lc.at"), F.col("_sb")).cast("int"))
    return rows.drop("_sw", "_c", "_lc", "_sb")


def lines_both_ways(lines: DataFrame, sep: str) -> DataFrame:
    """For each line and either state at its split's start: the state before it (e0, e1), after it (x0, x1), and
    the records that have started in the split by then (r0, r1)."""
    rows = lines.withColumn("_mid", F.monotonically_increasing_id())
    for s in (0, 1):
        rows = rows.withColumn(f"to{s}", leaves_open(F.col("line"), sep, bool(s)).cast("int"))
    rows = _prefix(rows, ["_file", "_block"], "_mid", "to0", "to1")
    up = Window.partitionBy("_file", "_block").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    for s in (0, 1):
        rows = rows.withColumn(f"x{s}", F.when(F.col(f"e{s}") == 0, F.col("to0")).otherwise(F.col("to1")))
        rows = rows.withColumn(f"r{s}", F.sum(((F.col(f"e{s}") == 0) & ~is_blank("line")).cast("long")).over(up))
    return rows.select("_file", "_block", "_mid", "line", "last", "e0", "e1", "x0", "x1", "r0", "r1")


def split_states(both: DataFrame) -> DataFrame:
    """(_file, _block, state, before, unclosed): each split's true entry state, the records that start before it,
    and whether its file ends inside quotes. One row per split."""
    ends = both.groupBy("_file", "_block").agg(*[F.max_by(c, "_mid").alias(c) for c in ("x0", "x1", "r0", "r1")])
    ends = _prefix(ends, ["_file"], "_block", "x0", "x1")
    state = F.col("e0")  # a file starts outside of quotes
    w = Window.partitionBy("_file").orderBy("_block")
    starts = F.when(state == 0, F.col("r0")).otherwise(F.col("r1"))
    exits = F.when(state == 0, F.col("x0")).otherwise(F.col("x1"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (ends.withColumn("_starts", starts).withColumn("_exit", exits)
            .select("_file", "_block", state.alias("state"),
                    F.coalesce(F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                    (F.last("_exit").over(whole) == 1).alias("unclosed")))


def broken_line_records(both: DataFrame) -> DataFrame:
    """(_file, _line, line): records of files whose quoted fields hold line breaks, those across splits
    too. A file that ends inside quotes is an error, as for pandas."""
    rows = both.join(split_states(both), ["_file", "_block"])
    state = F.col("state")
    pick = lambda c: F.when(state == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    error = F.raise_error(F.concat(F.lit("a quoted field is not closed at the end of "), "_file")).cast("long")
    rows = rows.select("_file", "_block", "_mid", "line", "last", pick("e").alias("entry"), pick("x").alias("exit"),
                       F.when(F.col("unclosed"), error).otherwise(F.col("before") + pick("r")).alias("_line"))
    single = rows.filter((F.col("entry") == 0) & (F.col("exit") == 0) & ~is_blank("line")).select("_file", "_line", "line")
    pieces = rows.filter((F.col("entry") == 1) | (F.col("exit") == 1))
    text = F.concat("line", F.when(F.col("exit") == 0, F.lit("")).when(F.col("last"), F.lit("\n")).otherwise(F.lit("\r")))
    joined = pieces.groupBy("_file", "_line").agg(F.array_sort(F.collect_list(F.struct("_block", "_mid", text.alias("t")))).alias("p"))
    return single.unionByName(joined.select("_file", "_line", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("line")))
