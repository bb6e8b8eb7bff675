"""Landed report files.

* S1 reads report CSVs in their encoding, with the header on line N, and
  numbers rows in file order without collecting anything: a distributed
  zip-with-index over (file, split) blocks.
* S2 labels each file's encoding from a byte sample (UTF-8 validity, then
  trial decoding in a vectorised UDF).
* S5/S6 work on file listings (``binaryFile`` metadata; file contents are
  never read for them).
* S9 derives target names and keeps every landed version as its own
  snapshot partition instead of renaming files in place.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import materialize, ship_package

# Encodings tried in order and the default.
DEFAULT_ENCODING = "cp932"
TRIAL_ENCODINGS = ("cp932", "euc_jp")
SAMPLE_LINES = 10
NOT_ASCII = "[^\\x00-\\x7F]"
JAVA_CHARSETS = {"cp932": "windows-31j", "euc_jp": "EUC-JP"}
# The strings pandas reads as missing by default.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Partial-download suffixes and report names.
PARTIAL_SUFFIXES = (".crdownload", ".part", ".download")
REPORT_NAMES = {"detailed_analysis": "detailed_report", "cv_attribute": "conversion_attribute"}
REPORT_NAME_INFIX = "_ebis_"


def _ensure_charsets(spark: SparkSession, encoding: str) -> None:
    if encoding.lower().replace("-", "").replace("_", "") not in ("utf8", "usascii", "ascii"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def with_file_row_number(df: DataFrame, name: str = "rn") -> DataFrame:
    """Add the 1-based position of each row inside its file.

    Rows of one file split are contiguous inside a partition, so
    ``monotonically_increasing_id`` minus the split's minimum gives the
    position inside the split; a per-file running sum over the split sizes
    (one row per split, not per record) gives the split's offset.
    """
    base = (df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_mid", F.monotonically_increasing_id()))
    blocks = base.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (base.join(blocks.select("_file", "_block", "_min", "_off"), ["_file", "_block"])
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_min") + 1)
            .drop("_block", "_mid", "_min", "_off"))


def order_rows(df: DataFrame, by: str = "source_file", rn: str = "rn") -> DataFrame:
    """Number the rows of several files through: files in the order of ``by``,
    rows in file order. Row counts (one row per file) are dealt by ranges of ``by`` and summed up in two
    steps, within each range and over the ranges. Drops ``by`` and ``source_file``."""
    files = df.groupBy(by).agg(F.max(rn).alias("_n"))
    files = materialize(files.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()))
    ranges = files.groupBy("_range").agg(F.sum("_n").alias("_rows"))  # one row per partition of the exchange
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(up), F.lit(0)).alias("_lower"))
    here = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = files.withColumn("_here", F.coalesce(F.sum("_n").over(here), F.lit(0))).join(ranges, "_range")
    return (df.join(before.select(by, (F.col("_here") + F.col("_lower")).alias("_before")), by)
            .withColumn(rn, F.col(rn) + F.col("_before")).drop("_before", by, "source_file"))


def plain_path(path) -> Column:
    """A file path in one spelling (``file:/x`` for ``file:///x``)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def header_names(line: str | None, sep: str = ",") -> list[str]:
    """Column names of a header line: empty ones by position, repeats numbered (a, a.1)."""
    import csv as _csv
    fields = next(_csv.reader([line or ""], delimiter=sep), [])
    out: list[str] = []
    for i, v in enumerate(fields):
        name, k = v or f"Unnamed: {i}", 0
        while name in out:
            k += 1
            name = f"{v or f'Unnamed: {i}'}.{k}"
        out.append(name)
    return out


def _raw_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(line, _file): lines as ISO-8859-1, one character a byte, so nothing is lost whatever the encoding."""
    r = (spark.read.schema("line string").option("header", False).option("encoding", "ISO-8859-1")
         .option("sep", "\u0001").option("quote", "").option("escape", "").option("recursiveFileLookup", True))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.csv(path)


def read_report_csv(spark: SparkSession, path, encoding: str | None = "utf-8", header_row: int = 1,
                    pandas_na: bool = True, sep: str = ",") -> DataFrame:
    """All columns as text plus ``rn`` (1-based data row in file order)
    and ``source_file``. ``header_row`` = the record holding the header (blank lines don't count);
    records above it are dropped (they may have any number of fields). Quoted fields may hold
    line breaks, also across splits; a quote that a file doesn't close is an error.
    ``pandas_na`` reads pandas' default missing markers as null, as the
    profiler being matched sees them. Every file is read by its own header
    (repeated names are numbered); columns of several headers are put side
    by side by name. A record with more fields than its header is an error,
    as it is for pandas. ``encoding`` "auto" (or None) gives each file the
    encoding that decodes all of it.

    One scan takes the splits' facts, which are written down; the scan of the data then parses each
    record once into an array and places the fields by its file's position
    list, however many headers there are. The driver sees the distinct column
    names and counts.
    """
    from quarry.sources import records as rec
    encoding = (encoding or "auto").lower().replace("_", "-")
    if encoding.startswith(("utf-16", "utf-32")):
        raise ValueError("lines are found byte by byte: UTF-16 and UTF-32 files must be converted first")
    auto = encoding == "auto"
    _ensure_charsets(spark, DEFAULT_ENCODING if auto else encoding)
    lines = rec.raw_lines(spark, path)
    facts = materialize(rec.split_facts(lines, sep))
    seen = facts.agg(F.bool_or("open"), F.bool_and("open"), F.bool_and("utf8")).first()
    some_open, all_utf8 = bool(seen[0]), seen[2] is not False
    of_file = None  # (_file, encoding), where files differ
    if auto and not all_utf8:
        other = facts.groupBy("_file").agg(F.bool_and("utf8").alias("utf8")).filter("not utf8").select("_file")
        ship_package(spark)
        odd = lines.filter(F.col("line").rlike(NOT_ASCII)).join(other, "_file", "left_semi")
        trials = _trials(odd.select("_file", F.col("line").cast("binary").alias("_b")))
        of_file = materialize(trials.select("_file", _first_that_decodes().alias("encoding")))
    records = rec.one_line_records(lines, facts, not some_open)
    if some_open:
        open_files = facts.groupBy("_file").agg(F.bool_or("open").alias("open")).filter("open").select("_file")
        both = materialize(rec.lines_both_ways(lines.join(open_files, "_file", "left_semi"), sep))
        broken = materialize(rec.broken_line_records(both))
        records = records.unionByName(broken)

    def decoded(df: DataFrame) -> DataFrame:
        raw = F.col("line").cast("binary")
        if of_file is not None:
            text = F.col("line")
            for name in TRIAL_ENCODINGS:
                text = F.when(F.col("encoding") == name, F.decode(raw, JAVA_CHARSETS[name])).otherwise(text)
            df = df.join(of_file, "_file", "left").withColumn("line", text).drop("encoding")
        elif not auto and encoding not in ("utf-8", "utf8"):
            df = df.withColumn("line", F.decode(raw, JAVA_CHARSETS.get(encoding.replace("-", "_"), encoding)))
        return df.withColumn("line", F.rtrim("line", F.lit("\r")))

    if header_row == 1:  # the facts hold each file's first line
        heads = facts.groupBy("_file").agg(F.min_by("first_line", "_block").alias("line"), F.bool_or("open").alias("open"))
        heads = heads.filter(~F.col("open")).select("_file", "line")
        if some_open:
            heads = heads.unionByName(broken.filter("_line = 1").select("_file", "line"))
    else:
        heads = records.filter(F.col("_line") == header_row).select("_file", "line")
    heads = materialize(decoded(heads).select("_file", _header_fields(sep)(F.regexp_replace("line", "^\ufeff", "")).alias("names")))
    kinds = heads.groupBy("names").agg(F.count(F.lit(1)).alias("files"))
    facts_of_heads = kinds.agg(F.count(F.lit(1)), F.max(F.size("names"))).first()
    named = (kinds.select("names", F.posexplode("names").alias("pos", "name")).groupBy("name").agg(F.min(F.struct("names", "pos")).alias("at"))
             .orderBy("at").select("name").collect())
    names, width = [r["name"] for r in named], facts_of_heads[1] or 0
    data = decoded(records.filter(F.col("_line") > header_row))
    ddl = ", ".join(f"c{i} STRING" for i in range(width + 1))
    parsed = F.from_csv("line", ddl, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    if facts_of_heads[0] > 1:
        place = heads.select("_file", F.size("names").alias("_width"), F.transform(
            F.array(*[F.lit(n) for n in names]), lambda n: F.array_position("names", n).cast("int")).alias("_at"))
        data = data.join(place, "_file")
        fields = data.select("_line", "_file", "_width", "_at", parsed.alias("_r")).select(
            "_line", "_file", "_width", "_at", F.array(*[F.col(f"_r.c{i}") for i in range(width + 1)]).alias("_r"))
        cells = [F.when(F.col("_at")[j] > 0, F.get("_r", F.col("_at")[j] - 1)) for j in range(len(names))]
        extra, n_fields = F.get("_r", F.col("_width")), F.col("_width").cast("string")
    else:
        fields = data.select("_line", "_file", parsed.alias("_r"))
        cells = [F.col(f"_r.c{j}") for j in range(len(names))]
        extra, n_fields = F.col(f"_r.c{width}"), F.lit(str(width))
    rn = F.col("_line") - header_row
    more = F.concat(F.lit("expected "), n_fields, F.lit(" fields in record "), rn.cast("string"), F.lit(" of "), "_file", F.lit(", saw more"))
    clean = [F.when(c.isin(*PANDAS_NA), F.lit(None)).otherwise(c) if pandas_na else c for c in cells]
    return fields.select(F.when(extra.isNotNull(), F.raise_error(more).cast("long")).otherwise(rn).alias("rn"),
                         F.col("_file").alias("source_file"), *[c.alias(n) for c, n in zip(clean, names)])


def _header_fields(sep: str):
    @F.pandas_udf("array<string>")
    def names(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: header_names(line, sep))
    return names


def _decodes(name: str):
    @F.pandas_udf(T.BooleanType())
    def ok(lines: pd.Series) -> pd.Series:
        def one(b):
            try:
                bytes(b).decode(name)
                return True
            except UnicodeDecodeError:
                return False
        return lines.map(one)
    return ok


def _whole_encoding(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(_file, encoding): the first of utf-8, cp932 and euc_jp that decodes
    every line of the file (``lines``: ISO-8859-1 characters), else the
    default. Only lines that aren't ASCII take part in the trials."""
    ship_package(lines.sparkSession)
    raw = F.encode("line", "ISO-8859-1")
    files = lines.groupBy("_file", *keep).agg(F.bool_and(F.is_valid_utf8(raw.cast("string"))).alias("_utf8"))
    trials = _trials(lines.filter(F.col("line").rlike(NOT_ASCII)).withColumn("_b", raw))
    name = F.when(F.coalesce("_utf8", F.lit(True)), F.lit("utf-8")).otherwise(_first_that_decodes())
    return files.join(trials, "_file", "left").select("_file", *keep, name.alias("encoding"))


def _trials(odd: DataFrame) -> DataFrame:
    """(_file, a column per trial encoding): does it decode all of the file's lines (bytes ``_b``)?"""
    return odd.select("_file", *[_decodes(n)("_b").alias(n) for n in TRIAL_ENCODINGS]).groupBy("_file").agg(
        *[F.bool_and(n).alias(n) for n in TRIAL_ENCODINGS])


def _first_that_decodes() -> Column:
    return F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in TRIAL_ENCODINGS], F.lit(DEFAULT_ENCODING))


@F.pandas_udf(T.StringType())
def _detect_encoding(sample: pd.Series) -> pd.Series:
    def one(b):
        for enc in ("utf-8", *TRIAL_ENCODINGS):
            try:
                bytes(b or b"").decode(enc)
                return enc if b else DEFAULT_ENCODING
            except UnicodeDecodeError:
                continue
        return DEFAULT_ENCODING
    return sample.map(one)


def file_encoding(spark: SparkSession, path, glob: str | None = None, sample_lines: int | None = SAMPLE_LINES) -> DataFrame:
    """(path, length, encoding) per file, from its first ``sample_lines``
    whole lines (the profiler's sample), or from all of them (None), which is
    what the reader goes by. Files are read line by line, never as one value."""
    lines = _raw_lines(spark, path, glob)
    if sample_lines is None:
        lines = lines.withColumn("_file", F.col("_metadata.file_path"))
    else:
        lines = with_file_row_number(lines, "_line").filter(F.col("_line") <= sample_lines)
    sizes = _raw_lines(spark, path, glob).select(F.col("_metadata.file_path").alias("_file"),
                                                 F.col("_metadata.file_size").alias("length")).distinct()
    return _whole_encoding(lines).join(sizes, "_file").select(F.col("_file").alias("path"), "length", "encoding")


def encoding_of_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """S2 on a column of bytes already in a table, by its first SAMPLE_LINES lines."""
    ship_package(df.sparkSession)
    head = F.regexp_extract(F.decode(F.col(content), "ISO-8859-1"), r"\A(?:[^\n]*\n){0," + str(SAMPLE_LINES - 1) + r"}[^\n]*", 0)
    return df.withColumn("encoding", _detect_encoding(F.encode(head, "ISO-8859-1")))


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """File listing (path, name, dir, length, modificationTime), empty files too; contents
    are not read. Spark's scans leave files of no bytes out of their partitions, so those
    are the paths of the file index (which the driver holds for every source) that the scan doesn't
    return; only their times are asked of the file system one by one."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    index = r.load(path)
    df = index.select("path", "length", "modificationTime")
    indexed = sorted(index.inputFiles())
    if indexed:
        every = spark.createDataFrame([(unquote(p),) for p in indexed], "path string").select(plain_path("path").alias("path"))
        empty = [p for p, in every.join(df.select(plain_path("path").alias("path")), "path", "left_anti").collect()]
        if empty:
            jvm = spark.sparkContext._jvm
            conf = spark._jsparkSession.sessionState().newHadoopConf()
            rows = []
            for p in empty:
                at = jvm.org.apache.hadoop.fs.Path(p)
                status = at.getFileSystem(conf).getFileStatus(at)
                rows.append((p, status.getLen(), status.getModificationTime()))
            found = spark.createDataFrame(rows, "path string, length long, ms long").filter("length = 0")
            df = df.withColumn("path", plain_path("path")).unionByName(
                found.select("path", "length", F.timestamp_millis("ms").alias("modificationTime")))
    return with_names(df)


def with_names(listing: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(F.col(path), "/")
    return listing.withColumn("name", F.element_at(parts, -1)).withColumn(
        "dir", F.regexp_replace(F.col(path), "/[^/]*$", ""))


def _extension_ok(name: Column, extensions: Sequence[str] | None, prefix: str | None) -> Column:
    low = F.lower(name)
    ok = ~F.lit(False)
    for s in PARTIAL_SUFFIXES:
        ok = ok & ~low.endswith(s)
    if extensions:
        e = F.lit(False)
        for x in extensions:
            e = e | low.endswith(x.lower() if x.startswith(".") else "." + x.lower())
        ok = ok & e
    if prefix:
        ok = ok & name.startswith(prefix)
    return ok


def latest_file(listing: DataFrame, extensions: Sequence[str] | None = None, prefix: str | None = None,
                group: str = "dir") -> DataFrame:
    """Per folder the newest finished file; when the newest is empty
    the second newest is used if it is non-empty, else none (no row)."""
    files = listing.filter(_extension_ok(F.col("name"), extensions, prefix))
    rec = F.struct("modificationTime", "path", "name", "length")
    newest = files.groupBy(group).agg(F.max_by(rec, F.struct("modificationTime", "path")).alias("n1"))
    rest = (files.join(newest, group)
            .filter(F.struct("modificationTime", "path") < F.struct(F.col("n1.modificationTime"), F.col("n1.path"))))
    second = rest.groupBy(group).agg(F.max_by(rec, F.struct("modificationTime", "path")).alias("n2"))
    pick = (newest.join(second, group, "left")
            .select(group, F.when(F.col("n1.length") > 0, F.col("n1"))
                    .when(F.col("n2.length") > 0, F.col("n2")).alias("f"))
            .filter(F.col("f").isNotNull()))
    return pick.select(group, "f.path", "f.name", "f.length", "f.modificationTime")


def new_files(before: DataFrame, after: DataFrame, pattern: str | None = None) -> DataFrame:
    """Files present after but not before (by path, as one listing may
    hold several folders), whose name contains ``pattern`` (case-insensitive)."""
    fresh = after.join(before.select("path").distinct(), "path", "left_anti")
    if pattern:
        fresh = fresh.filter(F.lower(F.col("name")).contains(pattern.lower()))
    return fresh


def newest_new_file(before: DataFrame, after: DataFrame, pattern: str | None = None) -> DataFrame:
    """The newest new matching file (one row, or none)."""
    fresh = new_files(before, after, pattern)
    return fresh.agg(F.max_by(F.struct("path", "name", "modificationTime"),
                              F.struct("modificationTime", "path")).alias("f")) \
        .filter(F.col("f").isNotNull()).select("f.*")


def report_target_name(report_type: Column, run_date, pattern: Column | None = None) -> Column:
    """``YYYYMMDD_ebis_{detailed_report | conversion_attribute |
    {pattern}_report}.csv``."""
    d = _dt.date.fromisoformat(str(run_date)) if not isinstance(run_date, _dt.date) else run_date
    day = F.date_format(F.lit(d), "yyyyMMdd")
    other = F.concat(F.coalesce(pattern, report_type) if pattern is not None else report_type, F.lit("_report"))
    name = F.when(report_type == "detailed_analysis", F.lit(REPORT_NAMES["detailed_analysis"])) \
        .when(report_type == "cv_attribute", F.lit(REPORT_NAMES["cv_attribute"])).otherwise(other)
    return F.concat(day, F.lit(REPORT_NAME_INFIX), name, F.lit(".csv"))


def write_snapshot(df: DataFrame, root: str, snapshot_ts: str, fmt: str = "parquet") -> str:
    """S9 sink: land a report as a new ``snapshot_ts=`` partition; earlier
    snapshots stay as they are (the backup of the previous content). Only
    the written snapshot's partition is replaced, so re-running a failed
    landing with the same ``snapshot_ts`` is idempotent."""
    (df.withColumn("snapshot_ts", F.lit(snapshot_ts))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_ts").format(fmt).save(root))
    return root


def latest_snapshot(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The newest snapshot (partition pruning on ``snapshot_ts``)."""
    df = spark.read.format(fmt).load(root)
    newest = df.agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return df.join(newest, "snapshot_ts", "left_semi")
