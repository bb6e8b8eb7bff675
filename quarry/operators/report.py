"""Projections and filters on landed report tables.

Clock values (the run date) are always parameters, never read from the
wall clock inside an operator, so a job re-run after a failure computes the
same result.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The report date column name and the report types.
REPORT_DATE_COLUMN = "日付"
REPORT_TYPES = ("detailed_analysis", "cv_attribute")
REPORT_TYPE_ALIASES = {"conversion_attribute": "cv_attribute"}
TRAFFIC_TYPES = ("all", "organic", "direct", "referral", "social", "paid")
DEFAULT_RANGE_DAYS = 30


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d))


def add_report_date(df: DataFrame, run_date, name: str = REPORT_DATE_COLUMN) -> DataFrame:
    """Prepend ``日付`` = run date - 1 day as 'yyyy-MM-dd' to every row."""
    day = F.date_format(F.date_sub(F.lit(_as_date(run_date)), 1), "yyyy-MM-dd")
    return df.select(day.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def resolve_range(run_date, start=None, end=None, yesterday: bool = False) -> tuple[_dt.date, _dt.date]:
    """Defaults: end = run date, start = end - 30 days; ``yesterday`` = the
    single day before the run date."""
    run = _as_date(run_date)
    if yesterday:
        d = run - _dt.timedelta(days=1)
        return d, d
    e = _as_date(end) if end is not None else run
    s = _as_date(start) if start is not None else run - _dt.timedelta(days=DEFAULT_RANGE_DAYS)
    return s, e


def date_range(df: DataFrame, column: str, run_date, start=None, end=None,
               yesterday: bool = False) -> DataFrame:
    """Keep rows whose date lies in [start, end] inclusive.

    On timestamp/date columns the predicate is written as a half-open range
    on the raw column so it reaches the Parquet scan as a pushed filter; on
    text columns it parses the date.
    """
    s, e = resolve_range(run_date, start, end, yesterday)
    dt = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dt, T.DateType):
        return df.filter((c >= F.lit(s)) & (c <= F.lit(e)))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        # bounds as text cast in the session's zone: the same zone the
        # column's dates are read in, whatever the Python process uses
        lo = f"{s.isoformat()} 00:00:00"
        hi = f"{(e + _dt.timedelta(days=1)).isoformat()} 00:00:00"
        cast = "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else "timestamp"
        return df.filter((c >= F.lit(lo).cast(cast)) & (c < F.lit(hi).cast(cast)))
    d = F.try_to_date(c)  # text that is not a date never matches
    return df.filter((d >= F.lit(s)) & (d <= F.lit(e)))


def traffic_filter(df: DataFrame, column: str, traffic_type: str = "all",
                   known: Sequence[str] = TRAFFIC_TYPES) -> DataFrame:
    """``all`` keeps everything; a type outside the known list falls back
    to all traffic (the tab does not exist), otherwise an equality filter."""
    if traffic_type == "all" or traffic_type not in known:
        return df
    return df.filter(F.col(column) == F.lit(traffic_type))


def preview(df: DataFrame, order_by: str = "rn", n: int = 5) -> DataFrame:
    """First ``n`` rows in file order (a TakeOrderedAndProject, no full
    sort)."""
    return df.orderBy(order_by).limit(n)


def normalize_report_type(col):
    out = col
    for alias, target in REPORT_TYPE_ALIASES.items():
        out = F.when(col == F.lit(alias), F.lit(target)).otherwise(out)
    return out


def requested_types(requested: str) -> list[str]:
    requested = REPORT_TYPE_ALIASES.get(requested, requested)
    if requested == "all":
        return list(REPORT_TYPES)
    if requested not in REPORT_TYPES:
        raise ValueError(f"unknown report type {requested!r}")
    return [requested]


def report_dispatch(df: DataFrame, requested: str = "all", column: str = "report_type") -> DataFrame:
    """P5: rows of the requested report type(s); ``conversion_attribute`` is
    an alias of ``cv_attribute`` on both sides."""
    norm = normalize_report_type(F.col(column))
    return df.withColumn(column, norm).filter(F.col(column).isin(*requested_types(requested)))
