"""ST2: page-change stream.

Keeps, per URL, the last seen state of a page (hash of the source, element
count, body text length) in the state store and emits a row whenever a new
snapshot differs by the page-change rules (H30): different source, more
than 5 elements or more than 20 characters of text difference. The first
snapshot of a URL is emitted as ``first_seen``.

State is one small record per URL in a state processor's value state, so it grows with the
number of pages, not with snapshots; with ``expire_after_ms`` the state of a URL that is not
seen for so long goes. A trigger's rows of one URL are put in order by an external merge sort (sorted runs of at
most ``RUN_ROWS`` rows, the task's scratch files beyond one), so a URL that has most of the snapshots is
worked off in bounded memory. The state lives in RocksDB, which the processor needs.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quarry.session import ship_package

ELEMENT_DELTA = 5
TEXT_DELTA = 20
#: rows of one url that a task holds at a time, and rows of a frame that goes out
RUN_ROWS, OUT_ROWS = 50_000, 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT_SCHEMA = ("url string, snapshot long, source_changed boolean, d_elements long, d_text long, "
                 "changed boolean, first_seen boolean")
STATE_SCHEMA = "hash string, n_elements long, text_len long, snapshot long"


def _in_order(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[tuple]:
    """(snapshot, arrival, hash, n_elements, text_len) of a url's rows by snapshot, earlier arrivals first."""
    def read(path):
        with open(path, "rb") as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return
    runs: list[str] = []
    held: list[tuple] = []
    n = 0
    for b in batches:
        for row in zip(b["snapshot"].tolist(), range(n, n + len(b)), b["hash"].tolist(), b["n_elements"].tolist(), b["text_len"].tolist()):
            held.append(row)
            if len(held) >= RUN_ROWS:
                held.sort(key=lambda r: r[:2])
                runs.append(f"{folder}/{len(runs)}")
                with open(runs[-1], "wb") as f:
                    for at in range(0, len(held), 1000):
                        pickle.dump(held[at:at + 1000], f)
                held = []
        n += len(b)
    held.sort(key=lambda r: r[:2])
    yield from heapq.merge(*map(read, runs), held, key=lambda r: r[:2]) if runs else held


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Compare a url's snapshots in their order, over all Arrow batches of the trigger. A
    snapshot not later than the stored one came too late or twice and is
    passed over."""
    (url,) = key
    prev = state.get if state.exists else None
    cols = ["url", "snapshot", "source_changed", "d_elements", "d_text", "changed", "first_seen"]
    rows = []
    with tempfile.TemporaryDirectory(prefix="quarry-order-") as folder:
        for snapshot, _, hash_, n_elements, text_len in _in_order(batches, folder):
            if prev is not None and int(snapshot) <= prev[3]:
                continue
            if prev is None:
                rows.append((url, int(snapshot), False, 0, 0, True, True))
            else:
                src = hash_ != prev[0]
                de = int(n_elements) - int(prev[1])
                dt = int(text_len) - int(prev[2])
                changed = bool(src or abs(de) > ELEMENT_DELTA or abs(dt) > TEXT_DELTA)
                rows.append((url, int(snapshot), bool(src), de, dt, changed, False))
            prev = (hash_, int(n_elements), int(text_len), int(snapshot))
            if len(rows) >= OUT_ROWS:
                yield pd.DataFrame(rows, columns=cols)
                rows = []
    if prev is not None:
        state.update(prev)
    yield pd.DataFrame(rows, columns=cols)


class _Last:
    """A value state as ``_track`` reads it."""

    def __init__(self, value):
        self._value = value
        self.exists = value.exists()
        self.get = tuple(value.get()) if self.exists else None
        self.update = value.update


class PageTracker(StatefulProcessor):
    def __init__(self, expire_after_ms: int | None):
        self.expire_after_ms = expire_after_ms

    def init(self, handle) -> None:
        self._last = handle.getValueState("last", STATE_SCHEMA, self.expire_after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _track(key, rows, _Last(self._last))

    def close(self) -> None:
        pass


def page_change_stream(metrics: DataFrame, emit_unchanged: bool = False, expire_after_ms: int | None = None) -> DataFrame:
    """``metrics``: streaming rows (url, snapshot, hash, n_elements,
    text_len), e.g. page snapshots passed through H1 + page_metrics. State that has outlived
    ``expire_after_ms`` isn't read any more and is cleaned up with the next data; batches without
    data are switched off for the session then, as an ``availableNow`` run would otherwise never end."""
    spark = metrics.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if expire_after_ms is not None:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = metrics.groupBy("url").transformWithStateInPandas(
        PageTracker(expire_after_ms), OUTPUT_SCHEMA, "Append", "None" if expire_after_ms is None else "ProcessingTime")
    return out if emit_unchanged else out.filter(F.col("changed") | F.col("first_seen"))


def snapshot_metrics(snapshots: DataFrame, elements: DataFrame) -> DataFrame:
    """(url, snapshot, hash, n_elements, text_len) from snapshot rows
    (page_id, url, snapshot, html) and their element table."""
    m = elements.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.coalesce(F.max(F.when(F.col("tag") == "body", F.length("text"))), F.lit(0)).alias("text_len"))
    return (snapshots.select("page_id", "url", "snapshot", F.sha2(F.col("html"), 256).alias("hash"))
            .join(m, "page_id", "left")
            .select("url", "snapshot", "hash", F.coalesce("n_elements", F.lit(0)).cast("long").alias("n_elements"),
                    F.coalesce("text_len", F.lit(0)).cast("long").alias("text_len")))


def _page_stats(html):
    from quarry.functions.html import parse_elements
    rows = parse_elements(html)
    body = [r for r in rows if r[3] == "body"]
    return len(rows), (len(body[0][8]) if body else 0)


@F.pandas_udf(T.StructType([T.StructField("n_elements", T.LongType()), T.StructField("text_len", T.LongType())]))
def page_stats(html: pd.Series) -> pd.DataFrame:
    """Element count and body text length of each page (H1 rules), for
    streaming plans where an aggregate over the element table cannot
    precede the state operator."""
    stats = [_page_stats(h) for h in html]
    return pd.DataFrame(stats, columns=["n_elements", "text_len"])


def stream_metrics(snapshots: DataFrame) -> DataFrame:
    """(url, snapshot, hash, n_elements, text_len) per snapshot row."""
    ship_package(snapshots.sparkSession)
    return snapshots.select("url", F.col("snapshot").cast("long").alias("snapshot"),
                            F.sha2(F.col("html"), 256).alias("hash"), page_stats(F.col("html")).alias("m")
                            ).select("url", "snapshot", "hash", "m.n_elements", "m.text_len")
