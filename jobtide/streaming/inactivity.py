"""Spans of activity and inactivity after a gap, ended in event time.

Rows of a key within one gap-long slice of time are one span in any case, so they are put together before the shuffle: a
key sends a row or two per slice, however many sightings it has. The state of a key is its open spans, session windows of Spark: the watermark that
passes the end of a span's gap writes the span and drops it from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def activity_spans(events: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, active_from, inactive_from, sightings): a span ends when nothing is seen for ``gap`` seconds. Rows without a time are left out.

    Only one row per key and gap-long slice reaches the window, so a hot key is as small as any other.
    """
    micros = F.unix_micros(at)
    slices = events.where(F.col(at).isNotNull()).groupBy(*keys, F.floor(micros / F.lit(gap * 1_000_000)).alias("_slice")).agg(
        F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("sightings")
    )
    order = W.partitionBy(*keys).orderBy("first")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(order) >= gap * 1_000_000, F.lit(True)).cast("long")
    runs = slices.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    spans = runs.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sightings").alias("sightings"))
    return _as_times(spans, keys, gap)


def _as_times(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    return spans.select(
        *keys, F.timestamp_micros("first").alias("active_from"), F.timestamp_micros(F.col("last") + gap * 1_000_000).alias("inactive_from"), "sightings"
    )


def _sliced(keys: list[str], gap: int):
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.assign(slice=batch["micros"] // (gap * 1_000_000)).groupby([*keys, "slice"], dropna=False)["micros"]
            found = rows.agg(first="min", last="max", sightings="count").reset_index().drop(columns="slice")
            found["at"] = pd.to_datetime(found["last"], unit="us")
            yield found[[*keys, "first", "last", "sightings", "at"]]

    return combine


def stream_spans(events: DataFrame, keys: list[str], at: str, gap: int, late: str = "1 hour") -> DataFrame:
    """:func:`activity_spans` of a stream: a span is written once the watermark has passed its end. Needs the RocksDB
    state store (see :func:`with_timers`).

    A slice is a sighting at its first and one at its last time, less than a gap apart, so the session windows of these are the spans. Windows that
    touch are merged, but a gap to the full ends a span: a window ends one microsecond before its gap does.
    """
    schema = events.schema
    sliced = T.StructType([schema[k] for k in keys]).add("first", "long").add("last", "long").add("sightings", "long").add("at", "timestamp")
    rows = events.where(F.col(at).isNotNull()).select(*keys, F.unix_micros(at).alias("micros")).mapInPandas(_sliced(keys, gap), sliced)
    end = F.struct(F.col("at"), F.when(F.col("first") < F.col("last"), 1).otherwise(F.col("sightings")).alias("n"))
    start = F.when(F.col("first") < F.col("last"), F.struct(F.timestamp_micros("first").alias("at"), (F.col("sightings") - 1).alias("n")))
    ends = rows.select(*keys, F.explode(F.array_compact(F.array(start, end))).alias("_e")).select(*keys, F.col("_e.at").alias("at"), F.col("_e.n").alias("n"))
    window = F.session_window("at", f"{gap * 1_000_000 - 1} microseconds").alias("_w")
    spans = ends.withWatermark("at", late).groupBy(*keys, window).agg(F.sum("n").alias("sightings"))
    return spans.select(*keys, F.col("_w.start").alias("active_from"), (F.col("_w.end") + F.expr("INTERVAL 0.000001 SECOND")).alias("inactive_from"), "sightings")


def with_timers(spark, run):
    """``run()`` with a state store that keeps the open spans on disk; the setting is put back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return run()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
