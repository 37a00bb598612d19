"""Streams per key: spans with timers, keys without a horizon, and sliding windows from panes."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobtide.operators import lifecycle
from jobtide.streaming import distinct, inactivity, sightings

T0 = dt.datetime(2025, 1, 1)


def sightings_frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp")


def naive_spans(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        run = []
        for at in sorted(t for k, t in rows if k == key and t is not None):
            if run and (at - run[-1]).total_seconds() >= gap:
                out.append((key, run[0], run[-1] + dt.timedelta(seconds=gap), len(run)))
                run = []
            run.append(at)
        if run:
            out.append((key, run[0], run[-1] + dt.timedelta(seconds=gap), len(run)))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("k", "active_from", "inactive_from", "sightings").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(rng.choice(["hot"] * 8 + ["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 30))) for _ in range(600)]
    return out + [("edge", T0), ("edge", T0 + dt.timedelta(hours=6)), ("edge", T0 + dt.timedelta(hours=11, minutes=59)), ("none", None)]


def test_batch_spans_equal_a_plain_loop(spark, rows):
    gap = 6 * 3600
    assert collected(inactivity.activity_spans(sightings_frame(spark, rows), ["k"], "ts", gap)) == naive_spans(rows, gap)


def test_streamed_spans_over_several_batches(spark, rows, tmp_path):
    gap = 6 * 3600
    source = str(tmp_path / "in")
    ordered = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (ordered[:200], ordered[200:400], ordered[400:]):
        sightings_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = sightings.file_stream(spark, source, sightings_frame(spark, part).schema, "*.parquet")
        spans = inactivity.stream_spans(stream, ["k"], "ts", gap)
        out = inactivity.with_timers(spark, lambda: sightings.run_to_table(spans, table, checkpoint))
    end = max(t for _, t in ordered) - dt.timedelta(hours=1)
    expected = [s for s in naive_spans(ordered, gap) if s[2] <= end]
    assert collected(out) == expected
    # The postings whose last span is over are those that a scan for overdue ones finds.
    last = sightings_frame(spark, ordered).groupBy(F.col("k").alias("id")).agg(F.max("ts").alias("last_seen_at")).withColumn("is_active", F.lit(True))
    days = 1
    spans = inactivity.activity_spans(sightings_frame(spark, ordered), ["k"], "ts", days * 86_400)
    over = {r["k"] for r in spans.groupBy("k").agg(F.max("inactive_from").alias("e")).where(F.col("e") < F.lit(end)).collect()}
    marked = lifecycle.mark_inactive(last.withColumn("detected_inactive_at", F.lit(None).cast("timestamp")), str(end), days)
    assert over == {r["id"] for r in marked.where("NOT is_active").collect()}


def test_streamed_spans_at_the_gap_to_the_microsecond(spark, tmp_path):
    gap, one = 3600, dt.timedelta(microseconds=1)
    hour = dt.timedelta(hours=1)
    rows = [("under", T0 + one), ("under", T0 + hour), ("full", T0 + one), ("full", T0 + hour + one), ("twice", T0), ("twice", T0),
            ("long", T0), *(("long", T0 + i * dt.timedelta(minutes=50)) for i in range(9)), ("later", T0 + dt.timedelta(days=2))]
    source = str(tmp_path / "in")
    sightings_frame(spark, rows).write.parquet(source)
    stream = sightings.file_stream(spark, source, sightings_frame(spark, rows).schema, "*.parquet")
    spans = inactivity.stream_spans(stream, ["k"], "ts", gap)
    # The spans are Spark's own state: no row of a key goes through Python once it is sliced.
    assert "TransformWithState" not in spans._jdf.queryExecution().analyzed().toString()
    out = inactivity.with_timers(spark, lambda: sightings.run_to_table(spans, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert collected(out) == [s for s in naive_spans(rows, gap) if s[0] != "later"]


def test_a_hot_key_sends_one_row_per_slice():
    micros = [i * 1_000_000 for i in range(10_000)]
    batch = pd.DataFrame({"k": ["hot"] * len(micros), "micros": micros})
    (out,) = inactivity._sliced(["k"], 3600)(iter([batch]))
    assert len(out) == 3 and out["sightings"].sum() == 10_000


def test_each_key_once_however_late(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = sightings_frame(spark, []).schema
    store = distinct.distinct_store(spark, str(tmp_path / "store"), ["k"], schema, 4)
    batches = [
        [(f"k{i}", T0) for i in range(300)] + [(None, T0)],
        [(f"k{i}", T0 + dt.timedelta(days=900)) for i in range(250, 350)] + [(None, T0)],  # repeats after years, and a null again
        [(f"k{i}", T0 - dt.timedelta(days=900)) for i in range(340, 360)],  # late ones
    ]
    for batch in batches:
        sightings_frame(spark, batch).write.mode("append").parquet(source)
        distinct.keep_distinct(sightings.file_stream(spark, source, schema, "*.parquet"), ["k"], store, checkpoint, slots=8)
    got = [r["k"] for r in store["keys"].collect()]
    assert len(got) == len(set(got)) and set(got) == {f"k{i}" for i in range(360)} | {None}


def test_filters_spare_most_lookups_and_a_full_one_is_still_right(spark, tmp_path):
    schema = sightings_frame(spark, []).schema
    store = distinct.distinct_store(spark, str(tmp_path / "s"), ["k"], schema, 4)
    known = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("k"))
    for tag, slots in (("one", 8),):
        distinct.grow(store, tag, lambda: distinct.first_sightings(known, store, ["k"], slots))
    held = F.lit(True)
    for place in distinct._places(["k"]):
        held = held & distinct._has(F.col("bits"), place)
    slot = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(8)).cast("int").alias("slot")
    asked = lambda df: df.select("k", slot).join(store["filters"], "slot").where(held).count()
    assert asked(known) == 2000
    other = spark.range(2000).select(F.concat(F.lit("b"), "id").alias("k"))
    assert asked(other) < 20
    crowded = distinct.distinct_store(spark, str(tmp_path / "c"), ["k"], schema, 4)
    many = spark.range(60_000).select(F.concat(F.lit("a"), "id").alias("k"))
    distinct.grow(crowded, "one", lambda: distinct.first_sightings(many, crowded, ["k"], 1))
    distinct.grow(crowded, "two", lambda: distinct.first_sightings(many.unionByName(other), crowded, ["k"], 1))
    assert crowded["keys"].count() == 62_000


def test_rows_go_to_one_pane(spark):
    rows = spark.range(5000).select((F.lit(T0) + F.make_interval(mins=F.col("id") % 3000)).alias("ts"), F.lit("ok").alias("s"))
    found = sightings.run_window_counts(rows, "ts", F.col("s"), "24 hours", "1 hour")
    plain = rows.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), "s").agg(F.count("*").alias("runs")).select("w.start", "w.end", "s", "runs")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
