"""All spans at once: counts of the sweep against plain range tests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobtide.operators import sweep

T0 = dt.datetime(2025, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # A third of the points and many bounds share one instant; bounds touch points; some spans are reversed or open.
    points = [(i, 500 if i % 3 == 0 else rng.randrange(1000)) for i in range(600)] + [(1000, None), (1001, -50), (1002, 5000)]
    spans = [(i, lo, lo + rng.choice([0, 1, 7, 300])) for i, lo in ((i, 500 if i % 4 == 0 else rng.randrange(1000)) for i in range(200))]
    return points, spans + [(900, 40, 30), (901, None, 70), (902, 70, None)]


@pytest.fixture(scope="module")
def frames(spark, rows):
    points, spans = rows
    return (
        spark.createDataFrame([(i, at(s)) for i, s in points], "p long, at timestamp"),
        spark.createDataFrame([(i, at(a), at(b)) for i, a, b in spans], "s long, lo timestamp, hi timestamp"),
    )


def inside(s, lo, hi):
    return None not in (s, lo, hi) and lo <= s <= hi


def test_points_know_their_spans(spark, rows, frames):
    points, spans = rows
    got = {r["p"]: r for r in sweep.covering_counts(frames[0], "at", "p", frames[1], "lo", "hi").collect()}
    numbered = sweep.numbered_spans(frames[1], "s", "lo", "hi").collect()
    assert len(got) == len(points) and sorted(r["start_rank"] for r in numbered) == list(range(1, 201))
    for p, s in points:
        expected = {i for i, lo, hi in spans if inside(s, lo, hi)}
        assert got[p]["spans_open"] == len(expected)
        named = {r["s"] for r in numbered if r["start_rank"] <= got[p]["spans_started"] and r["end_rank"] > got[p]["spans_ended"]}
        assert named == expected


def test_spans_count_their_points(rows, frames):
    points, spans = rows
    got = {r["s"]: r["points_inside"] for r in sweep.covered_counts(frames[1], "s", "lo", "hi", frames[0], "at").collect()}
    assert got == {i: sum(inside(s, lo, hi) for _, s in points) for i, lo, hi in spans}


def test_empty_sides(frames):
    points, spans = frames
    assert sweep.covering_counts(points, "at", "p", spans.limit(0), "lo", "hi").where("spans_open <> 0").count() == 0
    assert sweep.covering_counts(points.limit(0), "at", "p", spans, "lo", "hi").count() == 0
    assert sweep.covered_counts(spans, "s", "lo", "hi", points.limit(0), "at").agg(F.sum("points_inside")).first()[0] == 0


def test_equal_ranks_of_covering_condition(frames):
    """The columns form of the condition, in an equi-join-free check of one point."""
    one = sweep.covering_counts(frames[0], "at", "p", frames[1], "lo", "hi").where("p = 0").first()
    numbered = sweep.numbered_spans(frames[1], "s", "lo", "hi")
    held = numbered.where(sweep.covers(F.lit(one["spans_started"]), F.lit(one["spans_ended"])))
    assert held.count() == one["spans_open"] > 0
