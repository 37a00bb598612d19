"""Points in time against all spans at once, without making a row per pair.

A pair of a point and a span that covers it is fine for one span (:func:`jobtide.plans.joins.near_in_time`); over all spans
the pairs grow with the square of the data. Here every bound and every asked time is put on one time line, which is swept once:
a point then knows how many spans had started and how many had ended before it. With the spans numbered by start and
by end, those two numbers name the spans that cover it, so each point is one row, however many cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordering import global_position, slice_by_order
from .skew import spread_join


def _running(marks: DataFrame, at: str, counts: dict[str, bool]) -> DataFrame:
    """Running totals over one row per time; ``counts`` says of each column whether the row's own count belongs to its total.

    Slices of the time line are summed side by side; of the earlier slices only one row each is looked at.
    """
    sliced = slice_by_order(marks, [F.col(at)])
    inside = W.partitionBy("_slice").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # One row per slice, so at most as many as there are partitions.
    before = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_{c}") for c in counts]).select(
        "_slice", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in counts]
    )

    def total(c: str, own: bool) -> Column:
        upto = F.col(f"_{c}") + F.sum(c).over(inside)
        return (upto if own else upto - F.col(c)).cast("bigint").alias(c)

    return sliced.join(F.broadcast(before), "_slice").select(at, *[total(c, own) for c, own in counts.items()])


def _marks(*parts: tuple[DataFrame, str, str], names: tuple[str, ...]) -> DataFrame:
    """One row per time with the number of rows of each part at it. Rows without a time are left out."""
    rows = None
    for df, column, name in parts:
        one = df.where(F.col(column).isNotNull()).select(
            F.col(column).alias("_at"), *[F.lit(int(n == name)).cast("bigint").alias(n) for n in names]
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("_at").agg(*[F.sum(n).alias(n) for n in names])


def covering_counts(points: DataFrame, at: str, point_id: str, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every point once, with ``spans_started`` (spans with ``lo <= at``), ``spans_ended`` (``hi < at``) and ``spans_open``,
    the number of spans that cover it. Spans with a null bound or ``lo > hi`` cover nothing; a point without a time has zeros."""
    whole = spans.where(F.col(lo) <= F.col(hi))
    names = ("spans_started", "spans_ended")
    marks = _marks((points, at, ""), (whole, lo, names[0]), (whole, hi, names[1]), names=names)
    line = _running(marks, "_at", {names[0]: True, names[1]: False}).withColumnRenamed("_at", at)
    found = spread_join(points, line, [at], point_id)
    started, ended = (F.coalesce(n, F.lit(0).cast("bigint")) for n in names)
    return found.withColumns({names[0]: started, names[1]: ended, "spans_open": started - ended})


def numbered_spans(spans: DataFrame, span_id: str, lo: str, hi: str) -> DataFrame:
    """Spans that cover something, with ``start_rank`` in order of (lo, id) and ``end_rank`` in order of (hi, id), from 1.
    ``span_id`` must be unique."""
    whole = spans.where(F.col(lo) <= F.col(hi))
    placed = global_position(whole, [F.col(lo), F.col(span_id)], "start_rank")
    return global_position(placed, [F.col(hi), F.col(span_id)], "end_rank")


def covers(started: Column, ended: Column) -> Column:
    """Whether a numbered span covers a point with these two counts."""
    return (F.col("start_rank") <= started) & (F.col("end_rank") > ended)


def covered_counts(spans: DataFrame, span_id: str, lo: str, hi: str, points: DataFrame, at: str) -> DataFrame:
    """Every span once, with ``points_inside``, the number of points with ``lo <= at <= hi``; 0 for a span with a null bound or
    ``lo > hi``."""
    marks = _marks((points, at, "n"), (spans, lo, ""), (spans, hi, ""), names=("n",))
    own = marks.withColumn("upto", F.col("n")).withColumnRenamed("n", "before")
    line = _running(own, "_at", {"before": False, "upto": True})
    starts = line.select(F.col("_at").alias(lo), "before")
    ends = line.select(F.col("_at").alias(hi), "upto")
    found = spread_join(spread_join(spans, starts, [lo], span_id), ends, [hi], span_id, keys_from=spans)
    inside = F.when(F.col(lo) <= F.col(hi), F.col("upto") - F.col("before")).otherwise(F.lit(0))
    return found.withColumn("points_inside", inside.cast("bigint")).drop("before", "upto")
