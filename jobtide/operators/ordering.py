"""Exact ranks over data that is too big, or too skewed, for one sorted task.

A plain ``row_number`` sorts each group inside one task: a global rank would put the whole table in
one task, and a role type that holds a third of the postings would put a third there. Both ranks here
cut the table into range slices of about equal size first. A row's rank is then its position inside
its own slice plus the number of rows in the slices before it; only those counts are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage, shuffle_width

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def slice_by_order(df: DataFrame, order: list[Column], slice_col: str = "_slice") -> DataFrame:
    """Freeze ``df`` with the number of the range slice each row falls in (0 = first in ``order``)."""
    width = shuffle_width(df.sparkSession)
    sliced = df.repartitionByRange(width, *order).withColumn(slice_col, F.spark_partition_id())
    return cut_lineage(sliced)


def global_position(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based position of every row in ``order`` (which must be total)."""
    width = shuffle_width(df.sparkSession)
    placed = (
        df.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    frozen = cut_lineage(placed)
    in_slice = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    keyed = frozen.withColumn("_slice", F.shiftright("_place", _ROW_BITS))
    # One row per slice, so at most `width` rows: bounded by the partition count, not by the data.
    before = (
        keyed.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("_slice", "_before")
    )
    return (
        keyed.join(F.broadcast(before), "_slice")
        .withColumn(out, (F.col("_before") + in_slice + 1).cast("bigint"))
        .drop("_slice", "_before", "_place")
    )


def group_key(c: Column) -> Column:
    """A non-null text key; null values form a group of their own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def rank_in_groups(
    sliced: DataFrame, group: Column, order: list[Column], out: str, slice_col: str = "_slice"
) -> DataFrame:
    """Rank inside each group for a table cut by :func:`slice_by_order` on the same ``order``.

    The sort runs per (group, slice), so a hot group is spread over as many tasks as it has slices.
    Both inputs of the join are already placed by (group, slice).
    """
    keyed = sliced.withColumn("_group", group_key(group))
    inside = F.row_number().over(W.partitionBy("_group", slice_col).orderBy(*order))
    earlier = W.partitionBy("_group").orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    before = (
        keyed.groupBy("_group", slice_col)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .where(F.col("_before").isNotNull())
        .select("_group", slice_col, "_before")
    )
    return (
        keyed.withColumn("_inside", inside)
        .join(before, ["_group", slice_col], "left")
        .withColumn(out, (F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint"))
        .drop("_group", "_inside", "_before")
    )


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (smallest tuple, compared left to right).

    An aggregate instead of a ranked window: every task keeps one row per key before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, deep: bool = False) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` in ``order``, which should be total.

    A page is a top-k: every task keeps ``offset + limit`` rows. For pages far down that gathers many rows in one
    place; the caller then asks for a ``deep`` page, which is cut by :func:`global_position`, one sort of the whole match.
    """
    if deep:
        placed = global_position(df, order, "_position")
        return placed.where(F.col("_position").between(offset + 1, offset + limit)).drop("_position")
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
