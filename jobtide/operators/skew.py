"""Joins whose left side may hold most of its rows under a few keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_width

FINE = 8  # parts per even share: parts are placed by hash, and many small ones fill the partitions evenly


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, how: str = "left",
                keys_from: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) without one task getting a hot key's rows.

    A key is hot when it holds more than an even share of one partition, so fewer keys than partitions
    are hot, and their list is safe to broadcast. Each hot key is split into ``FINE`` parts per even share it holds:
    its rows of ``left`` get a part number from ``spread_by``, its row of ``right`` is repeated once per part. Rows whose
    key has a null match nothing and are spread over all partitions. Other keys are left alone.
    Adaptive skew splitting does not cover this case: it needs a plain shuffle on both sides, and
    ``right`` is mostly an aggregate by the same key. ``keys_from`` is a stored frame with the same keys to
    count instead of ``left``, where ``left`` is itself the result of joins.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"cannot split a {how} join")
    width = shuffle_width(left.sparkSession)
    whole = reduce(and_, [F.col(c).isNotNull() for c in on])
    counts = (left if keys_from is None else keys_from).where(whole).groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    parts = F.ceil(F.col("_n") * width * FINE / total).cast("int").alias("_parts")
    hot = F.broadcast(counts.where(F.col("_n") * width > total).select(*on, parts))
    number = F.xxhash64(spread_by)
    own_part = F.when(whole, F.coalesce(F.pmod(number, F.col("_parts")), F.lit(0))).otherwise(F.pmod(number, F.lit(width * FINE)))
    every_part = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    split_left = left.join(hot, on, "left").withColumn("_part", own_part.cast("int")).drop("_parts")
    split_right = right.where(whole).join(hot, on, "left").withColumn("_part", F.explode(every_part)).drop("_parts")
    return split_left.join(split_right, [*on, "_part"], how).drop("_part")
