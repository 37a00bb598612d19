"""Dashboard figures from partial aggregates that batches leave behind.

A batch is reduced to one row per day (counts, sketches of distinct values and of quantiles), appended under its tag and merged with
the others on read. A new batch reads only itself; a figure over any range of days reads one row per day and batch.

Counts are exact, also when rows change: a change is its old row with weight -1 and its new row with weight 1. Sketches
cannot forget, so they see rows of weight 1 only and answer over everything that was ever true. HyperLogLog with ``2**DISTINCT_BITS`` registers has a
standard error of 1.04 / sqrt(4096) = 1.6 %; KLL quantiles of size ``QUANTILE_SIZE`` are off by about 1.3 % in rank.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .growing import GrowingTables, grow

DISTINCT_BITS = 12
QUANTILE_SIZE = 200
WEIGHT = "_weight"
TABLE = "partials"


@dataclass(frozen=True)
class Figures:
    """What to keep per day, as SQL expressions over a batch's rows: ``counts`` by condition, ``distinct`` and ``quantiles`` by value.
    ``day`` is a date, or null for rows without one."""

    day: str
    counts: Mapping[str, str]
    distinct: Mapping[str, str] = field(default_factory=dict)
    quantiles: Mapping[str, str] = field(default_factory=dict)

    def partial(self, rows: DataFrame) -> DataFrame:
        """One row per day. ``rows`` may carry a weight of 1 or -1."""
        weight = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1)
        present = weight > 0
        kept = {n: F.sum(F.when(F.expr(c), weight).otherwise(0)).cast("bigint") for n, c in self.counts.items()}
        kept |= {n: F.hll_sketch_agg(F.when(present, F.expr(c)), F.lit(DISTINCT_BITS)) for n, c in self.distinct.items()}
        kept |= {n: F.kll_sketch_agg_double(F.when(present, F.expr(c).cast("double")), F.lit(QUANTILE_SIZE)) for n, c in self.quantiles.items()}
        return rows.groupBy(F.expr(self.day).alias("day")).agg(*[c.alias(n) for n, c in kept.items()])

    def merged(self, partials: DataFrame, by_day: bool, fractions: tuple[float, ...]) -> DataFrame:
        out = {n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint") for n in self.counts}
        out |= {n: F.hll_sketch_estimate(F.hll_union_agg(n)) for n in self.distinct}
        out |= {n: F.kll_merge_agg_double(n) for n in self.quantiles}
        rows = (partials.groupBy("day") if by_day else partials.groupBy()).agg(*[c.alias(n) for n, c in out.items()])
        asked = F.array(*[F.lit(float(f)) for f in fractions])
        # A sketch of nothing has no quantiles.
        return rows.withColumns({
            n: F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, asked)) for n in self.quantiles
        })


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of a change: what was counted is taken back, what holds now is counted."""
    return old.withColumn(WEIGHT, F.lit(-1)).unionByName(new.withColumn(WEIGHT, F.lit(1)))


class DailyFigures:
    """Figures kept by day below ``root``. One writer; a batch that is repeated under its tag counts once."""

    def __init__(self, spark: SparkSession, root: str, figures: Figures):
        self.figures, self.tables = figures, GrowingTables(spark, root, {})

    def start(self, rows: DataFrame) -> None:
        """Begin with ``rows``, which may be empty."""
        self.tables.fill({TABLE: self.figures.partial(rows)})

    def add(self, tag: str, rows: DataFrame) -> None:
        grow(self.tables, tag, lambda: {TABLE: self.figures.partial(rows)})

    def _within(self, first_day: str | None, last_day: str | None) -> DataFrame:
        kept = self.tables[TABLE]
        if first_day is not None:
            kept = kept.where(F.col("day") >= F.lit(first_day).cast("date"))
        return kept if last_day is None else kept.where(F.col("day") <= F.lit(last_day).cast("date"))

    def total(self, first_day: str | None = None, last_day: str | None = None, fractions: tuple[float, ...] = (0.5,)) -> DataFrame:
        """One row over the days of the range, bounds included; without bounds over all rows, those without a day too."""
        return self.figures.merged(self._within(first_day, last_day), False, fractions)

    def by_day(self, first_day: str | None = None, last_day: str | None = None, fractions: tuple[float, ...] = (0.5,)) -> DataFrame:
        """One row per day. A day of which all rows were taken back stays, with zeros."""
        return self.figures.merged(self._within(first_day, last_day), True, fractions)
