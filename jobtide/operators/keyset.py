"""Deep pages by a token instead of an offset.

The rows are stored once in their order, cut into range slices, one folder each, with a table of the slices' first rows and
sizes. A page token holds the sort values of the last row shown. The next page starts in the slice the token
falls into and reads no more slices than hold ``limit`` further rows, so a page far down costs what the first one does.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F, types as T

from ..session import cut_lineage, shuffle_width

SLICE = "_slice"


@dataclass(frozen=True)
class Key:
    """A sort column; nulls come last either way."""

    column: str
    descending: bool = False

    @property
    def order(self) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()

    def beyond(self, value: Column | None) -> Column:
        """Whether a row sorts strictly after ``value``; None stands for null."""
        if value is None:
            return F.lit(False)
        c = F.col(self.column)
        return (c < value if self.descending else c > value) | c.isNull()

    def same(self, value: Column | None) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column).eqNullSafe(value)


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A sort value as text that reads back as the same value."""
    return (F.unix_micros(c) if isinstance(kind, T.TimestampType) else c).cast("string")


def _as_value(text: str | None, kind: T.DataType) -> Column | None:
    if text is None:
        return None
    return F.timestamp_micros(F.lit(int(text))) if isinstance(kind, T.TimestampType) else F.lit(text).cast(kind)


class KeysetPages:
    """Pages over rows stored in order below ``path``. The last key must make the order total, as a unique id does."""

    def __init__(self, spark: SparkSession, path: str, keys: list[Key]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    @property
    def _order(self) -> list[Column]:
        return [k.order for k in self.keys]

    def store(self, df: DataFrame, slices: int | None = None) -> None:
        """Write ``df`` in order. Choose ``slices`` so that a slice is a file of ordinary size."""
        cut = df.repartitionByRange(slices or shuffle_width(self.spark), *self._order)
        rows = cut_lineage(cut.withColumn(SLICE, F.spark_partition_id()))
        rows.sortWithinPartitions(SLICE, *self._order).write.mode("overwrite").partitionBy(SLICE).parquet(f"{self.path}/rows")
        # Rank 1 only: every task keeps one row per slice before the shuffle.
        place = F.row_number().over(W.partitionBy(SLICE).orderBy(*self._order))
        first = rows.select(SLICE, *[k.column for k in self.keys]).withColumn("_place", place).where("_place = 1").drop("_place")
        sizes = rows.groupBy(SLICE).agg(F.count("*").alias("_rows"))
        first.join(sizes, SLICE).write.mode("overwrite").parquet(f"{self.path}/fences")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")

    def _after(self, token: str | None) -> Column:
        """Rows behind the token: equal in the first keys and beyond in the next one."""
        if token is None:
            return F.lit(True)
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        values = [_as_value(v, schema[k.column].dataType) for k, v in zip(self.keys, json.loads(token), strict=True)]
        cases = []
        for i, (key, value) in enumerate(zip(self.keys, values)):
            cases.append(reduce(and_, [k.same(v) for k, v in zip(self.keys[:i], values)], key.beyond(value)))
        return reduce(or_, cases)

    def slices(self, token: str | None, limit: int) -> list[int]:
        """The slices the page lies in: that of the token, then as many as hold ``limit`` rows. One fence per slice is gathered."""
        fences = self.spark.read.parquet(f"{self.path}/fences")
        found = sorted(fences.select(SLICE, "_rows", self._after(token).alias("_behind")).collect())
        wanted, rows = [r[SLICE] for r in found if not r["_behind"]][-1:], 0
        for fence in found:
            if fence["_behind"] and rows < limit:
                wanted.append(fence[SLICE])
                rows += fence["_rows"]
        return wanted

    def page(self, limit: int, token: str | None = None) -> DataFrame:
        """The next ``limit`` rows behind ``token`` in order; without a token the first ones."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField(SLICE, T.IntegerType())])).parquet(f"{self.path}/rows")
        inside = rows.where(F.col(SLICE).isin(self.slices(token, limit))).drop(SLICE)
        return inside.where(self._after(token)).orderBy(*self._order).limit(limit)

    def token(self, page: DataFrame) -> str | None:
        """The token behind the last row of a page; None for an empty page. A page is at most ``limit`` rows."""
        back = [F.col(k.column).asc_nulls_first() if k.descending else F.col(k.column).desc_nulls_first() for k in self.keys]
        texts = [_as_text(F.col(k.column), page.schema[k.column].dataType).alias(f"t{i}") for i, k in enumerate(self.keys)]
        last: Row | None = page.orderBy(*back).select(*texts).first()
        return None if last is None else json.dumps(list(last))
