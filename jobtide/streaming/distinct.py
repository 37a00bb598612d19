"""Repeat suppression without a horizon: each key once, however long ago it was seen before.

The keys seen so far are a growing table in key buckets, with a Bloom filter per slot of keys beside it. Of a micro-batch, keys
that their filter does not know are new for certain; only the others are held against the stored keys, and only in
the buckets they fall into. No state is kept in the stream, and no key is lost or repeated because of its time.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.growing import GrowingTables, grow
from ..session import store_wide

BITS = 32_768  # of a filter: the size of Spark's bitmaps
HASHES = 4


def distinct_store(spark: SparkSession, root: str, keys: list[str], schema, buckets: int = 64) -> GrowingTables:
    """An empty table of ``keys`` (their types from ``schema``) with its filters."""
    store = GrowingTables(spark, root, {"filters": ("slot",)}, buckets, {"keys": tuple(keys)})
    store.fill({
        "keys": spark.createDataFrame([], T.StructType([schema[k] for k in keys])),
        "filters": spark.createDataFrame([], "slot int, bits binary"),
    })
    return store


def _places(keys: list[str]) -> list[Column]:
    """Bit positions of a key in its filter."""
    return [F.pmod(F.xxhash64(*keys, F.lit(i + 2)), F.lit(BITS)) for i in range(HASHES)]


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def first_sightings(batch: DataFrame, store: GrowingTables, keys: list[str], slots: int) -> dict[str, DataFrame]:
    """What a batch adds: its keys that were never seen (nulls are a value like others), and the filters with them."""
    slot = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(slots)).cast("int").alias("slot")
    own = store_wide(batch.select(*keys).distinct().select(*keys, slot))
    filters = store.part("filters", own)
    held = reduce(and_, [_has(F.col("bits"), p) for p in _places(keys)])
    asked = own.join(filters, "slot", "left").select(*keys, "slot", F.coalesce(held, F.lit(False)).alias("held"))
    asked = store_wide(asked)
    suspects = asked.where("held").alias("s")
    known = store.part("keys", asked.where("held").select(*keys)).alias("k")
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys])
    fresh = asked.where("NOT held").unionByName(suspects.join(known, same, "left_anti"))
    fresh = store_wide(fresh.select(*keys, "slot"))
    bits = fresh.select("slot", F.explode(F.array(*_places(keys))).alias("place")).groupBy("slot").agg(F.bitmap_construct_agg("place").alias("bits"))
    return {"keys": fresh.select(*keys), "filters": filters.unionByName(bits).groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits"))}


def keep_distinct(events: DataFrame, keys: list[str], store: GrowingTables, checkpoint: str, slots: int = 1024) -> None:
    """Add the keys of a stream to ``store``, each once; the table ``keys`` then holds what DISTINCT over all events would.

    ``slots`` filters of 4 KB each hold about 3,000 keys with one needless look-up in fifty; beyond that there are more look-ups, never a wrong
    answer. A micro-batch that Spark repeats puts the same keys in place again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        grow(store, f"batch-{batch_id}", lambda: first_sightings(batch, store, keys, slots))

    (
        events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
