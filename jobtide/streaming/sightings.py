"""Streams over posting sightings and runs. All use event time and bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.growing import GrowingTables, grow


def file_stream(spark: SparkSession, directory: str, schema, glob: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, a bounded number per trigger."""
    return (
        spark.readStream.schema(schema).format(fmt)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
        .load(directory)
    )


def seen_ranges(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last sighting per key, map-side combined."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def merge_seen(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(new).groupBy(*keys).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def run_window_counts(runs: DataFrame, at: str, status: Column, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Runs per window and status. Sliding windows are put together from panes of one ``slide`` each: rows are counted per pane, and only the
    counts of a pane go to the windows that hold it. ``width`` is a multiple of ``slide``."""
    panes = (
        runs.withWatermark(at, late)
        .groupBy(F.window(at, slide or width).alias("w"), status.alias("status"))
        .agg(F.count("*").alias("runs"))
    )
    if slide:
        panes = panes.groupBy(F.window(F.window_time("w"), width, slide).alias("w"), "status").agg(F.sum("runs").alias("runs"))
    return panes.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "runs")


def run_to_table(stream: DataFrame, out_dir: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that has landed and return the written table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").start(out_dir).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out_dir)


def seen_store(spark: SparkSession, root: str, keys: list[str], schema, buckets: int = 64) -> GrowingTables:
    """An empty (key, first, last) table in key buckets; ``schema`` has the key columns."""
    store = GrowingTables(spark, root, {"seen": tuple(keys)}, buckets)
    own = T.StructType([schema[k] for k in keys]).add("first_seen_at", "timestamp").add("last_seen_at", "timestamp")
    store.fill({"seen": spark.createDataFrame([], own)})
    return store


def keep_seen_table(events: DataFrame, keys: list[str], at: str, store: GrowingTables, checkpoint: str) -> None:
    """Maintain a (key, first, last) table from a stream. A micro-batch reads and replaces only the buckets of its keys;
    one that is repeated after a failure puts the same rows in place again."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        def make() -> dict[str, DataFrame]:
            new = seen_ranges(batch, keys, at)
            return {"seen": merge_seen(store.part("seen", new), new, keys)}

        grow(store, f"batch-{batch_id}", make)

    (
        events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
