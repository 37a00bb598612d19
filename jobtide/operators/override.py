"""Vague locations and the company seat shown instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import location, text
from ..session import cut_lineage
from .skew import spread_join
from .tables import update_from


def active_patterns(spark, config: DataFrame | None) -> DataFrame:
    """Active patterns of the stored configuration; the fixed default list when none is active."""
    defaults = spark.createDataFrame([(p,) for p in location.VAGUE_PATTERNS], "pattern string")
    if config is None:
        return defaults
    active = config.where("is_active").select("pattern").distinct()
    none_active = active.agg(F.count("*") == 0).scalar()
    return active.unionByName(defaults.where(none_active))


def vague_strings(rows: DataFrame, column: str, config: DataFrame | None) -> DataFrame:
    """Distinct values of ``column`` that start with an active pattern.

    Written as an equi-join: each distinct string is expanded to its prefixes of the lengths that patterns have, so
    neither side is broadcast and no pair of rows is tested in vain.
    """
    patterns = active_patterns(rows.sparkSession, config)
    lengths = patterns.where(F.length("pattern") > 0).agg(F.collect_set(F.length("pattern"))).scalar()
    strings = rows.select(column).where(F.length(column) > 0).distinct()
    cuts = strings.select(column, F.explode(lengths).alias("_n")).where(F.col("_n") <= F.length(column))
    prefixes = cuts.select(column, F.substring(F.col(column), F.lit(1), F.col("_n")).alias("pattern"))
    return prefixes.join(patterns, "pattern", "left_semi").select(column).distinct()


def vague_by_city(locations: DataFrame, config: DataFrame | None) -> DataFrame:
    """Locations whose city is exactly a pattern (the backfill's test)."""
    patterns = active_patterns(locations.sparkSession, config)
    return locations.join(patterns.withColumnRenamed("pattern", "city"), "city", "left_semi")


def backfill_override(
    postings: DataFrame, locations: DataFrame, master: DataFrame, config: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, locations, summary) after giving postings with a vague location their company's seat."""
    vague = vague_by_city(locations, config).select(F.col("id").alias("location_id")).distinct()
    affected = postings.select("id", "company_id", "location_id").join(vague, "location_id", "left_semi")
    seats = master.where(~text.is_placeholder(F.col("locatie_belgie"))).groupBy("company_id").agg(
        F.min("locatie_belgie").alias("_seat")
    )
    wanted = spread_join(affected, seats, ["company_id"], "id").withColumn(
        "full_location_string", text.strip(F.concat("_seat", F.lit(", Belgium")))
    )
    wanted = cut_lineage(wanted)
    id_type = locations.schema["id"].dataType
    hashed = F.xxhash64("full_location_string") if id_type.simpleString() == "bigint" else F.sha2("full_location_string", 256)
    stored = locations.groupBy("full_location_string").agg(F.min("id").alias("_id"))
    mapping = (
        wanted.select("full_location_string").where(F.col("full_location_string").isNotNull()).distinct()
        .join(stored, "full_location_string", "left")
        .withColumn("_key", F.coalesce("_id", hashed))
    )
    columns = location.location_columns(F.col("full_location_string"))
    fresh = mapping.where(F.col("_id").isNull()).select(
        F.col("_key").alias("id"), *[v.alias(k) for k, v in columns.items()], F.lit(False).alias("ai_enriched")
    )
    keys = mapping.select("full_location_string", F.col("_key").alias("to"))
    moves = spread_join(wanted, keys, ["full_location_string"], "id", "inner").select("id", "to")
    summary = wanted.agg(
        F.count("*").alias("processed"),
        F.count("_seat").alias("updated"),
        F.count_if(F.col("_seat").isNull()).alias("skipped"),
    )
    moved = update_from(postings, moves, ["id"], {"location_id_override": F.col("src_to")})
    return moved, locations.unionByName(fresh, allowMissingColumns=True), summary
