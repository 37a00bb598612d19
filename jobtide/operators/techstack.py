"""Technology master data and its assignment to postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..session import cut_lineage
from .skew import spread_join
from .tables import get_or_create, insert_ignore

# Requirement levels in the order in which they are assigned.
LEVELS = ("must_have", "nice_to_have")


def mentions(enrichment: DataFrame, must: str, nice: str) -> DataFrame:
    """(posting, name, level) with trimmed names; the first mention of a name in a posting wins, and
    required items come before optional ones. Arrays, or array literals as text, are accepted."""

    def items(column: str):
        is_text = enrichment.schema[column].dataType.simpleString() == "string"
        return text.parse_array_literal(F.col(column)) if is_text else F.col(column)

    def level(i: int, column: str) -> DataFrame:
        return enrichment.select(
            "job_posting_id", F.explode(items(column)).alias("name"), F.lit(i).alias("_level")
        )

    both = level(0, must).unionByName(level(1, nice)).withColumn("name", text.strip(F.col("name")))
    return (
        both.where(F.col("name") != "")
        .groupBy("job_posting_id", "name")
        .agg(F.min("_level").alias("_level"))
        .select(
            "job_posting_id", "name",
            F.when(F.col("_level") == 0, LEVELS[0]).otherwise(LEVELS[1]).alias("requirement_level"),
        )
    )


def process(enrichment: DataFrame, must: str, nice: str, dim: DataFrame, assigned: DataFrame, item_id: str) -> tuple[DataFrame, DataFrame]:
    """(master data, assignments) after adding the items of ``enrichment``. Only active master rows
    match; an assignment that exists keeps its level. The mentions are stored once (this runs a job)."""
    found = cut_lineage(mentions(enrichment, must, nice))
    active = dim.where("is_active")
    grown, mapping = get_or_create(
        active, found, "name", "id", {"display_name": F.col("name"), "is_active": F.lit(True)}
    )
    new = spread_join(found, mapping, ["name"], "job_posting_id", "inner").select("job_posting_id", F.col("id").alias(item_id), "requirement_level")
    return grown.unionByName(dim.where("NOT is_active"), allowMissingColumns=True), insert_ignore(
        assigned, new, ["job_posting_id", item_id]
    )


def stack_of_jobs(assigned: DataFrame, dim: DataFrame, item_id: str) -> DataFrame:
    """One row per posting with its items, sorted by name, as an array of (name, level)."""
    named = assigned.join(dim.select(F.col("id").alias(item_id), "name"), item_id)
    return named.groupBy("job_posting_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "requirement_level"))).alias("items")
    )
