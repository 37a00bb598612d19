"""Type assignments of postings, by run, by search query, or to one default type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .skew import spread_join
from .tables import get_or_create, insert_ignore

KEY = ["job_posting_id", "job_type_id"]


def unassigned(postings: DataFrame, assignments: DataFrame) -> DataFrame:
    """Ids of postings without a type. An anti join, so null assignment ids cannot empty the result."""
    return postings.select(F.col("id").alias("job_posting_id")).join(
        assignments.select("job_posting_id"), "job_posting_id", "left_anti"
    )


def first_run(history: DataFrame) -> DataFrame:
    """The earliest run of each posting (by time, then run id)."""
    return history.groupBy("job_posting_id").agg(
        F.min_by("scrape_run_id", F.struct("detected_at", "scrape_run_id")).alias("scrape_run_id")
    )


def type_by_query(queries: DataFrame) -> DataFrame:
    """Type of each (query, place) pair in lower case; of several the one with the largest id."""
    return queries.where(F.col("job_type_id").isNotNull()).groupBy(
        F.lower("search_query").alias("_query"), F.lower("location_query").alias("_place")
    ).agg(F.max_by("job_type_id", "id").alias("_query_type"))


def types_from_runs(postings: DataFrame, assignments: DataFrame, history: DataFrame, runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(posting, type) for unassigned postings: the type of their first run, else that of the stored
    query with the same words. Postings without either stay out. The first runs are stored once (this runs a job)."""
    seen = first_run(history).join(unassigned(postings, assignments), "job_posting_id", "left_semi")
    r = runs.select(
        F.col("id").alias("scrape_run_id"), "job_type_id",
        F.lower(F.coalesce("search_query", F.lit(""))).alias("_query"),
        F.lower(F.coalesce("location_query", F.lit(""))).alias("_place"),
    )
    return (
        spread_join(cut_lineage(seen.join(r, "scrape_run_id")), type_by_query(queries), ["_query", "_place"], "job_posting_id")
        .select("job_posting_id", F.coalesce("job_type_id", "_query_type").alias("job_type_id"))
        .where(F.col("job_type_id").isNotNull())
    )


def assign_from_runs(postings: DataFrame, assignments: DataFrame, history: DataFrame, runs: DataFrame, queries: DataFrame) -> DataFrame:
    new = types_from_runs(postings, assignments, history, runs, queries).withColumn("assigned_via", F.lit("script"))
    return insert_ignore(assignments, new, KEY)


def assign_all_run_types(assignments: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """Every type of every run an unassigned posting was seen in."""
    typed = runs.where(F.col("job_type_id").isNotNull()).select(F.col("id").alias("scrape_run_id"), "job_type_id")
    new = (
        history.select("job_posting_id", "scrape_run_id")
        .join(assignments.select("job_posting_id"), "job_posting_id", "left_anti")
        .join(typed, "scrape_run_id")
        .select("job_posting_id", "job_type_id", F.lit("migration").alias("assigned_via"))
        .distinct()
    )
    return insert_ignore(assignments, new, KEY)


def assign_on_sighting(assignments: DataFrame, new_history: DataFrame, runs: DataFrame) -> DataFrame:
    """The write-path rule: a sighting of a posting without a type gives it the type of its run; of
    several sightings in one write the earliest with a type counts."""
    typed = runs.where(F.col("job_type_id").isNotNull()).select(F.col("id").alias("scrape_run_id"), "job_type_id")
    new = (
        new_history.join(typed, "scrape_run_id")
        .groupBy("job_posting_id")
        .agg(F.min_by("job_type_id", F.struct("detected_at", "scrape_run_id")).alias("job_type_id"))
        .join(assignments.select("job_posting_id"), "job_posting_id", "left_anti")
        .withColumn("assigned_via", F.lit("trigger"))
    )
    return insert_ignore(assignments, new, KEY)


def assign_default(postings: DataFrame, assignments: DataFrame, types: DataFrame, name: str = "Data") -> tuple[DataFrame, DataFrame]:
    """(assignments, types): every unassigned posting gets the type ``name``, created when missing."""
    wanted = types.sparkSession.createDataFrame([(name,)], "name string")
    types_out, mapping = get_or_create(types, wanted, "name", "id", {"is_active": F.lit(True)})
    new = unassigned(postings, assignments).select(
        "job_posting_id", mapping.agg(F.max("id")).scalar().alias("job_type_id"), F.lit("migration").alias("assigned_via")
    )
    return insert_ignore(assignments, new, KEY), types_out


def coverage(postings: DataFrame, assignments: DataFrame, types: DataFrame, name: str = "Data") -> DataFrame:
    """Labelled counts before/after an assignment run."""
    named = assignments.join(
        types.where(F.col("name") == name).select(F.col("id").alias("job_type_id")), "job_type_id", "left_semi"
    )

    def line(label: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.alias("count")).select(F.lit(label).alias("metric"), "count")

    return (
        line("Total jobs", postings, F.count("*"))
        .unionByName(line("Jobs with type assignment", assignments, F.count_distinct("job_posting_id")))
        .unionByName(line(f"Jobs with {name} type", named, F.count_distinct("job_posting_id")))
        .unionByName(line("Jobs without type", unassigned(postings, assignments), F.count("*")))
    )
