"""Listings and detail reads for companies, runs, queries, failures and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import AsOf, before, instant
from ..operators.ordering import page
from ..operators.runs import platform_is
from .search import contains_text, location_matches
from .views import Tables


def company_listing(t: Tables, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Page of companies with their master data as one struct, null when there is none."""
    found = t["companies"].where(contains_text(F.col("name"), search)) if search else t["companies"]
    rows = page(found, [F.col("name"), F.col("id")], limit, offset)
    m = t["company_master_data"]
    fields = [c for c in m.columns if c != "company_id"]
    nested = m.select("company_id", F.struct(*fields).alias("company_master_data"))
    return rows.join(nested, rows["id"] == nested["company_id"], "left").drop("company_id")


def company_total(t: Tables, search: str | None = None) -> DataFrame:
    found = t["companies"].where(contains_text(F.col("name"), search)) if search else t["companies"]
    return found.agg(F.count("*").alias("total"))


def active_dimension(dim: DataFrame) -> DataFrame:
    return dim.where("is_active").orderBy("name", "id")


def location_listing(t: Tables, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = t["locations"].where(location_matches(search)) if search else t["locations"]
    return page(found, [F.col("city").asc_nulls_last(), F.col("id")], limit, offset)


def inactive_listing(t: Tables, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = page(
        t["job_postings"].where(~F.col("is_active")),
        [F.col("detected_inactive_at").desc_nulls_last(), F.col("id")], limit, offset,
    )
    return with_names(t, rows).select("id", "title", "detected_inactive_at", "company_name", "location_city")


def with_names(t: Tables, postings: DataFrame) -> DataFrame:
    return postings.join(
        t["companies"].select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left"
    ).join(
        t["locations"].select(F.col("id").alias("location_id"), F.col("city").alias("location_city")), "location_id", "left"
    )


def jobs_by_hiring_model(t: Tables, model: str, classification: str | None = None) -> DataFrame:
    """Postings whose company has this hiring model."""
    jobs = t["job_postings"]
    if classification:
        jobs = jobs.where(F.col("title_classification") == classification)
    firms = t["company_master_data"].where(F.col("hiring_model") == model).select("company_id", "hiring_model")
    names = t["companies"].select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return jobs.join(firms.join(names, "company_id"), "company_id")


def recent_failures(df: DataFrame, key: str, error: str, at: str, parents: DataFrame, parent_key: str, name: str, limit: int) -> DataFrame:
    """Newest rows with an error, with the name of their parent."""
    rows = page(
        df.where(F.col(error).isNotNull()), [F.col(at).desc_nulls_last(), F.col(key)], limit
    ).select(F.col(key).alias("_key"), F.col(error).alias("error"), F.col(at).alias("failed_at"))
    named = parents.select(F.col(parent_key).alias("_key"), F.col(name).alias("name"))
    return rows.join(named, "_key", "left").withColumnRenamed("_key", "id")


def active_runs(runs: DataFrame, platform: str, limit: int = 10) -> DataFrame:
    return page(
        runs.where((F.col("status") == "running") & platform_is(platform)),
        [F.col("started_at").desc_nulls_last(), F.col("id")], limit,
    )


def run_page(runs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = runs.where(F.col("status") == status) if status else runs
    return page(found, [F.col("started_at").desc_nulls_last(), F.col("id")], limit, offset)


def run_listing(t: Tables, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of runs with their type's name and the defaults a client expects."""
    types = t["job_types"].select(F.col("id").alias("job_type_id"), F.col("name").alias("job_type"), "color")
    rows = run_page(t["scrape_runs"], status, limit, offset)
    return rows.join(types, "job_type_id", "left").withColumns(
        {
            "source": F.coalesce("source", F.lit("linkedin")),
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("jobs_found", "jobs_new", "jobs_updated")},
            "archived": F.coalesce("archived", F.lit(False)),
        }
    )


def run_detail(runs: DataFrame) -> DataFrame:
    """Counters of every run; those kept in the metadata default to 0 and to an empty list."""
    counters = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("jobs_found", "jobs_new", "jobs_updated")}
    return runs.select(
        "id", "search_query", "location_query", "status", "started_at", "completed_at",
        *[v.alias(c) for c, v in counters.items()],
        F.coalesce(F.get_json_object("metadata", "$.jobs_error").try_cast("bigint"), F.lit(0)).alias("jobs_error"),
        F.coalesce(
            F.from_json(F.get_json_object("metadata", "$.error_details"), "array<string>"),
            F.array().cast("array<string>"),
        ).alias("error_details"),
        F.lit(0).alias("jobs_skipped"),
    )


def of_source(df: DataFrame, source: str) -> DataFrame:
    """Rows of a source; rows without one belong to the first source."""
    mine = F.col("source") == source
    return df.where(mine | F.col("source").isNull() if source == "linkedin" else mine)


def query_page(queries: DataFrame, source: str, active: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest queries of a source."""
    found = of_source(queries, source)
    if active is not None:
        found = found.where(F.col("is_active") == F.lit(active))
    return page(found, [F.col("created_at").desc_nulls_last(), F.col("id")], limit, offset)


def query_history(queries: DataFrame, runs: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Queries with their last run, total jobs and run count. ``keys``: pairs (query column, run column)."""
    run_keys = [r for _, r in keys]
    totals = runs.groupBy(*run_keys).agg(
        F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("_last"),
        F.max("started_at").alias("last_run_at"),
        F.sum(F.coalesce("jobs_found", F.lit(0))).alias("_jobs"),
        F.count("*").alias("_runs"),
    )
    totals = totals.select(
        *[F.col(r).alias(f"_k{i}") for i, r in enumerate(run_keys)],
        F.col("_last.id").alias("last_run_id"), F.col("_last.status").alias("last_run_status"), "last_run_at", "_jobs", "_runs",
    )
    on: Column = F.lit(True)
    for i, (q, _) in enumerate(keys):
        on = on & (F.col(q) == F.col(f"_k{i}"))
    return (
        queries.join(totals, on, "left")
        .withColumns({"total_jobs": F.coalesce("_jobs", F.lit(0)), "run_count": F.coalesce("_runs", F.lit(0))})
        .drop("_jobs", "_runs", *[f"_k{i}" for i in range(len(keys))])
    )


def ageing_failures(df: DataFrame, error: str, at: str, as_of: AsOf, hours: int = 23) -> DataFrame:
    """Failed rows about to be retried, with their age, oldest first."""
    return (
        df.where(F.col(error).isNotNull() & (F.col(at) < before(as_of, hours=hours)))
        .withColumn("age_hours", (F.unix_micros(instant(as_of)) - F.unix_micros(at)) / F.lit(3_600_000_000))
        .orderBy(at, "id")
    )
