"""Scrape-run state: stuck runs, retries, incremental windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.dates import AsOf, before, instant
from .tables import update_from, update_where

STUCK_HOURS, RETRY_DELAY_HOURS, MAX_RETRIES, MIN_INTERVAL_HOURS = 1, 4, 4, 6
QUERY = ["search_query", "location_query"]


def platform_is(name: str) -> Column:
    """Runs of a platform; runs without one belong to the first platform."""
    same = F.col("platform") == name
    return same | F.col("platform").isNull() if name == "linkedin_brightdata" else same


def stuck(as_of: AsOf, hours: int = STUCK_HOURS) -> Column:
    return (F.col("status") == "running") & (F.col("started_at") < before(as_of, hours=hours))


def clean_stuck(runs: DataFrame, as_of: AsOf, hours: int = STUCK_HOURS, platform: str | None = None) -> DataFrame:
    """Stuck runs become failed and are closed now."""
    hit = stuck(as_of, hours)
    if platform:
        hit = hit & platform_is(platform)
    return update_where(runs, hit, {"status": "failed", "completed_at": instant(as_of)})


def repair_states(runs: DataFrame, as_of: AsOf, hours: int = 2) -> DataFrame:
    """Running runs that have an end become completed; those that never started, or are too old, failed."""
    running = F.col("status") == "running"
    too_old = F.col("started_at").isNull() | (F.col("started_at") < before(as_of, hours=hours))
    status = F.when(running & F.col("completed_at").isNotNull(), "completed").when(running & too_old, "failed")
    closed = F.when(running & F.col("completed_at").isNull() & too_old, instant(as_of))
    return runs.withColumns(
        {
            "status": F.coalesce(status, F.col("status")),
            "completed_at": F.coalesce(F.col("completed_at"), closed),
        }
    )


def retry_plan(runs: DataFrame, as_of: AsOf, hours: int = STUCK_HOURS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Running runs with the ``action`` due: completed, permanently_failed, scheduled_retry, still_running."""
    running = runs.where(F.col("status") == "running")
    tries = F.coalesce(F.col("retry_count"), F.lit(0))
    return running.withColumn(
        "action",
        F.when(F.col("completed_at").isNotNull(), "completed")
        .when(F.col("started_at").isNull(), "permanently_failed")
        .when(~stuck(as_of, hours), "still_running")
        .when(tries < max_retries, "scheduled_retry")
        .otherwise("permanently_failed"),
    )


def apply_retry_plan(runs: DataFrame, as_of: AsOf, hours: int = STUCK_HOURS, delay: int = RETRY_DELAY_HOURS,
                     max_retries: int = MAX_RETRIES) -> DataFrame:
    """Runs after the plan: closed ones updated, one ``pending_retry`` run added per scheduled retry. Its id
    is a hash of the run and the number of the retry, so planning twice names it alike."""
    now = instant(as_of)
    due = now + F.make_dt_interval(hours=F.lit(delay))
    planned = retry_plan(runs, as_of, hours, max_retries)
    age = F.format_string("%.1f", dates.age_hours(F.col("started_at"), as_of))
    tries = F.coalesce(F.col("retry_count"), F.lit(0))
    message = (
        F.when((F.col("action") == "permanently_failed") & F.col("started_at").isNull(), F.lit("Run never started properly"))
        .when(
            F.col("action") == "scheduled_retry",
            F.concat(F.lit("Run stuck for "), age, F.lit("h - retry "), (tries + 1).cast("string"), F.lit(f"/{max_retries} scheduled")),
        )
        .when(
            F.col("action") == "permanently_failed",
            F.concat(F.lit("Run stuck for "), age, F.lit(f"h - permanently failed after {max_retries} attempts")),
        )
    )
    closing = F.col("action").isin("permanently_failed", "scheduled_retry")
    changed = planned.withColumns(
        {
            "status": F.when(F.col("action") == "completed", "completed").when(closing, "failed").otherwise(F.col("status")),
            "error_message": message,
            "completed_at": F.when(closing, now).otherwise(F.col("completed_at")),
            "next_retry_at": F.when(F.col("action") == "scheduled_retry", due).otherwise(F.col("next_retry_at")),
        }
    ).drop("action")
    id_type = runs.schema["id"].dataType
    parts = (F.lit("retry"), F.col("id").cast("string"), (tries + 1).cast("string"))
    key = F.sha2(F.concat_ws(":", *parts), 256) if id_type.simpleString() == "string" else F.xxhash64(*parts)  # whole-number ids become long
    retries = planned.where(F.col("action") == "scheduled_retry").select(
        key.alias("id"),
        *QUERY,
        *[c for c in ("search_query_id", "platform") if c in runs.columns],
        F.lit("pending_retry").alias("status"),
        (tries + 1).cast(runs.schema["retry_count"].dataType).alias("retry_count"),
        F.lit(max_retries).alias("max_retries"),
        F.col("id").alias("original_run_id"),
        F.lit(True).alias("is_retry"),
        due.alias("next_retry_at"),
        now.alias("created_at"),
    )
    others = runs.where(~F.coalesce(F.col("status") == "running", F.lit(False)))
    return others.unionByName(changed, allowMissingColumns=True).unionByName(retries, allowMissingColumns=True)


def due_retries(runs: DataFrame, as_of: AsOf) -> DataFrame:
    return runs.where((F.col("status") == "pending_retry") & (F.col("next_retry_at") <= instant(as_of)))


def last_success(runs: DataFrame) -> DataFrame:
    """The latest completed run of each (query, place)."""
    return runs.where(F.col("status") == "completed").groupBy(*QUERY).agg(
        F.max_by("id", F.struct("completed_at", "id")).alias("run_id"), F.max("completed_at").alias("completed_at")
    )


def scrape_windows(queries: DataFrame, runs: DataFrame, as_of: AsOf) -> DataFrame:
    """Look-back window and trigger gate per stored query, from its last successful run."""
    last = last_success(runs).select(*QUERY, "completed_at")
    since = dates.age_whole_days(F.col("completed_at"), as_of)
    manual = F.col("lookback_days") if "lookback_days" in queries.columns else F.lit(None).cast("int")
    days = F.coalesce(manual, dates.incremental_days(since))
    gap = dates.age_hours(F.col("completed_at"), as_of)
    return queries.join(last, QUERY, "left").select(
        "id", *QUERY, since.alias("days_since_success"), days.alias("window_days"),
        dates.lookback_window(days).alias("date_range"),
        F.coalesce(gap >= MIN_INTERVAL_HOURS, F.lit(True)).alias("should_trigger"),
    )


def archive(runs: DataFrame, predicate: Column) -> DataFrame:
    return update_where(runs, predicate, {"archived": True})


def source_from_query(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Runs still marked with the default source take that of their query, then that of their metadata."""
    linked = update_from(
        runs, queries.select(F.col("id").alias("search_query_id"), "source"), ["search_query_id"],
        {"source": F.col("src_source")}, when=F.col("source") == "linkedin",
    )
    return update_where(
        linked,
        (F.get_json_object("metadata", "$.source") == "indeed") & (F.col("source") == "linkedin"),
        {"source": "indeed"},
    )
