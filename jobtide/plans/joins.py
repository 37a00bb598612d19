"""Joins with their own shape: nested detail, time proximity, latest and first per key, natural keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..operators.dedup import best_company_by_name
from ..operators.skew import spread_join
from .views import Tables


def job_details(t: Tables) -> DataFrame:
    """Postings with company, place, description, enrichment, and posters and sources as arrays.

    Both arrays are short by the data model: a posting has one entry per source, and ingest writes one
    poster with a new posting."""
    posters = t["job_posters"].groupBy("job_posting_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "title"))).alias("posters")
    )
    sources = t["job_sources"].groupBy("job_posting_id").agg(
        F.array_sort(F.collect_list(F.struct("source", "source_job_id"))).alias("sources")
    )
    j = t["job_postings"].select("id", "title", "company_id", "location_id")
    return (
        j.join(t["companies"].select(F.col("id").alias("company_id"), F.struct("name", "logo_url").alias("company")), "company_id", "left")
        .join(t["locations"].select(F.col("id").alias("location_id"), F.struct("city", "country_code").alias("location")), "location_id", "left")
        .join(t["job_descriptions"].select(F.col("job_posting_id").alias("id"), "summary", "full_description_text"), "id", "left")
        .join(posters.withColumnRenamed("job_posting_id", "id"), "id", "left")
        .join(sources.withColumnRenamed("job_posting_id", "id"), "id", "left")
        .join(
            t["llm_enrichment"].select(
                F.col("job_posting_id").alias("id"), F.struct("type_datarol", "sourcing_type").alias("enrichment")
            ),
            "id", "left",
        )
    )


def enrichment_of_class(enrichment: DataFrame, postings: DataFrame, classification: str = "Data") -> DataFrame:
    """Enrichment rows whose posting has this title class."""
    wanted = postings.where(F.col("title_classification") == classification).select(F.col("id").alias("job_posting_id"))
    return enrichment.join(wanted, "job_posting_id", "left_semi")


def without_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def with_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def job_history(history: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select(F.col("id").alias("scrape_run_id"), "search_query", "status", "started_at")
    return history.select("job_posting_id", "scrape_run_id", "detected_at").join(r, "scrape_run_id", "left")


def run_jobs(t: Tables, source: str | None = None) -> DataFrame:
    """Postings seen in each run, with company, optionally of one source."""
    j = t["job_postings"].where(F.col("source") == source) if source else t["job_postings"]
    return (
        t["job_scrape_history"].select("scrape_run_id", "job_posting_id", "detected_at")
        .join(j.select(F.col("id").alias("job_posting_id"), "title", "company_id"), "job_posting_id")
        .join(t["companies"].select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left")
    )


def near_in_time(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, bucket_seconds: int = 600) -> DataFrame:
    """Every (point, span) pair with ``lo <= at <= hi``.

    Spans are listed under each time bucket they touch and meet the points of that bucket in an
    equi-join; the exact bounds decide afterwards. A point lies in one bucket, so no pair is doubled.
    """
    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c) / F.lit(bucket_seconds)).cast("bigint")

    ranges = spans.where(F.col(lo) <= F.col(hi)).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi))))
    )
    return (
        points.withColumn("_bucket", bucket(F.col(at)))
        .join(ranges, "_bucket")
        .where(F.col(at).between(F.col(lo), F.col(hi)))
        .drop("_bucket")
    )


def run_spans(runs: DataFrame, open_minutes: int = 10, slack_minutes: int = 1) -> DataFrame:
    """Time span of each run with slack; a run without an end counts as ``open_minutes`` long."""
    slack = F.make_dt_interval(mins=F.lit(slack_minutes))
    end = F.coalesce("completed_at", F.col("started_at") + F.make_dt_interval(mins=F.lit(open_minutes)))
    return runs.where(F.col("started_at").isNotNull()).select(
        F.col("id").alias("run_id"), (F.col("started_at") - slack).alias("span_lo"), (end + slack).alias("span_hi")
    )


def last_scraped(postings: DataFrame, history: DataFrame) -> DataFrame:
    latest = history.groupBy(F.col("job_posting_id").alias("id")).agg(F.max("detected_at").alias("last_scraped_at"))
    return postings.join(latest, "id", "left")


def latest_ranking(postings: DataFrame) -> DataFrame:
    """Active ranked 'Data' postings of the newest ranking run."""
    ranked = postings.where(
        F.col("is_active") & (F.col("title_classification") == "Data") & F.col("ranking_position").isNotNull()
    )
    newest = ranked.agg(F.max("ranking_updated_at")).scalar()
    return ranked.where(F.col("ranking_updated_at") == newest)


def match_postings(records: DataFrame, postings: DataFrame) -> DataFrame:
    """Records (arrival, title, company_name) with the oldest posting of the same dedup key."""
    stored = postings.where(F.col("dedup_key").isNotNull()).groupBy("dedup_key").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("existing_id")
    )
    keyed = records.withColumn("dedup_key", text.dedup_key(F.col("title"), F.col("company_name")))
    return spread_join(keyed, stored, ["dedup_key"], "arrival")


def match_companies(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Records (arrival, linkedin_company_id, company_name) with their company: by vendor id, or by name only
    when they have none."""
    by_id = companies.where(F.col("linkedin_company_id").isNotNull()).groupBy("linkedin_company_id").agg(F.min("id").alias("_by_id"))
    by_name = best_company_by_name(companies.select("id", "name", "has_logo", "linkedin_company_id")).select(
        F.col("name").alias("company_name"), F.col("id").alias("_by_name")
    )
    return (
        spread_join(
            spread_join(records, by_id, ["linkedin_company_id"], "arrival"), by_name, ["company_name"], "arrival",
            keys_from=records,
        ).withColumn(
            "company_id",
            F.when(F.col("linkedin_company_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_name")),
        )
        .drop("_by_id", "_by_name")
    )
