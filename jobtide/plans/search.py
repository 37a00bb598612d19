"""Posting search: optional filters, order, page and exact total from one predicate builder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import AsOf, posted_within
from ..operators.ordering import page
from ..session import cut_lineage
from .views import Tables

SORTABLE = (
    "ranking_position", "ranking_score", "base_score", "posted_date", "created_at", "last_seen_at", "title",
    "num_applicants", "base_salary_min", "base_salary_max", "id",
)


@dataclass(frozen=True)
class Search:
    search_query: str | None = None
    location: str | None = None
    company_ids: tuple = ()
    location_ids: tuple = ()
    type_ids: tuple = ()
    seniority: tuple = ()
    employment: tuple = ()
    posted_date: str | None = None
    ai_enriched: bool | None = None
    title_classification: str | None = None
    type_datarol: str | None = None
    contract: str | None = None
    subdivision_name_en: str | None = None
    source: str | None = None
    active_only: bool = True
    job_ids: tuple | None = None
    run_id: object | None = None
    sort_field: str = "ranking_position"
    sort_direction: str = "asc"
    limit: int = 50
    offset: int = 0


def contains_text(c: Column, needle: str) -> Column:
    return c.ilike(f"%{needle}%")


def one_of(c: Column, values) -> Column:
    """Membership; an empty list is no filter."""
    return c.isin(*values) if values else F.lit(True)


def location_matches(needle: str) -> Column:
    return (
        contains_text(F.col("city"), needle) | contains_text(F.col("country_code"), needle)
        | contains_text(F.col("region"), needle)
    )


def matching(t: Tables, s: Search, as_of: AsOf) -> DataFrame:
    """Postings that pass every filter. Filters on other tables are semi-joins on their keys, so they
    neither multiply rows nor add columns."""
    found = t["job_postings"]
    if s.job_ids is not None:
        found = found.where(F.col("id").isin(*s.job_ids) if s.job_ids else F.lit(False))
    if s.run_id is not None:
        seen = t["job_scrape_history"].where(F.col("scrape_run_id") == F.lit(s.run_id))
        found = found.join(seen.select(F.col("job_posting_id").alias("id")), "id", "left_semi")
    if s.active_only and s.run_id is None:
        found = found.where("is_active")
    if s.search_query:
        found = found.where(contains_text(F.col("title"), s.search_query))
    found = found.where(
        one_of(F.col("company_id"), s.company_ids)
        & one_of(F.col("location_id"), s.location_ids)
        & one_of(F.col("seniority_level"), s.seniority)
        & one_of(F.col("employment_type"), s.employment)
        & posted_within(F.col("posted_date"), s.posted_date, as_of)
    )
    for column in ("title_classification", "source"):
        wanted = getattr(s, column)
        if wanted:
            found = found.where(F.col(column) == wanted)
    places = t["locations"]
    if s.location:
        places = places.where(location_matches(s.location))
    if s.subdivision_name_en:
        places = places.where(F.col("subdivision_name_en") == s.subdivision_name_en)
    if s.location or s.subdivision_name_en:
        found = found.join(places.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    if s.type_ids:
        typed = t["job_type_assignments"].where(F.col("job_type_id").isin(*s.type_ids))
        found = found.join(typed.select(F.col("job_posting_id").alias("id")), "id", "left_semi")
    e = t["llm_enrichment"]
    if s.type_datarol:
        e = e.where(F.col("type_datarol") == s.type_datarol)
    if s.contract:
        e = e.where(F.array_contains("contract", s.contract))
    if s.type_datarol or s.contract:
        found = found.join(e.select(F.col("job_posting_id").alias("id")), "id", "left_semi")
    if s.ai_enriched is not None:
        done = t["llm_enrichment"].where(F.col("enrichment_completed_at").isNotNull()).select(
            F.col("job_posting_id").alias("id")
        )
        found = found.join(done, "id", "left_semi" if s.ai_enriched else "left_anti")
    return found


def sort_order(s: Search) -> list[Column]:
    """Caller's column with nulls last, best score first among equals, id to make the order total."""
    if s.sort_field not in SORTABLE:
        raise ValueError(f"cannot sort by {s.sort_field!r}")
    c = F.col(s.sort_field)
    first = c.desc_nulls_last() if s.sort_direction.lower() == "desc" else c.asc_nulls_last()
    score = [F.col("ranking_score").desc_nulls_last()] if s.sort_field == "ranking_position" else []
    return [first, *score, F.col("id").asc()]


def count_jobs(t: Tables, s: Search, as_of: AsOf) -> DataFrame:
    return matching(t, s, as_of).agg(F.count("*").alias("total"))


def search_page(t: Tables, s: Search, as_of: AsOf, deep: bool = False) -> DataFrame:
    """The requested page with company, place, sources, types and enrichment state.

    The page is cut first and stored (this runs a job), so the search is done once; only its at most ``limit`` rows meet
    the other tables. ``deep`` as in :func:`page`.
    """
    rows = cut_lineage(page(matching(t, s, as_of), sort_order(s), s.limit, s.offset, deep))
    ids = rows.select(F.col("id").alias("job_posting_id"))
    sources = t["job_sources"].join(ids, "job_posting_id", "left_semi").groupBy("job_posting_id").agg(
        F.array_sort(F.collect_list(F.struct("source", "source_job_id"))).alias("sources")
    )
    types = (
        t["job_type_assignments"].join(ids, "job_posting_id", "left_semi")
        .join(t["job_types"].select(F.col("id").alias("job_type_id"), "name", "color"), "job_type_id")
        .groupBy("job_posting_id")
        .agg(F.array_sort(F.collect_list(F.struct("name", "color"))).alias("job_types"))
    )
    e = t["llm_enrichment"].join(ids, "job_posting_id", "left_semi").select(
        "job_posting_id", "type_datarol", "contract",
        F.col("enrichment_completed_at").isNotNull().alias("ai_enriched"),
    )
    return (
        rows.alias("j")
        .join(t["companies"].select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "logo_url"), "company_id", "left")
        .join(
            t["locations"].select(
                F.col("id").alias("location_id"), F.col("city").alias("location_city"), "country_code", "subdivision_name_en"
            ),
            "location_id", "left",
        )
        .join(sources.withColumnRenamed("job_posting_id", "id"), "id", "left")
        .join(types.withColumnRenamed("job_posting_id", "id"), "id", "left")
        .join(e.withColumnRenamed("job_posting_id", "id"), "id", "left")
        .withColumn("ai_enriched", F.coalesce("ai_enriched", F.lit(False)))
    )


def suggestions(df: DataFrame, column: str, needle: str, limit: int = 10) -> DataFrame:
    """Autocomplete: the first matches in name order."""
    return page(df.where(contains_text(F.col(column), needle)), [F.col(column), F.col("id")], limit)
