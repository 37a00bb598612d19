"""The denormalised views. Each joins on unique keys, so no row is multiplied. The join strategy is left
to the optimizer, which broadcasts a side only when its size statistics allow it. Beyond that size a company
or place may hold a large part of the postings: joins on the company and on the place take turns, because
adaptive execution splits a hot key only where the next step shuffles by something else. A company row
always exists for a posting's company (a foreign key), so its master data can be joined by that id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Tables = Mapping[str, DataFrame]

JOB_FIELDS = (
    "id", "title", "company_id", "location_id", "posted_date", "seniority_level", "employment_type",
    "function_areas", "base_salary_min", "base_salary_max", "apply_url", "num_applicants", "is_active",
    "title_classification",
)
SECTOR_FIELDS = ("sector_nl", "sector_en", "sector_fr")
SIZE_FIELDS = (
    "size_category", "category_nl", "category_en", "category_fr", "size_summary_nl", "size_summary_en",
    "size_summary_fr", "size_confidence",
)
PLACE_FIELDS = (
    "city_name_nl", "city_name_en", "city_name_fr", "subdivision_name_nl", "subdivision_name_en", "subdivision_name_fr",
)
CLASS_FIELDS = (
    "type_datarol", "rolniveau", "seniority", "contract", "sourcing_type", "labels", "samenvatting_kort_en",
    "samenvatting_lang_en", "samenvatting_kort_nl", "samenvatting_lang_nl", "samenvatting_kort_fr",
    "samenvatting_lang_fr", "samenvatting_kort", "samenvatting_lang", "must_have_programmeertalen",
    "nice_to_have_programmeertalen", "must_have_ecosystemen", "nice_to_have_ecosystemen", "must_have_talen",
    "nice_to_have_talen",
)
PERK_FIELDS = (
    "remote_work_policy", "perk_remote_policy", "perk_salary_range", "perk_company_car",
    "perk_hospitalization_insurance", "perk_training_budget", "perk_team_events",
)
RUN_FIELDS = ("enrichment_completed_at", "enrichment_error", "enrichment_model_version")


def _from(alias: str, frame: DataFrame, names) -> list[Column]:
    """Columns of an aliased table; a column the table lacks reads as null."""
    return [
        F.col(f"{alias}.{n}") if n in frame.columns else F.lit(None).cast("string").alias(n) for n in names
    ]


def ranking_view(t: Tables) -> DataFrame:
    """Active postings with everything scoring needs; the original location, not the override.
    Descriptions are reduced to their length at the scan, so no text is shuffled."""
    descriptions = t["job_descriptions"].select(
        "job_posting_id", F.length("full_description_text").alias("description_length")
    )
    return (
        t["job_postings"].where("is_active").alias("jp")
        .join(t["companies"].alias("c"), F.col("jp.company_id") == F.col("c.id"), "left")
        .join(t["locations"].alias("l"), F.col("jp.location_id") == F.col("l.id"), "left")
        .join(t["company_master_data"].alias("cmd"), F.col("jp.company_id") == F.col("cmd.company_id"), "left")
        .join(t["llm_enrichment"].alias("e"), F.col("jp.id") == F.col("e.job_posting_id"), "left")
        .join(descriptions.alias("jd"), F.col("jp.id") == F.col("jd.job_posting_id"), "left")
        .select(
            *[F.col(f"jp.{c}") for c in JOB_FIELDS],
            F.col("c.name").alias("company_name"),
            F.col("c.industry").alias("company_industry"),
            F.col("c.company_url"),
            F.col("c.has_logo"),
            F.col("c.employee_count_range").alias("company_employee_count_range"),
            F.col("c.rating").alias("company_rating"),
            F.col("c.reviews_count").alias("company_reviews_count"),
            F.col("cmd.hiring_model"),
            F.col("l.city").alias("location_city"),
            F.col("e.enrichment_completed_at"),
            F.col("e.type_datarol").alias("data_role_type"),
            F.col("e.hard_skills").alias("skills_must_have"),
            F.col("e.samenvatting_kort_nl").alias("samenvatting_kort"),
            F.col("e.samenvatting_lang_nl").alias("samenvatting_lang"),
            F.col("e.must_have_programmeertalen"),
            F.col("e.nice_to_have_programmeertalen"),
            F.col("e.must_have_ecosystemen"),
            F.col("e.nice_to_have_ecosystemen"),
            F.col("e.labels"),
            F.col("jd.description_length"),
        )
    )


def shown_location() -> Column:
    return F.coalesce(F.col("j.location_id_override"), F.col("j.location_id"))


def _company_part(t: Tables) -> list[Column]:
    m = t["company_master_data"]
    return [
        F.col("c.logo_url"),
        F.col("c.name").alias("company_name"),
        *_from("cmd", m, SECTOR_FIELDS),
        *_from("cmd", m, SIZE_FIELDS),
        *_from("cmd", m, ("aantal_werknemers", "founded_year", "industry")),
    ]


def job_listings(t: Tables) -> DataFrame:
    """Active 'Data' postings with enrichment; the location honours the override."""
    j = t["job_postings"].where(F.col("is_active") & (F.col("title_classification") == "Data"))
    return (
        t["llm_enrichment"].alias("e")
        .join(j.alias("j"), F.col("e.job_posting_id") == F.col("j.id"))
        .join(t["companies"].alias("c"), F.col("j.company_id") == F.col("c.id"))
        .join(t["locations"].alias("l"), F.col("l.id") == shown_location(), "left")
        .join(t["company_master_data"].alias("cmd"), F.col("j.company_id") == F.col("cmd.company_id"), "left")
        .select(
            F.col("e.job_posting_id"),
            *[
                F.col(f"j.{c}")
                for c in (
                    "title", "posted_date", "ranking_position", "base_score", "ranking_score", "hourly_multiplier",
                    "ranking_metadata", "title_classification",
                )
            ],
            *_company_part(t),
            shown_location().alias("location_id"),
            *_from("l", t["locations"], PLACE_FIELDS),
            *_from("e", t["llm_enrichment"], CLASS_FIELDS),
            F.col("e.created_at"),
        )
    )


def job_listings_columnwise(t: Tables) -> DataFrame:
    """The earlier listing: every enrichment row; each place name falls back on its own."""
    places = [
        F.coalesce(F.col(f"o.{n}"), F.col(f"l.{n}")).alias(n) for n in PLACE_FIELDS
    ]
    return (
        _enrichment_star(t)
        .join(t["locations"].alias("o"), F.col("j.location_id_override") == F.col("o.id"), "left")
        .select(*_enrichment_head(t), *places, *_enrichment_tail(t))
    )


def enrichment_active(t: Tables) -> DataFrame:
    """Every enrichment row with posting, company and original location."""
    return _enrichment_star(t).select(
        *_enrichment_head(t), *_from("l", t["locations"], PLACE_FIELDS), *_enrichment_tail(t)
    )


def _enrichment_star(t: Tables) -> DataFrame:
    return (
        t["llm_enrichment"].alias("e")
        .join(t["job_postings"].alias("j"), F.col("e.job_posting_id") == F.col("j.id"), "left")
        .join(t["companies"].alias("c"), F.col("j.company_id") == F.col("c.id"), "left")
        .join(t["locations"].alias("l"), F.col("j.location_id") == F.col("l.id"), "left")
        .join(t["company_master_data"].alias("cmd"), F.col("j.company_id") == F.col("cmd.company_id"), "left")
    )


def _enrichment_head(t: Tables) -> list[Column]:
    return [
        F.col("e.job_posting_id"), F.col("j.title"), F.col("j.posted_date"), F.col("j.ranking_position"),
        *_company_part(t),
    ]


def _enrichment_tail(t: Tables) -> list[Column]:
    e = t["llm_enrichment"]
    return [
        *_from("e", e, CLASS_FIELDS), *_from("e", e, PERK_FIELDS), *_from("e", e, RUN_FIELDS), F.col("e.created_at"),
    ]


MASTER_LIST_FIELDS = (
    "hiring_model", "is_consulting", *SECTOR_FIELDS, "size_category", "category_nl", "category_en", "category_fr",
    "locatie_belgie", "aantal_werknemers", "bedrijfswebsite", "jobspagina", "email_hr", "ai_enriched", "ai_enriched_at",
)


def companies_list(t: Tables) -> DataFrame:
    """Companies with master data and posting counts; counted once per company before the join."""
    counts = t["job_postings"].groupBy("company_id").agg(
        F.count("*").alias("job_count"), F.count_if(F.col("is_active")).alias("active_job_count")
    )
    m = t["company_master_data"]
    return (
        t["companies"].alias("c")
        .join(m.alias("cmd"), F.col("c.id") == F.col("cmd.company_id"), "left")
        .join(counts.alias("n"), F.col("c.id") == F.col("n.company_id"), "left")
        .select(
            *[F.col(f"c.{c}") for c in ("id", "name", "logo_url", "industry", "linkedin_company_id")],
            F.col("cmd.id").alias("master_data_id"),
            *_from("cmd", m, MASTER_LIST_FIELDS),
            F.coalesce("n.job_count", F.lit(0)).alias("job_count"),
            F.coalesce("n.active_job_count", F.lit(0)).alias("active_job_count"),
        )
    )
