"""Posting activity, backlogs of work to be done elsewhere, re-rank marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.changes import differs
from ..functions.dates import AsOf, before, instant
from .tables import update_where

DEFAULT_INACTIVE_DAYS = 14
RETRY_HOURS = 24

# Fields whose change asks for a new ranking.
RANKING_FIELDS = ("posted_date", "is_active", "title", "company_id", "location_id")


def overdue(as_of: AsOf, days: int = DEFAULT_INACTIVE_DAYS) -> Column:
    return F.col("is_active") & (F.col("last_seen_at") < before(as_of, days=days))


def mark_inactive(postings: DataFrame, as_of: AsOf, days: int = DEFAULT_INACTIVE_DAYS) -> DataFrame:
    return update_where(postings, overdue(as_of, days), {"is_active": False, "detected_inactive_at": instant(as_of)})


def reactivate(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Active again for the postings whose ids are in ``chosen``."""
    marked = postings.join(chosen.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    return update_where(
        marked, F.col("_chosen"), {"is_active": True, "detected_inactive_at": F.lit(None)}
    ).select(*postings.columns)


def job_backlog(enrichment: DataFrame, postings: DataFrame, as_of: AsOf, include_retries: bool = True) -> DataFrame:
    """'Data' postings never enriched, or failed more than a day ago; with the reason."""
    fresh = F.col("enrichment_completed_at").isNull() & F.col("enrichment_error").isNull()
    retry = F.col("enrichment_error").isNotNull() & (
        F.col("enrichment_completed_at") < before(as_of, hours=RETRY_HOURS)
    )
    wanted = (fresh | retry) if include_retries else fresh
    data = postings.where(F.col("title_classification") == "Data").select(F.col("id").alias("job_posting_id"))
    return (
        enrichment.where(wanted).join(data, "job_posting_id", "left_semi")
        .select("job_posting_id", F.when(fresh, "new").otherwise("retry").alias("reason"))
    )


def location_backlog(locations: DataFrame, as_of: AsOf, include_retries: bool = True) -> DataFrame:
    fresh = ~F.coalesce(F.col("ai_enriched"), F.lit(False)) & F.col("ai_enrichment_error").isNull()
    retry = F.col("ai_enrichment_error").isNotNull() & (F.col("ai_enriched_at") < before(as_of, hours=RETRY_HOURS))
    wanted = (fresh | retry) if include_retries else fresh
    return locations.where(wanted).select("id", F.when(fresh, "new").otherwise("retry").alias("reason"))


def company_backlog(companies: DataFrame, master: DataFrame, as_of: AsOf, include_retries: bool = True) -> DataFrame:
    """Companies with no master row, not enriched, or with an old or undated error."""
    m = master.select("company_id", "ai_enriched", "ai_enrichment_error", "ai_enriched_at", F.lit(True).alias("_m"))
    failed = F.coalesce(F.col("ai_enrichment_error"), F.lit("")) != ""
    undone = ~F.coalesce(F.col("ai_enriched"), F.lit(False))
    old = F.col("ai_enriched_at").isNull() | (F.col("ai_enriched_at") < before(as_of, hours=RETRY_HOURS))
    reason = F.when(F.col("_m").isNull() | (undone & ~failed), "new")
    if include_retries:
        reason = reason.when(failed & old, "retry")
    return (
        companies.select("id").join(m, F.col("id") == F.col("company_id"), "left")
        .select("id", reason.alias("reason")).where(F.col("reason").isNotNull())
    )


def data_job_backlog(postings: DataFrame, enrichment: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Active 'Data' postings with a non-empty description and no finished enrichment."""
    wanted = postings.where(F.col("is_active") & (F.col("title_classification") == "Data")).select("id", "title")
    done = enrichment.where(F.col("enrichment_completed_at").isNotNull()).select(F.col("job_posting_id").alias("id"))
    described = descriptions.where(F.length("full_description_text") > 0).select(F.col("job_posting_id").alias("id"))
    return wanted.join(done, "id", "left_anti").join(described, "id", "left_semi")


def missing_role_backlog(enrichment: DataFrame, postings: DataFrame) -> DataFrame:
    """Enrichment rows without a role type whose posting is a 'Data' posting."""
    data = postings.where(F.col("title_classification") == "Data").select(
        F.col("id").alias("job_posting_id"), "title"
    )
    return enrichment.where(F.col("type_datarol").isNull()).select("job_posting_id").join(data, "job_posting_id")


def unclassified_titles(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("title_classification").isNull()).select("id", "title")


def unscored_items(dim: DataFrame) -> DataFrame:
    return dim.where(F.col("relevance_score").isNull()).select("id", "name")


def described(master: DataFrame) -> DataFrame:
    """Companies with a description, the input of the consulting classifier."""
    return master.where(F.col("bedrijfsomschrijving_en").isNotNull()).select("company_id", "bedrijfsomschrijving_en")


def enriched_without_seat(companies: DataFrame, master: DataFrame) -> DataFrame:
    m = master.where(F.col("ai_enriched") & F.col("locatie_belgie").isNull()).select(F.col("company_id").alias("id"))
    return companies.select("id", "name").join(m, "id", "left_semi")


def never_sized(master: DataFrame) -> DataFrame:
    return master.where(F.col("size_category").isNull()).select("id", "company_id")


def select_for_batch(df: DataFrame, ids: DataFrame | None = None, key: str = "id", done: Column | None = None,
                     force: bool = False, limit: int | None = None) -> DataFrame:
    """Explicit ids, or all rows (``force``), or the rows not ``done``; then the first ``limit`` by key."""
    if ids is not None:
        chosen = df.join(ids.select(key), key, "left_semi")
    elif force or done is None:
        chosen = df
    else:
        chosen = df.where(~F.coalesce(done, F.lit(False)))
    return chosen if limit is None else chosen.orderBy(key).limit(limit)


def mark_for_reranking(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``needs_ranking`` set. Any inserted posting, or a change of a ranking field, marks
    that posting and every active one; otherwise flags stay."""
    before_row = old.select("id", F.struct(*RANKING_FIELDS).alias("_old"))
    joined = new.join(before_row, "id", "left")
    changed = F.col("_old").isNull()
    for f in RANKING_FIELDS:
        changed = changed | differs(F.col(f), F.col(f"_old.{f}"))
    marked = joined.withColumn("_changed", changed)
    any_change = marked.agg(F.coalesce(F.bool_or("_changed"), F.lit(False))).scalar()
    return marked.withColumn(
        "needs_ranking",
        F.when(F.col("_changed") | (any_change & F.col("is_active")), True).otherwise(F.col("needs_ranking")),
    ).select(*new.columns)


def apply_ranking_requests(postings: DataFrame, requests: DataFrame) -> DataFrame:
    """``needs_ranking`` set on every active posting that was not ranked since the last request (requested_at). A batch that asks for a
    new ranking of all postings so adds one row instead of rewriting them all."""
    last = requests.agg(F.max("requested_at")).scalar()
    open_ = F.col("is_active") & last.isNotNull() & F.coalesce(F.col("ranking_updated_at") <= last, F.lit(True))
    return update_where(postings, open_, {"needs_ranking": True})


def mark_all_active(postings: DataFrame) -> DataFrame:
    return update_where(postings, F.col("is_active"), {"needs_ranking": True})


def reset_rankings(postings: DataFrame) -> DataFrame:
    """Active 'Data' postings back to unranked."""
    return update_where(
        postings, F.col("is_active") & (F.col("title_classification") == "Data"),
        {
            "ranking_score": F.lit(None), "ranking_position": 999999, "ranking_updated_at": F.lit(None),
            "ranking_metadata": F.lit(None), "needs_ranking": True,
        },
    )
