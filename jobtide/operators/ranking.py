"""The ranking run: scores, diversity ranks, modifiers, final order, stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonx, scores
from ..functions.dates import AsOf, instant
from ..session import store_wide
from .ordering import global_position, group_key, rank_in_groups, slice_by_order
from .tables import update_from

RANK_KEYS = (
    ("company_rank", "company_id"),
    ("role_type_rank", "data_role_type"),
    ("location_rank", "location_id"),
    ("seniority_rank", "seniority"),
)
COMPONENTS = tuple(name for name, _ in scores.WEIGHTS)


def score_postings(view: DataFrame, as_of: AsOf) -> DataFrame:
    """Component scores and base score of the ranking view, without the long texts."""
    length = F.length("description_text") if "description_text" in view.columns else F.col("description_length")
    scored = view.where("is_active").select(
        "id", "company_id", "location_id", "data_role_type", "title_classification", "enrichment_completed_at",
        jsonx.label_value(F.col("labels"), "seniority").alias("seniority"),
        scores.freshness(F.col("posted_date"), as_of).alias("freshness_score"),
        scores.quality(length).alias("quality_score"),
        scores.transparency().alias("transparency_score"),
        scores.role_match(F.col("data_role_type")).alias("role_match_score"),
        scores.completeness().alias("completeness_score"),
        scores.reputation().alias("reputation_score"),
    )
    return scored.withColumn("base_score", scores.base_score()).drop("enrichment_completed_at")


def _best_first(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("id").asc()]


NARROW = ("id", "base_score", "title_classification")


def diversity_ranks(scored: DataFrame) -> DataFrame:
    """(NARROW, one rank per RANK_KEYS): rank by base score inside company, role type, location and seniority; ties go by id.

    Only ids, scores and keys take part. They are cut into range slices once; a row then stands once per key in one table of (key, slice)
    groups, where one window and one matrix of counts serve all four ranks.
    """
    order = _best_first("base_score")
    narrow = scored.select(*NARROW, *[F.col(key) for _, key in RANK_KEYS])
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), group_key(F.col(key)).alias("key")) for i, (_, key) in enumerate(RANK_KEYS)])
    rows = slice_by_order(narrow, order).select(*NARROW, "_slice", F.inline(keys))
    ranked = rank_in_groups(rows, F.concat_ws(":", "kind", "key"), order, "rank")
    ranks = [F.max(F.when(F.col("kind") == i, F.col("rank"))).alias(out) for i, (out, _) in enumerate(RANK_KEYS)]
    return ranked.groupBy("id").agg(*[F.first(c).alias(c) for c in NARROW[1:]], *ranks)


def apply_modifiers(ranked: DataFrame, as_of: AsOf) -> DataFrame:
    return ranked.withColumn("hourly_multiplier", scores.hourly_multiplier(F.col("id"), as_of)).withColumn(
        "final_score",
        scores.diversified(
            F.col("base_score"), F.col("company_rank"), F.col("role_type_rank"), F.col("location_rank"),
            F.col("seniority_rank"), F.col("hourly_multiplier"),
        ),
    )


def final_ranks(modified: DataFrame) -> DataFrame:
    """1..n by final score among postings in scope; the rest get a fixed rank far below.

    Out-of-scope rows sort after all others, so one global order serves both.
    """
    outside = F.coalesce(F.col("title_classification") == "NIS", F.lit(False))
    placed = global_position(
        modified.withColumn("_outside", outside), [F.col("_outside").asc(), *_best_first("final_score")], "_position"
    )
    return placed.withColumn(
        "final_rank", F.when(F.col("_outside"), F.lit(scores.OUT_OF_SCOPE_RANK)).otherwise(F.col("_position"))
    ).drop("_outside", "_position")


def rank_postings(view: DataFrame, as_of: AsOf) -> DataFrame:
    """Scores, ranks and final order of all active postings. The scores are made once and stored; all ranks are made
    of narrow rows, which meet the other columns in one join at the end. ``id`` is unique."""
    scored = store_wide(score_postings(view, as_of))
    ranked = final_ranks(apply_modifiers(diversity_ranks(scored), as_of))
    return ranked.join(scored.drop(*NARROW[1:]), "id")


def save_rankings(postings: DataFrame, ranked: DataFrame, as_of: AsOf) -> DataFrame:
    """Postings with the columns of the new ranking; postings that were not ranked keep theirs."""
    new = stored_ranking(ranked, as_of)
    fields = [c for c in new.columns if c != "id"]
    return update_from(
        postings, new, ["id"],
        {c: F.col(f"src_{c}").cast(postings.schema[c].dataType) if c in postings.columns else F.col(f"src_{c}") for c in fields},
    )


def stored_ranking(ranked: DataFrame, as_of: AsOf) -> DataFrame:
    """The columns written back: rounded scores, one run instant, the breakdown as JSON."""
    breakdown = F.struct(
        *[F.bround(F.col(c), 2).alias(c) for c in (*COMPONENTS, "base_score")],
        *[F.col(out) for out, _ in RANK_KEYS],
    )
    return ranked.select(
        "id",
        F.bround("base_score", 2).alias("base_score"),
        F.bround("final_score", 2).alias("ranking_score"),
        F.col("final_rank").alias("ranking_position"),
        instant(as_of).alias("ranking_updated_at"),
        F.to_json(breakdown).alias("ranking_metadata"),
        F.bround("hourly_multiplier", 3).alias("hourly_multiplier"),
        F.lit(False).alias("needs_ranking"),
    )
