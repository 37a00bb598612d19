"""Duplicate postings and duplicate companies: finding, choosing the survivor, merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import AsOf, instant
from ..session import cut_lineage
from .cascade import REFERENCES, Reference, delete_cascading
from .ordering import best_row
from .skew import spread_join
from .tables import insert_ignore, update_from

# Weights in the choice of the surviving company.
LOGO_POINTS, LOGO_URL_POINTS, VENDOR_ID_POINTS = 1000, 500, 100


def duplicate_groups(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that occur more than once, with their count; null keys are left out."""
    return (
        df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name)
        .agg(F.count("*").alias("copies")).where("copies > 1")
    )


def oldest_per_key(postings: DataFrame, key: str = "dedup_key") -> DataFrame:
    return best_row(postings.where(F.col(key).isNotNull()), [key], [F.col("created_at"), F.col("id")])


def best_company_by_name(companies: DataFrame) -> DataFrame:
    """Of companies with one name: one with a logo, then one with a vendor id, then the first id."""
    return best_row(
        companies, ["name"],
        [~F.coalesce(F.col("has_logo"), F.lit(False)), F.col("linkedin_company_id").isNull(), F.col("id")],
    )


def company_merge_scores(companies: DataFrame, postings: DataFrame) -> DataFrame:
    counts = postings.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("job_count"))
    jobs = F.coalesce(F.col("job_count"), F.lit(0))
    return companies.join(counts, "id", "left").select(
        *companies.columns,
        jobs.alias("job_count"),
        (
            F.when(F.coalesce(F.col("has_logo"), F.lit(False)), LOGO_POINTS).otherwise(0)
            + F.when(F.coalesce(F.col("logo_url"), F.lit("")) != "", LOGO_URL_POINTS).otherwise(0)
            + F.when(F.coalesce(F.col("linkedin_company_id"), F.lit("")) != "", VENDOR_ID_POINTS).otherwise(0)
            + jobs
        ).alias("merge_score"),
    )


def company_survivors(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, keep_id) for every company that has to give way to another of the same name."""
    scored = company_merge_scores(companies.where(F.col("name").isNotNull()), postings)
    keep = best_row(scored.select("name", "id", "merge_score"), ["name"], [-F.col("merge_score"), F.col("id")])
    best = keep.select("name", F.col("id").alias("keep_id"))
    copies = spread_join(companies.select("id", "name"), best, ["name"], "id", "inner")
    return copies.where(F.col("id") != F.col("keep_id")).select("id", "keep_id")


def merge_companies(companies: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, postings, mapping): postings point to the survivor, the others are gone."""
    mapping = company_survivors(companies, postings)
    return companies.join(mapping.select("id"), "id", "left_anti"), _repoint(postings, mapping), mapping


def merge_master_rows(master: DataFrame, mapping: DataFrame, last_by: str = "id") -> DataFrame:
    """Master data after a merge by ``mapping`` (id, keep_id). A survivor keeps its own row. One without takes over the row of its first
    removed company (smallest id, then smallest ``last_by``); the other rows of removed companies are deleted."""
    moved = master.join(mapping.withColumnRenamed("id", "company_id"), "company_id")
    left = master.join(mapping.select(F.col("id").alias("company_id")), "company_id", "left_anti")
    heirs = best_row(moved, ["keep_id"], [F.col("company_id"), F.col(last_by)])
    heirs = heirs.withColumn("company_id", F.col("keep_id")).join(left.select("company_id"), "company_id", "left_anti")
    return left.select(*master.columns).unionByName(heirs.select(*master.columns))


def _repoint(postings: DataFrame, mapping: DataFrame) -> DataFrame:
    target = mapping.select(F.col("id").alias("company_id"), "keep_id")
    return postings.join(target, "company_id", "left").select(
        *[F.coalesce("keep_id", "company_id").alias(c) if c == "company_id" else F.col(c) for c in postings.columns]
    )


def posting_survivors(postings: DataFrame) -> DataFrame:
    """(id, keep_id) for every posting younger than another with the same dedup key."""
    keep = (
        postings.where(F.col("dedup_key").isNotNull()).groupBy("dedup_key")
        .agg(F.min_by("id", F.struct("created_at", "id")).alias("keep_id"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    copies = spread_join(postings.select("id", "dedup_key"), keep.drop("_n"), ["dedup_key"], "id", "inner")
    return copies.where(F.col("id") != F.col("keep_id")).select("id", "keep_id")


def resolve_duplicate_postings(
    postings: DataFrame, sources: DataFrame, children: Mapping[str, DataFrame], as_of: AsOf
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Keep the oldest posting of each key, give it the sources it lacks, delete the others with all that refers to them: ``children``
    may be any tables of REFERENCES, and others with a ``job_posting_id``. Of several donors of one source the oldest entry wins."""
    mapping = cut_lineage(posting_survivors(postings))
    gone = mapping.select(F.col("id").alias("job_posting_id"))
    donated = (
        sources.join(mapping.withColumnRenamed("id", "job_posting_id"), "job_posting_id")
        .select(
            F.col("keep_id").alias("job_posting_id"), "source", "source_job_id", "first_seen_at",
            instant(as_of).alias("last_seen_at"),
        )
    )
    left = sources.join(gone, "job_posting_id", "left_anti")
    merged = insert_ignore(
        left, donated, ["job_posting_id", "source"], first_by=[F.col("first_seen_at"), F.col("source_job_id")]
    )
    named = {r.child for r in REFERENCES}
    further = [Reference(n, "job_posting_id", "job_postings") for n in children if n not in named]
    after = delete_cascading({**children, "job_postings": postings}, [*REFERENCES, *further], "job_postings", mapping)
    return after.pop("job_postings"), merged, {n: after.get(n, c) for n, c in children.items()}


def backfill_sources(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Source rows for postings that have none, from their own id columns."""
    bare = postings.join(sources.select(F.col("job_posting_id").alias("id")), "id", "left_anti")
    source_id = F.when(F.col("source") == "linkedin", F.col("linkedin_job_id")).when(
        F.col("source") == "indeed", F.col("indeed_job_id")
    )
    new = bare.select(
        F.col("id").alias("job_posting_id"), "source", source_id.alias("source_job_id"),
        F.col("created_at").alias("first_seen_at"), F.col("created_at").alias("last_seen_at"),
    ).where(F.coalesce(F.col("source_job_id"), F.lit("")) != "")
    return insert_ignore(sources, new, ["job_posting_id", "source"])


def most_common_industry(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """(company id, industry) for companies without one: the most frequent of their postings' industries,
    the smallest name on a tie."""
    missing = companies.where(F.col("industry").isNull()).select(F.col("id").alias("company_id"))
    counts = (
        postings.select("company_id", F.explode("industries").alias("industry"))
        .groupBy("company_id", "industry")
        .agg(F.count("*").alias("_n"))
        .join(missing, "company_id", "left_semi")
    )
    return counts.groupBy("company_id").agg(F.min_by("industry", F.struct(-F.col("_n"), F.col("industry"))).alias("industry"))


def backfill_industries(companies: DataFrame, postings: DataFrame) -> DataFrame:
    found = most_common_industry(companies, postings).withColumnRenamed("company_id", "id")
    return update_from(companies, found, ["id"], {"industry": F.col("src_industry")}, when=F.col("industry").isNull())
