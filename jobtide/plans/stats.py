"""Counts, shares and profiles. Each is one partial-then-final aggregate per table; one-row results of
several tables are put side by side with scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import AsOf, before
from ..operators.dedup import duplicate_groups
from .listings import run_page
from .views import Tables

# Traffic price per GB and monthly minimum by plan, and the volumes compared.
PLANS = (
    ("pay_as_you_go", 0.6, 0.0), ("starter", 0.51, 499.0), ("advanced", 0.45, 999.0), ("advanced_plus", 0.42, 1999.0),
)
MONTHLY_VOLUMES = (100, 500, 1000, 5000, 10000)

# Error text -> group, first match wins; score bands, highest first.
ERROR_GROUPS = (("quota", "Quota Exceeded"), ("extract", "Parsing Error"), ("timeout", "Timeout"))
SCORE_BANDS = ((80, "High (80-100)"), (50, "Medium (50-79)"))
LOWEST_BAND = "Low (0-49)"


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    columns = {}
    for other in others:
        for c in other.columns:
            columns[c] = other.select(c).scalar()
    return first.withColumns(columns)


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    return F.when(total > 0, F.round(part * F.lit(100.0) / total, digits)).otherwise(F.lit(0.0))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def dashboard(t: Tables, as_of: AsOf) -> DataFrame:
    jobs = t["job_postings"].agg(F.count("*").alias("total_jobs"), F.count_if("is_active").alias("active_jobs"))
    firms = t["companies"].agg(F.count("*").alias("total_companies"))
    runs = t["scrape_runs"].agg(F.count_if(F.col("started_at") >= before(as_of, days=7)).alias("runs_last_7_days"))
    return side_by_side(jobs, firms, runs)


def inactive_summary(postings: DataFrame, as_of: AsOf) -> DataFrame:
    at = F.col("detected_inactive_at")
    return postings.where(~F.col("is_active")).agg(
        F.count("*").alias("total_inactive"),
        F.count_if(at >= before(as_of, days=7)).alias("inactive_last_7_days"),
        F.count_if(at >= before(as_of, days=30)).alias("inactive_last_30_days"),
    )


def job_enrichment(enrichment: DataFrame, postings: DataFrame) -> DataFrame:
    """Progress over the enrichment rows of 'Data' postings."""
    data = postings.where(F.col("title_classification") == "Data").select(F.col("id").alias("job_posting_id"))
    counts = enrichment.join(data, "job_posting_id", "left_semi").agg(
        F.count("*").alias("total"), F.count("enrichment_completed_at").alias("enriched")
    )
    return _progress(counts)


def company_enrichment(companies: DataFrame, master: DataFrame) -> DataFrame:
    counts = side_by_side(
        companies.agg(F.count("*").alias("total")), master.agg(F.count_if("ai_enriched").alias("enriched"))
    )
    return _progress(counts)


def _progress(counts: DataFrame) -> DataFrame:
    return counts.select(
        "total", "enriched", (F.col("total") - F.col("enriched")).alias("unenriched"),
        percent(F.col("enriched"), F.col("total")).alias("percentage_enriched"),
    )


def size_classification(master: DataFrame) -> DataFrame:
    classified, failed = F.count("size_category"), F.count("size_enrichment_error")
    return master.agg(
        F.count("*").alias("total"), classified.alias("classified"), failed.alias("failed"),
        (F.count("*") - classified - failed).alias("pending"),
    )


def size_categories(master: DataFrame) -> DataFrame:
    return master.where(F.col("size_category").isNotNull()).groupBy("size_category").agg(F.count("*").alias("companies"))


def location_quality(locations: DataFrame) -> DataFrame:
    no_subdivision = ~(filled("subdivision_name") | filled("subdivision_name_fr") | filled("subdivision_name_en"))
    no_timezone = ~filled("timezone")
    no_translation = ~(
        filled("city_name_nl") & filled("city_name_fr") & filled("city_name_en") & filled("country_name_nl")
    )
    return locations.agg(
        F.count("*").alias("total"),
        F.count_if(no_subdivision).alias("missing_subdivision"),
        F.count_if(no_timezone).alias("missing_timezone"),
        F.count_if(no_translation).alias("missing_translations"),
        F.count_if(~(no_subdivision | no_timezone | no_translation)).alias("complete"),
    )


def tech_stack(t: Tables) -> DataFrame:
    def dim(name: str) -> DataFrame:
        return t[name].agg(F.count("*").alias(f"total_{name}"), F.count_if("is_active").alias(f"active_{name}"))

    def links(name: str, out: str) -> DataFrame:
        return t[name].agg(F.count("*").alias(out))

    return side_by_side(
        dim("programming_languages"), dim("ecosystems"),
        links("job_programming_languages", "language_assignments"), links("job_ecosystems", "ecosystem_assignments"),
    )


def type_usage(types: DataFrame, assignments: DataFrame, active_only: bool = False) -> DataFrame:
    counts = assignments.groupBy(F.col("job_type_id").alias("id")).agg(F.count("*").alias("_n"))
    kept = types.where("is_active") if active_only else types
    return kept.join(counts, "id", "left").select(
        "id", "name", "color", "is_active", F.coalesce("_n", F.lit(0)).alias("job_count")
    )


def run_monitor(runs: DataFrame, as_of: AsOf, limit: int = 50, offset: int = 0) -> DataFrame:
    """Counts over the fetched page only, as the monitor shows them."""
    recent = F.col("started_at") > before(as_of, days=1)
    return run_page(runs, None, limit, offset).agg(
        F.count_if(F.col("status") == "running").alias("active_runs"),
        F.count_if(recent & (F.col("status") == "completed")).alias("completed_24h"),
        F.count_if(recent & (F.col("status") == "failed")).alias("failed_24h"),
    )


def run_totals(runs: DataFrame, platform: str) -> DataFrame:
    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint")

    return runs.where(F.col("platform") == platform).agg(
        F.count("*").alias("total_runs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")],
        total("jobs_found").alias("total_jobs_found"),
        total("jobs_new").alias("total_jobs_new"),
        total("jobs_updated").alias("total_jobs_updated"),
    )


def query_totals(queries: DataFrame) -> DataFrame:
    return queries.agg(
        F.count("*").alias("total_queries"),
        F.count_if("is_active").alias("active_queries"),
        F.count_if("schedule_enabled").alias("scheduled_queries"),
    )


def enrichment_monitor(df: DataFrame, done: Column, error: Column) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("total"), F.count_if(done).alias("enriched"), F.count_if(error.isNotNull()).alias("errors")
    )
    return counts.withColumn("pending", F.col("total") - F.col("enriched") - F.col("errors"))


def backlog_coverage(postings: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Active 'Data' postings with and without finished enrichment."""
    jobs = postings.where(F.col("is_active") & (F.col("title_classification") == "Data")).select(F.col("id").alias("job_posting_id"))
    return jobs.join(enrichment.select("job_posting_id", "enrichment_completed_at"), "job_posting_id", "left").agg(
        F.count("*").alias("total_data_jobs"),
        F.count("enrichment_completed_at").alias("enriched"),
        (F.count("*") - F.count("enrichment_completed_at")).alias("unenriched"),
    )


def jobs_per_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("total_jobs"), F.count_if("is_active").alias("active_jobs"))


def runs_per_platform(runs: DataFrame) -> DataFrame:
    label = F.when(F.col("platform") == "linkedin_brightdata", "LinkedIn").when(F.col("platform") == "indeed_brightdata", "Indeed")
    return runs.where(F.col("status") == "completed").groupBy("platform").agg(
        F.count("*").alias("total_runs"),
        F.sum("jobs_found").alias("total_jobs_found"),
        F.sum("jobs_new").alias("total_jobs_new"),
        F.avg("jobs_found").alias("avg_jobs_per_run"),
    ).select(label.alias("source"), "total_runs", "total_jobs_found", "total_jobs_new", "avg_jobs_per_run")


def source_profile(postings: DataFrame, source: str, approximate: bool = False) -> DataFrame:
    """Distinct companies and places, and how many rows fill each column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return postings.where(F.col("source") == source).agg(
        F.count("*").alias("total"),
        distinct("company_id").alias("unique_companies"),
        distinct("location_id").alias("unique_locations"),
        F.count("title").alias("has_title"),
        F.count("base_salary_min").alias("has_salary"),
        F.count("employment_type").alias("has_type"),
    )


def location_health(locations: DataFrame) -> DataFrame:
    return locations.agg(
        F.count_if("ai_enriched").alias("enriched"),
        F.count("ai_enrichment_error").alias("failed"),
        F.count_if(~F.coalesce("ai_enriched", F.lit(False))).alias("pending"),
    )


def error_histogram(df: DataFrame, error: str) -> DataFrame:
    group = F.lit("Other")
    for word, name in reversed(ERROR_GROUPS):
        group = F.when(F.col(error).like(f"%{word}%"), name).otherwise(group)
    return df.where(F.col(error).isNotNull()).groupBy(group.alias("error_type")).agg(F.count("*").alias("count"))


def score_bands(dim: DataFrame) -> DataFrame:
    """Scored items per band, highest band first."""
    band = F.lit(LOWEST_BAND)
    for floor, name in reversed(SCORE_BANDS):
        band = F.when(F.col("relevance_score") >= floor, name).otherwise(band)
    return (
        dim.where(F.col("relevance_score").isNotNull()).groupBy(band.alias("category"))
        .agg(F.count("*").alias("count"), F.min("relevance_score").alias("_low"))
        .orderBy(F.col("_low").desc()).select("category", "count")
    )


def scored_coverage(t: Tables) -> DataFrame:
    def line(label: str, name: str) -> DataFrame:
        return t[name].agg(F.count("*").alias("total"), F.count("relevance_score").alias("scored")).select(
            F.lit(label).alias("type"), "total", "scored", percent(F.col("scored"), F.col("total")).alias("pct_scored")
        )

    return line("languages", "programming_languages").unionByName(line("ecosystems", "ecosystems"))


def shares(df: DataFrame, column: str, digits: int = 2, keep_null: bool = False) -> DataFrame:
    """Count and percent of total per value. The total is a scalar over the same grouped counts, not a
    one-partition window over the rows."""
    kept = df if keep_null else df.where(F.col(column).isNotNull())
    counts = kept.groupBy(column).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", F.round(F.col("count") * F.lit(100.0) / total, digits))


def jobs_by_sector(active: DataFrame, needle: str) -> DataFrame:
    return active.where(F.col("sector_en").ilike(f"%{needle}%")).groupBy("company_name", "sector_en").agg(
        F.count("*").alias("job_count")
    )


def jobs_by_size(active: DataFrame) -> DataFrame:
    """Distinct companies counted after one row per (size, company) is left, so a large size group is
    spread over its companies."""
    per_company = active.where(F.col("size_category").isNotNull()).groupBy("size_category", "company_name").agg(
        F.count("*").alias("_n")
    )
    return per_company.groupBy("size_category").agg(
        F.count("company_name").alias("company_count"), F.sum("_n").alias("job_count")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def ranking_diagnostics(postings: DataFrame) -> DataFrame:
    ranked = postings.where(
        F.col("is_active") & (F.col("title_classification") == "Data") & F.col("ranking_position").isNotNull()
    )
    return ranked.agg(
        F.max("ranking_updated_at").alias("latest_ranking"),
        F.count_distinct("ranking_updated_at").alias("distinct_timestamps"),
        F.count("*").alias("total_ranked_jobs"),
    )


def ranking_runs(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("ranking_position").isNotNull()).groupBy("ranking_updated_at").agg(
        F.count("*").alias("jobs"), F.min("ranking_position").alias("min_rank"), F.max("ranking_position").alias("max_rank")
    )


def shared_positions(latest: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` positions held by several postings, with their distinct titles in order and how often each
    occurs. Equal titles are counted before they are listed, so a repeated title does not lengthen the text."""
    shared = (
        latest.groupBy("ranking_position").agg(F.count("*").alias("count")).where("count > 1")
        .orderBy("ranking_position").limit(limit)
    )
    label = F.concat(F.col("title"), F.lit(" ("), F.coalesce("source", F.lit("no source")), F.lit(")"))
    titles = (
        latest.join(F.broadcast(shared), "ranking_position")  # at most `limit` rows
        .groupBy("ranking_position", "count", label.alias("label"))
        .agg(F.count("*").alias("times"))
    )
    listed = F.array_sort(F.collect_list(F.struct("label", "times")))
    written = F.transform(listed, lambda x: F.concat(x["label"], F.lit(" x"), x["times"].cast("string")))
    return titles.groupBy("ranking_position", "count").agg(F.array_join(written, " | ").alias("jobs"))


def position_audit(postings: DataFrame, limit: int = 20) -> DataFrame:
    """The best ``limit`` by stored position, with the place their score would give them there."""
    best = (
        postings.where(F.col("is_active") & F.col("ranking_position").isNotNull())
        .orderBy("ranking_position", F.col("ranking_score").desc_nulls_last(), "id").limit(limit)
    )
    # The window sees at most `limit` rows.
    by_score = F.row_number().over(W.orderBy(F.col("ranking_score").desc_nulls_last(), "id"))
    return best.select("id", "ranking_position", "ranking_score", by_score.cast("bigint").alias("score_order"))


def ranking_status(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("ranking_updated_at").isNotNull()).agg(
        F.max("ranking_updated_at").alias("last_update"), F.count("ranking_position").alias("ranked_jobs")
    )


def source_integrity(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Multi-source postings, sources against postings, and unusable dedup keys."""
    multi = sources.groupBy("job_posting_id").agg(F.count("*").alias("_n")).agg(
        F.count_if(F.col("_n") > 1).alias("multi_source_jobs")
    )
    jobs = postings.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("dedup_key").isNull()).alias("null_dedup_keys"),
        F.count_if(F.trim("dedup_key") == "").alias("blank_dedup_keys"),
    )
    combined = side_by_side(jobs, sources.agg(F.count("*").alias("total_sources")), multi)
    return combined.withColumn("enough_sources", F.col("total_sources") >= F.col("total_jobs"))


def company_profiles(companies: DataFrame, postings: DataFrame, newest: int = 10) -> DataFrame:
    """Each company with its newest postings (at most ``newest``) and the number shown.

    ``row_number() <= k`` is cut per task before the shuffle, so a large company sends k rows per task.
    """
    order = [F.col("posted_date").desc_nulls_last(), F.col("id")]
    top = (
        postings.select("company_id", "id", "posted_date")
        .withColumn("_n", F.row_number().over(W.partitionBy("company_id").orderBy(*order)))
        .where(F.col("_n") <= newest)
    )
    shown = top.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_jobs"), F.count("*").alias("job_count")
    )
    return companies.select("id", "name").join(shown.withColumnRenamed("company_id", "id"), "id", "left").select(
        "id", "name", F.transform("_jobs", lambda j: j["id"]).alias("newest_jobs"),
        F.coalesce("job_count", F.lit(0)).alias("job_count"),
    )


def payload_size(records: DataFrame, columns: list[str]) -> DataFrame:
    """Average JSON bytes per record."""
    size = F.octet_length(F.to_json(F.struct(*columns)))
    return records.agg(F.count("*").alias("records"), F.sum(size).alias("total_bytes")).withColumn(
        "avg_gb", F.col("total_bytes") / F.col("records") / F.lit(1024.0 * 1024 * 1024)
    )


def plan_costs(sizes: DataFrame) -> DataFrame:
    """Monthly cost of each plan at each volume, with the plan's minimum."""
    plans = F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(p).alias("price"), F.lit(m).alias("minimum")) for n, p, m in PLANS])
    listed = sizes.select("avg_gb", F.explode(F.array(*[F.lit(v) for v in MONTHLY_VOLUMES])).alias("monthly_jobs"))
    priced = listed.select("avg_gb", "monthly_jobs", F.explode(plans).alias("p"))
    cost = F.greatest(F.col("monthly_jobs") * F.col("avg_gb") * F.col("p.price"), F.col("p.minimum"))
    return priced.select("monthly_jobs", "p.plan", cost.alias("monthly_cost"))


def cheapest_plans(costs: DataFrame) -> DataFrame:
    return costs.groupBy("monthly_jobs").agg(
        F.min_by("plan", F.struct("monthly_cost", "plan")).alias("best_plan"), F.min("monthly_cost").alias("best_cost")
    )


def quality(t: Tables) -> DataFrame:
    """Totals with the duplicate groups, missing salaries and missing descriptions really counted."""
    p = t["job_postings"]
    jobs = p.agg(
        F.count("*").alias("total_jobs"),
        F.count_if("is_active").alias("active_jobs"),
        F.count_if(~F.col("is_active")).alias("inactive_jobs"),
        F.count_if(F.col("base_salary_min").isNull()).alias("jobs_missing_salary"),
    )
    groups = duplicate_groups(p, F.col("dedup_key"), "k").agg(F.count("*").alias("duplicate_groups"))
    described = t["job_descriptions"].where(F.length("full_description_text") > 0).select(F.col("job_posting_id").alias("id"))
    bare = p.select("id").join(described, "id", "left_anti").agg(F.count("*").alias("jobs_missing_description"))
    return side_by_side(jobs, groups, bare)


def retry_candidates(t: Tables, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Failed attempts old enough to be tried again, per table."""
    limit = before(as_of, hours=hours)

    def line(label: str, df: DataFrame, error: str, at: str) -> DataFrame:
        return df.where(F.col(error).isNotNull() & (F.col(at) < limit)).agg(F.count("*").alias("retry_candidates")).select(
            F.lit(label).alias("table_name"), "retry_candidates"
        )

    data = t["job_postings"].where(F.col("title_classification") == "Data").select(F.col("id").alias("job_posting_id"))
    jobs = t["llm_enrichment"].join(data, "job_posting_id", "left_semi")
    return (
        line("locations", t["locations"], "ai_enrichment_error", "ai_enriched_at")
        .unionByName(line("jobs", jobs, "enrichment_error", "enrichment_completed_at"))
        .unionByName(line("companies", t["company_master_data"], "ai_enrichment_error", "ai_enriched_at"))
    )


def title_coverage(postings: DataFrame) -> DataFrame:
    cls = F.col("title_classification")
    return postings.agg(
        F.count("*").alias("total"),
        F.count_if(cls == "Data").alias("data_jobs"),
        F.count_if(cls == "NIS").alias("nis_jobs"),
        F.count_if(cls.isNull()).alias("unclassified"),
        F.count("title_classification_error").alias("errored"),
        F.count_if(F.col("needs_ranking") & F.col("is_active")).alias("pending_ranking"),
    )
