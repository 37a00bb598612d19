"""Aggregations, statistics and window results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign, dedup, ordering, sinks
from ..plans import joins, listings, stats, views
from .base import JOBS_AS_OF, RUNS_AS_OF
from .registry import JOBS_NOW, RUNS_NOW, query, ts

_DATA = "title_classification = 'Data'"
_RANKED = f"is_active AND {_DATA} AND ranking_position IS NOT NULL"


@query("dashboard_stats", "A1 R5", f"""
SELECT (SELECT count(*) FROM @job_postings) AS total_jobs, (SELECT count(*) FROM @job_postings WHERE is_active) AS active_jobs,
 (SELECT count(*) FROM @companies) AS total_companies, (SELECT count(*) FROM @scrape_runs WHERE started_at >= {RUNS_NOW} - INTERVAL 7 DAY) AS runs_last_7_days""")
def dashboard_stats(t):
    return stats.dashboard(t, RUNS_AS_OF)


@query("inactive_summary", "A2", f"""
SELECT count(*) AS total_inactive, count(*) FILTER (WHERE detected_inactive_at >= {JOBS_NOW} - INTERVAL 7 DAY) AS inactive_last_7_days,
 count(*) FILTER (WHERE detected_inactive_at >= {JOBS_NOW} - INTERVAL 30 DAY) AS inactive_last_30_days FROM @job_postings WHERE NOT is_active""")
def inactive_summary(t):
    return stats.inactive_summary(t["job_postings"], JOBS_AS_OF)


@query("job_enrichment_stats", "A3", f"""
SELECT total, enriched, total - enriched AS unenriched, CASE WHEN total > 0 THEN round(enriched * 100.0::DOUBLE / total, 1) ELSE 0 END AS percentage_enriched
FROM (SELECT count(*) AS total, count(enrichment_completed_at) AS enriched FROM @llm_enrichment e JOIN @job_postings p ON p.id = e.job_posting_id WHERE {_DATA})""")
def job_enrichment_stats(t):
    return stats.job_enrichment(t["llm_enrichment"], t["job_postings"])


@query("company_enrichment_stats", "A4", """
SELECT total, enriched, total - enriched AS unenriched, round(enriched * 100.0::DOUBLE / total, 1) AS percentage_enriched
FROM (SELECT (SELECT count(*) FROM @companies) AS total, (SELECT count(*) FROM @company_master_data WHERE ai_enriched) AS enriched)""")
def company_enrichment_stats(t):
    return stats.company_enrichment(t["companies"], t["company_master_data"])


@query("size_stats", "A5", """
SELECT count(*) AS total, count(size_category) AS classified, count(size_enrichment_error) AS failed,
 count(*) - count(size_category) - count(size_enrichment_error) AS pending FROM @company_master_data""")
def size_stats(t):
    return stats.size_classification(t["company_master_data"])


@query("size_category_counts", "A5", "SELECT size_category, count(*) AS companies FROM @company_master_data WHERE size_category IS NOT NULL GROUP BY 1")
def size_category_counts(t):
    return stats.size_categories(t["company_master_data"])


@query("location_quality", "A6", """
WITH f AS (SELECT coalesce(nullif(subdivision_name, ''), nullif(subdivision_name_fr, ''), nullif(subdivision_name_en, '')) IS NULL AS a, coalesce(timezone, '') = '' AS b,
 coalesce(city_name_nl, '') = '' OR coalesce(city_name_fr, '') = '' OR coalesce(city_name_en, '') = '' OR coalesce(country_name_nl, '') = '' AS c FROM @locations)
SELECT count(*) AS total, count(*) FILTER (WHERE a) AS missing_subdivision, count(*) FILTER (WHERE b) AS missing_timezone,
 count(*) FILTER (WHERE c) AS missing_translations, count(*) FILTER (WHERE NOT (a OR b OR c)) AS complete FROM f""")
def location_quality(t):
    return stats.location_quality(t["locations"])


@query("tech_stack_stats", "A7", """
SELECT (SELECT count(*) FROM @programming_languages) AS total_programming_languages, (SELECT count(*) FROM @programming_languages WHERE is_active) AS active_programming_languages,
 (SELECT count(*) FROM @ecosystems) AS total_ecosystems, (SELECT count(*) FROM @ecosystems WHERE is_active) AS active_ecosystems,
 (SELECT count(*) FROM @job_programming_languages) AS language_assignments, (SELECT count(*) FROM @job_ecosystems) AS ecosystem_assignments""")
def tech_stack_stats(t):
    return stats.tech_stack(t)


@query("job_type_usage", "A8", """
SELECT y.id, y.name, y.color, y.is_active, count(a.job_posting_id) AS job_count FROM @job_types y LEFT JOIN @job_type_assignments a ON a.job_type_id = y.id GROUP BY 1, 2, 3, 4""")
def job_type_usage(t):
    return stats.type_usage(t["job_types"], t["job_type_assignments"])


@query("run_monitor", "A9", f"""
SELECT count(*) FILTER (WHERE status = 'running') AS active_runs, count(*) FILTER (WHERE started_at > {RUNS_NOW} - INTERVAL 1 DAY AND status = 'completed') AS completed_24h,
 count(*) FILTER (WHERE started_at > {RUNS_NOW} - INTERVAL 1 DAY AND status = 'failed') AS failed_24h
FROM (SELECT * FROM @scrape_runs ORDER BY started_at DESC NULLS LAST, id LIMIT 50)""")
def run_monitor(t):
    return stats.run_monitor(t["scrape_runs"], RUNS_AS_OF)


@query("indeed_run_totals", "A10", """
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
 count(*) FILTER (WHERE status = 'running') AS running, CAST(sum(coalesce(jobs_found, 0)) AS BIGINT) AS total_jobs_found,
 CAST(sum(coalesce(jobs_new, 0)) AS BIGINT) AS total_jobs_new, CAST(sum(coalesce(jobs_updated, 0)) AS BIGINT) AS total_jobs_updated
FROM @scrape_runs WHERE platform = 'indeed_brightdata'""")
def indeed_run_totals(t):
    return stats.run_totals(t["scrape_runs"], "indeed_brightdata")


@query("query_totals", "A11", """
SELECT count(*) AS total_queries, count(*) FILTER (WHERE is_active) AS active_queries, count(*) FILTER (WHERE schedule_enabled) AS scheduled_queries
FROM @search_queries WHERE source = 'linkedin' OR source IS NULL""")
def query_totals(t):
    return stats.query_totals(listings.of_source(t["search_queries"], "linkedin"))


@query("indeed_query_totals", "A11", """
SELECT count(*) AS total_queries, count(*) FILTER (WHERE is_active) AS active_queries, count(*) FILTER (WHERE schedule_enabled) AS scheduled_queries
FROM @search_queries WHERE source = 'indeed'""")
def indeed_query_totals(t):
    return stats.query_totals(listings.of_source(t["search_queries"], "indeed"))


@query("enrichment_monitor", "A13", """
SELECT *, total - enriched - errors AS pending FROM (SELECT count(*) AS total, count(*) FILTER (WHERE ai_enriched) AS enriched, count(ai_enrichment_error) AS errors FROM @company_master_data)""")
def enrichment_monitor(t):
    return stats.enrichment_monitor(t["company_master_data"], F.col("ai_enriched"), F.col("ai_enrichment_error"))


@query("backlog_coverage", "A14", f"""
SELECT count(*) AS total_data_jobs, count(e.enrichment_completed_at) AS enriched, count(*) - count(e.enrichment_completed_at) AS unenriched
FROM @job_postings p LEFT JOIN @llm_enrichment e ON e.job_posting_id = p.id WHERE is_active AND {_DATA}""")
def backlog_coverage(t):
    return stats.backlog_coverage(t["job_postings"], t["llm_enrichment"])


@query("jobs_per_source", "A15", "SELECT source, count(*) AS total_jobs, count(CASE WHEN is_active THEN 1 END) AS active_jobs FROM @job_postings GROUP BY source")
def jobs_per_source(t):
    return stats.jobs_per_source(t["job_postings"])


@query("runs_per_platform", "A16", """
SELECT CASE WHEN platform = 'linkedin_brightdata' THEN 'LinkedIn' WHEN platform = 'indeed_brightdata' THEN 'Indeed' END AS source, count(*) AS total_runs,
 CAST(sum(jobs_found) AS BIGINT) AS total_jobs_found, CAST(sum(jobs_new) AS BIGINT) AS total_jobs_new, avg(jobs_found) AS avg_jobs_per_run
FROM @scrape_runs WHERE status = 'completed' GROUP BY platform""")
def runs_per_platform(t):
    return stats.runs_per_platform(t["scrape_runs"])


@query("indeed_profile", "A17", """
SELECT count(*) AS total, count(DISTINCT company_id) AS unique_companies, count(DISTINCT location_id) AS unique_locations, count(title) AS has_title,
 count(base_salary_min) AS has_salary, count(employment_type) AS has_type FROM @job_postings WHERE source = 'indeed'""")
def indeed_profile(t):
    return stats.source_profile(t["job_postings"], "indeed")


@query("location_health", "A18", """
SELECT count(*) FILTER (WHERE ai_enriched = true) AS enriched, count(*) FILTER (WHERE ai_enrichment_error IS NOT NULL) AS failed,
 count(*) FILTER (WHERE ai_enriched IS NULL OR ai_enriched = false) AS pending FROM @locations""")
def location_health(t):
    return stats.location_health(t["locations"])


@query("error_histogram", "A19", """
SELECT CASE WHEN enrichment_error LIKE '%quota%' THEN 'Quota Exceeded' WHEN enrichment_error LIKE '%extract%' THEN 'Parsing Error' WHEN enrichment_error LIKE '%timeout%' THEN 'Timeout'
 ELSE 'Other' END AS error_type, count(*) AS count FROM @llm_enrichment WHERE enrichment_error IS NOT NULL GROUP BY 1""")
def error_histogram(t):
    return stats.error_histogram(t["llm_enrichment"], "enrichment_error")


@query("score_bands", "A20", """
SELECT CASE WHEN relevance_score >= 80 THEN 'High (80-100)' WHEN relevance_score >= 50 THEN 'Medium (50-79)' ELSE 'Low (0-49)' END AS category, count(*) AS count
FROM @programming_languages WHERE relevance_score IS NOT NULL GROUP BY 1""")
def score_bands(t):
    return stats.score_bands(t["programming_languages"])


@query("scored_coverage", "A21 U1", """
SELECT 'languages' AS type, count(*) AS total, count(relevance_score) AS scored, round(count(relevance_score) * 100.0::DOUBLE / count(*), 1) AS pct_scored FROM @programming_languages
UNION ALL SELECT 'ecosystems', count(*), count(relevance_score), round(count(relevance_score) * 100.0::DOUBLE / count(*), 1) FROM @ecosystems""")
def scored_coverage(t):
    return stats.scored_coverage(t)


@query("hiring_model_shares", "A22 W7", """
SELECT hiring_model, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM @company_master_data WHERE hiring_model IS NOT NULL GROUP BY 1""")
def hiring_model_shares(t):
    return stats.shares(t["company_master_data"], "hiring_model")


_ACTIVE = """(SELECT e.job_posting_id, c.name AS company_name, m.sector_en, m.size_category FROM @llm_enrichment e LEFT JOIN @job_postings j ON e.job_posting_id = j.id
 LEFT JOIN @companies c ON j.company_id = c.id LEFT JOIN @company_master_data m ON c.id = m.company_id)"""


@query("jobs_by_sector", "A23", f"SELECT company_name, sector_en, count(*) AS job_count FROM {_ACTIVE} WHERE sector_en ILIKE '%machin%' GROUP BY 1, 2")
def jobs_by_sector(t):
    return stats.jobs_by_sector(views.enrichment_active(t), "machin")


@query("jobs_by_size", "A23", f"""
SELECT size_category, count(DISTINCT company_name) AS company_count, count(*) AS job_count FROM {_ACTIVE} WHERE size_category IS NOT NULL GROUP BY 1""")
def jobs_by_size(t):
    return stats.jobs_by_size(views.enrichment_active(t))


@query("role_type_counts", "A24", "SELECT type_datarol, count(*) AS count FROM @llm_enrichment GROUP BY 1")
def role_type_counts(t):
    return stats.value_counts(t["llm_enrichment"], "type_datarol")


@query("model_version_counts", "A24", "SELECT enrichment_model_version, count(*) AS count FROM @llm_enrichment GROUP BY 1")
def model_version_counts(t):
    return stats.value_counts(t["llm_enrichment"], "enrichment_model_version")


@query("title_class_shares", "A24", """
SELECT title_classification, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM @job_postings GROUP BY 1""")
def title_class_shares(t):
    return stats.shares(t["job_postings"], "title_classification", keep_null=True)


@query("duplicate_dedup_keys", "A25", "SELECT dedup_key, count(*) AS copies FROM @job_postings WHERE dedup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_dedup_keys(t):
    return dedup.duplicate_groups(t["job_postings"], F.col("dedup_key"), "dedup_key")


@query("duplicate_company_names", "A25", "SELECT name, count(*) AS copies FROM @companies GROUP BY 1 HAVING count(*) > 1")
def duplicate_company_names(t):
    return dedup.duplicate_groups(t["companies"], F.col("name"), "name")


@query("duplicate_language_names", "A25", "SELECT lower(name) AS name_key, count(*) AS copies FROM @programming_languages GROUP BY 1 HAVING count(*) > 1")
def duplicate_language_names(t):
    return dedup.duplicate_groups(t["programming_languages"], F.lower("name"), "name_key")


@query("duplicate_document_texts", "A25", "SELECT md5(text) AS text_hash, count(*) AS copies FROM @documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_document_texts(t):
    return dedup.duplicate_groups(t["documents"], F.md5("text"), "text_hash")


@query("shared_ranking_positions", "A25 A26", f"""
WITH l AS (SELECT * FROM @job_postings WHERE {_RANKED} AND ranking_updated_at = (SELECT max(ranking_updated_at) FROM @job_postings WHERE {_RANKED}))
SELECT ranking_position, CAST(sum(times) AS BIGINT) AS count, string_agg(label || ' x' || CAST(times AS VARCHAR), ' | ' ORDER BY label) AS jobs
FROM (SELECT ranking_position, title || ' (' || coalesce(source, 'no source') || ')' AS label, count(*) AS times FROM l GROUP BY 1, 2)
GROUP BY 1 HAVING sum(times) > 1 ORDER BY 1 LIMIT 10""")
def shared_ranking_positions(t):
    return stats.shared_positions(joins.latest_ranking(t["job_postings"]))


@query("ranking_position_copies", "A25", "SELECT ranking_position, count(*) AS copies FROM @job_postings WHERE ranking_position IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ranking_position_copies(t):
    return dedup.duplicate_groups(t["job_postings"], F.col("ranking_position"), "ranking_position")


@query("common_industries", "A27", """
WITH n AS (SELECT company_id, i AS industry, count(*) AS n FROM (SELECT company_id, unnest(industries) AS i FROM @job_postings) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, industry) AS k FROM n)
SELECT c.id, coalesce(c.industry, r.industry) AS industry FROM @companies c LEFT JOIN r ON r.company_id = c.id AND k = 1""")
def common_industries(t):
    return dedup.backfill_industries(t["companies"], t["job_postings"]).select("id", "industry")


@query("industry_list", "A28", "SELECT DISTINCT industry FROM @companies WHERE industry IS NOT NULL")
def industry_list(t):
    return stats.distinct_values(t["companies"], "industry")


@query("ranking_diagnostics", "A29", f"""
SELECT {ts('max(ranking_updated_at)', 'latest_ranking')}, count(DISTINCT ranking_updated_at) AS distinct_timestamps, count(*) AS total_ranked_jobs FROM @job_postings WHERE {_RANKED}""")
def ranking_diagnostics(t):
    return stats.ranking_diagnostics(t["job_postings"])


@query("ranking_runs", "A29", f"""
SELECT {ts('ranking_updated_at')}, count(*) AS jobs, min(ranking_position) AS min_rank, max(ranking_position) AS max_rank FROM @job_postings WHERE ranking_position IS NOT NULL
GROUP BY job_postings.ranking_updated_at""")
def ranking_runs(t):
    return stats.ranking_runs(t["job_postings"])


@query("type_coverage", "A30 U1", """
SELECT 'Total jobs' AS metric, count(*) AS count FROM @job_postings UNION ALL SELECT 'Jobs with type assignment', count(DISTINCT job_posting_id) FROM @job_type_assignments
UNION ALL SELECT 'Jobs with Data type', count(DISTINCT job_posting_id) FROM @job_type_assignments a JOIN @job_types y ON y.id = a.job_type_id WHERE y.name = 'Data'
UNION ALL SELECT 'Jobs without type', count(*) FROM @job_postings WHERE id NOT IN (SELECT job_posting_id FROM @job_type_assignments)""")
def type_coverage(t):
    return assign.coverage(t["job_postings"], t["job_type_assignments"], t["job_types"])


@query("ranking_status", "A31", f"SELECT {ts('max(ranking_updated_at)', 'last_update')}, count(ranking_position) AS ranked_jobs FROM @job_postings WHERE ranking_updated_at IS NOT NULL")
def ranking_status(t):
    return stats.ranking_status(t["job_postings"])


@query("source_integrity", "A32", """
SELECT (SELECT count(*) FROM @job_postings) AS total_jobs, (SELECT count(*) FROM @job_postings WHERE dedup_key IS NULL) AS null_dedup_keys,
 (SELECT count(*) FROM @job_postings WHERE trim(dedup_key) = '') AS blank_dedup_keys, (SELECT count(*) FROM @job_sources) AS total_sources,
 (SELECT count(*) FROM (SELECT job_posting_id FROM @job_sources GROUP BY 1 HAVING count(*) > 1)) AS multi_source_jobs,
 (SELECT count(*) FROM @job_sources) >= (SELECT count(*) FROM @job_postings) AS enough_sources""")
def source_integrity(t):
    return stats.source_integrity(t["job_postings"], t["job_sources"])


@query("company_profiles", "A33 O3", """
WITH r AS (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY posted_date DESC NULLS LAST, id) AS k FROM @job_postings)
SELECT c.id, c.name, string_agg(CAST(r.id AS VARCHAR), '|' ORDER BY k) AS newest_jobs, count(r.id) AS job_count FROM @companies c LEFT JOIN r ON r.company_id = c.id AND k <= 10 GROUP BY 1, 2""")
def company_profiles(t):
    return stats.company_profiles(t["companies"], t["job_postings"])


@query("payload_plan_costs", "A34", """
WITH s AS (SELECT sum(octet_length(encode('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}')))::DOUBLE / count(*) / 1073741824::DOUBLE AS g FROM @documents),
p AS (SELECT * FROM (VALUES ('pay_as_you_go', 0.6::DOUBLE, 0::DOUBLE), ('starter', 0.51::DOUBLE, 499::DOUBLE), ('advanced', 0.45::DOUBLE, 999::DOUBLE), ('advanced_plus', 0.42::DOUBLE, 1999::DOUBLE)) v(plan, price, fee))
SELECT n AS monthly_jobs, plan, round(greatest(n * g * price, fee), 6) AS monthly_cost FROM s, p, (VALUES (100), (500), (1000), (5000), (10000)) w(n)""")
def payload_plan_costs(t):
    sizes = stats.payload_size(t["documents"], ["doc_id", "text", "lang", "source", "n_chars"])
    return stats.plan_costs(sizes).withColumn("monthly_cost", F.round("monthly_cost", 6))


@query("cheapest_plans", "A34", """
SELECT n AS monthly_jobs, 'pay_as_you_go' AS best_plan, round(n * (SELECT sum(octet_length(encode('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}')))::DOUBLE / count(*) / 1073741824::DOUBLE FROM @documents) * 0.6::DOUBLE, 6) AS best_cost
FROM (VALUES (100), (500), (1000), (5000), (10000)) w(n)""")
def cheapest_plans(t):
    sizes = stats.payload_size(t["documents"], ["doc_id", "text", "lang", "source", "n_chars"])
    return stats.cheapest_plans(stats.plan_costs(sizes)).withColumn("best_cost", F.round("best_cost", 6))


@query("quality_stats", "A35", """
SELECT (SELECT count(*) FROM @job_postings) AS total_jobs, (SELECT count(*) FROM @job_postings WHERE is_active) AS active_jobs, (SELECT count(*) FROM @job_postings WHERE NOT is_active) AS inactive_jobs,
 (SELECT count(*) FROM @job_postings WHERE base_salary_min IS NULL) AS jobs_missing_salary,
 (SELECT count(*) FROM (SELECT dedup_key FROM @job_postings WHERE dedup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups,
 (SELECT count(*) FROM @job_postings WHERE id NOT IN (SELECT job_posting_id FROM @job_descriptions WHERE length(full_description_text) > 0)) AS jobs_missing_description""")
def quality_stats(t):
    return stats.quality(t)


@query("retry_candidates", "A36", f"""
SELECT 'locations' AS table_name, count(*) AS retry_candidates FROM @locations WHERE ai_enrichment_error IS NOT NULL AND ai_enriched_at < {JOBS_NOW} - INTERVAL 24 HOUR
UNION ALL SELECT 'jobs', count(*) FROM @llm_enrichment e JOIN @job_postings j ON e.job_posting_id = j.id WHERE enrichment_error IS NOT NULL AND enrichment_completed_at < {JOBS_NOW} - INTERVAL 24 HOUR AND {_DATA}
UNION ALL SELECT 'companies', count(*) FROM @company_master_data WHERE ai_enrichment_error IS NOT NULL AND ai_enriched_at < {JOBS_NOW} - INTERVAL 24 HOUR""")
def retry_candidates(t):
    return stats.retry_candidates(t, JOBS_AS_OF)


@query("ageing_failures", "A36 M2", f"""
SELECT job_posting_id, enrichment_error, date_diff('second', enrichment_completed_at, {JOBS_NOW}) / 3600::DOUBLE AS age_hours FROM @llm_enrichment
WHERE enrichment_error IS NOT NULL AND enrichment_completed_at < {JOBS_NOW} - INTERVAL 23 HOUR""")
def ageing_failures(t):
    return listings.ageing_failures(t["llm_enrichment"], "enrichment_error", "enrichment_completed_at", JOBS_AS_OF).select(
        "job_posting_id", "enrichment_error", "age_hours"
    )


@query("result_tally", "A37", """
SELECT count(*) AS total, count(*) FILTER (WHERE enrichment_error IS NULL) AS successful, count(*) FILTER (WHERE enrichment_error IS NOT NULL) AS failed,
 count(*) FILTER (WHERE contains(lower(enrichment_error), 'quota') OR contains(lower(enrichment_error), '429') OR contains(lower(enrichment_error), 'rate limit')) AS rate_limited FROM @llm_enrichment""")
def result_tally(t):
    results = t["llm_enrichment"].select(F.col("enrichment_error").isNull().alias("success"), F.col("enrichment_error").alias("error"))
    return sinks.result_tally(results)


@query("title_coverage", "A38 C11", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {_DATA}) AS data_jobs, count(*) FILTER (WHERE title_classification = 'NIS') AS nis_jobs,
 count(*) FILTER (WHERE title_classification IS NULL) AS unclassified, count(title_classification_error) AS errored, count(*) FILTER (WHERE needs_ranking AND is_active) AS pending_ranking FROM @job_postings""")
def title_coverage(t):
    return stats.title_coverage(t["job_postings"])


# --- window results -----------------------------------------------------------------------------


@query("oldest_of_duplicates", "W4", """
SELECT dedup_key, arg_min(id, (created_at, id)) AS id FROM @job_postings WHERE dedup_key IS NOT NULL GROUP BY 1""")
def oldest_of_duplicates(t):
    return dedup.oldest_per_key(t["job_postings"]).select("dedup_key", "id")


@query("best_company_by_name", "W5", "SELECT name, arg_min(id, (NOT has_logo, linkedin_company_id IS NULL, id)) AS id FROM @companies GROUP BY 1")
def best_company_by_name(t):
    return dedup.best_company_by_name(t["companies"]).select("name", "id")


@query("company_merge_scores", "W6", """
SELECT c.id, CASE WHEN has_logo THEN 1000 ELSE 0 END + CASE WHEN logo_url IS NOT NULL THEN 500 ELSE 0 END + CASE WHEN linkedin_company_id IS NOT NULL THEN 100 ELSE 0 END
 + (SELECT count(*) FROM @job_postings p WHERE p.company_id = c.id) AS merge_score FROM @companies c""")
def company_merge_scores(t):
    return dedup.company_merge_scores(t["companies"], t["job_postings"]).select("id", "merge_score")


@query("first_run_of_job", "W8", """
SELECT job_posting_id, arg_min(scrape_run_id, (detected_at, scrape_run_id)) AS scrape_run_id FROM @job_scrape_history GROUP BY 1""")
def first_run_of_job(t):
    return assign.first_run(t["job_scrape_history"])


@query("position_audit", "W10", """
WITH b AS (SELECT id, ranking_position, ranking_score FROM @job_postings WHERE is_active AND ranking_position IS NOT NULL ORDER BY ranking_position, ranking_score DESC NULLS LAST, id LIMIT 20)
SELECT *, row_number() OVER (ORDER BY ranking_score DESC NULLS LAST, id) AS score_order FROM b""")
def position_audit(t):
    return stats.position_audit(t["job_postings"])


@query("order_positions", "W2", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM @orders")
def order_positions(t):
    df = t["orders"].select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return ordering.global_position(df, [F.col("o_totalprice").desc(), F.col("id")], "position").select("id", "position")


@query("ranks_in_priority", "W1", """
SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM @orders""")
def ranks_in_priority(t):
    order = [F.col("o_totalprice").desc(), F.col("id")]
    cut = ordering.slice_by_order(t["orders"].select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderpriority"), order)
    return ordering.rank_in_groups(cut, F.col("o_orderpriority"), order, "rank").select("id", "rank")
