"""Column functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import changes, dates, jsonx, location, salary, scores, text
from ..operators import runs, sinks
from ..operators.ranking import score_postings
from ..plans.views import ranking_view
from .base import JOBS_AS_OF, RUNS_AS_OF
from .registry import JOBS_NOW, RUNS_NOW, query, sql_collapse, sql_key, sql_strip, sql_title, ts

# --- text ---------------------------------------------------------------------------------------


@query("normalized_titles", "T1 T4", f"SELECT id, {sql_title('title')} AS title_normalized, {sql_strip('lower(title)')} AS ingest_title FROM @job_postings")
def normalized_titles(t):
    c = F.col("title")
    return t["job_postings"].select("id", text.normalize_title(c).alias("title_normalized"), text.ingest_title(c).alias("ingest_title"))


@query("normalized_documents", "T1", f"SELECT doc_id, md5({sql_title('text')}) AS normalized_hash, length({sql_title('text')}) AS normalized_length FROM @documents")
def normalized_documents(t):
    n = text.normalize_title(F.col("text"))
    return t["documents"].select("doc_id", F.md5(n).alias("normalized_hash"), F.length(n).cast("bigint").alias("normalized_length"))


@query("dedup_keys", "T2 T3 S17", f"""
SELECT p.id, {sql_key('p.title', 'c.name')} AS dedup_key, lower(trim({sql_title('p.title')} || '|' || coalesce(c.name, ''))) AS backfill_key
FROM @job_postings p LEFT JOIN @companies c ON c.id = p.company_id""")
def dedup_keys(t):
    names = t["companies"].select(F.col("id").alias("company_id"), "name")
    p = t["job_postings"].join(names, "company_id", "left")
    return p.select(
        "id", text.dedup_key(F.col("title"), F.col("name")).alias("dedup_key"),
        text.dedup_key_from_normalized(text.normalize_title(F.col("title")), F.col("name")).alias("backfill_key"),
    )


@query("company_cleaning", "T5", f"""
SELECT arrival, {sql_strip('company_name')} AS name, CASE WHEN company_id <> '' THEN {sql_strip('company_id')} END AS linkedin_company_id,
 CASE WHEN company_url = '' THEN NULL WHEN starts_with(company_url, 'http') THEN company_url ELSE 'https://' || company_url END AS company_url,
 CASE WHEN starts_with(company_logo, 'http') THEN company_logo END AS logo_url, nullif({sql_strip('job_industries')}, '') AS industry FROM @linkedin_raw""")
def company_cleaning(t):
    c = F.col
    columns = text.company_columns(c("company_name"), c("company_id"), c("company_url"), c("company_logo"), c("job_industries"))
    return t["linkedin_raw"].select("arrival", *[v.alias(k) for k, v in columns.items()])


_PARTS = f"(SELECT arrival, job_location, [{sql_strip('x')} for x in string_split(job_location, ',')] AS p FROM @linkedin_raw)"


@query("location_parts", "T6", f"""
SELECT arrival, {sql_strip('job_location')} AS full_location_string, CASE WHEN len(p) > 1 OR length(p[1]) <> 2 THEN p[1] END AS city,
 CASE WHEN len(p) = 2 AND length(p[2]) <= 3 THEN upper(p[2]) WHEN len(p) > 2 THEN p[2] END AS region,
 CASE WHEN len(p) = 1 AND length(p[1]) = 2 THEN upper(p[1]) WHEN len(p) > 2 AND length(p[3]) = 2 THEN upper(p[3]) END AS country_code FROM {_PARTS}""")
def location_parts(t):
    return t["linkedin_raw"].select("arrival", *[v.alias(k) for k, v in location.location_columns(F.col("job_location")).items()])


@query("record_location_parts", "T7", f"""
SELECT arrival, job_location AS full_location_string, CASE WHEN len(p) > 1 THEN p[1] END AS city,
 CASE WHEN len(p) = 2 AND length(p[2]) <= 3 OR len(p) > 2 THEN p[2] END AS region,
 CASE WHEN len(p) = 1 AND length(p[1]) = 2 THEN p[1] WHEN len(p) = 2 AND length(p[2]) = 2 THEN p[2] WHEN len(p) > 2 AND length(p[3]) = 2 THEN p[3] END AS country_code FROM {_PARTS}""")
def record_location_parts(t):
    return t["linkedin_raw"].select(
        "arrival", *[v.alias(k) for k, v in location.record_location_columns(F.col("job_location")).items()]
    )


def _decoded(x):
    for entity, plain in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


@query("page_texts", "T8 S7", f"""
SELECT page_id, md5(txt) AS text_hash, length(txt) AS text_length
FROM (SELECT page_id, nullif({sql_strip(sql_collapse(_decoded("regexp_replace(html, '<[^>]+>', '', 'g')")))}, '') AS txt FROM @pages)""")
def page_texts(t):
    txt = text.html_to_text(F.col("html"))
    return t["pages"].select("page_id", F.md5(txt).alias("text_hash"), F.length(txt).cast("bigint").alias("text_length"))


@query("page_urls", "T9", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS url FROM @pages""")
def page_urls(t):
    bare = F.regexp_replace("url", "^https?://", "")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), bare, F.lit("\t"))).otherwise(F.col("url"))
    return t["pages"].select("page_id", text.ensure_url(given).alias("url"))


@query("industry_lists", "T10", f"""
SELECT arrival, array_to_string(list_filter([{sql_strip('x')} for x in string_split(coalesce(job_industries, ''), ',')], lambda i: i <> ''), '|') AS industries FROM @linkedin_raw""")
def industry_lists(t):
    return t["linkedin_raw"].select("arrival", text.split_list(F.col("job_industries")).alias("industries"))


@query("preferred_address", "T13", """
SELECT arrival, coalesce(nullif(job_location, ''), coalesce(location, 'Unknown Location')) AS address FROM @indeed_raw""")
def preferred_address(t):
    from ..sources.snapshots import location_string, type_records

    return type_records(t["indeed_raw"], "indeed").select("arrival", location_string("indeed").alias("address"))


_CITY = """SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 0 THEN 'Gent' WHEN 1 THEN ' antwerpen ' WHEN 2 THEN 'Leuven' WHEN 3 THEN 'BRUSSEL' WHEN 4 THEN 'Brugge'
 WHEN 5 THEN 'Luik' WHEN 6 THEN 'Paris' WHEN 7 THEN 'Gent, BE' ELSE 'Ghent' END AS place FROM @supplier"""


@query("search_locations", "T14", f"""
SELECT id, CASE lower(trim(place)) WHEN 'gent' THEN 'Ghent, Belgium' WHEN 'antwerpen' THEN 'Antwerp, Belgium' WHEN 'brussel' THEN 'Brussels, Belgium' WHEN 'brugge' THEN 'Bruges, Belgium'
  WHEN 'leuven' THEN place || ', Belgium' WHEN 'luik' THEN place || ', Belgium' WHEN 'ghent' THEN place || ', Belgium' ELSE place END AS search_location,
 CASE WHEN lower(trim(place)) IN ('gent', 'antwerpen', 'brussel', 'brugge', 'leuven', 'luik', 'ghent') THEN 'BE' ELSE '' END AS country_code FROM ({_CITY})""")
def search_locations(t):
    df = t.sql(_CITY)
    return df.select("id", *[v.alias(k) for k, v in location.search_location_columns(F.col("place")).items()])


@query("logo_file_names", "T15", """
SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(name), '++', 'pp'), '#', 'sharp'), '.', ''), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') || '-logo.png' AS file_name
FROM (SELECT id, name FROM @ecosystems UNION ALL SELECT id, name FROM @programming_languages)""")
def logo_file_names(t):
    both = t["ecosystems"].select("id", "name").unionByName(t["programming_languages"].select("id", "name"))
    return both.select("id", text.logo_file_name(F.col("name")).alias("file_name"))


@query("array_literals", "T16", """
SELECT job_posting_id, '{' || array_to_string([chr(34) || x || chr(34) for x in rolniveau], ',') || '}' AS literal, array_to_string(rolniveau, '|') AS items FROM @llm_enrichment""")
def array_literals(t):
    literal = text.format_array_literal(F.col("rolniveau"))
    return t["llm_enrichment"].select(
        "job_posting_id", literal.alias("literal"), text.parse_array_literal(literal).alias("items")
    )


@query("spreadsheet_cells", "T17", f"""
SELECT csv_name, nullif(split_part({sql_strip('csv_id')}, '.', 1), '') AS linkedin_company_id, try_cast(regexp_replace(csv_founded, '[^0-9]', '', 'g') AS INT) AS founded_year FROM @company_csv""")
def spreadsheet_cells(t):
    return t["company_csv"].select(
        "csv_name", text.spreadsheet_id(F.col("csv_id")).alias("linkedin_company_id"),
        text.digits_as_int(F.col("csv_founded")).alias("founded_year"),
    )


_RETRY = f"""CASE WHEN coalesce(enrichment_error, '') = '' THEN FALSE WHEN enrichment_completed_at IS NULL THEN TRUE WHEN enrichment_completed_at > {JOBS_NOW} - INTERVAL 24 HOUR THEN FALSE
 WHEN regexp_matches(lower(enrichment_error), 'quota|429|rate limit|too many requests|timeout|timed out') THEN TRUE
 WHEN regexp_matches(lower(enrichment_error), 'parse|json|invalid|validation') THEN FALSE ELSE TRUE END"""


@query("error_classes", "T18", """
SELECT job_posting_id, CASE WHEN enrichment_error IS NULL THEN NULL WHEN regexp_matches(lower(enrichment_error), 'quota|429') THEN 'quota'
 WHEN regexp_matches(lower(enrichment_error), 'rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(lower(enrichment_error), 'timeout|timed out') THEN 'timeout'
 WHEN regexp_matches(lower(enrichment_error), 'parse|json|invalid|validation') THEN 'permanent' ELSE 'unknown' END AS error_class,
 coalesce(regexp_matches(lower(enrichment_error), 'quota|429|rate limit'), FALSE) AS is_quota FROM @llm_enrichment""")
def error_classes(t):
    e = F.col("enrichment_error")
    return t["llm_enrichment"].select("job_posting_id", dates.error_class(e).alias("error_class"), dates.is_quota_error(e).alias("is_quota"))


@query("retry_decisions", "P25", f"SELECT job_posting_id, {_RETRY} AS retry FROM @llm_enrichment")
def retry_decisions(t):
    return t["llm_enrichment"].select(
        "job_posting_id", dates.should_retry(F.col("enrichment_error"), F.col("enrichment_completed_at"), JOBS_AS_OF).alias("retry")
    )


@query("generic_backlog", "P25", f"""
SELECT company_id FROM @company_master_data WHERE NOT coalesce(ai_enriched, FALSE) OR (ai_enrichment_error IS NOT NULL AND ai_enriched_at < {JOBS_NOW} - INTERVAL 24 HOUR)""")
def generic_backlog(t):
    c = F.col
    return t["company_master_data"].where(
        dates.needs_first_or_retry(c("ai_enriched"), c("ai_enrichment_error"), c("ai_enriched_at"), JOBS_AS_OF)
    ).select("company_id")


# --- dates and scores ---------------------------------------------------------------------------


@query("lenient_timestamps", "M1", f"""
SELECT arrival, {ts("CASE job_posted_date WHEN '2025-10-01T12:00:00Z' THEN TIMESTAMP '2025-10-01 12:00:00' WHEN '2025-10-02' THEN TIMESTAMP '2025-10-02 00:00:00' END", "posted")} FROM @linkedin_raw""")
def lenient_timestamps(t):
    return t["linkedin_raw"].select("arrival", dates.lenient_timestamp(F.col("job_posted_date")).alias("posted"))


@query("run_ages", "M2", f"""
SELECT id, date_diff('second', started_at, {RUNS_NOW}) / 3600::DOUBLE AS age_hours, CAST(floor(date_diff('second', started_at, {RUNS_NOW}) / 86400::DOUBLE) AS INT) AS age_days FROM @scrape_runs""")
def run_ages(t):
    c = F.col("started_at")
    return t["scrape_runs"].select("id", dates.age_hours(c, RUNS_AS_OF).alias("age_hours"), dates.age_whole_days(c, RUNS_AS_OF).alias("age_days"))


FRESHNESS = f"""CASE WHEN posted_date IS NULL THEN 20 WHEN posted_date >= {JOBS_NOW} - INTERVAL 30 HOUR THEN 150 WHEN posted_date >= {JOBS_NOW} - INTERVAL 3 DAY THEN 90
 WHEN posted_date >= {JOBS_NOW} - INTERVAL 7 DAY THEN 75 WHEN posted_date >= {JOBS_NOW} - INTERVAL 14 DAY THEN 60 WHEN posted_date >= {JOBS_NOW} - INTERVAL 30 DAY THEN 40 ELSE 20 END::DOUBLE"""
QUALITY = """least(100, CASE WHEN len(e.hard_skills) >= 3 THEN 20 WHEN coalesce(len(e.hard_skills), 0) = 0 THEN -30 ELSE 0 END
 + CASE WHEN base_salary_min IS NOT NULL AND base_salary_max IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN seniority_level <> '' THEN 15 ELSE 0 END
 + CASE WHEN employment_type <> '' THEN 10 ELSE 0 END + CASE WHEN e.samenvatting_lang_nl <> '' THEN 15 ELSE 0 END + CASE WHEN length(d.full_description_text) > 500 THEN 10 ELSE 0 END
 + least(15, coalesce(len(e.must_have_programmeertalen), 0) + coalesce(len(e.nice_to_have_programmeertalen), 0) + coalesce(len(e.must_have_ecosystemen), 0) + coalesce(len(e.nice_to_have_ecosystemen), 0)))::DOUBLE"""
TRANSPARENCY = """(CASE WHEN hiring_model = 'direct' THEN 60 ELSE 0 END + CASE WHEN apply_url <> '' THEN 20 ELSE 0 END + CASE WHEN num_applicants IS NOT NULL THEN 10 ELSE 0 END
 + CASE WHEN has_logo THEN 10 ELSE 0 END)::DOUBLE"""
ROLE = """CASE WHEN coalesce(type_datarol, '') = '' THEN 10 WHEN type_datarol = 'Other' THEN -200 WHEN type_datarol = 'NIS' THEN -99999 WHEN type_datarol IN ('Data Engineer', 'Data Scientist') THEN 100
 WHEN type_datarol IN ('Data Analyst', 'Analytics Engineer') THEN 90 WHEN type_datarol IN ('ML Engineer', 'BI Developer', 'Machine Learning Engineer') THEN 85 ELSE 70 END::DOUBLE"""
COMPLETE = """(CASE WHEN employee_count_range <> '' THEN 15 ELSE 0 END + CASE WHEN c.industry <> '' THEN 15 ELSE 0 END + CASE WHEN company_url <> '' THEN 15 ELSE 0 END + CASE WHEN l.city <> '' THEN 15 ELSE 0 END
 + CASE WHEN len(function_areas) > 0 THEN 20 ELSE 0 END + CASE WHEN enrichment_completed_at IS NOT NULL THEN 20 ELSE 0 END)::DOUBLE"""
REPUTATION = """CASE WHEN hiring_model = 'recruitment' THEN CASE WHEN rating >= 4 THEN 20 ELSE 10 END
 ELSE CASE WHEN rating >= 4.5::DOUBLE THEN 40 WHEN rating >= 4 THEN 30 WHEN rating >= 3.5::DOUBLE THEN 20 ELSE 10 END
 + CASE WHEN employee_count_range IN ('1001-5000', '5001-10000', '10000+') THEN 30 WHEN employee_count_range IN ('201-500', '501-1000') THEN 20 ELSE 10 END
 + CASE WHEN lower(c.name) IN ('google', 'microsoft', 'meta', 'amazon', 'apple', 'netflix', 'facebook', 'alphabet') THEN 30 ELSE 0 END END::DOUBLE"""
SENIORITY = """CASE e.job_posting_id % 6 WHEN 0 THEN 'Junior' WHEN 1 THEN 'Senior' WHEN 2 THEN 'Expert' WHEN 3 THEN 'Medior' END"""

SCORED = f"""s0 AS (SELECT p.id, p.company_id, p.location_id, e.type_datarol AS role, p.title_classification, e.enrichment_completed_at IS NOT NULL AS done, {SENIORITY} AS seniority,
 {FRESHNESS} AS freshness_score, {QUALITY} AS quality_score, {TRANSPARENCY} AS transparency_score, {ROLE} AS role_match_score, {COMPLETE} AS completeness_score, {REPUTATION} AS reputation_score
 FROM @job_postings p LEFT JOIN @companies c ON c.id = p.company_id LEFT JOIN @company_master_data m ON m.company_id = c.id LEFT JOIN @locations l ON l.id = p.location_id
 LEFT JOIN @llm_enrichment e ON e.job_posting_id = p.id LEFT JOIN @job_descriptions d ON d.job_posting_id = p.id WHERE p.is_active),
s1 AS (SELECT *, CASE WHEN done THEN freshness_score * 0.25::DOUBLE + quality_score * 0.2::DOUBLE + transparency_score * 0.2::DOUBLE + role_match_score * 0.15::DOUBLE
 + completeness_score * 0.1::DOUBLE + reputation_score * 0.1::DOUBLE ELSE -9999::DOUBLE END AS base_score FROM s0)"""


@query("posting_scores", "M3 M4 M5 M6 M7 M8 M9 M15", f"""
WITH {SCORED} SELECT id, seniority, freshness_score, quality_score, transparency_score, role_match_score, completeness_score, reputation_score, base_score FROM s1""")
def posting_scores(t):
    return score_postings(ranking_view(t), JOBS_AS_OF).select(
        "id", "seniority", "freshness_score", "quality_score", "transparency_score", "role_match_score", "completeness_score",
        "reputation_score", "base_score",
    )


HOURLY = "(0.8::DOUBLE + (('0x' || substr(md5('2001-08-02-00-' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 10000) / 10000::DOUBLE * 0.4::DOUBLE)"


@query("hourly_multipliers", "M10", f"SELECT id, {HOURLY} AS hourly_multiplier FROM @job_postings")
def hourly_multipliers(t):
    return t["job_postings"].select("id", scores.hourly_multiplier(F.col("id"), JOBS_AS_OF).alias("hourly_multiplier"))


# --- changes, JSON, run state -------------------------------------------------------------------

_NEW = """SELECT id, CASE WHEN id % 5 = 0 THEN title || ' II' ELSE title END AS title, CASE WHEN id % 7 = 0 THEN 1 ELSE num_applicants END AS num_applicants,
 CASE WHEN id % 4 = 0 THEN NULL ELSE base_salary_min END AS base_salary_min, base_salary_max, employment_type, seniority_level, NOT (application_available AND id % 6 = 0) AND application_available AS application_available FROM @job_postings"""


def old_and_new(t):
    fields = changes.WATCHED
    old = t["job_postings"].select("id", F.struct(*fields).alias("old"))
    new = t.sql(_NEW).select("id", F.struct(*fields).alias("new"))
    return old.join(new, "id")


_DIFF = "FROM @job_postings o JOIN n ON n.id = o.id"


@query("changed_postings", "M13 M14", f"""
WITH n AS ({_NEW}) SELECT o.id,
 array_to_string(list_filter([CASE WHEN o.title IS DISTINCT FROM n.title THEN 'title' END, CASE WHEN o.num_applicants IS DISTINCT FROM n.num_applicants THEN 'num_applicants' END,
  CASE WHEN o.base_salary_min IS DISTINCT FROM n.base_salary_min THEN 'base_salary_min' END, CASE WHEN o.application_available IS DISTINCT FROM n.application_available THEN 'application_available' END], lambda x: x IS NOT NULL), '|') AS changed,
 o.title IS DISTINCT FROM n.title OR o.num_applicants IS DISTINCT FROM n.num_applicants OR o.base_salary_min IS DISTINCT FROM n.base_salary_min OR o.application_available IS DISTINCT FROM n.application_available AS should_update {_DIFF}""")
def changed_postings(t):
    return old_and_new(t).select(
        "id", changes.changed_fields("old", "new", changes.WATCHED).alias("changed"), changes.any_changed("old", "new").alias("should_update")
    )


@query("content_hashes", "M12", """
SELECT id, md5('base_salary_max=' || coalesce(CAST(base_salary_max AS VARCHAR), '~') || chr(10) || 'base_salary_min=' || coalesce(CAST(base_salary_min AS VARCHAR), '~') || chr(10)
 || 'employment_type=' || coalesce(employment_type, '~') || chr(10) || 'num_applicants=' || coalesce(CAST(num_applicants AS VARCHAR), '~') || chr(10)
 || 'seniority_level=' || coalesce(seniority_level, '~') || chr(10) || 'title=' || title) AS content_hash FROM @job_postings""")
def content_hashes(t):
    return t["job_postings"].select("id", changes.content_hash().alias("content_hash"))


@query("label_seniority", "M15", f"SELECT job_posting_id, {SENIORITY.replace('e.job_posting_id', 'job_posting_id')} AS seniority FROM @llm_enrichment")
def label_seniority(t):
    return t["llm_enrichment"].select("job_posting_id", jsonx.label_value(F.col("labels"), "seniority").alias("seniority"))


@query("result_path_fallback", "M16", """
SELECT company_id, coalesce(nullif(json_extract_string(payload, '$.website'), ''), nullif(json_extract_string(payload, '$.bedrijfswebsite'), '')) AS website FROM @company_results""")
def result_path_fallback(t):
    return t["company_results"].select("company_id", jsonx.first_filled(F.col("payload"), "website", "bedrijfswebsite").alias("website"))


@query("size_labels", "M17", """
SELECT id, coalesce(category_nl, CASE size_category WHEN 'startup' THEN 'Startup' WHEN 'sme' THEN 'KMO' WHEN 'corporate' THEN 'Corporate' WHEN 'government' THEN 'Overheid' WHEN 'unknown' THEN 'Onbekend' END) AS category_nl,
 coalesce(category_en, CASE size_category WHEN 'startup' THEN 'Startup' WHEN 'sme' THEN 'SME' WHEN 'corporate' THEN 'Corporate' WHEN 'government' THEN 'Government' WHEN 'unknown' THEN 'Unknown' END) AS category_en,
 coalesce(category_fr, CASE size_category WHEN 'startup' THEN 'Startup' WHEN 'sme' THEN 'PME' WHEN 'corporate' THEN 'Corporate' WHEN 'government' THEN 'Gouvernement' WHEN 'unknown' THEN 'Inconnu' END) AS category_fr
FROM @company_master_data""")
def size_labels(t):
    return sinks.label_sizes(t["company_master_data"]).select("id", "category_nl", "category_en", "category_fr")


@query("scrape_windows", "M18 M19", f"""
WITH l AS (SELECT search_query, location_query, max(completed_at) AS c FROM @scrape_runs WHERE status = 'completed' GROUP BY 1, 2),
d AS (SELECT q.id, c, CAST(floor(date_diff('second', c, {RUNS_NOW}) / 86400::DOUBLE) AS INT) AS days FROM @search_queries q LEFT JOIN l ON l.search_query = q.search_query AND l.location_query = q.location_query)
SELECT id, days AS days_since_success, CASE WHEN days <= 1 THEN 1 WHEN days <= 7 THEN 7 ELSE 30 END AS window_days,
 CASE WHEN days <= 1 THEN 'past_24h' WHEN days <= 7 THEN 'past_week' ELSE 'past_month' END AS date_range,
 coalesce(date_diff('second', c, {RUNS_NOW}) >= 6 * 3600, TRUE) AS should_trigger FROM d""")
def scrape_windows(t):
    return runs.scrape_windows(t["search_queries"], t["scrape_runs"], RUNS_AS_OF).select(
        "id", "days_since_success", "window_days", "date_range", "should_trigger"
    )


_PLAN = f"""CASE WHEN completed_at IS NOT NULL THEN 'completed' WHEN started_at IS NULL THEN 'permanently_failed' WHEN started_at >= {RUNS_NOW} - INTERVAL 1 HOUR THEN 'still_running'
 WHEN retry_count < 4 THEN 'scheduled_retry' ELSE 'permanently_failed' END"""


@query("retry_plan", "M20", f"SELECT id, {_PLAN} AS action FROM @scrape_runs WHERE status = 'running'")
def retry_plan(t):
    return runs.retry_plan(t["scrape_runs"], RUNS_AS_OF).select("id", "action")


@query("retry_plan_applied", "M20 S31", f"""
WITH p AS (SELECT *, CASE WHEN status = 'running' THEN {_PLAN} END AS a FROM @scrape_runs)
SELECT id, CASE a WHEN 'completed' THEN 'completed' WHEN 'permanently_failed' THEN 'failed' WHEN 'scheduled_retry' THEN 'failed' ELSE status END AS status, retry_count, search_query_id, NULL::BIGINT AS original_run_id, TRUE AS has_id FROM p
UNION ALL SELECT NULL, 'pending_retry', retry_count + 1, search_query_id, id, TRUE FROM p WHERE a = 'scheduled_retry'""")
def retry_plan_applied(t):
    planned = runs.apply_retry_plan(t["scrape_runs"], RUNS_AS_OF)
    own = F.when(F.col("original_run_id").isNull(), F.col("id"))  # a retry's key is a hash that SQL does not have
    return planned.select(own.alias("id"), "status", "retry_count", "search_query_id", "original_run_id", F.col("id").isNotNull().alias("has_id"))


@query("due_retries", "M21", f"SELECT id, {ts('next_retry_at')} FROM @scrape_runs WHERE status = 'pending_retry' AND next_retry_at <= {RUNS_NOW}")
def due_retries(t):
    return runs.due_retries(t["scrape_runs"], RUNS_AS_OF).select("id", "next_retry_at")


@query("metadata_merge", "M22", """
SELECT id, coalesce(json_extract_string(metadata, '$.k'), '-') AS k, 'killed' AS reason, '1' AS source,
 CASE WHEN json_extract(metadata, '$.error_details') IS NOT NULL THEN '["bad row","no title"]' END AS error_details FROM @scrape_runs""")
def metadata_merge(t):
    merged = jsonx.merge_text_map(F.col("metadata"), F.lit('{"reason":"killed","source":1}'))
    m = F.col("m")
    return t["scrape_runs"].select("id", merged.alias("m")).select(
        "id", F.coalesce(jsonx.path(m, "k"), F.lit("-")).alias("k"), jsonx.path(m, "reason").alias("reason"),
        jsonx.path(m, "source").alias("source"), jsonx.path(m, "error_details").alias("error_details"),
    )


@query("subdivision_sync", "M25", "SELECT id, subdivision_name AS subdivision_name_nl FROM @locations")
def subdivision_sync(t):
    return sinks.sync_subdivision(t["locations"]).select("id", "subdivision_name_nl")


@query("pay_ranges", "T11", f"""
SELECT arrival, CASE arrival % 6 WHEN 0 THEN '$' WHEN 1 THEN '€' END AS salary_currency, CASE arrival % 6 WHEN 0 THEN 'yr' WHEN 1 THEN 'hr' END AS salary_period,
 CASE arrival % 6 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN 15.5 WHEN 4 THEN 100 END::DOUBLE AS base_salary_min,
 CASE arrival % 6 WHEN 0 THEN floor(o_totalprice) + 1000.5 WHEN 1 THEN 18 WHEN 4 THEN 200 END::DOUBLE AS base_salary_max FROM @linkedin_raw JOIN @orders ON o_orderkey = arrival""")
def pay_ranges(t):
    return t["linkedin_raw"].select("arrival", *[v.alias(k) for k, v in salary.pay_range_columns(F.col("job_base_pay_range")).items()])


@query("formatted_salaries", "T12", """
SELECT arrival, CASE arrival % 7 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN 50000 WHEN 2 THEN 25 WHEN 3 THEN 50000 WHEN 4 THEN 1200000 END::DOUBLE AS base_salary_min,
 CASE arrival % 7 WHEN 0 THEN floor(o_totalprice) + 10 WHEN 1 THEN 70000 WHEN 2 THEN 35.5 WHEN 3 THEN 50000 WHEN 4 THEN 1200000 END::DOUBLE AS base_salary_max,
 CASE arrival % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'USD' WHEN 4 THEN 'GBP' END AS salary_currency,
 CASE arrival % 7 WHEN 0 THEN 'yearly' WHEN 2 THEN 'hourly' WHEN 4 THEN 'yearly' END AS salary_period FROM @indeed_raw JOIN @orders ON o_orderkey = arrival""")
def formatted_salaries(t):
    return t["indeed_raw"].select("arrival", *[v.alias(k) for k, v in salary.formatted_salary_columns(F.col("salary_formatted")).items()])
