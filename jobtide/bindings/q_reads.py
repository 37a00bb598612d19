"""Searches, listings, predicates, views, joins, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.changes import differs
from ..functions.dates import before, posted_within
from ..operators import assign, lifecycle, override, runs
from ..operators.ordering import page
from ..plans import joins, listings, views
from ..plans.search import Search, count_jobs, matching, search_page, suggestions
from .base import JOBS_AS_OF, RUNS_AS_OF
from .registry import JOBS_NOW, RUNS_NOW, query, sql_key, ts

FULL = Search(
    search_query="data", seniority=("Mid-Senior level", "Entry level", "Director"), employment=("Full-time", "Contract"),
    title_classification="Data", ai_enriched=True, contract="Permanent", type_ids=(0, 1, 2), limit=20,
)
_FULL_SQL = """is_active AND title ILIKE '%data%' AND seniority_level IN ('Mid-Senior level', 'Entry level', 'Director') AND employment_type IN ('Full-time', 'Contract')
  AND title_classification = 'Data' AND id IN (SELECT job_posting_id FROM @llm_enrichment WHERE enrichment_completed_at IS NOT NULL)
  AND id IN (SELECT job_posting_id FROM @llm_enrichment WHERE list_contains(contract, 'Permanent'))
  AND id IN (SELECT job_posting_id FROM @job_type_assignments WHERE job_type_id IN (0, 1, 2))"""


@query("search_page", "P1 P8 P9 O1 O2 J6", f"""
WITH f AS (SELECT * FROM @job_postings WHERE {_FULL_SQL} ORDER BY ranking_position ASC NULLS LAST, ranking_score DESC NULLS LAST, id LIMIT 20)
SELECT f.id, f.title, f.ranking_position, c.name AS company_name, l.city AS location_city, e.type_datarol, e.enrichment_completed_at IS NOT NULL AS ai_enriched,
  (SELECT string_agg(source, ',' ORDER BY source) FROM @job_sources s WHERE s.job_posting_id = f.id) AS source_names,
  (SELECT string_agg(y.name, ',' ORDER BY y.name) FROM @job_type_assignments a JOIN @job_types y ON y.id = a.job_type_id WHERE a.job_posting_id = f.id) AS type_names
FROM f LEFT JOIN @companies c ON c.id = f.company_id LEFT JOIN @locations l ON l.id = f.location_id LEFT JOIN @llm_enrichment e ON e.job_posting_id = f.id""")
def q_search_page(t):
    found = search_page(t, FULL, JOBS_AS_OF)
    return found.select(
        "id", "title", "ranking_position", "company_name", "location_city", "type_datarol", "ai_enriched",
        F.array_join(F.col("sources.source"), ",").alias("source_names"),
        F.array_join(F.col("job_types.name"), ",").alias("type_names"),
    )


@query("search_total", "P1 O2", f"SELECT count(*) AS total FROM @job_postings WHERE {_FULL_SQL}")
def q_search_total(t):
    return count_jobs(t, FULL, JOBS_AS_OF)


@query("search_all_matches", "P1 P2 P7", """
SELECT id, title FROM @job_postings p WHERE is_active AND source = 'linkedin' AND id IN (SELECT job_posting_id FROM @llm_enrichment WHERE type_datarol = 'Data Analyst')
 AND location_id IN (SELECT id FROM @locations WHERE subdivision_name_en = 'NATION_20')""")
def search_all_matches(t):
    s = Search(source="linkedin", type_datarol="Data Analyst", subdivision_name_en="NATION_20")
    return matching(t, s, JOBS_AS_OF).select("id", "title")


@query("search_by_ids", "P3", "SELECT id, title FROM @job_postings WHERE id IN (5, 42, 77, 100) AND company_id IN (SELECT company_id FROM @job_postings) AND is_active")
def search_by_ids(t):
    return matching(t, Search(job_ids=(5, 42, 77, 100)), JOBS_AS_OF).select("id", "title")


@query("search_empty_ids_total", "P3", "SELECT count(*) AS total FROM @job_postings WHERE FALSE")
def search_empty_ids_total(t):
    return count_jobs(t, Search(job_ids=()), JOBS_AS_OF)


@query("title_contains", "P4", "SELECT id, title FROM @job_postings WHERE title ILIKE '%engineer%' AND is_active")
def title_contains(t):
    return matching(t, Search(search_query="engineer"), JOBS_AS_OF).select("id", "title")


@query("search_by_place", "P5 P1", """
SELECT id FROM @job_postings WHERE is_active AND location_id IN (SELECT id FROM @locations WHERE city ILIKE '%be%' OR country_code ILIKE '%be%' OR region ILIKE '%be%')""")
def search_by_place(t):
    return matching(t, Search(location="be"), JOBS_AS_OF).select("id")


@query("search_posted_week", "P6", f"SELECT id, {ts('posted_date')} FROM @job_postings WHERE is_active AND posted_date >= {JOBS_NOW} - INTERVAL 7 DAY")
def search_posted_week(t):
    return matching(t, Search(posted_date="week"), JOBS_AS_OF).select("id", "posted_date")


@query("posted_preset_counts", "P6", f"""
SELECT count(*) FILTER (WHERE posted_date >= {JOBS_NOW} - INTERVAL 1 DAY) AS today, count(*) FILTER (WHERE posted_date >= {JOBS_NOW} - INTERVAL 7 DAY) AS week,
 count(*) FILTER (WHERE posted_date >= {JOBS_NOW} - INTERVAL 30 DAY) AS month, count(*) AS all_jobs FROM @job_postings""")
def posted_preset_counts(t):
    p = F.col("posted_date")
    return t["job_postings"].agg(
        *[F.count_if(posted_within(p, n, JOBS_AS_OF)).alias(n) for n in ("today", "week", "month")],
        F.count_if(posted_within(p, "all", JOBS_AS_OF)).alias("all_jobs"),
    )


@query("search_unenriched", "P9", """
SELECT id FROM @job_postings WHERE is_active AND id NOT IN (SELECT job_posting_id FROM @llm_enrichment WHERE enrichment_completed_at IS NOT NULL)""")
def search_unenriched(t):
    return matching(t, Search(ai_enriched=False), JOBS_AS_OF).select("id")


@query("search_jobs_of_run", "P10 J11", "SELECT id, is_active FROM @job_postings WHERE id IN (SELECT job_posting_id FROM @job_scrape_history WHERE scrape_run_id = 77)")
def search_jobs_of_run(t):
    return matching(t, Search(run_id=77), JOBS_AS_OF).select("id", "is_active")


@query("search_page_two", "O2 O6 P1", f"""
SELECT id, {ts('posted_date')} FROM @job_postings WHERE is_active AND company_id IN (SELECT id FROM @companies) ORDER BY posted_date DESC NULLS LAST, id LIMIT 25 OFFSET 50""")
def search_page_two(t):
    s = Search(sort_field="posted_date", sort_direction="desc", limit=25, offset=50)
    return search_page(t, s, JOBS_AS_OF).select("id", "posted_date")


@query("queries_of_first_source", "P11", "SELECT id, search_query FROM @search_queries WHERE source = 'linkedin' OR source IS NULL")
def queries_of_first_source(t):
    return listings.of_source(t["search_queries"], "linkedin").select("id", "search_query")


@query("runs_between", "P12", f"""
SELECT id, {ts('started_at')} FROM @scrape_runs WHERE started_at BETWEEN {RUNS_NOW} - INTERVAL 48 HOUR AND {RUNS_NOW} AND completed_at < {RUNS_NOW}""")
def runs_between(t):
    r = t["scrape_runs"]
    inside = F.col("started_at").between(before(RUNS_AS_OF, hours=48), before(RUNS_AS_OF))
    return r.where(inside & (F.col("completed_at") < before(RUNS_AS_OF))).select("id", "started_at")


_PATTERNS = "('Flemish Region'), ('Walloon Region'), ('Brussels-Capital Region'), ('Belgium'), ('België')"


@query("vague_locations", "P13", f"""
SELECT id, full_location_string FROM @locations l WHERE EXISTS (SELECT 1 FROM (VALUES {_PATTERNS}) v(p) WHERE starts_with(l.full_location_string, p))""")
def vague_locations(t):
    vague = override.vague_strings(t["locations"], "full_location_string", None)
    return t["locations"].join(vague, "full_location_string", "left_semi").select("id", "full_location_string")


@query("vague_cities", "P14", f"SELECT id, city FROM @locations WHERE city IN (SELECT p FROM (VALUES {_PATTERNS}) v(p))")
def vague_cities(t):
    return override.vague_by_city(t["locations"], None).select("id", "city")


@query("usable_company_seats", "P15", """
SELECT company_id, locatie_belgie FROM @company_master_data WHERE trim(locatie_belgie) <> '' AND lower(locatie_belgie) NOT IN ('niet gevonden', 'unknown', 'n/a')""")
def usable_company_seats(t):
    return t["company_master_data"].where(~text.is_placeholder(F.col("locatie_belgie"))).select("company_id", "locatie_belgie")


@query("size_label_differs", "P16", "SELECT id FROM @company_master_data WHERE category_nl IS DISTINCT FROM category_en")
def size_label_differs(t):
    return t["company_master_data"].where(differs(F.col("category_nl"), F.col("category_en"))).select("id")


@query("jobs_with_perk", "P17", """
SELECT job_posting_id FROM @llm_enrichment WHERE len(list_filter(CAST(json_extract(perks, '$[*]') AS JSON[]), lambda p: json_extract_string(p, '$.key') = 'remote_policy' AND json_extract_string(p, '$.found') = 'true')) > 0""")
def jobs_with_perk(t):
    return t["llm_enrichment"].where(jsonx.has_entry(F.col("perks"), "remote_policy")).select("job_posting_id")


@query("perk_values", "M23", """
SELECT job_posting_id, CASE WHEN json_extract_string(perks, '$[0].key') = 'salary_range' THEN json_extract_string(perks, '$[0].value') END AS salary FROM @llm_enrichment""")
def perk_values(t):
    return t["llm_enrichment"].select("job_posting_id", jsonx.entry_value(F.col("perks"), "salary_range").alias("salary"))


@query("run_metadata_fields", "P18", """
SELECT id, json_extract_string(metadata, '$.source') AS source, json_extract_string(metadata, '$.jobs_error') AS jobs_error, json_extract_string(metadata, '$.k') AS k FROM @scrape_runs""")
def run_metadata_fields(t):
    m = F.col("metadata")
    return t["scrape_runs"].select(
        "id", jsonx.path(m, "source").alias("source"), jsonx.path(m, "jobs_error").alias("jobs_error"), jsonx.path(m, "k").alias("k")
    )


@query("job_backlog", "P19 J7", f"""
SELECT job_posting_id, CASE WHEN enrichment_error IS NULL THEN 'new' ELSE 'retry' END AS reason FROM @llm_enrichment e
WHERE ((enrichment_completed_at IS NULL AND enrichment_error IS NULL) OR (enrichment_error IS NOT NULL AND enrichment_completed_at < {JOBS_NOW} - INTERVAL 24 HOUR))
 AND job_posting_id IN (SELECT id FROM @job_postings WHERE title_classification = 'Data')""")
def job_backlog(t):
    return lifecycle.job_backlog(t["llm_enrichment"], t["job_postings"], JOBS_AS_OF)


@query("location_backlog", "P20", f"""
SELECT id, CASE WHEN ai_enrichment_error IS NULL THEN 'new' ELSE 'retry' END AS reason FROM @locations
WHERE (NOT coalesce(ai_enriched, FALSE) AND ai_enrichment_error IS NULL) OR (ai_enrichment_error IS NOT NULL AND ai_enriched_at < {JOBS_NOW} - INTERVAL 24 HOUR)""")
def location_backlog(t):
    return lifecycle.location_backlog(t["locations"], JOBS_AS_OF)


@query("company_backlog", "P21 J8", f"""
SELECT * FROM (SELECT c.id, CASE WHEN m.company_id IS NULL OR (NOT coalesce(ai_enriched, FALSE) AND ai_enrichment_error IS NULL) THEN 'new'
  WHEN ai_enrichment_error IS NOT NULL AND (ai_enriched_at IS NULL OR ai_enriched_at < {JOBS_NOW} - INTERVAL 24 HOUR) THEN 'retry' END AS reason
FROM @companies c LEFT JOIN @company_master_data m ON m.company_id = c.id) WHERE reason IS NOT NULL""")
def company_backlog(t):
    return lifecycle.company_backlog(t["companies"], t["company_master_data"], JOBS_AS_OF)


@query("data_job_backlog", "P22", """
SELECT id, title FROM @job_postings WHERE is_active AND title_classification = 'Data'
 AND id NOT IN (SELECT job_posting_id FROM @llm_enrichment WHERE enrichment_completed_at IS NOT NULL)
 AND id IN (SELECT job_posting_id FROM @job_descriptions WHERE length(full_description_text) > 0)""")
def data_job_backlog(t):
    return lifecycle.data_job_backlog(t["job_postings"], t["llm_enrichment"], t["job_descriptions"])


@query("missing_role_backlog", "P23", """
SELECT job_posting_id, title FROM @llm_enrichment e JOIN @job_postings p ON p.id = e.job_posting_id WHERE type_datarol IS NULL AND title_classification = 'Data'""")
def missing_role_backlog(t):
    return lifecycle.missing_role_backlog(t["llm_enrichment"], t["job_postings"])


@query("small_backlogs", "P24", """
SELECT 'titles' AS backlog, id FROM @job_postings WHERE title_classification IS NULL
UNION ALL SELECT 'languages', id FROM @programming_languages WHERE relevance_score IS NULL
UNION ALL SELECT 'ecosystems', id FROM @ecosystems WHERE relevance_score IS NULL
UNION ALL SELECT 'consulting', company_id FROM @company_master_data WHERE bedrijfsomschrijving_en IS NOT NULL
UNION ALL SELECT 'seats', c.id FROM @companies c JOIN @company_master_data m ON m.company_id = c.id WHERE ai_enriched AND locatie_belgie IS NULL
UNION ALL SELECT 'sizes', company_id FROM @company_master_data WHERE size_category IS NULL""")
def small_backlogs(t):
    parts = [
        ("titles", lifecycle.unclassified_titles(t["job_postings"]), "id"),
        ("languages", lifecycle.unscored_items(t["programming_languages"]), "id"),
        ("ecosystems", lifecycle.unscored_items(t["ecosystems"]), "id"),
        ("consulting", lifecycle.described(t["company_master_data"]), "company_id"),
        ("seats", lifecycle.enriched_without_seat(t["companies"], t["company_master_data"]), "id"),
        ("sizes", lifecycle.never_sized(t["company_master_data"]), "company_id"),
    ]
    frames = [df.select(F.lit(n).alias("backlog"), F.col(k).alias("id")) for n, df, k in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("overdue_postings", "P26", f"SELECT id, {ts('last_seen_at')} FROM @job_postings WHERE is_active AND last_seen_at < {JOBS_NOW} - INTERVAL 1000 DAY")
def overdue_postings(t):
    return t["job_postings"].where(lifecycle.overdue(JOBS_AS_OF, 1000)).select("id", "last_seen_at")


@query("stuck_runs", "P27", f"""
SELECT id, platform, {ts('started_at')} FROM @scrape_runs WHERE status = 'running' AND started_at < {RUNS_NOW} - INTERVAL 2 HOUR AND (platform = 'linkedin_brightdata' OR platform IS NULL)""")
def stuck_runs(t):
    hit = runs.stuck(RUNS_AS_OF, 2) & runs.platform_is("linkedin_brightdata")
    return t["scrape_runs"].where(hit).select("id", "platform", "started_at")


@query("stuck_runs_cleaned", "P27", f"""
SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, {ts(f"CASE WHEN hit THEN {RUNS_NOW} ELSE completed_at END", "completed_at")}
FROM (SELECT *, coalesce(status = 'running' AND started_at < {RUNS_NOW} - INTERVAL 1 HOUR, FALSE) AS hit FROM @scrape_runs)""")
def stuck_runs_cleaned(t):
    return runs.clean_stuck(t["scrape_runs"], RUNS_AS_OF).select("id", "status", "completed_at")


@query("run_states_repaired", "P27", f"""
SELECT id, CASE WHEN status = 'running' AND completed_at IS NOT NULL THEN 'completed'
  WHEN status = 'running' AND (started_at IS NULL OR started_at < {RUNS_NOW} - INTERVAL 2 HOUR) THEN 'failed' ELSE status END AS status FROM @scrape_runs""")
def run_states_repaired(t):
    return runs.repair_states(t["scrape_runs"], RUNS_AS_OF, 2).select("id", "status")


@query("active_runs", "P28 O3", f"""
SELECT id, {ts('started_at')} FROM @scrape_runs WHERE status = 'running' AND platform = 'indeed_brightdata' ORDER BY scrape_runs.started_at DESC NULLS LAST, id LIMIT 10""")
def active_runs(t):
    return listings.active_runs(t["scrape_runs"], "indeed_brightdata").select("id", "started_at")


@query("active_query_page", "P28", f"""
SELECT id, {ts('created_at')} FROM @search_queries WHERE (source = 'linkedin' OR source IS NULL) AND is_active ORDER BY search_queries.created_at DESC, id LIMIT 10""")
def active_query_page(t):
    return listings.query_page(t["search_queries"], "linkedin", True, 10).select("id", "created_at")


@query("company_autocomplete", "P29", "SELECT id, name FROM @companies WHERE name ILIKE '%00%' ORDER BY name, id LIMIT 10")
def company_autocomplete(t):
    return suggestions(t["companies"], "name", "00").select("id", "name")


@query("location_autocomplete", "P29", "SELECT id, full_location_string FROM @locations WHERE full_location_string ILIKE '%CITY 1%' ORDER BY full_location_string, id LIMIT 10")
def location_autocomplete(t):
    return suggestions(t["locations"], "full_location_string", "CITY 1").select("id", "full_location_string")


@query("active_ecosystems", "P30", "SELECT id, name FROM @ecosystems WHERE is_active")
def active_ecosystems(t):
    return listings.active_dimension(t["ecosystems"]).select("id", "name")


@query("active_languages", "P30", "SELECT id, name FROM @programming_languages WHERE is_active")
def active_languages(t):
    return listings.active_dimension(t["programming_languages"]).select("id", "name")


@query("company_listing", "P31", """
SELECT c.id, c.name, m.hiring_model, m.company_id IS NOT NULL AS has_master FROM (SELECT * FROM @companies WHERE name ILIKE '%customer%' ORDER BY name, id LIMIT 100 OFFSET 20) c
LEFT JOIN @company_master_data m ON m.company_id = c.id""")
def company_listing(t):
    return listings.company_listing(t, "customer", 100, 20).select(
        "id", "name", F.col("company_master_data.hiring_model").alias("hiring_model"),
        F.col("company_master_data").isNotNull().alias("has_master"),
    )


@query("company_listing_total", "P31", "SELECT count(*) AS total FROM @companies WHERE name ILIKE '%customer%'")
def company_listing_total(t):
    return listings.company_total(t, "customer")


@query("location_listing", "P5 O2", "SELECT id, city FROM @locations WHERE city ILIKE '%be%' OR country_code ILIKE '%be%' OR region ILIKE '%be%' ORDER BY city NULLS LAST, id LIMIT 50")
def location_listing(t):
    return listings.location_listing(t, "be").select("id", "city")


@query("inactive_listing", "P32", f"""
SELECT p.id, title, {ts('p.detected_inactive_at', 'detected_inactive_at')}, c.name AS company_name, l.city AS location_city
FROM (SELECT * FROM @job_postings WHERE NOT is_active ORDER BY detected_inactive_at DESC NULLS LAST, id LIMIT 50 OFFSET 10) p
LEFT JOIN @companies c ON c.id = p.company_id LEFT JOIN @locations l ON l.id = p.location_id""")
def inactive_listing(t):
    return listings.inactive_listing(t, 50, 10)


@query("direct_employer_jobs", "P33", """
SELECT p.id, c.name AS company_name FROM @job_postings p JOIN @companies c ON p.company_id = c.id JOIN @company_master_data m ON m.company_id = c.id
WHERE hiring_model = 'direct' AND title_classification = 'Data'""")
def direct_employer_jobs(t):
    return listings.jobs_by_hiring_model(t, "direct", "Data").select("id", "company_name")


@query("recent_failures", "P34", f"""
SELECT f.job_posting_id AS id, enrichment_error AS error, {ts('enrichment_completed_at', 'failed_at')}, title AS name
FROM (SELECT * FROM @llm_enrichment WHERE enrichment_error IS NOT NULL ORDER BY enrichment_completed_at DESC NULLS LAST, job_posting_id LIMIT 20) f
LEFT JOIN @job_postings p ON p.id = f.job_posting_id""")
def recent_failures(t):
    return listings.recent_failures(
        t["llm_enrichment"], "job_posting_id", "enrichment_error", "enrichment_completed_at", t["job_postings"], "id", "title", 20
    )


@query("run_details", "P35", """
SELECT id, coalesce(jobs_found, 0) AS jobs_found, coalesce(CAST(json_extract_string(metadata, '$.jobs_error') AS BIGINT), 0) AS jobs_error,
  CASE WHEN json_extract(metadata, '$.error_details') IS NULL THEN '' ELSE 'bad row|no title' END AS error_details, 0 AS jobs_skipped FROM @scrape_runs""")
def run_details(t):
    return listings.run_detail(t["scrape_runs"]).select("id", "jobs_found", "jobs_error", "error_details", "jobs_skipped")


@query("run_listing", "J18 O3", f"""
SELECT r.id, y.name AS job_type, coalesce(r.source, 'linkedin') AS source, coalesce(jobs_found, 0) AS jobs_found, {ts('r.started_at', 'started_at')}
FROM (SELECT * FROM @scrape_runs WHERE status = 'completed' ORDER BY started_at DESC NULLS LAST, id LIMIT 50) r LEFT JOIN @job_types y ON y.id = r.job_type_id""")
def run_listing(t):
    return listings.run_listing(t, "completed").select("id", "job_type", "source", "jobs_found", "started_at")


@query("batch_selection", "P36 O4", """
SELECT 'unenriched' AS mode, id FROM (SELECT id FROM @locations WHERE NOT coalesce(ai_enriched, FALSE) ORDER BY id LIMIT 40)
UNION ALL SELECT 'ids', id FROM @locations WHERE id IN (SELECT s_suppkey FROM @supplier WHERE s_nationkey = 5)
UNION ALL SELECT 'all', id FROM @locations""")
def batch_selection(t):
    loc = t["locations"]
    ids = t["supplier"].where("s_nationkey = 5").select(F.col("s_suppkey").alias("id"))
    modes = (
        ("unenriched", lifecycle.select_for_batch(loc, done=F.col("ai_enriched"), limit=40)),
        ("ids", lifecycle.select_for_batch(loc, ids)),
        ("all", lifecycle.select_for_batch(loc, force=True)),
    )
    frames = [df.select(F.lit(n).alias("mode"), "id") for n, df in modes]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# --- views and joins ----------------------------------------------------------------------------


@query("ranking_view", "J1", """
SELECT jp.id, jp.title, c.name AS company_name, c.industry AS company_industry, c.rating AS company_rating, m.hiring_model, l.city AS location_city,
  e.type_datarol AS data_role_type, array_to_string(e.hard_skills, '|') AS skills_must_have, e.samenvatting_lang_nl AS samenvatting_lang, length(jd.full_description_text) AS description_length
FROM @job_postings jp LEFT JOIN @companies c ON jp.company_id = c.id LEFT JOIN @company_master_data m ON c.id = m.company_id LEFT JOIN @locations l ON jp.location_id = l.id
LEFT JOIN @llm_enrichment e ON jp.id = e.job_posting_id LEFT JOIN @job_descriptions jd ON jp.id = jd.job_posting_id WHERE jp.is_active""")
def ranking_view(t):
    return views.ranking_view(t).select(
        "id", "title", "company_name", "company_industry", "company_rating", "hiring_model", "location_city", "data_role_type",
        "skills_must_have", "samenvatting_lang", "description_length",
    )


@query("job_listings_view", "J2", f"""
SELECT e.job_posting_id, j.title, c.name AS company_name, m.sector_en, m.size_category, coalesce(j.location_id_override, j.location_id) AS location_id,
  l.city_name_nl, l.subdivision_name_en, e.type_datarol, array_to_string(e.contract, '|') AS contract, j.ranking_position, {ts('e.created_at', 'created_at')}
FROM @llm_enrichment e JOIN @job_postings j ON e.job_posting_id = j.id JOIN @companies c ON j.company_id = c.id
LEFT JOIN @locations l ON l.id = coalesce(j.location_id_override, j.location_id) LEFT JOIN @company_master_data m ON c.id = m.company_id
WHERE j.is_active AND j.title_classification = 'Data'""")
def job_listings_view(t):
    return views.job_listings(t).select(
        "job_posting_id", "title", "company_name", "sector_en", "size_category", "location_id", "city_name_nl", "subdivision_name_en",
        "type_datarol", "contract", "ranking_position", "created_at",
    )


@query("job_listings_columnwise_view", "J3", """
SELECT e.job_posting_id, coalesce(o.city_name_fr, l.city_name_fr) AS city_name_fr, coalesce(o.subdivision_name_en, l.subdivision_name_en) AS subdivision_name_en, e.perk_remote_policy
FROM @llm_enrichment e LEFT JOIN @job_postings j ON e.job_posting_id = j.id LEFT JOIN @locations l ON j.location_id = l.id LEFT JOIN @locations o ON j.location_id_override = o.id""")
def job_listings_columnwise_view(t):
    return views.job_listings_columnwise(t).select("job_posting_id", "city_name_fr", "subdivision_name_en", "perk_remote_policy")


@query("enrichment_active_view", "J4", """
SELECT e.job_posting_id, j.title, c.name AS company_name, m.category_nl, l.city_name_en, e.perk_remote_policy, e.enrichment_error
FROM @llm_enrichment e LEFT JOIN @job_postings j ON e.job_posting_id = j.id LEFT JOIN @companies c ON j.company_id = c.id
LEFT JOIN @company_master_data m ON c.id = m.company_id LEFT JOIN @locations l ON j.location_id = l.id""")
def enrichment_active_view(t):
    return views.enrichment_active(t).select(
        "job_posting_id", "title", "company_name", "category_nl", "city_name_en", "perk_remote_policy", "enrichment_error"
    )


@query("companies_list_view", "J5", """
SELECT c.id, c.name, m.id AS master_data_id, m.hiring_model, m.size_category,
 (SELECT count(*) FROM @job_postings p WHERE p.company_id = c.id) AS job_count, (SELECT count(*) FROM @job_postings p WHERE p.company_id = c.id AND is_active) AS active_job_count
FROM @companies c LEFT JOIN @company_master_data m ON c.id = m.company_id""")
def companies_list_view(t):
    return views.companies_list(t).select("id", "name", "master_data_id", "hiring_model", "size_category", "job_count", "active_job_count")


@query("job_details", "J6", """
SELECT p.id, c.name AS company_name, l.city, d.summary, e.type_datarol,
 (SELECT string_agg(source || ':' || source_job_id, ',' ORDER BY source) FROM @job_sources s WHERE s.job_posting_id = p.id) AS sources,
 (SELECT string_agg(name, ',' ORDER BY name) FROM @job_posters s WHERE s.job_posting_id = p.id) AS posters
FROM @job_postings p LEFT JOIN @companies c ON c.id = p.company_id LEFT JOIN @locations l ON l.id = p.location_id
LEFT JOIN @job_descriptions d ON d.job_posting_id = p.id LEFT JOIN @llm_enrichment e ON e.job_posting_id = p.id""")
def job_details(t):
    d = joins.job_details(t)
    pairs = F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["source_job_id"]))
    return d.select(
        "id", F.col("company.name").alias("company_name"), F.col("location.city").alias("city"), "summary",
        F.col("enrichment.type_datarol").alias("type_datarol"), F.array_join(pairs, ",").alias("sources"),
        F.array_join(F.col("posters.name"), ",").alias("posters"),
    )


@query("enrichment_of_data_jobs", "J7", "SELECT job_posting_id, type_datarol FROM @llm_enrichment WHERE job_posting_id IN (SELECT id FROM @job_postings WHERE title_classification = 'Data')")
def enrichment_of_data_jobs(t):
    return joins.enrichment_of_class(t["llm_enrichment"], t["job_postings"]).select("job_posting_id", "type_datarol")


@query("companies_without_master", "J8", "SELECT id, name FROM @companies c WHERE NOT EXISTS (SELECT 1 FROM @company_master_data m WHERE m.company_id = c.id)")
def companies_without_master(t):
    return joins.without_child(t["companies"], t["company_master_data"], "id", "company_id").select("id", "name")


@query("jobs_without_type", "J9 J10 U2", "SELECT id AS job_posting_id FROM @job_postings p WHERE NOT EXISTS (SELECT 1 FROM @job_type_assignments a WHERE a.job_posting_id = p.id)")
def jobs_without_type(t):
    return assign.unassigned(t["job_postings"], t["job_type_assignments"])


@query("jobs_without_sources", "J10 U2", "SELECT id, source FROM @job_postings p WHERE NOT EXISTS (SELECT 1 FROM @job_sources s WHERE s.job_posting_id = p.id)")
def jobs_without_sources(t):
    return joins.without_child(t["job_postings"], t["job_sources"], "id", "job_posting_id").select("id", "source")


@query("jobs_of_type", "J11 O2", """
SELECT id, title FROM @job_postings WHERE id IN (SELECT job_posting_id FROM @job_type_assignments WHERE job_type_id = 2) ORDER BY posted_date DESC NULLS LAST, id LIMIT 50""")
def jobs_of_type(t):
    typed = t["job_type_assignments"].where("job_type_id = 2")
    found = joins.with_child(t["job_postings"], typed, "id", "job_posting_id")
    return page(found, [F.col("posted_date").desc_nulls_last(), F.col("id")], 50).select("id", "title")


@query("job_history", "J13", f"""
SELECT h.job_posting_id, h.scrape_run_id, {ts('h.detected_at', 'detected_at')}, r.search_query, r.status FROM @job_scrape_history h LEFT JOIN @scrape_runs r ON r.id = h.scrape_run_id""")
def job_history(t):
    return joins.job_history(t["job_scrape_history"], t["scrape_runs"]).select(
        "job_posting_id", "scrape_run_id", "detected_at", "search_query", "status"
    )


@query("run_jobs_of_source", "J13", """
SELECT h.scrape_run_id, h.job_posting_id, p.title, c.name AS company_name FROM @job_scrape_history h JOIN @job_postings p ON p.id = h.job_posting_id AND p.source = 'indeed'
LEFT JOIN @companies c ON c.id = p.company_id""")
def run_jobs_of_source(t):
    return joins.run_jobs(t, "indeed").select("scrape_run_id", "job_posting_id", "title", "company_name")


@query("events_near_runs", "J14", """
SELECT e.event_id, r.id AS run_id FROM @events e JOIN (SELECT * FROM @scrape_runs WHERE started_at IS NOT NULL ORDER BY jobs_found DESC NULLS LAST, id LIMIT 1) r ON e.ts BETWEEN r.started_at - INTERVAL 1 MINUTE
 AND coalesce(r.completed_at, r.started_at + INTERVAL 10 MINUTE) + INTERVAL 1 MINUTE""")
def events_near_runs(t):
    # One run is looked at, the one that found most; near all runs at once the rows would grow with the square.
    run = t["scrape_runs"].where("started_at IS NOT NULL").orderBy(F.col("jobs_found").desc_nulls_last(), "id").limit(1)
    points = t["events"].select("event_id", "ts")
    return joins.near_in_time(points, "ts", joins.run_spans(run), "span_lo", "span_hi").select("event_id", "run_id")


@query("last_scraped", "J15 W3", f"""
SELECT p.id, {ts('h.m', 'last_scraped_at')} FROM @job_postings p LEFT JOIN (SELECT job_posting_id, max(detected_at) AS m FROM @job_scrape_history GROUP BY 1) h ON h.job_posting_id = p.id""")
def last_scraped(t):
    return joins.last_scraped(t["job_postings"], t["job_scrape_history"]).select("id", "last_scraped_at")


_RANKED = "is_active AND title_classification = 'Data' AND ranking_position IS NOT NULL"


@query("latest_ranking_rows", "J16", f"""
SELECT id, ranking_position FROM @job_postings WHERE {_RANKED} AND ranking_updated_at = (SELECT max(ranking_updated_at) FROM @job_postings WHERE {_RANKED})""")
def latest_ranking_rows(t):
    return joins.latest_ranking(t["job_postings"]).select("id", "ranking_position")


@query("query_history_by_text", "J17", f"""
WITH r AS (SELECT search_query, location_query, max(started_at) AS m, sum(coalesce(jobs_found, 0)) AS j, count(*) AS n, arg_max(id, (coalesce(started_at, TIMESTAMP '1900-01-01'), id)) AS lid
 FROM @scrape_runs GROUP BY 1, 2)
SELECT q.id, {ts('r.m', 'last_run_at')}, lid AS last_run_id, CAST(coalesce(j, 0) AS BIGINT) AS total_jobs, coalesce(n, 0) AS run_count
FROM @search_queries q LEFT JOIN r ON r.search_query = q.search_query AND r.location_query = q.location_query""")
def query_history_by_text(t):
    keys = [("search_query", "search_query"), ("location_query", "location_query")]
    return listings.query_history(t["search_queries"], t["scrape_runs"], keys).select(
        "id", "last_run_at", "last_run_id", "total_jobs", "run_count"
    )


@query("query_history_by_id", "J17", f"""
SELECT q.id, {ts('r.m', 'last_run_at')}, CAST(coalesce(j, 0) AS BIGINT) AS total_jobs, coalesce(n, 0) AS run_count
FROM @search_queries q LEFT JOIN (SELECT search_query_id, max(started_at) AS m, sum(coalesce(jobs_found, 0)) AS j, count(*) AS n FROM @scrape_runs GROUP BY 1) r ON r.search_query_id = q.id""")
def query_history_by_id(t):
    return listings.query_history(t["search_queries"], t["scrape_runs"], [("id", "search_query_id")]).select(
        "id", "last_run_at", "total_jobs", "run_count"
    )


@query("posting_match", "J19 T2", f"""
WITH s AS (SELECT dedup_key, arg_min(id, (created_at, id)) AS existing_id FROM (SELECT p.id, p.created_at, {sql_key('p.title', 'c.name')} AS dedup_key FROM @job_postings p JOIN @companies c ON c.id = p.company_id) GROUP BY 1)
SELECT r.arrival, {sql_key('r.job_title', 'r.company_name')} AS dedup_key, s.existing_id
FROM @linkedin_raw r LEFT JOIN s ON s.dedup_key = {sql_key('r.job_title', 'r.company_name')}""")
def posting_match(t):
    names = t["companies"].select(F.col("id").alias("company_id"), F.col("name"))
    stored = t["job_postings"].drop("dedup_key").join(names, "company_id").withColumn("dedup_key", text.dedup_key(F.col("title"), F.col("name")))
    records = t["linkedin_raw"].select("arrival", F.col("job_title").alias("title"), "company_name")
    return joins.match_postings(records, stored).select("arrival", "dedup_key", "existing_id")


@query("company_match", "J19 W5", """
WITH n AS (SELECT name, arg_min(id, (NOT has_logo, linkedin_company_id IS NULL, id)) AS id FROM @companies GROUP BY 1)
SELECT r.arrival, CASE WHEN r.company_id IS NOT NULL THEN i.id ELSE n.id END AS company_id
FROM @linkedin_raw r LEFT JOIN @companies i ON i.linkedin_company_id = r.company_id LEFT JOIN n ON n.name = r.company_name""")
def company_match(t):
    records = t["linkedin_raw"].select("arrival", F.col("company_id").alias("linkedin_company_id"), "company_name")
    return joins.match_companies(records, t["companies"]).select("arrival", "company_id")


@query("classifier_inputs", "J20 T19", """
SELECT c.id, 'Company: ' || c.name || CASE WHEN bedrijfswebsite <> '' THEN chr(10) || 'Website: ' || bedrijfswebsite ELSE '' END
  || CASE WHEN sector_en <> '' THEN chr(10) || 'Sector: ' || sector_en ELSE '' END || CASE WHEN aantal_werknemers <> '' THEN chr(10) || 'Employees: ' || aantal_werknemers ELSE '' END
  || coalesce(chr(10) || 'Description: ' || coalesce(nullif(bedrijfsomschrijving_nl, ''), nullif(bedrijfsomschrijving_en, '')), '')
  || chr(10) || 'Facts: [city] ' || coalesce(nullif(locatie_belgie, ''), 'none') || coalesce(' | [] ' || nullif(sector_fr, ''), '')
  || coalesce(chr(10) || 'Key facts: ' || nullif(concat_ws(' | ', 'size ' || size_category, 'since ' || CAST(founded_year AS VARCHAR)), ''), '') AS input_text
FROM @companies c LEFT JOIN @company_master_data m ON m.company_id = c.id""")
def classifier_inputs(t):
    m = t["company_master_data"].drop("id", "industry")
    joined = t["companies"].join(m, F.col("id") == F.col("company_id"), "left")

    def fact(category, nl, en):
        return F.struct(category.alias("category"), nl.alias("text_nl"), en.alias("text_en"))

    nothing = F.lit(None).cast("string")
    facts = F.array(
        fact(F.lit("city"), F.col("locatie_belgie"), F.lit("none")), fact(nothing, F.lit(""), F.col("sector_fr")),
        fact(F.lit("empty"), nothing, nothing),
    )
    c = F.col
    size_arguments = F.array_compact(F.array(F.concat(F.lit("size "), c("size_category")), F.concat(F.lit("since "), c("founded_year").cast("string"))))
    return joined.select(
        "id",
        text.classifier_text(
            c("name"), c("bedrijfswebsite"), c("sector_en"), c("aantal_werknemers"), c("bedrijfsomschrijving_nl"),
            c("bedrijfsomschrijving_en"), facts, size_arguments,
        ).alias("input_text"),
    )


@query("rated_indeed_jobs", "O3 O4", """
SELECT p.id, c.rating FROM @job_postings p JOIN @companies c ON c.id = p.company_id WHERE p.source = 'indeed' AND c.rating IS NOT NULL ORDER BY c.rating DESC, p.id LIMIT 100""")
def rated_indeed_jobs(t):
    rated = t["companies"].where("rating IS NOT NULL").select(F.col("id").alias("company_id"), "rating")
    found = t["job_postings"].where("source = 'indeed'").join(rated, "company_id")
    return page(found, [F.col("rating").desc(), F.col("id")], 100).select("id", "rating")


@query("last_success", "O5", f"""
SELECT search_query, location_query, arg_max(id, (completed_at, id)) AS run_id, {ts('max(completed_at)', 'completed_at')} FROM @scrape_runs WHERE status = 'completed' GROUP BY 1, 2""")
def last_success(t):
    return runs.last_success(t["scrape_runs"])


@query("type_seen_pairs", "U3", """
SELECT DISTINCT h.job_posting_id, r.job_type_id, 'migration' AS assigned_via FROM @job_scrape_history h JOIN @scrape_runs r ON r.id = h.scrape_run_id
WHERE r.job_type_id IS NOT NULL AND h.job_posting_id NOT IN (SELECT job_posting_id FROM @job_type_assignments)
UNION ALL SELECT job_posting_id, job_type_id, assigned_via FROM @job_type_assignments""")
def type_seen_pairs(t):
    return assign.assign_all_run_types(t["job_type_assignments"], t["job_scrape_history"], t["scrape_runs"])
