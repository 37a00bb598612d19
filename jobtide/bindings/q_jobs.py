"""Composite jobs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assign, dedup, override, ranking, tables, techstack
from ..operators import lifecycle
from ..plans import ingest
from ..plans.views import ranking_view
from ..session import checkpoint_root, shuffles_go
from ..operators.growing import grow
from ..operators.sizing import input_parts
from ..streaming import distinct, inactivity, sightings
from .base import JOBS_AS_OF, RUNS_AS_OF
from .q_functions import HOURLY, SCORED
from .registry import JOBS_NOW, query, sql_key, sql_strip, ts

RANKED = f"""{SCORED},
s2 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY base_score DESC, id) AS company_rank, row_number() OVER (PARTITION BY role ORDER BY base_score DESC, id) AS role_type_rank,
 row_number() OVER (PARTITION BY location_id ORDER BY base_score DESC, id) AS location_rank, row_number() OVER (PARTITION BY seniority ORDER BY base_score DESC, id) AS seniority_rank FROM s1),
s3 AS (SELECT *, {HOURLY} AS hourly_multiplier FROM s2),
s4 AS (SELECT *, (CASE WHEN location_rank = 1 THEN base_score * greatest(0.1::DOUBLE, 1 - (company_rank - 1) * 0.15::DOUBLE) * greatest(0.3::DOUBLE, 1 - (role_type_rank - 1) * 0.1::DOUBLE) * 1.05::DOUBLE
  ELSE base_score * greatest(0.1::DOUBLE, 1 - (company_rank - 1) * 0.15::DOUBLE) * greatest(0.3::DOUBLE, 1 - (role_type_rank - 1) * 0.1::DOUBLE) END)
  * greatest(0.5::DOUBLE, 1 - (seniority_rank - 1) * 0.05::DOUBLE) * hourly_multiplier AS final_score FROM s3),
s5 AS (SELECT *, CASE WHEN title_classification = 'NIS' THEN 999999 ELSE row_number() OVER (PARTITION BY title_classification IS NOT DISTINCT FROM 'NIS' ORDER BY final_score DESC, id) END AS final_rank FROM s4)"""


@query("ranking_run", "C2 W1 W2 M11", f"""
WITH {RANKED} SELECT id, company_rank, role_type_rank, location_rank, seniority_rank, base_score, final_score, final_rank FROM s5""")
def ranking_run(t):
    return ranking.rank_postings(ranking_view(t), JOBS_AS_OF).select(
        "id", "company_rank", "role_type_rank", "location_rank", "seniority_rank", "base_score", "final_score", "final_rank",
    )


@query("stored_ranking", "S30 C2", f"""
WITH {RANKED} SELECT id, round_even(base_score, 2) + 0::DOUBLE AS base_score, round_even(final_score, 2) + 0::DOUBLE AS ranking_score, final_rank AS ranking_position,
 strftime({JOBS_NOW}, '%Y-%m-%d %H:%M:%S') AS ranking_updated_at, round_even(hourly_multiplier, 3) AS hourly_multiplier, FALSE AS needs_ranking,
 CAST(company_rank AS VARCHAR) AS company_rank, CAST(role_match_score AS VARCHAR) AS role_match_score FROM s5""")
def stored_ranking(t):
    ranked = ranking.rank_postings(ranking_view(t), JOBS_AS_OF)
    return ranking.stored_ranking(ranked, JOBS_AS_OF).select(
        "id", "base_score", "ranking_score", "ranking_position", "ranking_updated_at", "hourly_multiplier", "needs_ranking",
        F.get_json_object("ranking_metadata", "$.company_rank").alias("company_rank"),
        F.get_json_object("ranking_metadata", "$.role_match_score").alias("role_match_score"),
    )


@query("rankings_saved", "S30 S17 C2", f"""
WITH {RANKED} SELECT p.id, CASE WHEN s5.id IS NULL THEN p.ranking_position ELSE s5.final_rank END AS ranking_position,
 CASE WHEN s5.id IS NULL THEN p.base_score ELSE round_even(s5.base_score, 2) + 0::DOUBLE END AS base_score, s5.id IS NULL AND p.needs_ranking AS needs_ranking
FROM @job_postings p LEFT JOIN s5 ON s5.id = p.id""")
def rankings_saved(t):
    ranked = ranking.rank_postings(ranking_view(t), JOBS_AS_OF)
    return ranking.save_rankings(t["job_postings"], ranked, JOBS_AS_OF).select("id", "ranking_position", "base_score", "needs_ranking")


# --- ingest -------------------------------------------------------------------------------------


def stored_tables(t):
    """The stored side of an ingest: ids as text, dedup keys from the real titles and names."""
    def as_text(df, *columns):
        return df.withColumns({c: F.col(c).cast("string") for c in columns})

    companies = as_text(t["companies"], "id")
    names = companies.select(F.col("id").alias("company_id"), "name")
    postings = as_text(t["job_postings"], "id", "company_id", "location_id", "location_id_override")
    postings = postings.join(names, "company_id").withColumn("dedup_key", text.dedup_key(F.col("title"), F.col("name"))).drop("name")
    kept = postings.select(F.col("id").alias("job_posting_id"))

    def of_kept(name):
        return as_text(t[name], "job_posting_id").join(kept, "job_posting_id", "left_semi")

    return {
        "companies": companies,
        "company_master_data": as_text(t["company_master_data"], "company_id"),
        "locations": as_text(t["locations"], "id"),
        "job_postings": postings,
        "job_sources": of_kept("job_sources"),
        "job_descriptions": of_kept("job_descriptions").withColumn("full_description_html", F.lit(None).cast("string")),
        "job_posters": of_kept("job_posters").withColumn("profile_url", F.lit(None).cast("string")).drop("id"),
        "llm_enrichment": as_text(t["llm_enrichment"], "job_posting_id").drop("id"),
        "job_scrape_history": t["job_scrape_history"].select(
            F.col("job_posting_id").cast("string"), F.col("scrape_run_id").cast("string"), "detected_at"
        ),
    }


def ingested(t):
    from .q_tables import linkedin_records

    raw = linkedin_records(t)
    return ingest.ingest_items(raw, "linkedin", "run-1", stored_tables(t), JOBS_AS_OF)


# One row per valid record with the company it resolves to and its dedup key.
INGEST = f"""
st_c AS (SELECT * FROM @companies),
st_p AS (SELECT p.id, p.created_at, {sql_key('p.title', 'c.name')} AS dedup_key, c.name FROM @job_postings p JOIN st_c c ON c.id = p.company_id),
old AS (SELECT dedup_key, arg_min(id, (created_at, CAST(id AS VARCHAR))) AS id FROM st_p GROUP BY 1),
v AS (SELECT * FROM @linkedin_raw WHERE error IS NULL AND job_posting_id IS NOT NULL AND job_title IS NOT NULL AND coalesce(url, job_url) IS NOT NULL),
k AS (SELECT v.*, {sql_key('job_title', "CASE WHEN v.company_id IS NOT NULL THEN coalesce(i.name, v.company_name) ELSE v.company_name END")} AS dedup_key
 FROM v LEFT JOIN st_c i ON i.linkedin_company_id = v.company_id),
n AS (SELECT k.*, old.id AS old_id, row_number() OVER (PARTITION BY k.dedup_key ORDER BY arrival) AS nth FROM k LEFT JOIN old ON old.dedup_key = k.dedup_key)"""


@query("ingest_statuses", "C1 W9 J19", f"""
WITH {INGEST.strip()}
SELECT arrival, CASE WHEN old_id IS NULL AND nth = 1 THEN 'new' ELSE 'updated' END AS status, coalesce(CAST(old_id AS VARCHAR), sha256(dedup_key)) AS job_id FROM n
UNION ALL SELECT arrival, 'error', NULL FROM @linkedin_raw WHERE error IS NULL AND (job_posting_id IS NULL OR job_title IS NULL OR coalesce(url, job_url) IS NULL)""")
def ingest_statuses(t):
    return ingested(t).results.select("arrival", "status", "job_id")


@query("ingest_errors", "A12 S4", """
SELECT arrival, CASE WHEN job_posting_id IS NULL THEN 'Field ''job_posting_id'': Field required' WHEN job_title IS NULL THEN 'Field ''job_title'': Field required' ELSE 'Field ''url'': Field required' END AS error
FROM @linkedin_raw WHERE error IS NULL AND (job_posting_id IS NULL OR job_title IS NULL OR coalesce(url, job_url) IS NULL)""")
def ingest_errors(t):
    return ingest.batch_errors(ingested(t).results)


@query("ingest_summary", "A12 C1", f"""
WITH {INGEST.strip()}
SELECT (SELECT count(*) FROM n WHERE old_id IS NULL AND nth = 1) AS new_count, (SELECT count(*) FROM n WHERE NOT (old_id IS NULL AND nth = 1)) AS updated_count, 0 AS skipped_count,
 (SELECT count(*) FROM @linkedin_raw WHERE error IS NULL AND (job_posting_id IS NULL OR job_title IS NULL OR coalesce(url, job_url) IS NULL)) AS error_count,
 (SELECT count(DISTINCT dedup_key) FROM n) AS distinct_jobs""")
def ingest_summary(t):
    return ingest.batch_summary(ingested(t).results)


@query("ingest_postings", "C1 S5 S14 S31", f"""
WITH {INGEST.strip()},
w AS (SELECT n.*, p.title AS p_title, p.num_applicants AS p_num, p.base_salary_min AS p_min, p.base_salary_max AS p_max, p.employment_type AS p_emp, p.seniority_level AS p_sen, p.application_available AS p_app,
  s.job_posting_id IS NOT NULL AS known FROM n LEFT JOIN @job_postings p ON p.id = n.old_id LEFT JOIN @job_sources s ON s.job_posting_id = n.old_id AND s.source = 'linkedin'),
f AS (SELECT *, (job_title, job_num_applicants, job_employment_type, job_seniority_level, application_availability, job_base_pay_range) AS f7, lag((job_title, job_num_applicants, job_employment_type, job_seniority_level, application_availability, job_base_pay_range)) OVER (PARTITION BY dedup_key ORDER BY arrival) AS prev FROM w),
ch AS (SELECT *, CASE WHEN nth > 1 THEN f7 IS DISTINCT FROM prev ELSE TRUE END AS changed FROM f),
win AS (SELECT dedup_key, max(arrival) AS a FROM ch WHERE changed GROUP BY 1)
SELECT coalesce(CAST(ch.old_id AS VARCHAR), sha256(ch.dedup_key)) AS id, ch.job_title AS title, ch.job_posting_id AS linkedin_job_id, ch.job_num_applicants AS num_applicants, coalesce(url, job_url) AS job_url
FROM ch JOIN win ON win.dedup_key = ch.dedup_key AND win.a = ch.arrival""")
def ingest_postings(t):
    out = ingested(t)
    touched = out.results.select(F.col("job_id").alias("id"))
    return out.tables["job_postings"].join(touched, "id", "left_semi").select(
        "id", "title", "linkedin_job_id", F.col("num_applicants").cast("int").alias("num_applicants"), "job_url"
    )


@query("ingest_rerank_flags", "C1 C10", f"""
WITH {INGEST.strip()}
SELECT CAST(p.id AS VARCHAR) AS id, p.is_active OR p.needs_ranking OR p.id IN (SELECT old_id FROM n WHERE old_id IS NOT NULL) AS needs_ranking FROM @job_postings p WHERE p.id IN (SELECT id FROM st_p)
UNION ALL SELECT DISTINCT sha256(dedup_key), TRUE FROM n WHERE old_id IS NULL""")
def ingest_rerank_flags(t):
    return ingested(t).tables["job_postings"].select("id", "needs_ranking")


@query("ingest_run_types", "C1 C6 S14", f"""
WITH {INGEST.strip()},
a AS (SELECT CAST(job_posting_id AS VARCHAR) AS job_posting_id, job_type_id, assigned_via FROM @job_type_assignments)
SELECT * FROM a UNION ALL SELECT DISTINCT coalesce(CAST(old_id AS VARCHAR), sha256(dedup_key)), 2, 'scrape' FROM n
 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.job_type_id = 2 AND a.job_posting_id = CAST(n.old_id AS VARCHAR))""")
def ingest_run_types(t):
    held = t["job_type_assignments"].withColumn("job_posting_id", F.col("job_posting_id").cast("string"))
    return ingest.assign_run_type(held, ingested(t).results, 2)


@query("ingest_run_closed", "C1 A12 S16", f"""
WITH {INGEST.strip()},
c AS (SELECT (SELECT count(*) FROM n WHERE old_id IS NULL AND nth = 1) AS nw, (SELECT count(*) FROM n WHERE NOT (old_id IS NULL AND nth = 1)) AS up,
 (SELECT count(*) FROM @linkedin_raw WHERE error IS NULL AND (job_posting_id IS NULL OR job_title IS NULL OR coalesce(url, job_url) IS NULL)) AS er)
SELECT r.id, CASE WHEN r.id = 20 THEN 'completed' ELSE status END AS status, CASE WHEN r.id = 20 THEN nw + up + er ELSE jobs_found END AS jobs_found, CASE WHEN r.id = 20 THEN nw ELSE jobs_new END AS jobs_new,
 CASE WHEN r.id = 20 THEN 'New: ' || nw || ', Updated: ' || up || ', Skipped: 0, Errors: ' || er END AS batch_summary FROM @scrape_runs r, c""")
def ingest_run_closed(t):
    closed = ingest.close_run(t["scrape_runs"], 20, ingested(t).results, RUNS_AS_OF)
    return closed.select("id", "status", "jobs_found", "jobs_new", F.get_json_object("metadata", "$.batch_summary").alias("batch_summary"))


@query("ingest_sources", "C1 S14", f"""
WITH {INGEST.strip()},
st_s AS (SELECT CAST(s.job_posting_id AS VARCHAR) AS job_posting_id, source, source_job_id FROM @job_sources s WHERE s.job_posting_id IN (SELECT id FROM st_p))
SELECT * FROM st_s UNION ALL
SELECT coalesce(CAST(old_id AS VARCHAR), sha256(dedup_key)), 'linkedin', job_posting_id FROM n WHERE nth = 1
 AND NOT EXISTS (SELECT 1 FROM st_s WHERE st_s.source = 'linkedin' AND st_s.job_posting_id = CAST(n.old_id AS VARCHAR))""")
def ingest_sources(t):
    return ingested(t).tables["job_sources"].select("job_posting_id", "source", "source_job_id")


@query("ingest_locations", "C1 C5 S15", f"""
WITH {INGEST.strip()},
seen AS (SELECT DISTINCT {sql_strip('job_location')} AS s FROM v)
SELECT full_location_string, city FROM @locations
UNION ALL SELECT s, CASE WHEN contains(s, ',') OR length(s) <> 2 THEN {sql_strip("split_part(s, ',', 1)")} END FROM seen WHERE s NOT IN (SELECT full_location_string FROM @locations)
UNION ALL SELECT DISTINCT seat || ', Belgium', {sql_strip('seat')} FROM (
  SELECT m.locatie_belgie AS seat FROM v JOIN st_c c ON c.linkedin_company_id = v.company_id JOIN @company_master_data m ON m.company_id = c.id WHERE starts_with(v.job_location, 'Belgium')
  UNION SELECT m.locatie_belgie FROM v JOIN st_c c ON v.company_id IS NULL AND c.name = v.company_name JOIN @company_master_data m ON m.company_id = c.id WHERE starts_with(v.job_location, 'Belgium'))
 WHERE trim(seat) <> '' AND lower(seat) NOT IN ('niet gevonden', 'unknown', 'n/a') AND seat || ', Belgium' NOT IN (SELECT full_location_string FROM @locations)""")
def ingest_locations(t):
    return ingested(t).tables["locations"].select("full_location_string", "city")


@query("ingest_companies", "C1 S15", f"""
WITH {INGEST.strip()}
SELECT name, linkedin_company_id FROM st_c
UNION ALL SELECT arg_min(company_name, arrival), company_id FROM v WHERE company_id IS NOT NULL AND company_id NOT IN (SELECT linkedin_company_id FROM st_c WHERE linkedin_company_id IS NOT NULL) GROUP BY company_id
UNION ALL SELECT DISTINCT company_name, NULL FROM v WHERE company_id IS NULL AND company_name NOT IN (SELECT name FROM st_c)
 AND arrival < (SELECT coalesce(min(arrival), 9999999999) FROM v x WHERE x.company_name = v.company_name AND x.company_id IS NOT NULL AND x.company_id NOT IN (SELECT linkedin_company_id FROM st_c WHERE linkedin_company_id IS NOT NULL))""")
def ingest_companies(t):
    return ingested(t).tables["companies"].select("name", "linkedin_company_id")


# --- merges and assignments ---------------------------------------------------------------------


@query("duplicates_resolved", "C3 W4 S14", f"""
WITH g AS (SELECT dedup_key, arg_min(id, (created_at, id)) AS keep FROM @job_postings WHERE dedup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT p.id, keep FROM @job_postings p JOIN g USING (dedup_key) WHERE p.id <> keep),
kept AS (SELECT * FROM @job_sources WHERE job_posting_id NOT IN (SELECT id FROM gone)),
d AS (SELECT keep AS job_posting_id, source, arg_min(source_job_id, (first_seen_at, source_job_id)) AS source_job_id, min(first_seen_at) AS first_seen_at FROM @job_sources s JOIN gone ON gone.id = s.job_posting_id GROUP BY 1, 2)
SELECT job_posting_id, source, source_job_id, {ts('first_seen_at')} FROM kept
UNION ALL SELECT job_posting_id, source, source_job_id, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') FROM d WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.job_posting_id = d.job_posting_id AND k.source = d.source)""")
def duplicates_resolved(t):
    _, sources, _ = dedup.resolve_duplicate_postings(t["job_postings"], t["job_sources"], {}, JOBS_AS_OF)
    return sources.select("job_posting_id", "source", "source_job_id", "first_seen_at")


@query("postings_after_merge", "C3", """
WITH g AS (SELECT dedup_key, arg_min(id, (created_at, id)) AS keep FROM @job_postings WHERE dedup_key IS NOT NULL GROUP BY 1)
SELECT p.id, p.dedup_key FROM @job_postings p LEFT JOIN g ON g.dedup_key = p.dedup_key WHERE g.keep IS NULL OR g.keep = p.id""")
def postings_after_merge(t):
    kept, _, _ = dedup.resolve_duplicate_postings(t["job_postings"], t["job_sources"], {}, JOBS_AS_OF)
    return kept.select("id", "dedup_key")


@query("company_merge", "C4 W6", """
WITH s AS (SELECT c.id, c.name, CASE WHEN has_logo THEN 1000 ELSE 0 END + CASE WHEN logo_url IS NOT NULL THEN 500 ELSE 0 END + CASE WHEN linkedin_company_id IS NOT NULL THEN 100 ELSE 0 END
 + (SELECT count(*) FROM @job_postings p WHERE p.company_id = c.id) AS score FROM @companies c),
k AS (SELECT name, arg_min(id, (-score, id)) AS keep FROM s GROUP BY 1)
SELECT p.id, k.keep AS company_id FROM @job_postings p JOIN @companies c ON c.id = p.company_id JOIN k ON k.name = c.name""")
def company_merge(t):
    _, moved, _ = dedup.merge_companies(t["companies"], t["job_postings"])
    return moved.select("id", "company_id")


@query("companies_after_merge", "C4", """
WITH s AS (SELECT c.id, c.name, CASE WHEN has_logo THEN 1000 ELSE 0 END + CASE WHEN logo_url IS NOT NULL THEN 500 ELSE 0 END + CASE WHEN linkedin_company_id IS NOT NULL THEN 100 ELSE 0 END
 + (SELECT count(*) FROM @job_postings p WHERE p.company_id = c.id) AS score FROM @companies c)
SELECT name, arg_min(id, (-score, id)) AS id FROM s GROUP BY 1""")
def companies_after_merge(t):
    left, _, _ = dedup.merge_companies(t["companies"], t["job_postings"])
    return left.select("name", "id")


_VAGUE = "l.city IN ('Flemish Region', 'Walloon Region', 'Brussels-Capital Region', 'Belgium', 'België')"
_SEAT = "trim(m.locatie_belgie) <> '' AND lower(m.locatie_belgie) NOT IN ('niet gevonden', 'unknown', 'n/a')"


@query("override_backfill", "C5 P14 P15 S17", f"""
WITH a AS (SELECT p.id, m.locatie_belgie || ', Belgium' AS s FROM @job_postings p JOIN @locations l ON l.id = p.location_id AND {_VAGUE} JOIN @company_master_data m ON m.company_id = p.company_id WHERE {_SEAT}),
k AS (SELECT full_location_string AS s, min(id) AS kid FROM @locations GROUP BY 1)
SELECT p.id, CASE WHEN a.id IS NULL THEN coalesce(CAST(p.location_id_override AS VARCHAR), '-') WHEN k.kid IS NOT NULL THEN CAST(k.kid AS VARCHAR) ELSE a.s END AS override
FROM @job_postings p LEFT JOIN a ON a.id = p.id LEFT JOIN k ON k.s = a.s""")
def override_backfill(t):
    moved, places, _ = override.backfill_override(t["job_postings"], t["locations"], t["company_master_data"], None)
    fresh = places.join(t["locations"].select("id"), "id", "left_anti").select(
        F.col("id").alias("location_id_override"), F.col("full_location_string").alias("_s")
    )
    return moved.join(fresh, "location_id_override", "left").select(
        "id", F.coalesce("_s", F.col("location_id_override").cast("string"), F.lit("-")).alias("override")
    )


@query("override_summary", "C5", f"""
SELECT count(*) AS processed, count(*) FILTER (WHERE ok) AS updated, count(*) FILTER (WHERE NOT ok) AS skipped
FROM (SELECT coalesce({_SEAT}, FALSE) AS ok FROM @job_postings p JOIN @locations l ON l.id = p.location_id AND {_VAGUE} LEFT JOIN @company_master_data m ON m.company_id = p.company_id)""")
def override_summary(t):
    return override.backfill_override(t["job_postings"], t["locations"], t["company_master_data"], None)[2]


_TYPES = """f AS (SELECT job_posting_id, arg_min(scrape_run_id, (detected_at, scrape_run_id)) AS run FROM @job_scrape_history GROUP BY 1),
q AS (SELECT lower(search_query) AS a, lower(location_query) AS b, arg_max(job_type_id, id) AS y FROM @search_queries WHERE job_type_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT f.job_posting_id, coalesce(r.job_type_id, q.y) AS job_type_id FROM f JOIN @scrape_runs r ON r.id = f.run LEFT JOIN q ON q.a = lower(r.search_query) AND q.b = lower(r.location_query)
 WHERE f.job_posting_id IN (SELECT id FROM @job_postings) AND f.job_posting_id NOT IN (SELECT job_posting_id FROM @job_type_assignments))"""


@query("types_assigned_from_runs", "C6 J12 W8", f"""
WITH {_TYPES} SELECT job_posting_id, job_type_id, 'script' AS assigned_via FROM x WHERE job_type_id IS NOT NULL
UNION ALL SELECT job_posting_id, job_type_id, assigned_via FROM @job_type_assignments""")
def types_assigned_from_runs(t):
    return assign.assign_from_runs(
        t["job_postings"], t["job_type_assignments"], t["job_scrape_history"], t["scrape_runs"], t["search_queries"]
    ).select("job_posting_id", "job_type_id", "assigned_via")


@query("types_assigned_on_sighting", "C6", """
WITH s AS (SELECT h.job_posting_id, arg_min(r.job_type_id, (h.detected_at, h.scrape_run_id)) AS job_type_id FROM @job_scrape_history h JOIN @scrape_runs r ON r.id = h.scrape_run_id WHERE r.job_type_id IS NOT NULL GROUP BY 1)
SELECT job_posting_id, job_type_id, 'trigger' AS assigned_via FROM s WHERE job_posting_id NOT IN (SELECT job_posting_id FROM @job_type_assignments)
UNION ALL SELECT job_posting_id, job_type_id, assigned_via FROM @job_type_assignments""")
def types_assigned_on_sighting(t):
    return assign.assign_on_sighting(t["job_type_assignments"], t["job_scrape_history"], t["scrape_runs"]).select(
        "job_posting_id", "job_type_id", "assigned_via"
    )


@query("default_type_assigned", "C6 J9", """
SELECT id AS job_posting_id, 0 AS job_type_id, 'migration' AS assigned_via FROM @job_postings WHERE id NOT IN (SELECT job_posting_id FROM @job_type_assignments)
UNION ALL SELECT job_posting_id, job_type_id, assigned_via FROM @job_type_assignments""")
def default_type_assigned(t):
    types = t["job_types"].withColumn("id", F.col("id").cast("string"))
    out, _ = assign.assign_default(t["job_postings"], t["job_type_assignments"].withColumn("job_type_id", F.col("job_type_id").cast("string")), types)
    return out.select("job_posting_id", F.col("job_type_id").cast("int").alias("job_type_id"), "assigned_via")


_MENTIONS = f"""(SELECT job_posting_id, name, min(lv) AS lv FROM (SELECT job_posting_id, {sql_strip('x')} AS name, lv FROM (
  SELECT job_posting_id, unnest(must_have_programmeertalen) AS x, 0 AS lv FROM @llm_enrichment UNION ALL SELECT job_posting_id, unnest(nice_to_have_programmeertalen), 1 FROM @llm_enrichment))
 WHERE name <> '' GROUP BY 1, 2)"""


@query("tech_mentions", "C7 U4", f"SELECT job_posting_id, name, CASE WHEN lv = 0 THEN 'must_have' ELSE 'nice_to_have' END AS requirement_level FROM {_MENTIONS}")
def tech_mentions(t):
    return techstack.mentions(t["llm_enrichment"], "must_have_programmeertalen", "nice_to_have_programmeertalen")


@query("tech_assignments", "C7 S14 S15", f"""
WITH k AS (SELECT name, min(CAST(id AS VARCHAR)) AS id FROM @programming_languages WHERE is_active GROUP BY 1),
m AS (SELECT x.*, coalesce(k.id, sha256(x.name)) AS iid FROM {_MENTIONS} x LEFT JOIN k ON k.name = x.name)
SELECT job_posting_id, CAST(programming_language_id AS VARCHAR) AS programming_language_id, requirement_level FROM @job_programming_languages
UNION ALL SELECT job_posting_id, iid, CASE WHEN lv = 0 THEN 'must_have' ELSE 'nice_to_have' END FROM m
 WHERE NOT EXISTS (SELECT 1 FROM @job_programming_languages j WHERE j.job_posting_id = m.job_posting_id AND CAST(j.programming_language_id AS VARCHAR) = m.iid)""")
def tech_assignments(t):
    dim = t["programming_languages"].withColumn("id", F.col("id").cast("string"))
    old = t["job_programming_languages"].withColumn("programming_language_id", F.col("programming_language_id").cast("string"))
    _, out = techstack.process(
        t["llm_enrichment"], "must_have_programmeertalen", "nice_to_have_programmeertalen", dim, old, "programming_language_id"
    )
    return out


@query("tech_stack_of_jobs", "C8", """
SELECT j.job_posting_id, string_agg(p.name || ':' || j.requirement_level, '|' ORDER BY p.name, j.requirement_level) AS items FROM @job_programming_languages j JOIN @programming_languages p ON p.id = j.programming_language_id GROUP BY 1""")
def tech_stack_of_jobs(t):
    s = techstack.stack_of_jobs(t["job_programming_languages"], t["programming_languages"], "programming_language_id")
    return s.select(
        "job_posting_id",
        F.transform("items", lambda i: F.concat(i["name"], F.lit(":"), i["requirement_level"])).alias("items"),
    )


@query("rerank_flags", "C10 P16", """
WITH n AS (SELECT id, is_active, needs_ranking, company_id = 7 AS changed FROM @job_postings)
SELECT id, changed OR (is_active AND (SELECT bool_or(changed) FROM n)) OR needs_ranking AS needs_ranking FROM n""")
def rerank_flags(t):
    old = t["job_postings"]
    new = old.withColumn("title", F.when(F.col("company_id") == 7, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return lifecycle.mark_for_reranking(old, new).select("id", "needs_ranking")


# --- streams ------------------------------------------------------------------------------------


def _events(t):
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = sightings.file_stream(t.spark, t.sf_dir, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t, name):
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_seen_ranges", "R3", f"SELECT user_id, event_type, {ts('min(ts)', 'first_seen_at')}, {ts('max(ts)', 'last_seen_at')} FROM @events GROUP BY 1, 2")
def stream_seen_ranges(t):
    root = _folder(t, "seen")
    keys = ["user_id", "event_type"]
    store = sightings.seen_store(t.spark, f"{root}/store", keys, t["events"].schema, 16)
    sightings.keep_seen_table(_events(t), keys, "ts", store, f"{root}/checkpoint")
    return store["seen"]


@query("stream_distinct_sightings", "R2", "SELECT DISTINCT user_id, event_type FROM @events")
def stream_distinct_sightings(t):
    """Each key of the stream once; half of the keys are in the table before it starts."""
    root = _folder(t, "distinct")
    keys = ["user_id", "event_type"]
    store = distinct.distinct_store(t.spark, f"{root}/store", keys, t["events"].schema, 16)
    known = t["events"].where("user_id % 2 = 0")
    grow(store, "before", lambda: distinct.first_sightings(known, store, keys, 64))
    distinct.keep_distinct(_events(t), keys, store, f"{root}/checkpoint", 64)
    return store["keys"]


@query("run_window_counts", "R5", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS status, count(*) AS runs FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type FROM @events) GROUP BY 1, 2""")
def run_window_counts(t):
    events = t["events"].select("ts", "event_type")
    return sightings.run_window_counts(events, "ts", F.col("event_type"), "1 day").select("window_start", "status", "runs")


@query("sliding_window_counts", "R5", f"""
WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS p, event_type FROM @events),
w AS (SELECT p - to_days(CAST(i AS INTEGER)) AS w, event_type FROM d, range(7) r(i))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS status, count(*) AS runs FROM w GROUP BY w, event_type""")
def sliding_window_counts(t):
    """Runs of the last seven days, every day."""
    return sightings.run_window_counts(t["events"].select("ts", "event_type"), "ts", F.col("event_type"), "7 days", "1 day")


@query("stream_sliding_counts", "R5", f"""
WITH d AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS p, event_type FROM @events),
w AS (SELECT p - to_hours(CAST(i AS INTEGER)) AS w, event_type FROM d, range(24) r(i))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS status, count(*) AS runs
FROM w GROUP BY w, event_type HAVING w + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM @events)""")
def stream_sliding_counts(t):
    """Runs of the last 24 hours, every hour, from a stream."""
    root = _folder(t, "sliding")
    counts = sightings.run_window_counts(_events(t), "ts", F.col("event_type"), "24 hours", "1 hour")
    return sightings.run_to_table(counts, f"{root}/table", f"{root}/checkpoint")


@query("stream_window_counts", "R5", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS status, count(*) AS runs
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type FROM @events) GROUP BY w, event_type HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM @events)""")
def stream_window_counts(t):
    """As ``run_window_counts`` but streamed; the last windows stay open behind the watermark."""
    root = _folder(t, "windows")
    counts = sightings.run_window_counts(_events(t), "ts", F.col("event_type"), "1 day")
    return sightings.run_to_table(counts, f"{root}/table", f"{root}/checkpoint")


@query("activity_sessions", "R4", f"""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS s FROM @events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS active_from, strftime(max(ts) + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS inactive_from, count(*) AS sightings FROM g GROUP BY user_id, n""")
def activity_sessions(t):
    return inactivity.activity_spans(t["events"], ["user_id"], "ts", 2 * 86_400)


@query("stream_activity_sessions", "R4", f"""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM @events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS active_from, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS inactive_from, count(*) AS sightings
FROM g GROUP BY user_id, n HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM @events)""")
def stream_activity_sessions(t):
    """Spans of activity from a stream; a span is written once a timer fires behind the watermark."""
    root = _folder(t, "sessions")
    spans = inactivity.stream_spans(_events(t), ["user_id"], "ts", 2 * 3_600)
    return inactivity.with_timers(t.spark, lambda: sightings.run_to_table(spans, f"{root}/table", f"{root}/checkpoint"))


@query("stream_inactive_keys", "R4 S16", f"""
SELECT user_id, event_type, strftime(max(ts) + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS inactive_from
FROM @events GROUP BY 1, 2 HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM @events)""")
def stream_inactive_keys(t):
    """Keys not seen for two days at the end of the stream: the last span of each whose timer fired, unless a later one is open."""
    root, keys = _folder(t, "inactive"), ["user_id", "event_type"]
    spans = inactivity.stream_spans(_events(t), keys, "ts", 2 * 86_400)
    ended = inactivity.with_timers(t.spark, lambda: sightings.run_to_table(spans, f"{root}/table", f"{root}/checkpoint"))
    last = t["events"].groupBy(*keys).agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("inactive_from"))
    return ended.join(last, [*keys, "inactive_from"], "left_semi").select(*keys, "inactive_from")


@query("stream_ingest_landed", "R1 S1 S13 C1", f"""
WITH {INGEST.strip()},
w AS (SELECT coalesce(CAST(old_id AS VARCHAR), sha256(dedup_key)) AS id, 1 AS seen FROM n GROUP BY 1)
SELECT CAST(p.id AS VARCHAR) AS id, p.is_active OR p.needs_ranking OR w.id IS NOT NULL AS needs_ranking, w.id IS NOT NULL AS seen FROM @job_postings p LEFT JOIN w ON w.id = CAST(p.id AS VARCHAR)
UNION ALL SELECT DISTINCT sha256(dedup_key), TRUE, TRUE FROM n WHERE old_id IS NULL""")
def stream_ingest_landed(t):
    """Postings landed as JSON files, read as a stream of several micro-batches and merged into the filled tables."""
    from ..streaming import ingest as stream
    from .q_tables import linkedin_records

    root = _folder(t, "landed")
    store = stream.posting_store(t.spark, f"{root}/store", 16)
    stream.fill_store(store, stored_tables(t))
    landing = linkedin_records(t).drop("arrival", "poster_name").withColumn("job_posted_date", F.col("job_posted_date").cast("string"))
    # Compressed files are not split, so there are more of them for more postings, read in two micro-batches.
    files = 4 * max(1, input_parts(landing))
    with shuffles_go(t.spark):
        landing.repartition(files).write.option("compression", "gzip").json(f"{root}/landing")
    stream.ingest_landed(t.spark, f"{root}/landing", "linkedin", store, f"{root}/checkpoint", JOBS_AS_OF, lines=True, files_per_batch=files // 2)
    seen = store["job_scrape_history"].where("scrape_run_id LIKE 'linkedin-%'").select(F.col("job_posting_id").alias("id")).distinct()
    postings = stream.current_postings(store).select("id", "needs_ranking")
    return postings.join(seen.withColumn("seen", F.lit(True)), "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
