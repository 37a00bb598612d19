"""Sources, sinks and table mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import instant
from ..operators import lifecycle, runs, sinks, tables
from ..operators.dedup import backfill_sources
from ..sources import company_csv, snapshots
from .base import JOBS_AS_OF
from .registry import JOBS_NOW, arr, query, sql_strip, ts


def linkedin_records(t):
    raw = t["linkedin_raw"]
    nested = raw.withColumns(
        {
            "job_poster": F.struct(
                F.col("poster_name").alias("name"), F.lit("Recruiter").alias("title"), F.lit(None).cast("string").alias("url")
            ),
            "job_description_formatted": F.lit(None).cast("string"),
            "base_salary": F.lit(None).cast(
                "struct<currency:string,min_amount:double,max_amount:double,payment_period:string>"
            ),
        }
    )
    return snapshots.type_records(snapshots.drop_error_items(nested), "linkedin")


def indeed_records(t):
    return snapshots.type_records(snapshots.drop_error_items(t["indeed_raw"]), "indeed")


@query("snapshot_scan", "S1", """
SELECT arrival, json_extract_string(item, '$.job_posting_id') AS job_posting_id, json_extract_string(item, '$.url') AS url,
  CAST(json_extract_string(item, '$.job_num_applicants') AS INT) AS job_num_applicants
FROM @linkedin_items WHERE json_extract(item, '$.error') IS NULL AND json_extract(item, '$.error_code') IS NULL""")
def snapshot_scan(t):
    items = snapshots.parse_items(t["linkedin_items"], "item", "linkedin")
    return snapshots.drop_error_items(items).select("arrival", "job_posting_id", "url", "job_num_applicants")


@query("snapshot_item_counts", "S1", """
SELECT count(*) FILTER (WHERE ok) AS jobs, count(*) FILTER (WHERE NOT ok) AS errors_filtered
FROM (SELECT json_extract(item, '$.error') IS NULL AND json_extract(item, '$.error_code') IS NULL AS ok FROM @linkedin_items)""")
def snapshot_item_counts(t):
    return snapshots.item_counts(snapshots.parse_items(t["linkedin_items"], "item", "linkedin"))


@query("linkedin_record_typing", "S2", f"""
SELECT arrival, job_posting_id, job_title, company_name, job_location, coalesce(url, job_url) AS url,
  {ts("try_cast(job_posted_date AS TIMESTAMP)", "job_posted_date")}
FROM @linkedin_raw WHERE error IS NULL""")
def linkedin_record_typing(t):
    return linkedin_records(t).select(
        "arrival", "job_posting_id", "job_title", "company_name", "job_location", "url", "job_posted_date"
    )


@query("indeed_record_typing", "S3", f"""
SELECT arrival, jobid, url, coalesce(job_title, 'Untitled Position') AS job_title,
  coalesce(company_name, 'Unknown Company') AS company_name, coalesce(location, 'Unknown Location') AS location,
  coalesce(description_text, '') AS description_text, {ts("try_cast(date_posted_parsed AS TIMESTAMP)", "date_posted_parsed")}
FROM @indeed_raw WHERE error_code IS NULL""")
def indeed_record_typing(t):
    return indeed_records(t).select(
        "arrival", "jobid", "url", "job_title", "company_name", "location", "description_text", "date_posted_parsed"
    )


@query("quarantine_records", "S4", """
SELECT 'linkedin' AS source, arrival, CASE WHEN job_posting_id IS NULL THEN 'Field ''job_posting_id'': Field required'
  WHEN job_title IS NULL THEN 'Field ''job_title'': Field required' ELSE 'Field ''url'': Field required' END AS record_error
FROM @linkedin_raw WHERE error IS NULL AND (job_posting_id IS NULL OR job_title IS NULL OR coalesce(url, job_url) IS NULL)
UNION ALL
SELECT 'indeed', arrival, CASE WHEN jobid IS NULL THEN 'Field ''jobid'': Field required' ELSE 'Field ''url'': Field required' END
FROM @indeed_raw WHERE error_code IS NULL AND (jobid IS NULL OR url IS NULL)""")
def quarantine_records(t):
    _, bad = snapshots.split_valid(linkedin_records(t), "linkedin")
    _, bad2 = snapshots.split_valid(indeed_records(t), "indeed")
    columns = ("source", "arrival", "record_error")
    return (
        bad.withColumn("source", F.lit("linkedin")).select(*columns)
        .unionByName(bad2.withColumn("source", F.lit("indeed")).select(*columns))
    )


_LI_OK = "error IS NULL AND job_posting_id IS NOT NULL AND job_title IS NOT NULL AND coalesce(url, job_url) IS NOT NULL"
_IN_OK = "error_code IS NULL AND jobid IS NOT NULL AND url IS NOT NULL"


@query("linkedin_posting_rows", "S5 T10 T11", f"""
WITH r AS (SELECT *, string_split(job_base_pay_range, '-') AS h FROM @linkedin_raw WHERE {_LI_OK}),
p AS (SELECT *, try_cast(regexp_replace(h[1], '[^0-9.]', '', 'g') AS DOUBLE) AS lo, {sql_strip("h[2]")} AS rt FROM r),
q AS (SELECT *, try_cast(regexp_replace(split_part(rt, '/', 1), '[^0-9.]', '', 'g') AS DOUBLE) AS hi FROM p),
s AS (SELECT *, coalesce(len(h) = 2 AND lo IS NOT NULL AND hi IS NOT NULL, FALSE) AS ok FROM q)
SELECT job_posting_id AS linkedin_job_id, job_title AS title, job_seniority_level AS seniority_level,
  job_employment_type AS employment_type,
  array_to_string(CASE WHEN coalesce(job_industries, '') = '' THEN [] ELSE [{sql_strip("x")} for x in string_split(job_industries, ',')] END, '|') AS industries,
  coalesce(job_function, '') AS function_areas, {ts("try_cast(job_posted_date AS TIMESTAMP)", "posted_date")},
  job_posted_time AS posted_time_ago, job_num_applicants AS num_applicants,
  CASE WHEN ok AND substr(job_base_pay_range, 1, 1) IN ('$', '€', '£') THEN substr(job_base_pay_range, 1, 1) END AS salary_currency,
  CASE WHEN ok THEN lo END AS base_salary_min, CASE WHEN ok THEN hi END AS base_salary_max,
  CASE WHEN ok AND contains(rt, '/') THEN string_split(rt, '/')[-1] END AS salary_period,
  coalesce(url, job_url) AS job_url, apply_link AS apply_url, application_availability AS application_available, 'linkedin' AS source
FROM s""")
def linkedin_posting_rows(t):
    valid, _ = snapshots.split_valid(linkedin_records(t), "linkedin")
    columns = snapshots.posting_columns("linkedin")
    return valid.select(*[v.alias(k) for k, v in columns.items() if k != "indeed_job_id"])


@query("indeed_posting_rows", "S6 T12", f"""
WITH r AS (SELECT *, regexp_extract_all(salary_formatted, '(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\s*([kK])?', 1) AS n,
  regexp_extract_all(salary_formatted, '(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\s*([kK])?', 2) AS k FROM @indeed_raw WHERE {_IN_OK}),
p AS (SELECT *, CAST(replace(n[1], ',', '') AS DOUBLE) * CASE WHEN coalesce(k[1], '') <> '' THEN 1000 ELSE 1 END AS lo,
  CAST(replace(n[2], ',', '') AS DOUBLE) * CASE WHEN coalesce(k[2], '') <> '' THEN 1000 ELSE 1 END AS hi FROM r)
SELECT jobid AS indeed_job_id, coalesce(job_title, 'Untitled Position') AS title, job_type AS employment_type,
  {ts("try_cast(date_posted_parsed AS TIMESTAMP)", "posted_date")}, lo AS base_salary_min, coalesce(hi, lo) AS base_salary_max,
  CASE WHEN lo IS NULL THEN NULL WHEN contains(salary_formatted, '€') THEN 'EUR' WHEN contains(salary_formatted, '£') THEN 'GBP' ELSE 'USD' END AS salary_currency,
  CASE WHEN lo IS NULL THEN NULL WHEN contains(salary_formatted, 'year') OR contains(salary_formatted, 'annual') THEN 'yearly'
    WHEN contains(salary_formatted, 'hour') THEN 'hourly' END AS salary_period,
  url AS job_url, apply_link AS apply_url, coalesce(apply_link <> '', FALSE) AS application_available
FROM p""")
def indeed_posting_rows(t):
    valid, _ = snapshots.split_valid(indeed_records(t), "indeed")
    columns = snapshots.posting_columns("indeed")
    keep = (
        "indeed_job_id", "title", "employment_type", "posted_date", "base_salary_min", "base_salary_max",
        "salary_currency", "salary_period", "job_url", "apply_url", "application_available",
    )
    return valid.select(*[columns[k].alias(k) for k in keep])


@query("indeed_description_rows", "S7", f"""
SELECT jobid, nullif(concat_ws(' | ', CASE WHEN len(benefits) > 0 THEN 'Benefits: ' || array_to_string(benefits, ', ') END,
    CASE WHEN qualifications <> '' THEN 'Qualifications: ' || qualifications END), '') AS summary,
  coalesce(nullif(job_description_formatted, ''), description) AS full_description_html,
  coalesce(description_text, '') AS full_description_text
FROM @indeed_raw WHERE {_IN_OK}""")
def indeed_description_rows(t):
    valid, _ = snapshots.split_valid(indeed_records(t), "indeed")
    return valid.select("jobid", *[v.alias(k) for k, v in snapshots.description_columns("indeed").items()])


@query("poster_rows", "S8", f"""
SELECT job_posting_id, poster_name AS name, 'Recruiter' AS title FROM @linkedin_raw WHERE {_LI_OK} AND poster_name <> ''""")
def poster_rows(t):
    valid, _ = snapshots.split_valid(linkedin_records(t), "linkedin")
    return (
        valid.withColumn("p", snapshots.poster_column("linkedin")).where(F.col("p").isNotNull())
        .select("job_posting_id", "p.name", "p.title")
    )


def csv_rows(t):
    renamed = t["company_csv"].select(
        F.col("csv_id").alias("LinkedIn Company ID"), F.col("csv_name").alias("Company Name"),
        F.col("csv_industry").alias("Industry"), F.col("csv_founded").alias("Founded Year"),
        F.col("csv_website").alias("Website"), F.col("csv_jobs").alias("Jobs Page URL"), F.col("csv_email").alias("Contact Email"),
    )
    return company_csv.name_import_columns(renamed)


def csv_classified(t):
    return company_csv.classify_import(csv_rows(t), t["companies"], t["company_master_data"])


_CSV = f"""
c AS (SELECT nullif(split_part({sql_strip("csv_id")}, '.', 1), '') AS lid, csv_name, nullif({sql_strip("csv_industry")}, '') AS industry,
  nullif(csv_website, '') AS website, csv_jobs AS jobs_page_url, csv_email AS contact_email,
  try_cast(regexp_replace(csv_founded, '[^0-9]', '', 'g') AS INT) AS founded_year FROM @company_csv),
o AS (SELECT c.*, k.id AS company_id, CASE WHEN lid IS NULL THEN 'skipped' WHEN k.id IS NULL THEN 'company_not_found'
  WHEN coalesce(c.industry, website, jobs_page_url, contact_email, CAST(c.founded_year AS VARCHAR)) IS NULL THEN 'skipped'
  WHEN m.company_id IS NOT NULL THEN 'master_data_updated' ELSE 'master_data_created' END AS outcome
  FROM c LEFT JOIN (SELECT linkedin_company_id, min(id) AS id FROM @companies WHERE linkedin_company_id IS NOT NULL GROUP BY 1) k ON k.linkedin_company_id = lid
  LEFT JOIN @company_master_data m ON m.company_id = k.id)"""


@query("csv_import_outcomes", "S9 T17", f"""
WITH {_CSV.strip()} SELECT lid AS linkedin_company_id, company_id, industry, founded_year, outcome FROM o""")
def csv_import_outcomes(t):
    return csv_classified(t).select("linkedin_company_id", "company_id", "industry", "founded_year", "outcome")


@query("csv_import_stats", "S9", f"""
WITH {_CSV.strip()} SELECT count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'skipped') AS skipped_rows, count(company_id) AS companies_found,
 count(*) FILTER (WHERE outcome = 'company_not_found') AS companies_not_found, count(*) FILTER (WHERE outcome = 'master_data_created') AS master_data_created,
 count(*) FILTER (WHERE outcome = 'master_data_updated') AS master_data_updated FROM o""")
def csv_import_stats(t):
    return company_csv.import_stats(csv_classified(t))


@query("csv_import_applied", "S9", f"""
WITH {_CSV.strip()}, h AS (SELECT * FROM o WHERE outcome LIKE 'master_data%')
SELECT coalesce(m.company_id, h.company_id) AS company_id, coalesce(h.industry, m.industry) AS industry,
  coalesce(h.founded_year, m.founded_year) AS founded_year, h.website, m.hiring_model
FROM @company_master_data m FULL JOIN h ON m.company_id = h.company_id""")
def csv_import_applied(t):
    return company_csv.apply_import(csv_classified(t), t["company_master_data"]).select(
        "company_id", "industry", "founded_year", "website", "hiring_model"
    )


@query("csv_export", "S10", """
SELECT coalesce(linkedin_company_id, '') AS "LinkedIn Company ID", c.name AS "Company Name", coalesce(m.industry, '') AS "Industry",
  coalesce(CAST(founded_year AS VARCHAR), '') AS "Founded Year", '' AS "Website", '' AS "Jobs Page URL", '' AS "Contact Email",
  coalesce(bedrijfswebsite, '') AS "Bedrijfswebsite (AI)", coalesce(jobspagina, '') AS "Jobspagina (AI)", coalesce(email_hr, '') AS "Email HR (AI)",
  '' AS "Email HR Bron (AI)", '' AS "Email Algemeen (AI)", '' AS "Bedrijfsomschrijving (AI)", CASE WHEN ai_enriched THEN 'Yes' ELSE 'No' END AS "AI Enriched"
FROM @companies c LEFT JOIN @company_master_data m ON c.id = m.company_id WHERE c.name ILIKE '%customer#%1%'""")
def csv_export(t):
    return company_csv.export_rows(t["companies"], t["company_master_data"], "customer#%1")


@query("postings_scan", "S11", f"""
SELECT id, title, company_id, {ts("posted_date")}, {arr("industries")} FROM @job_postings""")
def postings_scan(t):
    return t["job_postings"].select("id", "title", "company_id", "posted_date", "industries")


@query("posting_key_lookup", "S12", "SELECT id, title, source FROM @job_postings WHERE linkedin_job_id = 'li-42'")
def posting_key_lookup(t):
    return tables.lookup(t["job_postings"], "linkedin_job_id", "li-42").select("id", "title", "source")


@query("company_bulk_lookup", "S12", """
SELECT r.arrival, r.company_id AS linkedin_company_id, c.id FROM @linkedin_raw r LEFT JOIN @companies c ON c.linkedin_company_id = r.company_id""")
def company_bulk_lookup(t):
    keys = t["linkedin_raw"].select("arrival", F.col("company_id").alias("linkedin_company_id"))
    return tables.lookup_many(keys, t["companies"].select("linkedin_company_id", "id"), ["linkedin_company_id"])


@query("master_data_upsert", "S13", """
WITH n AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'IT' END AS sector_en, CAST(NULL AS VARCHAR) AS ai_enrichment_error,
  TRUE AS ai_enriched FROM @customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT coalesce(n.company_id, m.company_id) AS company_id, coalesce(n.sector_en, m.sector_en) AS sector_en,
 CASE WHEN n.company_id IS NOT NULL THEN n.ai_enrichment_error ELSE m.ai_enrichment_error END AS ai_enrichment_error,
 coalesce(n.ai_enriched, m.ai_enriched) AS ai_enriched, m.hiring_model
FROM @company_master_data m FULL JOIN n ON m.company_id = n.company_id""")
def master_data_upsert(t):
    new = t["customer"].where("c_mktsegment = 'AUTOMOBILE'").select(
        F.col("c_custkey").alias("company_id"), F.when(F.col("c_custkey") % 2 == 0, "IT").alias("sector_en"),
        F.lit(None).cast("string").alias("ai_enrichment_error"), F.lit(True).alias("ai_enriched"),
    )
    merged = tables.upsert(t["company_master_data"], new, ["company_id"], keep_nulls=("ai_enrichment_error",))
    return merged.select("company_id", "sector_en", "ai_enrichment_error", "ai_enriched", "hiring_model")


@query("source_insert_ignore", "S14", """
WITH n AS (SELECT l_orderkey AS job_posting_id, 'indeed' AS source, min('new-' || CAST(l_suppkey AS VARCHAR)) AS source_job_id FROM @lineitem GROUP BY 1)
SELECT job_posting_id, source, source_job_id FROM @job_sources
UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM @job_sources s WHERE s.job_posting_id = n.job_posting_id AND s.source = n.source)""")
def source_insert_ignore(t):
    new = t["lineitem"].select(
        F.col("l_orderkey").alias("job_posting_id"), F.lit("indeed").alias("source"),
        F.concat(F.lit("new-"), F.col("l_suppkey").cast("string")).alias("source_job_id"),
    )
    return tables.insert_ignore(
        t["job_sources"].select("job_posting_id", "source", "source_job_id"), new, ["job_posting_id", "source"]
    )


@query("ecosystem_get_or_create", "S15", """
WITH w AS (SELECT DISTINCT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS name FROM @part)
SELECT w.name, coalesce(CAST(e.id AS VARCHAR), sha256(w.name)) AS id FROM w LEFT JOIN @ecosystems e ON e.name = w.name""")
def ecosystem_get_or_create(t):
    wanted = t["part"].select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"))
    dim = t["ecosystems"].withColumn("id", F.col("id").cast("string"))
    _, mapping = tables.get_or_create(dim, wanted, "name", "id")
    return mapping.select("name", "id")


@query("mark_inactive", "S16 P26", f"""
SELECT id, is_active AND NOT (is_active AND last_seen_at < {JOBS_NOW} - INTERVAL 14 DAY) AS is_active,
  {ts(f"CASE WHEN is_active AND last_seen_at < {JOBS_NOW} - INTERVAL 14 DAY THEN {JOBS_NOW} ELSE detected_inactive_at END", "detected_inactive_at")}
FROM @job_postings""")
def mark_inactive(t):
    return lifecycle.mark_inactive(t["job_postings"], JOBS_AS_OF).select("id", "is_active", "detected_inactive_at")


@query("reactivate_postings", "S16", f"""
SELECT id, is_active OR hit AS is_active, {ts("CASE WHEN NOT hit THEN detected_inactive_at END", "detected_inactive_at")}
FROM (SELECT p.*, EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = p.id) AS hit FROM @job_postings p)""")
def reactivate_postings(t):
    chosen = t["labels"].select(F.col("doc_id").alias("id"))
    return lifecycle.reactivate(t["job_postings"], chosen).select("id", "is_active", "detected_inactive_at")


@query("archive_runs", "S16", "SELECT id, archived OR status = 'failed' AS archived FROM @scrape_runs")
def archive_runs(t):
    return runs.archive(t["scrape_runs"], F.col("status") == "failed").select("id", "archived")


@query("run_source_from_query", "S17", """
WITH a AS (SELECT r.id, r.metadata, CASE WHEN r.source = 'linkedin' AND q.id IS NOT NULL THEN q.source ELSE r.source END AS source
  FROM @scrape_runs r LEFT JOIN @search_queries q ON r.search_query_id = q.id)
SELECT id, CASE WHEN json_extract_string(metadata, '$.source') = 'indeed' AND source = 'linkedin' THEN 'indeed' ELSE source END AS source FROM a""")
def run_source_from_query(t):
    return runs.source_from_query(t["scrape_runs"], t["search_queries"]).select("id", "source")


@query("size_category_remap", "S18", """
SELECT id, CASE WHEN size_category IN ('Midmarket', 'Subsidiary', 'midmarket', 'subsidiary') THEN 'established_enterprise'
  WHEN size_category = 'Scaleup' THEN 'scaleup' ELSE size_category END AS size_category FROM @company_master_data""")
def size_category_remap(t):
    return tables.remap(t["company_master_data"], "size_category", sinks.OLD_SIZE_CATEGORIES).select("id", "size_category")


@query("clear_company_enrichment", "S19", f"""
SELECT id, CASE WHEN hit THEN NULL ELSE sector_en END AS sector_en, CASE WHEN hit THEN NULL ELSE size_category END AS size_category,
  CASE WHEN hit THEN FALSE ELSE ai_enriched END AS ai_enriched, {ts("CASE WHEN NOT hit THEN ai_enriched_at END", "ai_enriched_at")}
FROM (SELECT *, coalesce(ai_enriched, FALSE) OR size_category IS NOT NULL AS hit FROM @company_master_data)""")
def clear_company_enrichment(t):
    hit = F.coalesce("ai_enriched", F.lit(False)) | F.col("size_category").isNotNull()
    cleared = tables.reset_columns(
        t["company_master_data"], hit, ["sector_en", "size_category", "ai_enriched_at"], ai_enriched=False
    )
    return cleared.select("id", "sector_en", "size_category", "ai_enriched", "ai_enriched_at")


@query("reset_rankings", "S19", """
SELECT id, CASE WHEN hit THEN NULL ELSE ranking_score END AS ranking_score, CASE WHEN hit THEN 999999 ELSE ranking_position END AS ranking_position,
  hit OR needs_ranking AS needs_ranking
FROM (SELECT *, is_active AND coalesce(title_classification = 'Data', FALSE) AS hit FROM @job_postings)""")
def reset_rankings(t):
    return lifecycle.reset_rankings(t["job_postings"]).select("id", "ranking_score", "ranking_position", "needs_ranking")


@query("fill_subdivision", "S20", "SELECT id, coalesce(subdivision_name_nl, subdivision_name) AS subdivision_name_nl FROM @locations")
def fill_subdivision(t):
    return tables.fill_from(t["locations"], "subdivision_name_nl", "subdivision_name").select("id", "subdivision_name_nl")


_CUT = "TIMESTAMP '1999-01-01 00:00:00'"


@query("delete_old_postings", "S21", f"""
WITH k AS (SELECT id FROM @job_postings WHERE posted_date IS NULL OR posted_date >= {_CUT}),
c AS (SELECT 'job_postings' AS table_name, (SELECT count(*) FROM @job_postings) AS rows_before, (SELECT count(*) FROM k) AS rows_after
UNION ALL SELECT 'job_sources', (SELECT count(*) FROM @job_sources), (SELECT count(*) FROM @job_sources WHERE job_posting_id IN (SELECT id FROM k))
UNION ALL SELECT 'llm_enrichment', (SELECT count(*) FROM @llm_enrichment), (SELECT count(*) FROM @llm_enrichment WHERE job_posting_id IN (SELECT id FROM k)))
SELECT table_name, rows_before, rows_after, rows_before - rows_after AS rows_deleted FROM c""")
def delete_old_postings(t):
    return tables.retention_report(
        t["job_postings"], {"job_sources": t["job_sources"], "llm_enrichment": t["llm_enrichment"]}, instant("1999-01-01 00:00:00")
    )


@query("delete_old_children", "S21", f"""
SELECT job_posting_id, source FROM @job_sources WHERE job_posting_id IN (SELECT id FROM @job_postings WHERE posted_date IS NULL OR posted_date >= {_CUT})""")
def delete_old_children(t):
    _, kids = tables.retain_since(t["job_postings"], {"s": t["job_sources"]}, instant("1999-01-01 00:00:00"))
    return kids["s"].select("job_posting_id", "source")


# Every company has postings in the derived tables; suppliers are companies that have none.
_KNOWN = "SELECT id, name FROM @companies UNION ALL SELECT -s_suppkey, s_name FROM @supplier"


def known_companies(t):
    suppliers = t["supplier"].select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    return t["companies"].select("id", "name").unionByName(suppliers)


@query("companies_without_jobs", "S22 J10", f"SELECT id, name FROM ({_KNOWN}) WHERE id NOT IN (SELECT company_id FROM @job_postings WHERE company_id IS NOT NULL)")
def companies_without_jobs(t):
    return tables.childless(known_companies(t), t["job_postings"], "id", "company_id").select("id", "name")


@query("delete_companies_without_jobs", "S22", f"SELECT id, name FROM ({_KNOWN}) WHERE id IN (SELECT company_id FROM @job_postings)")
def delete_companies_without_jobs(t):
    return tables.drop_childless(known_companies(t), t["job_postings"], "id", "company_id").select("id", "name")


@query("retire_or_delete_types", "S23", """
SELECT id, name, CASE WHEN id IN (1, 2, 4) THEN FALSE ELSE is_active END AS is_active FROM @job_types
WHERE id NOT IN (1, 2, 4) OR id IN (SELECT job_type_id FROM @job_type_assignments)""")
def retire_or_delete_types(t):
    doomed = t["job_types"].where("id IN (1, 2, 4)")
    return tables.retire_or_delete(t["job_types"], t["job_type_assignments"], doomed, "id", "job_type_id").select("id", "name", "is_active")


@query("location_patch", "S24", """
SELECT l.id, coalesce(CASE WHEN l.id % 2 = 0 THEN 'Patched' END, l.city) AS city, coalesce(CASE WHEN l.id % 3 = 0 THEN 'XX' END, l.country_code) AS country_code
FROM @locations l""")
def location_patch(t):
    changes = t["supplier"].select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "Patched").alias("city"),
        F.when(F.col("s_suppkey") % 3 == 0, "XX").alias("country_code"),
    )
    return tables.patch(t["locations"], changes, "id").select("id", "city", "country_code")


@query("job_result_sink", "S25", f"""
WITH n AS (SELECT job_posting_id, json_valid(payload) AS ok, payload FROM @job_results)
SELECT e.job_posting_id,
 CASE WHEN ok THEN json_extract_string(payload, '$.data_role_type') ELSE type_datarol END AS type_datarol,
 array_to_string(CASE WHEN ok THEN coalesce(CAST(json_extract_string(payload, '$.role_level[*]') AS VARCHAR[]), []) ELSE rolniveau END, '|') AS rolniveau,
 array_to_string(CASE WHEN ok THEN coalesce(CAST(json_extract_string(payload, '$.must_have_languages[*]') AS VARCHAR[]), []) ELSE must_have_programmeertalen END, '|') AS must_have_programmeertalen,
 CASE WHEN ok THEN json_extract_string(payload, '$.summary_long') END AS samenvatting_lang_en,
 CASE WHEN ok THEN json_extract_string(payload, '$.summary_short_nl') ELSE samenvatting_kort_nl END AS samenvatting_kort_nl,
 CASE WHEN ok THEN nullif(CAST(json_extract(payload, '$.labels') AS VARCHAR), '{{}}') ELSE labels END AS labels,
 CASE WHEN n.job_posting_id IS NULL THEN enrichment_error WHEN NOT ok THEN 'Invalid JSON in result' END AS enrichment_error,
 {ts(f"CASE WHEN n.job_posting_id IS NULL THEN enrichment_completed_at ELSE {JOBS_NOW} END", "enrichment_completed_at")},
 CASE WHEN ok THEN 'prompt-x-v18' ELSE enrichment_model_version END AS enrichment_model_version
FROM @llm_enrichment e LEFT JOIN n ON e.job_posting_id = n.job_posting_id""")
def job_result_sink(t):
    saved, _ = sinks.save_job_results(
        t["llm_enrichment"], t["job_postings"], t["job_results"], "payload", "prompt-x-v18", JOBS_AS_OF
    )
    return saved.select(
        "job_posting_id", "type_datarol", "rolniveau", "must_have_programmeertalen", "samenvatting_lang_en",
        "samenvatting_kort_nl", "labels", "enrichment_error", "enrichment_completed_at", "enrichment_model_version",
    )


@query("job_result_rerank_flags", "S25 S16", """
SELECT id, needs_ranking OR id IN (SELECT r.job_posting_id FROM @job_results r JOIN @llm_enrichment e ON e.job_posting_id = r.job_posting_id WHERE json_valid(payload)) AS needs_ranking
FROM @job_postings""")
def job_result_rerank_flags(t):
    _, marked = sinks.save_job_results(
        t["llm_enrichment"], t["job_postings"], t["job_results"], "payload", "prompt-x-v18", JOBS_AS_OF
    )
    return marked.select("id", "needs_ranking")


def _first(*paths):
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(payload, '$.{p}'), '')" for p in paths) + ")"


@query("company_result_sink", "S26 M16", f"""
WITH n AS (SELECT company_id AS cid, {_first("maturity_en", "maturity.category_en", "category.en", "category_en")} AS c_en,
  {_first("maturity_nl", "maturity.category_nl", "category.nl", "category_nl")} AS c_nl, {_first("website", "bedrijfswebsite")} AS site,
  {_first("maturity.confidence", "confidence")} AS conf, {_first("locatie_belgie")} AS seat, {_first("hiring_model")} AS hm FROM @company_results)
SELECT coalesce(cid, company_id) AS company_id, coalesce(c_en, size_category) AS size_category, coalesce(c_nl, category_nl) AS category_nl,
  coalesce(site, bedrijfswebsite) AS bedrijfswebsite, coalesce(CAST(conf AS DOUBLE), size_confidence) AS size_confidence,
  coalesce(seat, locatie_belgie) AS locatie_belgie, coalesce(hm, hiring_model) AS hiring_model,
  CASE WHEN cid IS NOT NULL THEN TRUE ELSE ai_enriched END AS ai_enriched, CASE WHEN cid IS NULL THEN ai_enrichment_error END AS ai_enrichment_error
FROM @company_master_data m FULL JOIN n ON m.company_id = cid""")
def company_result_sink(t):
    return sinks.save_company_results(t["company_master_data"], t["company_results"], "payload", JOBS_AS_OF).select(
        "company_id", "size_category", "category_nl", "bedrijfswebsite", "size_confidence", "locatie_belgie", "hiring_model",
        "ai_enriched", "ai_enrichment_error",
    )


@query("location_result_sink", "S27", """
SELECT l.id, coalesce(json_extract_string(payload, '$.timezone'), timezone) AS timezone, coalesce(json_extract_string(payload, '$.subdivision_name'), subdivision_name) AS subdivision_name,
  coalesce(json_extract_string(payload, '$.city_name_en'), city_name_en) AS city_name_en, city_name_fr,
  coalesce(json_extract_string(payload, '$.country_name_nl'), country_name_nl) AS country_name_nl,
  CASE WHEN r.id IS NOT NULL THEN TRUE ELSE ai_enriched END AS ai_enriched, CASE WHEN r.id IS NULL THEN ai_enrichment_error END AS ai_enrichment_error
FROM @locations l LEFT JOIN @location_results r ON l.id = r.id""")
def location_result_sink(t):
    return sinks.save_location_results(t["locations"], t["location_results"], "payload", JOBS_AS_OF).select(
        "id", "timezone", "subdivision_name", "city_name_en", "city_name_fr", "country_name_nl", "ai_enriched", "ai_enrichment_error"
    )


_SIZE_ERROR = """CASE WHEN payload IS NULL THEN 'Empty response from LLM'
  WHEN json_extract(payload, '$.category') IS NULL OR json_extract(payload, '$.confidence') IS NULL OR json_extract(payload, '$.summary') IS NULL THEN 'Invalid response structure'
  WHEN json_extract_string(payload, '$.category') NOT IN ('startup', 'scaleup', 'sme', 'established_enterprise', 'corporate', 'public_company', 'government', 'unknown')
    THEN 'Invalid category: ' || json_extract_string(payload, '$.category') END"""


@query("size_result_sink", "S28", f"""
WITH n AS (SELECT id AS rid, payload, {_SIZE_ERROR} AS err FROM (SELECT id, nullif(payload, '') AS payload FROM @size_results))
SELECT m.id, CASE WHEN rid IS NOT NULL AND err IS NULL THEN json_extract_string(payload, '$.category') ELSE size_category END AS size_category,
  CASE WHEN rid IS NOT NULL AND err IS NULL THEN CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) ELSE size_confidence END AS size_confidence,
  CASE WHEN rid IS NOT NULL AND err IS NULL THEN json_extract_string(payload, '$.summary.en') ELSE size_summary_en END AS size_summary_en,
  CASE WHEN rid IS NOT NULL THEN err ELSE size_enrichment_error END AS size_enrichment_error
FROM @company_master_data m LEFT JOIN n ON m.id = rid""")
def size_result_sink(t):
    return sinks.save_size_results(t["company_master_data"], t["size_results"], "payload", JOBS_AS_OF).select(
        "id", "size_category", "size_confidence", "size_summary_en", "size_enrichment_error"
    )


@query("title_class_sink", "S29", f"""
WITH a AS (SELECT id AS aid, {sql_strip("answer")} AS v FROM @title_answers)
SELECT id, CASE WHEN v IN ('Data', 'NIS') THEN v ELSE title_classification END AS title_classification,
  CASE WHEN aid IS NULL THEN title_classification_error WHEN v NOT IN ('Data', 'NIS') THEN 'Unexpected classification: ' || v END AS title_classification_error
FROM @job_postings LEFT JOIN a ON id = aid""")
def title_class_sink(t):
    return sinks.save_title_classes(t["job_postings"], t["title_answers"], JOBS_AS_OF).select(
        "id", "title_classification", "title_classification_error"
    )


_CONSULTING = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '{"Consulting":true,"reasoning":"projects"}' WHEN 1 THEN '{"Consulting":false,"reasoning":""}'
  WHEN 2 THEN '{"consulting":true}' ELSE '{"Consulting":"true"}' END AS payload FROM @customer"""


@query("consulting_sink", "S29", f"""
SELECT id, CAST(json_extract_string(payload, '$.Consulting') AS BOOLEAN) AS is_consulting, nullif(json_extract_string(payload, '$.reasoning'), '') AS consulting_reasoning,
  CASE WHEN json_extract(payload, '$.Consulting') IS NULL THEN 'Missing ''Consulting'' field in response' END AS consulting_error FROM ({_CONSULTING})""")
def consulting_sink(t):
    df = t.sql(_CONSULTING)
    return df.select("id", *[v.alias(k) for k, v in sinks.consulting_columns(F.col("payload")).items()])


@query("consulting_tally", "A37", f"""
SELECT count(*) AS total, count(c) AS successful, count(*) - count(c) AS failed, count(*) FILTER (WHERE c) AS consulting, count(*) FILTER (WHERE NOT c) AS not_consulting
FROM (SELECT CAST(json_extract_string(payload, '$.Consulting') AS BOOLEAN) AS c FROM ({_CONSULTING}))""")
def consulting_tally(t):
    df = t.sql(_CONSULTING)
    return sinks.consulting_tally(df.select(*[v.alias(k) for k, v in sinks.consulting_columns(F.col("payload")).items()]))


_RELEVANCE = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size * 3 AS STRING) WHEN 1 THEN ' 77 ' WHEN 2 THEN 'high' WHEN 3 THEN '-5' ELSE '8.5' END AS answer FROM @part"""


@query("relevance_sink", "S29", f"""
WITH a AS (SELECT id, {sql_strip("answer")} AS v, CASE WHEN regexp_matches({sql_strip("answer")}, '^[+-]?\\d+$') THEN try_cast({sql_strip("answer")} AS INT) END AS n FROM ({_RELEVANCE}))
SELECT id, CASE WHEN n BETWEEN 0 AND 100 THEN n END AS relevance_score,
  CASE WHEN n IS NULL THEN 'Invalid score format: ' || v WHEN n NOT BETWEEN 0 AND 100 THEN 'Score out of range: ' || CAST(n AS VARCHAR) END AS relevance_error FROM a""")
def relevance_sink(t):
    df = t.sql(_RELEVANCE)
    return df.select("id", *[v.alias(k) for k, v in sinks.relevance_columns(F.col("answer")).items()])


@query("history_append", "S31", f"""
SELECT job_posting_id, CAST(scrape_run_id AS VARCHAR) AS scrape_run_id, {ts("detected_at")} FROM @job_scrape_history
UNION ALL SELECT id, 'run-1', strftime({JOBS_NOW}, '%Y-%m-%d %H:%M:%S') FROM @job_postings WHERE source = 'indeed'""")
def history_append(t):
    old = t["job_scrape_history"].select("job_posting_id", F.col("scrape_run_id").cast("string").alias("scrape_run_id"), "detected_at")
    seen = t["job_postings"].where("source = 'indeed'").select(F.col("id").alias("job_posting_id"), F.lit("run-1").alias("scrape_run_id"))
    return tables.append_history(old, seen, instant(JOBS_AS_OF))


@query("source_backfill", "C9 J10 U2", """
SELECT job_posting_id, source, source_job_id FROM @job_sources
UNION ALL SELECT id, source, CASE WHEN source = 'linkedin' THEN linkedin_job_id ELSE indeed_job_id END FROM @job_postings p
WHERE NOT EXISTS (SELECT 1 FROM @job_sources s WHERE s.job_posting_id = p.id) AND coalesce(CASE WHEN source = 'linkedin' THEN linkedin_job_id ELSE indeed_job_id END, '') <> ''""")
def source_backfill(t):
    return backfill_sources(t["job_postings"], t["job_sources"]).select("job_posting_id", "source", "source_job_id")
