"""Posting tables derived from the given tables.

Each table is one SELECT written in the SQL that Spark and DuckDB share, so both sides of a check start
from the same rows. ``@name`` refers to another derived or given table. Every row comes from a row of a
given table, so the derived tables grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

JOBS_AS_OF = "2001-08-02 00:00:00"
RUNS_AS_OF = "2024-01-30 12:00:00"

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {}

DERIVED["companies"] = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 97 = 1 THEN 'Google'
       WHEN c_custkey % 5 = 0 THEN 'Group ' || CAST(CAST(floor(c_custkey / 20) AS BIGINT) AS STRING)
       ELSE c_name END AS name,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS industry,
  CASE WHEN c_custkey % 7 <> 3 THEN 'https://firm.example/' || CAST(c_custkey AS STRING) END AS company_url,
  CASE WHEN c_custkey % 4 = 1 THEN 'https://logo.example/' || CAST(c_custkey AS STRING) END AS logo_url,
  c_custkey % 3 = 1 AS has_logo,
  CASE WHEN c_custkey % 4 <> 2 THEN CAST(100000 + c_custkey AS STRING) END AS linkedin_company_id,
  CASE c_custkey % 7 WHEN 0 THEN '1-10' WHEN 1 THEN '201-500' WHEN 2 THEN '501-1000' WHEN 3 THEN '1001-5000'
       WHEN 4 THEN '5001-10000' WHEN 5 THEN '10000+' END AS employee_count_range,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST(30 + c_custkey % 21 AS DOUBLE) / 10 END AS rating,
  c_custkey * 7 % 1000 AS reviews_count
FROM @customer
"""

DERIVED["company_master_data"] = """
SELECT 1000000 + c_custkey AS id, c_custkey AS company_id,
  CASE c_custkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'recruitment' WHEN 2 THEN 'direct' END AS hiring_model,
  c_custkey % 9 = 0 AS is_consulting,
  c_mktsegment || ' NL' AS sector_nl, c_mktsegment AS sector_en, c_mktsegment || ' FR' AS sector_fr,
  CASE c_custkey % 11 WHEN 0 THEN 'startup' WHEN 1 THEN 'Scaleup' WHEN 2 THEN 'sme' WHEN 3 THEN 'Midmarket'
       WHEN 4 THEN 'corporate' WHEN 5 THEN 'subsidiary' WHEN 6 THEN 'government' WHEN 7 THEN 'unknown'
       WHEN 8 THEN 'Established Enterprise' END AS size_category,
  CASE WHEN c_custkey % 3 = 0 THEN 'own label' END AS category_nl,
  CASE WHEN c_custkey % 5 = 0 THEN 'own label' END AS category_en,
  CAST(NULL AS STRING) AS category_fr,
  CAST(c_custkey % 100 AS DOUBLE) / 100 AS size_confidence,
  CAST(NULL AS STRING) AS size_summary_nl, CAST(NULL AS STRING) AS size_summary_en, CAST(NULL AS STRING) AS size_summary_fr,
  CASE c_custkey % 3 WHEN 0 THEN '1-10' WHEN 1 THEN '51-200' END AS aantal_werknemers,
  CASE c_custkey % 8 WHEN 0 THEN 'Gent' WHEN 1 THEN 'niet gevonden' WHEN 2 THEN ' ' WHEN 3 THEN 'Unknown'
       WHEN 4 THEN 'Town ' || CAST(c_nationkey AS STRING) WHEN 5 THEN 'N/A' WHEN 6 THEN 'Leuven' END AS locatie_belgie,
  CASE WHEN c_custkey % 7 < 4 THEN TRUE WHEN c_custkey % 7 = 4 THEN FALSE END AS ai_enriched,
  CASE WHEN c_custkey % 7 IN (0, 1, 2, 5) THEN CAST('2001-08-02 00:00:00' AS TIMESTAMP) - (c_custkey % 50) * INTERVAL '1' HOUR END AS ai_enriched_at,
  CASE WHEN c_custkey % 7 = 5 THEN 'quota exceeded' WHEN c_custkey % 14 = 6 THEN 'could not extract data' END AS ai_enrichment_error,
  CASE WHEN c_custkey % 11 = 10 THEN 'Invalid response structure' END AS size_enrichment_error,
  CASE WHEN c_custkey % 4 <> 0 THEN 'https://www.firm' || CAST(c_custkey AS STRING) || '.example' END AS bedrijfswebsite,
  CAST(NULL AS STRING) AS jobspagina,
  CASE WHEN c_custkey % 6 = 1 THEN 'hr' || CAST(c_custkey AS STRING) || ' at firm.example' END AS email_hr,
  CASE WHEN c_custkey % 3 = 1 THEN c_name || ' maakt software' WHEN c_custkey % 3 = 2 THEN '' END AS bedrijfsomschrijving_nl,
  CASE WHEN c_custkey % 4 <> 3 THEN c_name || ' makes software' END AS bedrijfsomschrijving_en,
  1950 + c_custkey % 70 AS founded_year,
  c_mktsegment AS industry
FROM @customer WHERE c_acctbal >= 1000
"""

DERIVED["locations"] = """
SELECT s_suppkey AS id,
  CASE s_suppkey % 8 WHEN 0 THEN 'Flemish Region, Belgium' WHEN 1 THEN 'Belgium' WHEN 5 THEN 'Gent, Belgium'
       WHEN 2 THEN 'City ' || CAST(s_suppkey AS STRING) || ', ' || r_name || ', BE'
       WHEN 3 THEN 'City ' || CAST(s_suppkey AS STRING) || ', NL'
       WHEN 4 THEN 'City ' || CAST(s_suppkey AS STRING)
       ELSE 'City ' || CAST(s_suppkey AS STRING) || ', ' || n_name END AS full_location_string,
  CASE s_suppkey % 8 WHEN 0 THEN 'Flemish Region' WHEN 1 THEN 'Belgium' WHEN 5 THEN 'Gent'
       ELSE 'City ' || CAST(s_suppkey AS STRING) END AS city,
  CASE WHEN s_suppkey % 5 <> 2 THEN r_name END AS region,
  CASE WHEN s_suppkey % 8 IN (0, 1, 2, 5) THEN 'BE' WHEN s_suppkey % 8 = 3 THEN 'NL' END AS country_code,
  CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS subdivision_name,
  CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' NL' END AS subdivision_name_nl,
  CASE WHEN s_suppkey % 10 = 0 THEN n_name || ' FR' END AS subdivision_name_fr,
  CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS subdivision_name_en,
  CASE WHEN s_suppkey % 6 <> 0 THEN 'Europe/' || r_name ELSE '' END AS timezone,
  'Stad ' || CAST(s_suppkey AS STRING) AS city_name_nl,
  CASE WHEN s_suppkey % 7 <> 0 THEN 'Ville ' || CAST(s_suppkey AS STRING) END AS city_name_fr,
  'Town ' || CAST(s_suppkey AS STRING) AS city_name_en,
  r_name || ' NL' AS country_name_nl,
  CASE s_suppkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END AS ai_enriched,
  CASE WHEN s_suppkey % 6 < 4 THEN CAST('2001-08-02 00:00:00' AS TIMESTAMP) - (s_suppkey % 48) * INTERVAL '1' HOUR END AS ai_enriched_at,
  CASE WHEN s_suppkey % 6 = 3 THEN 'request timed out' END AS ai_enrichment_error
FROM @supplier JOIN @nation ON s_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey
"""

DERIVED["job_postings"] = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 <> 2 THEN 'li-' || CAST(o_orderkey AS STRING) END AS linkedin_job_id,
  CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 30 <> 2 THEN 'in-' || CAST(o_orderkey AS STRING) END AS indeed_job_id,
  CASE WHEN o_orderkey % 3 <> 2 THEN 'linkedin' ELSE 'indeed' END AS source,
  o_custkey AS company_id,
  o_orderkey % (SELECT count(*) FROM @supplier) AS location_id,
  CASE WHEN o_orderkey % 9 = 4 THEN (o_orderkey * 3 + 1) % (SELECT count(*) FROM @supplier) END AS location_id_override,
  CASE o_orderkey % 12 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN '  Senior  Data Engineer ' WHEN 2 THEN 'Data Analyst'
       WHEN 3 THEN 'data engineer' WHEN 4 THEN 'ML Engineer' WHEN 5 THEN 'BI Developer (m/f/x)' WHEN 6 THEN 'Data Scientist'
       WHEN 7 THEN 'Bus Driver' WHEN 8 THEN 'DATA ENGINEER' WHEN 9 THEN 'Analytics Engineer' WHEN 10 THEN 'Nurse'
       ELSE 'Account Manager' END AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Mid-Senior level' WHEN '2-HIGH' THEN 'Entry level' WHEN '3-MEDIUM' THEN 'Director' WHEN '5-LOW' THEN '' END AS seniority_level,
  CASE o_orderstatus WHEN 'F' THEN 'Full-time' WHEN 'O' THEN 'Contract' END AS employment_type,
  CASE o_orderkey % 5 WHEN 0 THEN split('Software,Banking', ',') WHEN 1 THEN split('Retail', ',')
       WHEN 2 THEN split('Banking,Health', ',') WHEN 3 THEN split('Software', ',') END AS industries,
  CASE WHEN o_orderkey % 4 <> 1 THEN split('Engineering', ',') END AS function_areas,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS created_at,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR END AS posted_date,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 200 END AS num_applicants,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice / 10) AS DOUBLE) END AS base_salary_min,
  CASE WHEN o_orderkey % 6 <> 1 THEN CAST(floor(o_totalprice / 8) AS DOUBLE) END AS base_salary_max,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'https://apply.example/' || CAST(o_orderkey AS STRING) ELSE '' END AS apply_url,
  'https://jobs.example/' || CAST(o_orderkey AS STRING) AS job_url,
  o_orderkey % 2 = 0 AS application_available,
  o_orderkey % 8 <> 0 AS is_active,
  CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + (o_orderkey % 20) * INTERVAL '1' DAY END AS detected_inactive_at,
  o_orderdate + (o_orderkey % 10) * INTERVAL '1' DAY AS last_seen_at,
  CASE WHEN o_orderkey % 13 IN (1, 2) THEN 'NIS' WHEN o_orderkey % 13 <> 0 THEN 'Data' END AS title_classification,
  CASE WHEN o_orderkey % 26 = 0 THEN 'Unexpected classification: x' END AS title_classification_error,
  CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 50 = 9 THEN ' '
       ELSE 'title ' || CAST(o_orderkey % 4 AS STRING) || '|company ' || CAST(o_custkey AS STRING) END AS dedup_key,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderkey * 7 % 1009 + 1 END AS ranking_position,
  CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey * 31 % 10007 AS DOUBLE) / 64 END AS ranking_score,
  CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey * 17 % 10007 AS DOUBLE) / 64 END AS base_score,
  CASE WHEN o_orderkey % 10 <> 9 THEN CAST('2001-08-01 06:00:00' AS TIMESTAMP) + (o_orderkey % 3) * INTERVAL '1' HOUR END AS ranking_updated_at,
  CAST(NULL AS STRING) AS ranking_metadata,
  CAST(1 AS DOUBLE) AS hourly_multiplier,
  o_orderkey % 6 = 0 AS needs_ranking
FROM @orders
"""

DERIVED["job_descriptions"] = """
SELECT doc_id AS job_posting_id, 'Document ' || CAST(doc_id AS STRING) || ' in ' || lang AS summary,
  CASE WHEN doc_id % 17 = 3 THEN '' ELSE text END AS full_description_text
FROM @documents
"""

DERIVED["job_posters"] = """
SELECT conv_id * 100 + turn AS id, conv_id AS job_posting_id, role || ' ' || CAST(turn AS STRING) AS name,
  CASE WHEN turn % 2 = 0 THEN 'Recruiter' END AS title
FROM @conversations
"""

DERIVED["llm_enrichment"] = """
SELECT o_orderkey + 5000000 AS id, o_orderkey AS job_posting_id,
  CASE o_orderkey % 10 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'Data Scientist' WHEN 3 THEN 'Other'
       WHEN 4 THEN 'NIS' WHEN 5 THEN 'ML Engineer' WHEN 6 THEN 'Analytics Engineer' WHEN 7 THEN 'Data Architect' WHEN 8 THEN 'BI Developer' END AS type_datarol,
  CASE WHEN o_orderkey % 2 = 0 THEN split('Technical,Lead', ',') ELSE split('Technical', ',') END AS rolniveau,
  CASE o_orderkey % 3 WHEN 0 THEN split('Junior', ',') WHEN 1 THEN split('Medior,Senior', ',') END AS seniority,
  CASE o_orderkey % 4 WHEN 0 THEN split('Permanent', ',') WHEN 1 THEN split('Freelance,Permanent', ',') WHEN 2 THEN split('Intern', ',') END AS contract,
  CASE WHEN o_orderkey % 5 < 3 THEN 'Direct' ELSE 'Agency' END AS sourcing_type,
  CASE o_orderkey % 6 WHEN 0 THEN '{"nl":{"seniority":["Junior"]}}' WHEN 1 THEN '{"en":{"seniority":"Senior"}}'
       WHEN 2 THEN '{"nl":{"seniority":[]},"fr":{"seniority":["Expert","Senior"]}}' WHEN 3 THEN '{"nl":{"seniority":"Medior"}}' WHEN 4 THEN '{}' END AS labels,
  CASE WHEN o_orderkey % 3 = 0 THEN 'kort' END AS samenvatting_kort_nl,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'lange samenvatting' WHEN 2 THEN 'nog een samenvatting' END AS samenvatting_lang_nl,
  CASE o_orderkey % 4 WHEN 0 THEN split('SQL,Python,Spark', ',') WHEN 1 THEN split('SQL,Excel', ',') WHEN 2 THEN split('SQL,Python,Scala,dbt', ',') END AS hard_skills,
  CASE o_orderkey % 5 WHEN 0 THEN split('Python,SQL', ',') WHEN 1 THEN split('Scala', ',') WHEN 2 THEN split(' Python ,R,SQL,Java', ',') END AS must_have_programmeertalen,
  CASE o_orderkey % 3 WHEN 0 THEN split('Java,Python', ',') WHEN 1 THEN split('C++,Go,Rust', ',') END AS nice_to_have_programmeertalen,
  CASE o_orderkey % 4 WHEN 0 THEN split('Azure,Databricks,Airflow', ',') WHEN 3 THEN split('AWS,Spark,Kafka,Airflow,dbt,Snowflake', ',') END AS must_have_ecosystemen,
  CASE o_orderkey % 7 WHEN 0 THEN split('Kafka', ',') WHEN 1 THEN split('Power BI,Tableau,Looker', ',') END AS nice_to_have_ecosystemen,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST('2001-08-02 00:00:00' AS TIMESTAMP) - (o_orderkey % 72) * INTERVAL '1' HOUR END AS enrichment_completed_at,
  CASE WHEN o_orderkey % 12 = 5 THEN 'quota exceeded (429)' WHEN o_orderkey % 12 = 9 THEN 'timeout while calling'
       WHEN o_orderkey % 24 = 11 THEN 'could not extract JSON' WHEN o_orderkey % 24 = 6 THEN 'service error' END AS enrichment_error,
  'prompt-' || CAST(o_orderkey % 3 AS STRING) AS enrichment_model_version,
  o_orderdate AS created_at,
  CASE o_orderkey % 3 WHEN 0 THEN '[{"key":"remote_policy","found":true,"value":"hybrid"},{"key":"company_car","found":false}]'
       WHEN 1 THEN '[{"key":"salary_range","found":true,"value":"3000"},{"key":"remote_policy","found":false}]' END AS perks,
  CASE WHEN o_orderkey % 3 = 0 THEN 'hybrid' END AS perk_remote_policy
FROM @orders WHERE o_totalprice >= 60000
"""

DERIVED["job_sources"] = """
SELECT l_orderkey AS job_posting_id, CASE WHEN l_returnflag = 'A' THEN 'indeed' ELSE 'linkedin' END AS source,
  min('src-' || CAST(l_partkey AS STRING)) AS source_job_id, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at
FROM @lineitem WHERE l_quantity >= 30 GROUP BY 1, 2
"""

DERIVED["job_scrape_history"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_posting_id,
  (l_orderkey * 7 + l_linenumber * 13) % (SELECT count(*) FROM @events) AS scrape_run_id,
  l_shipdate + (l_linenumber % 24) * INTERVAL '1' HOUR AS detected_at
FROM @lineitem
"""

DERIVED["job_types"] = """
SELECT r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'Data' ELSE r_name END AS name,
  '#' || CAST(100000 + r_regionkey AS STRING) AS color, r_regionkey <> 3 AS is_active
FROM @region
"""

DERIVED["job_type_assignments"] = """
SELECT o_orderkey AS job_posting_id, CAST(o_orderkey % 4 AS INT) AS job_type_id, 'manual' AS assigned_via
FROM @orders WHERE o_orderpriority <> '5-LOW'
"""

DERIVED["search_queries"] = """
SELECT s_suppkey AS id, 'Query ' || CAST(s_suppkey % 40 AS STRING) AS search_query,
  'Nation ' || CAST(s_nationkey AS STRING) AS location_query,
  CASE s_suppkey % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' END AS source,
  s_suppkey % 4 <> 0 AS is_active, s_suppkey % 5 = 0 AS schedule_enabled,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 5 AS INT) END AS job_type_id,
  CAST('2023-12-01 00:00:00' AS TIMESTAMP) + (s_suppkey * 37 % 600) * INTERVAL '1' HOUR AS created_at
FROM @supplier
"""

DERIVED["scrape_runs"] = """
SELECT event_id AS id,
  CASE WHEN q.id IS NULL THEN 'Other ' ELSE q.search_query END AS search_query,
  CASE WHEN q.id IS NULL THEN 'Elsewhere' WHEN event_id % 6 = 1 THEN upper(q.location_query) ELSE q.location_query END AS location_query,
  q.id AS search_query_id,
  CASE event_id % 3 WHEN 0 THEN 'linkedin_brightdata' WHEN 1 THEN 'indeed_brightdata' END AS platform,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'linkedin' END AS source,
  CASE WHEN event_id % 20 IN (0, 1) THEN 'running' WHEN event_id % 20 = 2 THEN 'pending_retry' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 60 = 21 THEN NULL ELSE date_trunc('second', ts) END AS started_at,
  CASE WHEN event_id % 20 IN (0, 1) AND event_id % 80 <> 40 THEN NULL WHEN event_id % 20 = 2 THEN NULL
       ELSE date_trunc('second', ts) + (event_id % 40) * INTERVAL '1' MINUTE END AS completed_at,
  CASE WHEN event_id % 9 <> 4 THEN CAST(floor(value) AS BIGINT) END AS jobs_found,
  CASE WHEN event_id % 9 <> 4 THEN CAST(floor(value / 2) AS BIGINT) END AS jobs_new,
  CASE WHEN event_id % 9 <> 5 THEN CAST(floor(value / 4) AS BIGINT) END AS jobs_updated,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS INT) END AS job_type_id,
  CAST(event_id % 6 AS INT) AS retry_count,
  CASE WHEN event_id % 20 = 2 THEN date_trunc('second', ts) + 4 * INTERVAL '1' HOUR END AS next_retry_at,
  event_id % 11 = 0 AS archived,
  CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"source":"indeed","jobs_error":' || CAST(event_id % 4 AS STRING) || '}'
       WHEN 2 THEN '{"jobs_error":2,"error_details":["bad row","no title"]}' WHEN 3 THEN '{}' END AS metadata
FROM @events LEFT JOIN @search_queries q ON q.id = user_id % (SELECT count(*) + 2 FROM @supplier)
"""

DERIVED["programming_languages"] = """
SELECT p_partkey AS id, CASE p_partkey % 50 WHEN 0 THEN 'Python' WHEN 1 THEN 'C++' ELSE p_name END || CASE WHEN p_partkey < 50 THEN '' ELSE ' ' || CAST(p_partkey AS STRING) END AS name,
  upper(p_name) AS display_name, p_type AS category, p_size % 5 <> 0 AS is_active,
  CASE WHEN p_size % 4 <> 0 THEN CAST(p_partkey * 7 % 101 AS INT) END AS relevance_score
FROM @part
"""

DERIVED["ecosystems"] = """
SELECT p_partkey AS id, p_brand || '-' || CAST(p_partkey AS STRING) AS name, upper(p_brand) AS display_name, p_type AS category,
  p_size % 7 <> 0 AS is_active, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey * 11 % 101 AS INT) END AS relevance_score
FROM @part
"""

DERIVED["job_programming_languages"] = """
SELECT l_orderkey AS job_posting_id, l_partkey AS programming_language_id,
  min(CASE WHEN l_linestatus = 'O' THEN 'must_have' ELSE 'nice_to_have' END) AS requirement_level
FROM @lineitem GROUP BY 1, 2
"""

DERIVED["job_ecosystems"] = """
SELECT l_orderkey AS job_posting_id, l_partkey AS ecosystem_id,
  min(CASE WHEN l_linestatus = 'O' THEN 'must_have' ELSE 'nice_to_have' END) AS requirement_level
FROM @lineitem GROUP BY 1, 2
"""

DERIVED["linkedin_raw"] = """
SELECT o_orderkey AS arrival,
  CASE WHEN o_orderkey % 41 <> 5 THEN CAST(3000000 + o_orderkey AS STRING) END AS job_posting_id,
  CASE WHEN o_orderkey % 43 <> 7 THEN CASE o_orderkey % 4 WHEN 0 THEN 'Data  Engineer' WHEN 1 THEN ' data engineer' WHEN 2 THEN 'Data Analyst' ELSE 'ML Engineer' END END AS job_title,
  c_name AS company_name,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(100000 + c_custkey AS STRING) END AS company_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'firm.example/' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://firm.example' WHEN 2 THEN '' END AS company_url,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://logo.example/x.png' ELSE 'logo.png' END AS company_logo,
  CASE o_orderkey % 6 WHEN 0 THEN 'Belgium' WHEN 1 THEN 'NL' WHEN 2 THEN 'New York, NY' WHEN 3 THEN 'Amsterdam, North Holland, nl'
       WHEN 4 THEN 'London, England, United Kingdom' ELSE ' Ghent , Flemish Region' END AS job_location,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'https://posting.example/' || CAST(o_orderkey AS STRING) END AS url,
  CASE WHEN o_orderkey % 10 <> 0 THEN 'https://old.example/' || CAST(o_orderkey AS STRING) END AS job_url,
  'Posting ' || CAST(o_orderkey AS STRING) AS job_summary,
  CASE o_orderkey % 3 WHEN 0 THEN 'Mid-Senior level' WHEN 1 THEN 'Entry level' END AS job_seniority_level,
  CASE WHEN o_orderkey % 4 <> 1 THEN 'Engineering' END AS job_function,
  'Full-time' AS job_employment_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'IT Services, Software' WHEN 1 THEN 'Banking,, Insurance ' WHEN 2 THEN '' END AS job_industries,
  CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.00/yr - $' || CAST(CAST(floor(o_totalprice) AS BIGINT) + 1000 AS STRING) || '.50/yr'
       WHEN 1 THEN '€15.50/hr - €18.00/hr' WHEN 2 THEN '50k' WHEN 3 THEN '1.2.3 - 4' WHEN 4 THEN 'CHF 100 - 200' END AS job_base_pay_range,
  CASE o_orderkey % 4 WHEN 0 THEN '2025-10-01T12:00:00Z' WHEN 1 THEN '2025-10-02' WHEN 2 THEN 'yesterday' END AS job_posted_date,
  '2 weeks ago' AS job_posted_time,
  CAST(o_orderkey % 300 AS INT) AS job_num_applicants,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://apply.example' END AS apply_link,
  o_orderkey % 2 = 0 AS application_availability,
  CASE WHEN o_orderkey % 5 = 1 THEN 'Jane ' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 5 = 2 THEN '' END AS poster_name,
  CASE WHEN o_orderkey % 47 = 3 THEN 'crawl failed' END AS error,
  CAST(NULL AS STRING) AS error_code
FROM @orders JOIN @customer ON o_custkey = c_custkey
"""

DERIVED["indeed_raw"] = """
SELECT o_orderkey AS arrival,
  CASE WHEN o_orderkey % 31 <> 4 THEN 'in' || CAST(o_orderkey AS STRING) END AS jobid,
  CASE WHEN o_orderkey % 37 <> 6 THEN 'https://ind.example/' || CAST(o_orderkey AS STRING) END AS url,
  CASE o_orderkey % 5 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'data engineer ' WHEN 3 THEN 'Nurse' END AS job_title,
  CASE WHEN o_orderkey % 6 <> 2 THEN c_name END AS company_name,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'Gent, Belgium' END AS location,
  CASE o_orderkey % 3 WHEN 0 THEN 'Main street 1, Antwerp' WHEN 1 THEN '' END AS job_location,
  CASE WHEN o_orderkey % 2 = 0 THEN 'plain text' END AS description_text,
  '<p>plain &amp; text</p>' AS description,
  CASE o_orderkey % 3 WHEN 0 THEN '<b>formatted</b>' WHEN 1 THEN '' END AS job_description_formatted,
  CASE o_orderkey % 7 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' - $' || CAST(CAST(floor(o_totalprice) AS BIGINT) + 10 AS STRING) || ' a year'
       WHEN 1 THEN '€50k-€70K' WHEN 2 THEN '$25 - $35.50 an hour' WHEN 3 THEN 'Up to $50k' WHEN 4 THEN '£1,200,000 annual' WHEN 5 THEN 'to be discussed per week' END AS salary_formatted,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Full-time' END AS job_type,
  CASE o_orderkey % 3 WHEN 0 THEN split('Car,Insurance', ',') END AS benefits,
  CASE o_orderkey % 4 WHEN 0 THEN 'Degree' WHEN 1 THEN '' END AS qualifications,
  '30+ days ago' AS date_posted,
  CASE WHEN o_orderkey % 3 = 0 THEN '2025-10-03T08:00:00.000Z' END AS date_posted_parsed,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://apply.example' WHEN 1 THEN '' END AS apply_link,
  CAST(NULL AS STRING) AS company_website, CAST(NULL AS STRING) AS logo_url,
  CAST(NULL AS STRING) AS error, CASE WHEN o_orderkey % 53 = 8 THEN 'dead_page' END AS error_code
FROM @orders JOIN @customer ON o_custkey = c_custkey
"""

DERIVED["linkedin_items"] = """
SELECT o_orderkey AS arrival,
  CASE WHEN o_orderkey % 9 = 2 THEN '{"error":"crawl failed","error_code":"dead_page"}'
       WHEN o_orderkey % 19 = 3 THEN '{"error_code":"timeout","input":{"url":"x"}}'
       ELSE '{"job_posting_id":"' || CAST(o_orderkey AS STRING) || '","job_title":"Data Engineer","url":"https://posting.example/' || CAST(o_orderkey AS STRING)
            || '","job_num_applicants":' || CAST(o_orderkey % 90 AS STRING) || '}' END AS item
FROM @orders
"""

DERIVED["company_csv"] = """
SELECT CASE c_custkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN CAST(100000 + c_custkey AS STRING) || '.0' WHEN 2 THEN CAST(900000 + c_custkey AS STRING) ELSE ' ' || CAST(100000 + c_custkey AS STRING) END AS csv_id,
  c_name AS csv_name,
  CASE WHEN c_custkey % 4 <> 0 THEN ' ' || lower(c_mktsegment) || ' ' END AS csv_industry,
  CASE c_custkey % 6 WHEN 0 THEN 'c. 1999' WHEN 1 THEN '2005' WHEN 2 THEN 'unknown' END AS csv_founded,
  CASE WHEN c_custkey % 4 = 2 THEN 'www.firm.example' ELSE '' END AS csv_website,
  CASE WHEN c_custkey % 8 = 3 THEN 'firm.example/jobs' END AS csv_jobs,
  CASE WHEN c_custkey % 8 = 5 THEN 'info at firm.example' END AS csv_email
FROM @customer
"""

DERIVED["job_results"] = """
SELECT o_orderkey AS job_posting_id,
  CASE o_orderkey % 6 WHEN 0 THEN '{"data_role_type": broken'
   WHEN 1 THEN '{"data_role_type":"Data Engineer","role_level":["Technical","Lead"],"seniority":["Senior"],"contract":[],"sourcing_type":"Direct","summary_short":"Short","summary_long":"Long ' || CAST(o_orderkey AS STRING) || '","must_have_languages":["Python","SQL"],"labels":{"nl":{"seniority":["Senior"]}},"perk_company_car":"yes"}'
   WHEN 2 THEN '{"data_role_type":"Data Analyst","summary_short_nl":"Kort","must_have_ecosystems":["Azure"],"labels":{}}'
   ELSE '{"sourcing_type":"Agency","remote_work_policy":"hybrid"}' END AS payload
FROM @orders
"""

DERIVED["company_results"] = """
SELECT c_custkey AS company_id,
  CASE c_custkey % 4
   WHEN 0 THEN '{"website":"https://new' || CAST(c_custkey AS STRING) || '.example","maturity_en":"Scaleup","maturity_nl":"Schaal","description_nl":"Beschrijving","confidence":"0.5","hiring_model":"direct"}'
   WHEN 1 THEN '{"maturity":{"category_en":"SME","category_fr":"PME","confidence":0.75},"bedrijfswebsite":"https://old.example","locatie_belgie":"Brugge"}'
   WHEN 2 THEN '{"category":{"en":"Corporate","nl":"Corporate"},"website":"","bedrijfswebsite":"https://b.example","employee_count_range":"51-200"}'
   ELSE '{"category_en":"Startup","sector_en":"IT","email_hr":"hr"}' END AS payload
FROM @customer
"""

DERIVED["location_results"] = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '{"timezone":"Europe/Brussels","subdivision_name":"East Flanders","city_name_fr":null}'
   ELSE '{"city_name_en":"Ghent","country_name_nl":"België"}' END AS payload
FROM @supplier
"""

DERIVED["size_results"] = """
SELECT 1000000 + c_custkey AS id, CASE c_custkey % 5
   WHEN 0 THEN '{"category":"startup","confidence":0.9,"summary":{"en":"small","nl":"klein"},"key_arguments":["a","b"]}'
   WHEN 1 THEN '{"category":"huge","confidence":0.5,"summary":{"en":"x"}}'
   WHEN 2 THEN '{"category":"sme","confidence":0.25}' WHEN 3 THEN ''
   ELSE '{"category":"government","confidence":"0.75","summary":{"fr":"etat"}}' END AS payload
FROM @customer
"""

DERIVED["title_answers"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Data' WHEN 1 THEN ' NIS ' WHEN 2 THEN 'data' WHEN 3 THEN 'Other' ELSE 'Data' END AS answer
FROM @orders
"""

_REF = re.compile(r"@(\w+)")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps become session-zone instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


class Tables(dict):
    """Given and derived tables of one folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in GIVEN:
            df = load(self.spark, self.sf_dir, name)
        elif name in DERIVED:
            df = self.sql(DERIVED[name])
        else:
            raise KeyError(name)
        self[name] = df
        return df

    def get(self, name, default=None):
        return self[name] if name in GIVEN or name in DERIVED or name in self else default

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL; ``@name`` stands for a table."""
        names = sorted(set(_REF.findall(text)))
        escaped = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_REF.sub(r"{\1}", escaped), **{n: self[n] for n in names})


def _dependencies(text: str) -> list[str]:
    """Derived tables that ``text`` needs, dependencies first."""
    order: list[str] = []

    def visit(t: str) -> None:
        for name in _REF.findall(t):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(text)
    return order


def oracle(text: str) -> str:
    """DuckDB text of a check: the derived tables it uses as CTEs, then the query."""
    ctes = [f"{name} AS ({_REF.sub(r'\1', DERIVED[name]).strip()})" for name in _dependencies(text)]
    body = _REF.sub(r"\1", text).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
