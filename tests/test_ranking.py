"""A ranking run on hand-built postings, and its invariants on the test tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobtide.bindings.base import Tables
from jobtide.functions import scores
from jobtide.operators import ranking
from jobtide.plans.views import ranking_view

NOW = dt.datetime(2025, 6, 1, 10)
VIEW = """id string, title string, company_id string, company_name string, location_id string, posted_date timestamp, seniority_level string,
 employment_type string, function_areas array<string>, base_salary_min double, base_salary_max double, apply_url string, num_applicants int,
 is_active boolean, title_classification string, company_industry string, company_url string, has_logo boolean,
 company_employee_count_range string, company_rating double, hiring_model string, location_city string, skills_must_have array<string>,
 samenvatting_lang string, data_role_type string, enrichment_completed_at timestamp, labels string, description_length int,
 must_have_programmeertalen array<string>, nice_to_have_programmeertalen array<string>, must_have_ecosystemen array<string>,
 nice_to_have_ecosystemen array<string>"""


def job(i, **changes):
    base = dict(
        id=i, title="Data Engineer", company_id="c1", company_name="Firm", location_id="l1", posted_date=NOW - dt.timedelta(hours=3),
        seniority_level="Mid", employment_type="Full-time", function_areas=["Eng"], base_salary_min=1.0, base_salary_max=2.0,
        apply_url="u", num_applicants=0, is_active=True, title_classification="Data", company_industry="IT", company_url="u",
        has_logo=True, company_employee_count_range="201-500", company_rating=4.0, hiring_model="direct", location_city="Gent",
        skills_must_have=["a", "b", "c"], samenvatting_lang="text", data_role_type="Data Engineer", enrichment_completed_at=NOW,
        labels='{"nl":{"seniority":["Senior"]}}', description_length=501, must_have_programmeertalen=["x"] * 20,
        nice_to_have_programmeertalen=None, must_have_ecosystemen=[], nice_to_have_ecosystemen=None,
    )
    return {**base, **changes}


def frame(spark, jobs):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(VIEW)
    return spark.createDataFrame([tuple(j[f.name] for f in schema) for j in jobs], schema)


def scored(spark, *jobs):
    return {r["id"]: r for r in ranking.score_postings(frame(spark, jobs), NOW).collect()}


def test_component_scores(spark):
    got = scored(
        spark,
        job("full"),
        job("two", skills_must_have=["a", "b"], must_have_programmeertalen=["x"], description_length=500, samenvatting_lang=""),
        job("bare", skills_must_have=None, base_salary_min=None, seniority_level="", employment_type=None, samenvatting_lang=None,
            description_length=None, must_have_programmeertalen=None, apply_url="", num_applicants=None, has_logo=False,
            hiring_model=None, company_rating=None, company_employee_count_range=None, company_industry=None, company_url=None,
            location_city=None, function_areas=[], labels=None),
        job("agency", hiring_model="recruitment", company_rating=4.2, company_name="Google"),
        job("famous", company_name="GOOGLE", company_rating=4.5, company_employee_count_range="10000+"),
        job("raw", enrichment_completed_at=None),
    )
    assert got["full"]["quality_score"] == 100 and got["full"]["transparency_score"] == 100 and got["full"]["completeness_score"] == 100
    assert got["full"]["reputation_score"] == 50 and got["full"]["seniority"] == "Senior"
    assert got["two"]["quality_score"] == 25 + 15 + 10 + 1
    assert got["bare"]["quality_score"] == -30 and got["bare"]["transparency_score"] == 0 and got["bare"]["reputation_score"] == 20
    assert got["bare"]["completeness_score"] == 20 and got["bare"]["seniority"] is None
    assert got["agency"]["reputation_score"] == 20 and got["famous"]["reputation_score"] == 100
    assert got["raw"]["base_score"] == scores.UNENRICHED_SCORE
    assert got["full"]["base_score"] == pytest.approx(150 * 0.25 + 100 * 0.2 + 100 * 0.2 + 100 * 0.15 + 100 * 0.1 + 50 * 0.1)


def test_run_and_stored_form(spark):
    jobs = [
        job("a"), job("b"), job("c", company_id="c2", location_id="l2"), job("n", title_classification="NIS"),
        job("u", enrichment_completed_at=None), job("u2", enrichment_completed_at=None), job("off", is_active=False),
        job("none", title_classification=None, data_role_type="Other"),
    ]
    ranked = ranking.rank_postings(frame(spark, jobs), NOW)
    rows = {r["id"]: r for r in ranked.collect()}
    assert "off" not in rows and rows["n"]["final_rank"] == 999999
    assert sorted(r["final_rank"] for i, r in rows.items() if i != "n") == list(range(1, 7))
    assert rows["a"]["company_rank"] == 1 and rows["b"]["company_rank"] == 2 and rows["c"]["company_rank"] == 1
    m = rows["b"]["hourly_multiplier"]
    expected = rows["b"]["base_score"] * (1 - 0.15) * (1 - (rows["b"]["role_type_rank"] - 1) * 0.1) * max(0.5, 1 - (rows["b"]["seniority_rank"] - 1) * 0.05) * m
    assert rows["b"]["final_score"] == pytest.approx(expected)
    stored = {r["id"]: r for r in ranking.stored_ranking(ranked, NOW).collect()}
    detail = json.loads(stored["b"]["ranking_metadata"])
    assert detail["company_rank"] == 2 and detail["base_score"] == round(rows["b"]["base_score"], 2)
    assert len({r["ranking_updated_at"] for r in stored.values()}) == 1 and not any(r["needs_ranking"] for r in stored.values())


def test_ranks_have_no_gaps_on_test_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    ranked = ranking.rank_postings(ranking_view(t), "2001-08-02 00:00:00")
    inside = ranked.where(F.col("final_rank") != 999999)
    row = inside.agg(F.count("*").alias("n"), F.min("final_rank").alias("lo"), F.max("final_rank").alias("hi"), F.count_distinct("final_rank").alias("d")).first()
    assert (row["lo"], row["hi"], row["d"]) == (1, row["n"], row["n"])
