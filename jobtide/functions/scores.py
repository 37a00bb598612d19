"""The six posting scores, the weighted base score and the ranking modifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import AsOf, before, instant

# Weights of the scores, added in this order.
WEIGHTS = (
    ("freshness_score", 0.25),
    ("quality_score", 0.20),
    ("transparency_score", 0.20),
    ("role_match_score", 0.15),
    ("completeness_score", 0.10),
    ("reputation_score", 0.10),
)
UNENRICHED_SCORE = -9999.0
OUT_OF_SCOPE_RANK = 999999

# Age limits and points, newest first.
FRESHNESS = (({"hours": 30}, 150), ({"days": 3}, 90), ({"days": 7}, 75), ({"days": 14}, 60), ({"days": 30}, 40))
OLD_FRESHNESS = 20

# Points by role type.
ROLE_POINTS = (
    (("Other",), -200),
    (("NIS",), -99999),
    (("Data Engineer", "Data Scientist"), 100),
    (("Data Analyst", "Analytics Engineer"), 90),
    (("ML Engineer", "BI Developer", "Machine Learning Engineer"), 85),
)
LARGE = ("1001-5000", "5001-10000", "10000+")
MEDIUM = ("201-500", "501-1000")
WELL_KNOWN = ("google", "microsoft", "meta", "amazon", "apple", "netflix", "facebook", "alphabet")

# Penalty per extra posting of a group and its floor.
COMPANY_STEP, COMPANY_FLOOR = 0.15, 0.1
ROLE_STEP, ROLE_FLOOR = 0.10, 0.3
SENIORITY_STEP, SENIORITY_FLOOR = 0.05, 0.5
FIRST_IN_LOCATION = 1.05

TECH_ARRAYS = (
    "must_have_programmeertalen", "nice_to_have_programmeertalen", "must_have_ecosystemen", "nice_to_have_ecosystemen",
)


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _count(c: Column) -> Column:
    return F.coalesce(F.array_size(c), F.lit(0))


def _points(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def freshness(posted: Column, as_of: AsOf) -> Column:
    score = F.when(posted.isNull(), OLD_FRESHNESS)
    for limit, points in FRESHNESS:
        score = score.when(posted >= before(as_of, **limit), points)
    return score.otherwise(OLD_FRESHNESS).cast("double")


def quality(description_length: Column) -> Column:
    skills = _count(F.col("skills_must_have"))
    tech = sum((_count(F.col(c)) for c in TECH_ARRAYS), F.lit(0))
    score = (
        F.when(skills >= 3, 20).when(skills == 0, -30).otherwise(0)
        + _points(F.col("base_salary_min").isNotNull() & F.col("base_salary_max").isNotNull(), 25)
        + _points(_filled(F.col("seniority_level")), 15)
        + _points(_filled(F.col("employment_type")), 10)
        + _points(_filled(F.col("samenvatting_lang")), 15)
        + _points(F.coalesce(description_length > 500, F.lit(False)), 10)
        + F.least(F.lit(15), tech)
    )
    return F.least(F.lit(100), score).cast("double")


def transparency() -> Column:
    return (
        _points(F.coalesce(F.col("hiring_model") == "direct", F.lit(False)), 60)
        + _points(_filled(F.col("apply_url")), 20)
        + _points(F.col("num_applicants").isNotNull(), 10)
        + _points(F.coalesce(F.col("has_logo"), F.lit(False)), 10)
    ).cast("double")


def role_match(role: Column) -> Column:
    score = F.when(~_filled(role), 10)
    for roles, points in ROLE_POINTS:
        score = score.when(role.isin(*roles), points)
    return score.otherwise(70).cast("double")


def completeness() -> Column:
    return (
        _points(_filled(F.col("company_employee_count_range")), 15)
        + _points(_filled(F.col("company_industry")), 15)
        + _points(_filled(F.col("company_url")), 15)
        + _points(_filled(F.col("location_city")), 15)
        + _points(_count(F.col("function_areas")) > 0, 20)
        + _points(F.col("enrichment_completed_at").isNotNull(), 20)
    ).cast("double")


def is_well_known(company: Column) -> Column:
    return F.coalesce(F.lower(company).isin(*WELL_KNOWN), F.lit(False))


def reputation() -> Column:
    rating, size = F.col("company_rating"), F.col("company_employee_count_range")
    agency = F.when(rating >= 4.0, 20).otherwise(10)
    stars = F.when(rating >= 4.5, 40).when(rating >= 4.0, 30).when(rating >= 3.5, 20).otherwise(10)
    scale = F.when(size.isin(*LARGE), 30).when(size.isin(*MEDIUM), 20).otherwise(10)
    direct = stars + scale + _points(is_well_known(F.col("company_name")), 30)
    return F.when(F.col("hiring_model") == "recruitment", agency).otherwise(direct).cast("double")


def base_score() -> Column:
    total = None
    for name, weight in WEIGHTS:
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return F.when(F.col("enrichment_completed_at").isNull(), F.lit(UNENRICHED_SCORE)).otherwise(total)


def hourly_multiplier(posting_id: Column, as_of: AsOf) -> Column:
    """0.8 to 1.2, the same within an hour for one posting."""
    seed = F.concat(F.date_format(instant(as_of), "yyyy-MM-dd-HH"), F.lit("-"), posting_id.cast("string"))
    number = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint")
    return F.lit(0.8) + (number % 10000) / F.lit(10000) * F.lit(0.4)


def _penalty(rank: Column, step: float, floor: float) -> Column:
    return F.greatest(F.lit(floor), F.lit(1) - (rank - 1) * F.lit(step))


def diversified(base: Column, company_rank: Column, role_rank: Column, location_rank: Column,
                seniority_rank: Column, multiplier: Column) -> Column:
    score = base * _penalty(company_rank, COMPANY_STEP, COMPANY_FLOOR)
    score = score * _penalty(role_rank, ROLE_STEP, ROLE_FLOOR)
    score = F.when(location_rank == 1, score * F.lit(FIRST_IN_LOCATION)).otherwise(score)
    score = score * _penalty(seniority_rank, SENIORITY_STEP, SENIORITY_FLOOR)
    return score * multiplier
