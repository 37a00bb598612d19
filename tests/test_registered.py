"""A cross-section of the registered queries against DuckDB; ``check.py`` runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import normal
from jobtide.bindings import QUERIES, check_sql, run
from jobtide.bindings.base import GIVEN

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "linkedin_posting_rows", "indeed_posting_rows", "csv_import_outcomes", "job_result_sink", "search_page", "search_total",
    "vague_locations", "company_backlog", "ranking_view", "job_listings_view", "companies_list_view", "events_near_runs",
    "query_history_by_text", "company_match", "dashboard_stats", "quality_stats", "common_industries", "company_profiles",
    "page_texts", "posting_scores", "retry_plan_applied", "duplicates_resolved", "company_merge", "types_assigned_from_runs",
    "override_backfill", "tech_assignments", "activity_sessions", "ranking_run",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = run(name, spark, FOLDER)
    cursor = con.execute(check_sql(name))
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    left = normal([tuple(r) for r in df.collect()], df.columns)
    assert left and left == normal(cursor.fetchall(), names)


def test_contract(spark):
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
    assert entry_module.entry(spark).limit(1).count() == 1


def test_every_operator_is_covered():
    """Operator ids are letter plus number; these are the ranges of the inventory."""
    wanted = {
        **{"S": range(1, 32)}, "P": range(1, 37), "J": range(1, 21), "A": range(1, 39), "W": range(1, 11), "O": range(1, 7),
        "U": range(1, 5), "T": range(1, 20), "R": range(1, 6), "C": range(1, 12),
        "M": [n for n in range(1, 26) if n != 24],
    }
    covered = {c for q in QUERIES.values() for c in q.covers}
    missing = {f"{k}{n}" for k, numbers in wanted.items() for n in numbers} - covered
    assert not missing
