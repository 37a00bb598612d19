"""Merges, assignments, overrides, runs, search and joins on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtide.operators import assign, dedup, lifecycle, override, runs, techstack
from jobtide.plans import joins, listings, stats
from jobtide.plans.search import Search, sort_order, suggestions

NOW = dt.datetime(2025, 6, 1, 10)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_duplicate_postings(spark):
    posts = spark.createDataFrame([(1, "k", 3), (2, "k", 1), (3, "k", 2), (4, None, 1), (5, None, 2), (6, "o", 1)], "id int, dedup_key string, created_at int")
    sources = spark.createDataFrame(
        [(1, "linkedin", "l1", 5), (2, "linkedin", "l2", 6), (3, "indeed", "i3", 4), (1, "indeed", "i1", 9), (6, "indeed", "i6", 1)],
        "job_posting_id int, source string, source_job_id string, first_seen_at int",
    ).withColumn("first_seen_at", F.timestamp_seconds("first_seen_at")).withColumn("last_seen_at", F.col("first_seen_at"))
    kids = spark.createDataFrame([(1,), (2,), (6,)], "job_posting_id int")
    kept, merged, children = dedup.resolve_duplicate_postings(posts, sources, {"d": kids}, NOW)
    assert rows(kept, "id") == [(2,), (4,), (5,), (6,)]
    assert rows(merged, "job_posting_id", "source", "source_job_id") == [(2, "indeed", "i3"), (2, "linkedin", "l2"), (6, "indeed", "i6")]
    assert rows(children["d"]) == [(2,), (6,)]
    again, sources2, _ = dedup.resolve_duplicate_postings(kept, merged, {}, NOW)
    assert rows(again) == rows(kept) and rows(sources2) == rows(merged)


def test_company_merge(spark):
    firms = spark.createDataFrame(
        [(1, "A", False, None, "11"), (2, "A", True, None, None), (3, "A", False, "u", "12"), (4, "B", False, None, None), (5, "B", False, None, None), (6, None, True, None, None)],
        "id int, name string, has_logo boolean, logo_url string, linkedin_company_id string",
    )
    posts = spark.createDataFrame([(1, 1), (2, 3), (3, 5), (4, 4), (5, 5), (6, None)], "id int, company_id int")
    left, moved, mapping = dedup.merge_companies(firms, posts)
    assert rows(mapping, "id", "keep_id") == [(1, 2), (3, 2), (4, 5)]
    assert rows(left, "id") == [(2,), (5,), (6,)]
    assert rows(moved, "id", "company_id") == [(1, 2), (2, 2), (3, 5), (4, 5), (5, 5), (6, None)]
    assert rows(dedup.best_company_by_name(firms.where("name = 'A'")), "id") == [(2,)]


def test_industry_backfill(spark):
    firms = spark.createDataFrame([(1, None), (2, None), (3, "Own"), (4, None)], "id int, industry string")
    posts = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", "b"]), (1, ["c"]), (2, []), (3, ["x"])], "company_id int, industries array<string>")
    assert rows(dedup.backfill_industries(firms, posts), "id", "industry") == [(1, "a"), (2, None), (3, "Own"), (4, None)]


def test_source_backfill(spark):
    posts = spark.createDataFrame(
        [(1, "linkedin", "l1", None), (2, "indeed", None, "i2"), (3, "linkedin", None, None), (4, "other", "l4", None), (5, "linkedin", "l5", None)],
        "id int, source string, linkedin_job_id string, indeed_job_id string",
    ).withColumn("created_at", F.lit(NOW))
    sources = spark.createDataFrame([(5, "indeed", "x", NOW, NOW)], "job_posting_id int, source string, source_job_id string, first_seen_at timestamp, last_seen_at timestamp")
    assert rows(dedup.backfill_sources(posts, sources), "job_posting_id", "source", "source_job_id") == [(1, "linkedin", "l1"), (2, "indeed", "i2"), (5, "indeed", "x")]


def test_types_from_runs(spark):
    posts = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    held = spark.createDataFrame([(1, 9, "manual")], "job_posting_id int, job_type_id int, assigned_via string")
    history = spark.createDataFrame([(2, 20, 2), (2, 21, 1), (3, 22, 1), (4, 23, 1), (1, 20, 1)], "job_posting_id int, scrape_run_id int, detected_at int")
    scrapes = spark.createDataFrame([(20, 7, "q", "p"), (21, 8, "q", "p"), (22, None, "Data", "GENT"), (23, None, "none", "x")], "id int, job_type_id int, search_query string, location_query string")
    queries = spark.createDataFrame([(1, "data", "Gent", 5), (2, "DATA", "gent", 6), (3, "none", "x", None)], "id int, search_query string, location_query string, job_type_id int")
    got = assign.assign_from_runs(posts, held, history, scrapes, queries)
    assert rows(got) == [(1, 9, "manual"), (2, 8, "script"), (3, 6, "script")]
    assert rows(assign.assign_on_sighting(held, history, scrapes)) == [(1, 9, "manual"), (2, 8, "trigger")]
    assert rows(assign.unassigned(posts, held.unionByName(held.limit(1).withColumn("job_posting_id", F.lit(None).cast("int"))))) == [(2,), (3,), (4,), (5,)]


def test_default_type_is_created(spark):
    types = spark.createDataFrame([("1", "Sales", True)], "id string, name string, is_active boolean")
    posts = spark.createDataFrame([(1,), (2,)], "id int")
    held = spark.createDataFrame([(1, "1", "manual")], "job_posting_id int, job_type_id string, assigned_via string")
    out, grown = assign.assign_default(posts, held, types)
    new = {r["name"]: r["id"] for r in grown.collect()}["Data"]
    assert rows(out) == [(1, "1", "manual"), (2, new, "migration")]


def test_tech_stack(spark):
    df = spark.createDataFrame([("j", [" Python ", "SQL", ""], ["Python", "Go"]), ("k", None, ["SQL"])], "job_posting_id string, m array<string>, n array<string>")
    dim = spark.createDataFrame([("1", "Python", True), ("2", "Go", False)], "id string, name string, is_active boolean")
    held = spark.createDataFrame([("j", "1", "nice_to_have")], "job_posting_id string, item string, requirement_level string")
    grown, out = techstack.process(df, "m", "n", dim, held, "item")
    names = {r["id"]: r["name"] for r in grown.collect()}
    assert sorted((j, names[i], lv) for j, i, lv in rows(out)) == [
        ("j", "Go", "nice_to_have"), ("j", "Python", "nice_to_have"), ("j", "SQL", "must_have"), ("k", "SQL", "nice_to_have"),
    ]
    literal = df.select("job_posting_id", F.lit('{"Python","SQL"}').alias("m"), F.lit("{}").alias("n"))
    assert techstack.mentions(literal, "m", "n").count() == 4


def test_vague_patterns(spark):
    places = spark.createDataFrame([(1, "Belgium"), (2, "Flemish Region, BE"), (3, "Gent"), (4, ""), (5, "Belgi")], "id int, s string")
    assert rows(override.vague_strings(places, "s", None)) == [("Belgium",), ("Flemish Region, BE",)]
    config = spark.createDataFrame([("Ge", True), ("Belgium", False)], "pattern string, is_active boolean")
    assert rows(override.vague_strings(places, "s", config)) == [("Gent",)]
    assert rows(override.vague_strings(places, "s", config.where("pattern = 'Belgium'"))) == [("Belgium",), ("Flemish Region, BE",)]


def test_retry_plan(spark):
    h = dt.timedelta(hours=1)
    data = [
        (1, "running", NOW - h / 2, None, 0), (2, "running", NOW - 3 * h, None, 0), (3, "running", NOW - 3 * h, None, 4),
        (4, "running", NOW - 3 * h, NOW, 0), (5, "running", None, None, 0), (6, "completed", NOW, NOW, 0), (7, "running", NOW - 3 * h, None, None),
    ]
    df = spark.createDataFrame(data, "id int, status string, started_at timestamp, completed_at timestamp, retry_count int").withColumns(
        {"search_query": F.lit("q"), "location_query": F.lit("l"), "next_retry_at": F.lit(None).cast("timestamp")}
    )
    out = runs.apply_retry_plan(df, NOW)
    got = {r["id"]: r for r in out.where("original_run_id IS NULL").collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "running", 2: "failed", 3: "failed", 4: "completed", 5: "failed", 6: "completed", 7: "failed"}
    assert got[2]["error_message"] == "Run stuck for 3.0h - retry 1/4 scheduled"
    assert got[3]["error_message"] == "Run stuck for 3.0h - permanently failed after 4 attempts" and got[5]["error_message"] == "Run never started properly"
    added = out.where("original_run_id IS NOT NULL")
    keys = {r["id"] for r in added.collect()}
    assert len(keys) == 2 and None not in keys and not keys & set(got)
    assert keys == {r["id"] for r in runs.apply_retry_plan(df, NOW).where("original_run_id IS NOT NULL").collect()}
    assert rows(added, "original_run_id", "retry_count", "status") == [(2, 1, "pending_retry"), (7, 1, "pending_retry")]
    assert rows(runs.due_retries(out, NOW + 5 * h), "original_run_id") == [(2,), (7,)] and runs.due_retries(out, NOW).count() == 0


def test_scrape_windows(spark):
    d = dt.timedelta(days=1)
    scrapes = spark.createDataFrame(
        [(1, "a", "x", "completed", NOW - d / 8), (2, "b", "x", "completed", NOW - 5 * d), (3, "c", "x", "completed", NOW - 60 * d), (4, "d", "x", "failed", NOW)],
        "id int, search_query string, location_query string, status string, completed_at timestamp",
    )
    queries = spark.createDataFrame([(i, q, "x") for i, q in enumerate("abcd")], "id int, search_query string, location_query string")
    got = runs.scrape_windows(queries, scrapes, NOW).orderBy("id").collect()
    assert [(r["window_days"], r["date_range"], r["should_trigger"]) for r in got] == [
        (1, "past_24h", False), (7, "past_week", True), (30, "past_month", True), (30, "past_month", True),
    ]


def test_near_in_time_equals_plain_range_test(spark):
    t0 = dt.datetime(2025, 1, 1)
    points = [(i, t0 + dt.timedelta(seconds=137 * i)) for i in range(300)] + [(1000 + i, t0 + dt.timedelta(seconds=600)) for i in range(200)]
    spans = [(i, t0 + dt.timedelta(seconds=950 * i), t0 + dt.timedelta(seconds=950 * i + 40 * i)) for i in range(40)] + [(99, t0, t0 - dt.timedelta(seconds=1))]
    p = spark.createDataFrame(points, "p int, at timestamp")
    s = spark.createDataFrame(spans, "s int, lo timestamp, hi timestamp")
    expected = sorted((a, b) for a, at in points for b, lo, hi in spans if lo <= at <= hi)
    assert sorted(tuple(r) for r in joins.near_in_time(p, "at", s, "lo", "hi").select("p", "s").collect()) == expected


def test_lifecycle(spark):
    d = dt.timedelta(days=1)
    posts = spark.createDataFrame(
        [(1, True, NOW - 15 * d, None), (2, True, NOW - 13 * d, None), (3, False, NOW - 90 * d, NOW - 70 * d)],
        "id int, is_active boolean, last_seen_at timestamp, detected_inactive_at timestamp",
    )
    marked = lifecycle.mark_inactive(posts, NOW)
    assert rows(marked, "id", "is_active") == [(1, False), (2, True), (3, False)]
    back = lifecycle.reactivate(marked, spark.createDataFrame([(1,), (1,)], "id int"))
    assert rows(back, "id", "is_active") == [(1, True), (2, True), (3, False)]
    assert stats.inactive_summary(marked, NOW).first().asDict() == {"total_inactive": 2, "inactive_last_7_days": 1, "inactive_last_30_days": 1}


def test_rerank_marking(spark):
    old = spark.createDataFrame(
        [(1, "a", True, False), (2, "b", True, False), (3, "c", False, False)], "id int, title string, is_active boolean, needs_ranking boolean"
    ).withColumns({"posted_date": F.lit(NOW), "company_id": F.lit(1), "location_id": F.lit(1)})
    assert rows(lifecycle.mark_for_reranking(old, old), "id", "needs_ranking") == [(1, False), (2, False), (3, False)]
    changed = old.withColumn("title", F.when(F.col("id") == 3, "new").otherwise(F.col("title")))
    assert rows(lifecycle.mark_for_reranking(old, changed), "id", "needs_ranking") == [(1, True), (2, True), (3, True)]
    inserted = old.unionByName(old.where("id = 1").withColumns({"id": F.lit(4), "is_active": F.lit(False)}))
    assert rows(lifecycle.mark_for_reranking(old, inserted), "id", "needs_ranking") == [(1, True), (2, True), (3, False), (4, True)]


def test_company_backlog(spark):
    firms = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    d = dt.timedelta(days=1)
    master = spark.createDataFrame(
        [(2, True, None, None), (3, False, None, None), (4, False, "e", NOW - 2 * d), (5, False, "e", NOW), (6, False, "e", None), (7, None, None, None)],
        "company_id int, ai_enriched boolean, ai_enrichment_error string, ai_enriched_at timestamp",
    )
    assert rows(lifecycle.company_backlog(firms, master, NOW)) == [(1, "new"), (3, "new"), (4, "retry"), (6, "retry"), (7, "new")]
    assert rows(lifecycle.company_backlog(firms, master, NOW, include_retries=False)) == [(1, "new"), (3, "new"), (7, "new")]


def test_search_guards(spark):
    with pytest.raises(ValueError):
        sort_order(Search(sort_field="title; drop table"))
    df = spark.createDataFrame([(i, f"Gent {i:02d}") for i in range(20)], "id int, name string")
    assert [r["id"] for r in suggestions(df, "name", "gENT 1").collect()] == list(range(10, 20))


def test_query_history_by_text(spark):
    queries = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, search_query string, location_query string")
    scrapes = spark.createDataFrame(
        [(1, "a", "x", NOW, "completed", 3), (2, "a", "x", NOW + dt.timedelta(hours=1), "failed", None)],
        "id int, search_query string, location_query string, started_at timestamp, status string, jobs_found int",
    )
    keys = [("search_query", "search_query"), ("location_query", "location_query")]
    got = listings.query_history(queries, scrapes, keys)
    assert rows(got, "id", "last_run_id", "last_run_status", "total_jobs", "run_count") == [(1, 2, "failed", 3, 2), (2, None, None, 0, 0)]
