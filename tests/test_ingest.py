"""The batch ingest plan against a loop that applies the records one after another."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtide.plans import ingest
from jobtide.schemas import INDEED_ITEM, LINKEDIN_ITEM
from jobtide.sources import snapshots

NOW = "2025-06-01 10:00:00"
LATER = "2025-06-02 10:00:00"
WATCHED = ("job_title", "job_num_applicants", "job_seniority_level", "job_employment_type", "application_availability")

STORES = {
    "companies": "id string, name string, linkedin_company_id string, company_url string, logo_url string, industry string, has_logo boolean",
    "company_master_data": "company_id string, locatie_belgie string",
    "locations": "id string, full_location_string string, city string, region string, country_code string, ai_enriched boolean",
    "job_postings": """id string, linkedin_job_id string, indeed_job_id string, source string, company_id string, location_id string,
        location_id_override string, title string, title_normalized string, dedup_key string, seniority_level string, employment_type string,
        industries array<string>, function_areas array<string>, posted_date timestamp, posted_time_ago string, num_applicants int,
        base_salary_min double, base_salary_max double, salary_currency string, salary_period string, job_url string, apply_url string,
        application_available boolean, is_active boolean, created_at timestamp, last_seen_at timestamp, needs_ranking boolean, ranking_position int""",
    "job_sources": "job_posting_id string, source string, source_job_id string, first_seen_at timestamp, last_seen_at timestamp",
    "job_descriptions": "job_posting_id string, summary string, full_description_html string, full_description_text string",
    "job_posters": "job_posting_id string, name string, title string, profile_url string",
    "llm_enrichment": "job_posting_id string, created_at timestamp",
    "job_scrape_history": "job_posting_id string, scrape_run_id string, detected_at timestamp",
}


def empty_tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in STORES.items()}


def frame(spark, items, ddl=LINKEDIN_ITEM):
    schema = StructType.fromDDL(ddl).add("arrival", "long")
    return spark.createDataFrame([tuple({"arrival": i, **it}.get(f.name) for f in schema) for i, it in enumerate(items)], schema)


def item(n, title="Data Engineer", company="Tech Corp", **more):
    return {"job_posting_id": str(n), "job_title": title, "company_name": company, "job_location": "Gent, Belgium", "url": f"https://x/{n}", **more}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_new_updated_and_error(spark):
    items = [
        item(1, "Data Engineer"), item(2, " data  ENGINEER "), item(3, "Data Analyst", job_poster=("Jane", "HR", None)),
        {"job_posting_id": "4", "company_name": "X", "job_location": "Y", "url": "u"},
        {"error": "crawl failed", "error_code": "dead_page"}, {**item(6), "url": None, "job_url": "https://alias"},
    ]
    got = ingest.ingest_items(frame(spark, items), "linkedin", "run", empty_tables(spark), NOW)
    results = {r["arrival"]: (r["status"], r["error"]) for r in got.results.collect()}
    assert results == {0: ("new", None), 1: ("updated", None), 2: ("new", None), 3: ("error", "Field 'job_title': Field required"), 5: ("updated", None)}
    assert ingest.batch_summary(got.results).first().asDict() == {
        "new_count": 2, "updated_count": 2, "skipped_count": 0, "error_count": 1, "distinct_jobs": 2,
    }
    assert rows_of(got.tables["job_postings"], "dedup_key") == [("data analyst|tech corp",), ("data engineer|tech corp",)]
    assert got.tables["job_posters"].count() == 1 and got.tables["llm_enrichment"].count() == 2
    assert got.tables["job_scrape_history"].count() == 4 and got.tables["companies"].count() == 1
    assert rows_of(got.tables["job_sources"], "source", "source_job_id") == [("linkedin", "1"), ("linkedin", "3")]


def test_second_run_adds_nothing(spark):
    items = [item(i, f"Job {i % 4}", f"Firm {i % 3}", company_id=str(i % 3) if i % 2 else None, job_location="Belgium") for i in range(20)]
    first = ingest.ingest_items(frame(spark, items), "linkedin", "r1", empty_tables(spark), NOW)
    stored = {**empty_tables(spark), **first.tables}
    again = ingest.ingest_items(frame(spark, items), "linkedin", "r2", stored, LATER)
    assert {r["status"] for r in again.results.collect()} == {"updated"}
    for name in ("companies", "locations", "job_postings", "job_sources", "job_descriptions", "llm_enrichment"):
        assert again.tables[name].count() == first.tables[name].count(), name
    assert again.tables["job_scrape_history"].count() == 40
    keys = again.tables["job_postings"].groupBy("dedup_key").count().where("count > 1").count()
    assert keys == 0
    assert again.tables["job_sources"].agg(F.min("last_seen_at")).first()[0].day == 2
    assert again.tables["job_sources"].agg(F.max("first_seen_at")).first()[0].day == 1


def test_other_source_joins_the_posting(spark):
    first = ingest.ingest_items(frame(spark, [item(1, job_num_applicants=7)]), "linkedin", "r1", empty_tables(spark), NOW)
    indeed = [{"jobid": "in1", "url": "https://i/1", "job_title": "DATA engineer", "company_name": "Tech Corp", "location": "Brugge"}, {"jobid": "in2"}]
    got = ingest.ingest_items(frame(spark, indeed, INDEED_ITEM), "indeed", "r2", {**empty_tables(spark), **first.tables}, LATER)
    assert {(r["status"], r["error"]) for r in got.results.collect()} == {("updated", None), ("error", "Field 'url': Field required")}
    assert rows_of(got.tables["job_sources"], "source", "source_job_id") == [("indeed", "in1"), ("linkedin", "1")]
    row = got.tables["job_postings"].first()
    again = ingest.ingest_items(frame(spark, [item(1, job_num_applicants=9)]), "linkedin", "r3", {**empty_tables(spark), **got.tables}, LATER)
    kept = again.tables["job_postings"].first()
    assert (kept["source"], kept["indeed_job_id"], kept["linkedin_job_id"], kept["num_applicants"]) == ("indeed", "in1", "1", 9)
    assert row["source"] == "indeed" and row["num_applicants"] is None and row["indeed_job_id"] == "in1"
    assert got.tables["job_descriptions"].count() == 1


def test_vague_location_takes_company_seat(spark):
    stores = empty_tables(
        spark, companies=[("c1", "Tech Corp", "77", None, None, None, False)], company_master_data=[("c1", "Leuven")],
        locations=[("l1", "Belgium", "Belgium", None, None, None)],
    )
    items = [item(1, "A", company_id="77", job_location="Belgium"), item(2, "B", company_id="77", job_location="Gent, Belgium")]
    got = ingest.ingest_items(frame(spark, items), "linkedin", "r", stores, NOW)
    places = {r["id"]: r["full_location_string"] for r in got.tables["locations"].collect()}
    shown = {r["title"]: (places[r["location_id"]], places.get(r["location_id_override"])) for r in got.tables["job_postings"].collect()}
    assert shown == {"A": ("Belgium", "Leuven, Belgium"), "B": ("Gent, Belgium", None)}
    assert rows_of(got.tables["companies"], "id") == [("c1",)]


def one_by_one(items, stored_names):
    """Apply records in order; returns statuses, final data per key and the company of each record."""
    companies = [dict(c) for c in stored_names]
    postings, statuses, used = {}, [], []
    for n, it in enumerate(items):
        vendor, name = it.get("company_id"), it["company_name"]
        if vendor:
            hit = next((c for c in companies if c["vendor"] == vendor), None)
        else:
            same = [c for c in companies if c["name"] == name]
            hit = next((c for c in same if c["logo"]), None) or next((c for c in same if c["vendor"]), None) or (same[0] if same else None)
        if hit is None:
            hit = {"key": f"new{n}", "vendor": vendor, "name": name, "logo": False}
            companies.append(hit)
        used.append(hit["key"])
        key = " ".join(it["job_title"].lower().split()) + "|" + hit["name"].lower()
        watched = tuple(it.get(w) for w in WATCHED)
        if key not in postings:
            postings[key] = (watched, it["url"])
            statuses.append("new")
        else:
            if postings[key][0] != watched:
                postings[key] = (watched, it["url"])
            statuses.append("updated")
    return statuses, {k: v[1] for k, v in postings.items()}, used


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    stored = [
        {"key": "s1", "vendor": "v1", "name": "Alpha", "logo": False}, {"key": "s2", "vendor": None, "name": "Alpha", "logo": True},
        {"key": "s3", "vendor": None, "name": "Beta", "logo": False}, {"key": "s4", "vendor": "v4", "name": "Gamma", "logo": False},
    ]
    items = []
    for n in range(120):
        name = rng.choice(["Alpha", "Alpha", "Alpha", "Beta", "Gamma", "Delta", "Epsilon"])
        items.append(
            item(
                n, rng.choice(["Data Engineer", "data  engineer", "Data Analyst"]), name,
                company_id=rng.choice([None, None, "v1", "v4", f"v-{name}"]), job_num_applicants=rng.choice([1, 1, 1, 2, None]),
                job_seniority_level=rng.choice(["S", "S", None]),
            )
        )
    statuses, data, used = one_by_one(items, stored)
    stores = empty_tables(spark, companies=[(c["key"], c["name"], c["vendor"], None, None, None, c["logo"]) for c in stored])
    got = ingest.ingest_items(frame(spark, items), "linkedin", "r", stores, NOW)
    results = [r["status"] for r in got.results.orderBy("arrival").collect()]
    assert results == statuses
    assert {r["dedup_key"]: r["job_url"] for r in got.tables["job_postings"].collect()} == data
    rows = ingest.resolve_companies(
        snapshots.to_ingest_rows(snapshots.type_records(frame(spark, items), "linkedin"), "linkedin"), stores["companies"]
    )
    mine = [r["company_id"] for r in rows.orderBy("arrival").select("company_id").collect()]
    assert len(set(zip(mine, used))) == len(set(mine)) == len(set(used))
    assert got.tables["companies"].count() == len({c["key"] for c in stored} | set(used))


def test_only_keys_and_watched_fields_are_joined(spark, monkeypatch):
    """The rows that go through the key joins do not carry whole postings; the winner of a key gets its posting back."""
    stored, cut = [], ingest.cut_lineage
    monkeypatch.setattr(ingest, "cut_lineage", lambda df: stored.append(df.schema) or cut(df))
    items = [
        item(1, job_num_applicants=1, job_summary="first", apply_link="a1"), item(2, job_num_applicants=2, job_summary="second", apply_link="a2"),
        item(3, job_num_applicants=2, apply_link="a3"), item(4, "Nurse", " Tech Corp", apply_link="a4"),
    ]
    got = ingest.ingest_items(frame(spark, items), "linkedin", "r", empty_tables(spark), NOW)
    assert [set(s["posting"].dataType.names) for s in stored[:2]] == [set(ingest.WATCHED)] * 2
    assert "company" not in stored[1].names
    # The second record changed the posting, the third did not; its whole posting is kept, the description is that of the first.
    shown = rows_of(got.tables["job_postings"].where("title = 'Data Engineer'"), "linkedin_job_id", "apply_url", "num_applicants", "job_url")
    assert shown == [("2", "a2", 2, "https://x/2")]
    assert [r[0] for r in rows_of(got.tables["job_descriptions"].where("summary IS NOT NULL"), "summary")] == ["first"]


def test_repeated_arrivals_keep_one_posting(spark):
    """Rows that come twice under one arrival number are told apart: their key has one posting."""
    twice = frame(spark, [item(1, apply_link="a")]).unionByName(frame(spark, [item(1, apply_link="a")]))
    got = ingest.ingest_items(twice, "linkedin", "r", empty_tables(spark), NOW)
    assert rows_of(got.tables["job_postings"], "linkedin_job_id", "apply_url") == [("1", "a")]


def test_snapshot_files(spark, tmp_path):
    array = tmp_path / "array.json"
    array.write_text('[{"job_posting_id":"1","job_title":"T","company_name":"C","job_location":"L","url":"u"},\n {"error":"x","error_code":"y"}]')
    items = snapshots.read_snapshot(spark, str(array), "linkedin")
    assert snapshots.item_counts(items).first().asDict() == {"jobs": 1, "errors_filtered": 1}
    older = tmp_path / "older.json"
    older.write_text('{"job_id":"9","title":"Old names","company":"C","location":"L"}')
    _, bad = snapshots.split_valid(snapshots.type_records(snapshots.read_snapshot(spark, str(older), "linkedin"), "linkedin"), "linkedin")
    assert [r["record_error"] for r in bad.collect()] == ["Field 'job_posting_id': Field required"]
    with pytest.raises(ValueError):
        snapshots.type_records(items, "other")


def test_salary_struct_wins(spark):
    items = [item(1, base_salary=("EUR", 1.0, 2.0, "mo"), job_base_pay_range="$5/hr - $6/hr"), item(2, job_base_pay_range="$5/hr - $6/hr")]
    valid, _ = snapshots.split_valid(snapshots.type_records(frame(spark, items), "linkedin"), "linkedin")
    columns = snapshots.posting_columns("linkedin")
    got = valid.orderBy("arrival").select(columns["salary_currency"].alias("c"), columns["base_salary_min"].alias("m")).collect()
    assert [tuple(r) for r in got] == [("EUR", 1.0), ("$", 5.0)]
