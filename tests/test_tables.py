"""Table mutation, versions and commits, CSV, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.functions import text
from jobtide.operators import sinks, tables
from jobtide.sources import company_csv

NOW = "2025-06-01 10:00:00"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a", "e"), (2, "b", "e")], "k int, v string, err string")
    new = spark.createDataFrame([(1, None, None), (3, "c", None)], "k int, v string, err string")
    assert rows(tables.upsert(old, new, ["k"], ("err",))) == [(1, "a", None), (2, "b", "e"), (3, "c", None)]


def test_insert_ignore_takes_first_of_new(spark):
    old = spark.createDataFrame([(1, "s", "old")], "k int, s string, v string")
    new = spark.createDataFrame([(1, "s", "x"), (2, "s", "b"), (2, "s", "a")], "k int, s string, v string")
    got = tables.insert_ignore(old, new, ["k", "s"], first_by=[F.col("v")])
    assert rows(got) == [(1, "s", "old"), (2, "s", "a")]
    assert rows(tables.insert_ignore(got, new, ["k", "s"])) == rows(got)


def test_get_or_create_is_repeatable(spark):
    dim = spark.createDataFrame([("7", "SQL")], "id string, name string")
    wanted = spark.createDataFrame([("SQL",), ("dbt",), ("dbt",), (None,)], "name string")
    grown, mapping = tables.get_or_create(dim, wanted, "name", "id")
    again, mapping2 = tables.get_or_create(grown, wanted, "name", "id")
    assert grown.count() == 2 and rows(again) == rows(grown) and rows(mapping, "name", "id") == rows(mapping2, "name", "id")


def test_update_and_patch(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", None)], "k int, v string, ok boolean")
    assert rows(tables.update_where(df, F.col("ok"), {"v": "z", "ok": F.lit(None)})) == [(1, "z", None), (2, "b", None)]
    changes = spark.createDataFrame([(1, "n"), (2, None), (9, "x")], "k int, v string")
    assert rows(tables.patch(df, changes, "k"), "k", "v") == [(1, "n"), (2, "b")]
    assert rows(tables.remap(df, "v", {"a": "c"}), "k", "v") == [(1, "c"), (2, "b")]
    filled = tables.fill_from(df.withColumn("w", F.when(F.col("k") == 1, "w")), "w", "v", drop_origin=True)
    assert rows(filled, "k", "w") == [(1, "w"), (2, "b")]


def test_retire_or_delete(spark):
    types = spark.createDataFrame([(1, True), (2, True), (3, True)], "id int, is_active boolean")
    refs = spark.createDataFrame([(1,), (3,)], "t int")
    doomed = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(tables.retire_or_delete(types, refs, doomed, "id", "t")) == [(1, False), (3, True)]


def test_retention_keeps_children_of_kept(spark):
    posts = spark.sql("SELECT * FROM VALUES (1, timestamp'2025-01-01'), (2, timestamp'2024-01-01'), (3, NULL) AS t(id, posted_date)")
    kids = spark.createDataFrame([(1,), (2,), (3,), (2,)], "job_posting_id int")
    kept, children = tables.retain_since(posts, {"k": kids}, F.lit("2024-06-01").cast("timestamp"))
    assert rows(kept, "id") == [(1,), (3,)] and rows(children["k"]) == [(1,), (3,)]


COMPANIES = [(1, "Alpha", "48256"), (2, "Beta", "77"), (3, "Gamma", None)]


def test_csv_import_and_export(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "LinkedIn Company ID;Company Name;Company Number;Industry;Founded Year;Website\n"
        "48256.0;Alpha;BE1;IT;c. 1999;\n;Nobody;;IT;;\n999;Unknown;;IT;;\n77;Beta;;;;\n77;Beta;;Retail;;www.beta.example\n"
    )
    companies = spark.createDataFrame(COMPANIES, "id int, name string, linkedin_company_id string")
    master = spark.createDataFrame([(10, 1, "Old", True)], "id int, company_id int, industry string, ai_enriched boolean")
    classified = company_csv.classify_import(company_csv.read_company_csv(spark, str(path), sep=";"), companies, master)
    assert company_csv.import_stats(classified).first().asDict() == {
        "total_rows": 5, "skipped_rows": 2, "companies_found": 3, "companies_not_found": 1, "master_data_created": 1, "master_data_updated": 1,
    }
    after = company_csv.apply_import(classified, master)
    assert sorted(tuple(r) for r in after.select("company_id", "industry", "founded_year", "website").collect()) == [
        (1, "IT", 1999, None), (2, "Retail", None, "www.beta.example"),
    ]
    out = str(tmp_path / "out")
    company_csv.write_export(company_csv.export_rows(companies, after), out)
    back = spark.read.csv(out, header=True)
    assert back.columns == [h for h, _ in company_csv.EXPORT_COLUMNS]
    assert [(r["Company Name"], r["AI Enriched"], r["Industry"]) for r in back.orderBy("Company Name").collect()] == [
        ("Alpha", "Yes", "IT"), ("Beta", "No", "Retail"), ("Gamma", "No", None),
    ]
    assert [r["Company Name"] for r in company_csv.export_rows(companies, after, "ET").collect()] == ["Beta"]


def test_job_results(spark):
    enrichment = spark.createDataFrame(
        [("a", None, None, None, "old error", None), ("b", "Old", ["x"], None, None, None), ("c", "Keep", None, None, None, None)],
        "job_posting_id string, type_datarol string, must_have_programmeertalen array<string>, enrichment_completed_at timestamp, enrichment_error string, labels string",
    )
    posts = spark.createDataFrame([("a", False), ("b", False), ("z", False)], "id string, needs_ranking boolean")
    good = json.dumps({"data_role_type": "Data Engineer", "must_have_languages": ["Python"], "labels": {"nl": {"seniority": ["Senior"]}}})
    results = spark.createDataFrame([("a", good), ("b", "{broken"), ("z", good)], "job_posting_id string, payload string")
    saved, marked = sinks.save_job_results(enrichment, posts, results, "payload", "v18", NOW)
    got = {r["job_posting_id"]: r for r in saved.collect()}
    assert got["a"]["type_datarol"] == "Data Engineer" and got["a"]["must_have_programmeertalen"] == ["Python"]
    assert got["a"]["enrichment_error"] is None and got["a"]["enrichment_completed_at"] is not None
    assert got["b"]["type_datarol"] == "Old" and got["b"]["must_have_programmeertalen"] == ["x"] and got["b"]["enrichment_error"]
    assert got["c"]["type_datarol"] == "Keep" and got["c"]["enrichment_completed_at"] is None
    assert rows(marked) == [("a", True), ("b", False), ("z", False)]


def test_company_result_versions(spark):
    payloads = [
        {"maturity_en": "Scale-up", "website": "w", "hiring_model": "direct"}, {"maturity": {"category_en": "SME", "confidence": 0.5}, "locatie_belgie": "Gent"},
        {"category": {"en": "Corporate"}, "website": "", "bedrijfswebsite": "b"}, {"category_en": "Startup", "factlets": [{"category": "x"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "company_id int, payload string")
    got = [r for r in sinks.company_result_columns(df, "payload", NOW).orderBy("company_id").collect()]
    assert [r["size_category"] for r in got] == ["Scale-up", "SME", "Corporate", "Startup"]
    assert [r["bedrijfswebsite"] for r in got] == ["w", None, "b", None]
    assert got[1]["size_confidence"] == 0.5 and got[3]["weetjes"] == '[{"category":"x"}]'
    master = spark.createDataFrame([(0, "Old site", "err")], "company_id int, bedrijfswebsite string, ai_enrichment_error string")
    failed = sinks.save_company_errors(master, spark.createDataFrame([(0, "boom")], "company_id int, error string"), NOW)
    assert rows(failed, "company_id", "bedrijfswebsite", "ai_enrichment_error") == [(0, "Old site", "boom")]


def test_size_labels_leave_unknown_alone(spark):
    df = spark.createDataFrame(
        [("sme", None, "Mine", None), ("Scale-up", None, None, None), (None, None, None, None)],
        "size_category string, category_nl string, category_en string, category_fr string",
    )
    assert [tuple(r) for r in sinks.label_sizes(df).collect()] == [("sme", "KMO", "Mine", "PME"), ("Scale-up", None, None, None), (None, None, None, None)]


def test_classifier_text(spark):
    df = spark.sql(
        "SELECT 'Alpha' AS n, '' AS w, 'IT' AS s, NULL AS e, '' AS nl, 'Builds' AS en, "
        "array(named_struct('category','hq','text_nl','Zetel in Gent','text_en','x'), named_struct('category',NULL,'text_nl','','text_en','Old')) AS f, array('a','b') AS k"
    )
    c = F.col
    got = df.select(text.classifier_text(c("n"), c("w"), c("s"), c("e"), c("nl"), c("en"), c("f"), c("k"))).first()[0]
    assert got == "Company: Alpha\nSector: IT\nDescription: Builds\nFacts: [hq] Zetel in Gent | [] Old\nKey facts: a | b"


def test_one_row_per_key(spark):
    from pyspark.sql import functions as F

    from jobtide.operators import tables

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "n", 5), (3, "o", 4)], "id int, v string, at int")
    last = [F.col("at")]
    want = {(1, "y"), (2, "b"), (3, "n")}
    assert sorted(map(tuple, tables.upsert(old, new, ["id"], last_by=last).collect())) == sorted(want)
    got = tables.update_from(old, new, ["id"], {"v": F.col("src_v")}, last_by=last).collect()
    assert sorted(map(tuple, got)) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, tables.patch(old, new, "id", last_by=last).collect())) == [(1, "y"), (2, "b")]
    assert tables.upsert(old, new, ["id"]).count() == 3


def test_arrival_follows_file_time_and_name(spark, tmp_path):
    import os

    from jobtide.sources.snapshots import read_snapshot

    for order in ((1, 5, 50), (50, 5, 1)):
        folder = tmp_path / f"landing{order[0]}"
        folder.mkdir()
        n = 0
        for i, rows in enumerate(order):
            path = folder / f"{i:02d}.json"
            path.write_text("\n".join(f'{{"job_posting_id": "{n + k:04d}"}}' for k in range(rows)))
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
            n += rows
        got = read_snapshot(spark, str(folder), "linkedin", lines=True).orderBy("arrival").collect()
        assert [r["job_posting_id"] for r in got] == [f"{k:04d}" for k in range(n)]
        assert len({r["arrival"] for r in got}) == n
