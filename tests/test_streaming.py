"""Streams: landed files are applied once, and streamed results equal batch results."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_ingest import NOW, empty_tables, item

from jobtide import session
from jobtide.operators import growing, lifecycle
from jobtide.streaming import ingest, sightings


def land(folder, name, items):
    (folder / name).write_text(json.dumps(items))


def test_landed_files_are_applied_once(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    landing.mkdir()
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    store = ingest.posting_store(spark, root, 8)
    ingest.fill_store(store, empty_tables(spark))
    land(landing, "one.json", [item(1, "A"), item(2, "a "), {"job_title": "no id"}])
    ingest.ingest_landed(spark, str(landing), "linkedin", store, checkpoint, NOW)
    ingest.ingest_landed(spark, str(landing), "linkedin", store, checkpoint, NOW)
    assert store["ingest_results"].count() == 3
    land(landing, "two.json", [item(3, "A"), item(4, "B")])
    # The batch fails once everything is staged and part of it is in place; Spark repeats it.
    whole = growing.GrowingTables._put
    done = []

    def put(self, name, *more):
        done.append(name)
        if len(done) == 4:
            raise OSError("lost")
        return whole(self, name, *more)

    monkeypatch.setattr(growing.GrowingTables, "_put", put)
    with pytest.raises(StreamingQueryException):
        ingest.ingest_landed(spark, str(landing), "linkedin", store, checkpoint, NOW)
    monkeypatch.setattr(growing.GrowingTables, "_put", whole)
    ingest.ingest_landed(spark, str(landing), "linkedin", store, checkpoint, NOW)
    assert sorted(r["dedup_key"] for r in store["job_postings"].collect()) == ["a|tech corp", "b|tech corp"]
    assert store["job_scrape_history"].count() == 4 and store["companies"].count() == 1
    assert sorted(r["status"] for r in store["ingest_results"].collect()) == ["error", "new", "new", "updated", "updated"]
    ranked = store["job_postings"].withColumns({"needs_ranking": F.lit(False), "ranking_updated_at": F.lit(None).cast("timestamp")})
    assert all(r["needs_ranking"] for r in lifecycle.apply_ranking_requests(ranked, store["ranking_requests"]).collect())
    later = ranked.withColumn("ranking_updated_at", F.lit("2030-01-01").cast("timestamp"))
    assert not any(r["needs_ranking"] for r in lifecycle.apply_ranking_requests(later, store["ranking_requests"]).collect())


def test_seen_table_over_two_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    checkpoint = str(tmp_path / "cp")
    rows = "SELECT * FROM VALUES ('a', timestamp'2025-01-0{0}'), ('b', timestamp'2025-01-0{1}'), (NULL, timestamp'2025-01-0{1}') AS t(k, ts)"
    store = None
    for low, high in ((3, 4), (1, 9)):
        batch = spark.sql(rows.format(low, high))
        batch.write.mode("append").parquet(source)
        stream = sightings.file_stream(spark, source, batch.schema, "*.parquet")
        store = store or sightings.seen_store(spark, str(tmp_path / "seen"), ["k"], batch.schema)
        sightings.keep_seen_table(stream, ["k"], "ts", store, checkpoint)
    got = {r["k"]: (r["first_seen_at"].day, r["last_seen_at"].day) for r in store["seen"].collect()}
    assert got == {"a": (1, 3), "b": (4, 9), None: (4, 9)}


def test_windows_slide(spark):
    df = spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS ts, 'ok' AS s UNION ALL SELECT timestamp'2025-01-01 01:10:00', 'ok'")
    got = sightings.run_window_counts(df, "ts", df["s"], "2 hours", "1 hour").orderBy("window_start").collect()
    assert [r["runs"] for r in got] == [1, 2, 1]


def left_over(spark):
    """Stored tables and checkpoints below the shared folder."""
    root = session.checkpoint_root(spark).removeprefix("file:")
    own = session._own_folder(spark).removeprefix("file:")
    tables = os.listdir(own) if os.path.isdir(own) else []
    return set(tables) | {x for x in os.listdir(root) if x.startswith("rdd-")}


def test_a_batch_leaves_its_tables_only(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    root = str(tmp_path / "store")
    store = ingest.posting_store(spark, root, 8)
    before = left_over(spark)
    ingest.fill_store(store, empty_tables(spark))
    for i in range(3):
        land(landing, f"{i}.json", [item(2 * i, "A"), item(2 * i + 1, f"B{i}")])
    ingest.ingest_landed(spark, str(landing), "linkedin", store, str(tmp_path / "checkpoint"), NOW, files_per_batch=1)
    assert store["job_postings"].count() == 4 and store["ingest_results"].count() == 6
    assert left_over(spark) == before
