"""Stored helpers of reads: time sweeps, text indexes, ordered pages and daily figures, built from the whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import sweep
from ..operators.keyset import Key, KeysetPages
from ..operators.ordering import global_position
from ..operators.partials import DailyFigures, Figures, changed
from ..operators.textindex import TextIndex
from ..plans import joins
from ..session import cut_lineage
from .q_effects import _folder
from .registry import query, ts

_SPANS = """
SELECT id AS run_id, started_at - INTERVAL 1 MINUTE AS lo, coalesce(completed_at, started_at + INTERVAL 10 MINUTE) + INTERVAL 1 MINUTE AS hi
FROM @scrape_runs WHERE started_at IS NOT NULL"""


def _points(t):
    return t["events"].select("event_id", "ts")


@query("events_with_run_counts", "J14", f"""
WITH s AS ({_SPANS.strip()}), o AS (SELECT e.event_id, count(*) AS n FROM @events e JOIN s ON e.ts BETWEEN s.lo AND s.hi GROUP BY 1)
SELECT e.event_id, coalesce(o.n, 0) AS spans_open FROM @events e LEFT JOIN o USING (event_id)""")
def events_with_run_counts(t):
    """Every event with the number of runs it lies near to: all runs at once."""
    return sweep.covering_counts(_points(t), "ts", "event_id", joins.run_spans(t["scrape_runs"]), "span_lo", "span_hi").select("event_id", "spans_open")


@query("events_inside_runs", "J14", f"""
WITH s AS ({_SPANS.strip()}) SELECT s.run_id, count(e.event_id) AS points_inside FROM s LEFT JOIN @events e ON e.ts BETWEEN s.lo AND s.hi GROUP BY 1""")
def events_inside_runs(t):
    """Every run with the number of events near it."""
    return sweep.covered_counts(joins.run_spans(t["scrape_runs"]), "run_id", "span_lo", "span_hi", _points(t), "ts").select("run_id", "points_inside")


@query("runs_of_busiest_event", "J14", f"""
WITH s AS ({_SPANS.strip()}), b AS (SELECT e.event_id, e.ts FROM @events e JOIN s ON e.ts BETWEEN s.lo AND s.hi GROUP BY 1, 2 ORDER BY count(*) DESC, e.event_id LIMIT 1)
SELECT b.event_id, s.run_id FROM b JOIN s ON b.ts BETWEEN s.lo AND s.hi""")
def runs_of_busiest_event(t):
    """The runs near the event that has most of them, named by its two counts."""
    spans = joins.run_spans(t["scrape_runs"])
    counted = sweep.covering_counts(_points(t), "ts", "event_id", spans, "span_lo", "span_hi")
    busiest = cut_lineage(counted.orderBy(F.col("spans_open").desc(), "event_id").limit(1))
    numbered = sweep.numbered_spans(spans, "run_id", "span_lo", "span_hi")
    started, ended, event = (busiest.select(c).scalar() for c in ("spans_started", "spans_ended", "event_id"))
    return numbered.where(sweep.covers(started, ended)).select(event.alias("event_id"), "run_id")


def _indexed(t, table, column):
    made = TextIndex(t.spark, _folder(t, f"{table}-text"))
    made.store(t[table], "id", column)
    return made


@query("title_index_search", "P2 P4", "SELECT id, title AS text FROM @job_postings WHERE title ILIKE '%l%engin%'")
def title_index_search(t):
    """Postings by a part of their title with a wildcard, from the trigram lists."""
    return _indexed(t, "job_postings", "title").search("l%engin")


@query("company_index_search", "P29 P31", "SELECT id, name AS text FROM @companies WHERE name ILIKE '%p 10%'")
def company_index_search(t):
    return _indexed(t, "companies", "name").search("P 10")


@query("place_index_search", "P5 P29", "SELECT id, full_location_string AS text FROM @locations WHERE full_location_string ILIKE '%nl%'")
def place_index_search(t):
    """A needle of two characters, which is shorter than a trigram."""
    return _indexed(t, "locations", "full_location_string").search("NL")


_BY_DATE = [Key("posted_date", True), Key("id")]


def _ordered(t):
    rows = t["job_postings"].where("is_active").select("id", "posted_date", "title")
    pages = KeysetPages(t.spark, _folder(t, "postings-by-date"), _BY_DATE)
    pages.store(rows)
    return rows, pages


@query("keyset_deep_page", "O2 O6", f"""
SELECT id, title, {ts('posted_date')} FROM @job_postings WHERE is_active ORDER BY posted_date DESC NULLS LAST, id
LIMIT 50 OFFSET (SELECT count(*) // 2 FROM @job_postings WHERE is_active)""")
def keyset_deep_page(t):
    """The page behind the middle posting, newest first."""
    rows, pages = _ordered(t)
    placed = global_position(rows.select("id", "posted_date"), [k.order for k in _BY_DATE], "place")
    middle = placed.where(F.col("place") == F.lit(rows.count() // 2))
    return pages.page(50, pages.token(middle))


@query("keyset_page_of_nulls", "O2 O6", f"""
SELECT id, title, {ts('posted_date')} FROM @job_postings WHERE is_active AND posted_date IS NULL
AND id > (SELECT min(id) FROM @job_postings WHERE is_active AND posted_date IS NULL) ORDER BY id LIMIT 50""")
def keyset_page_of_nulls(t):
    """A page among the postings without a date, which come last."""
    rows, pages = _ordered(t)
    first = rows.where("posted_date IS NULL").agg(F.min("id")).first()[0]
    return pages.page(50, None if first is None else json.dumps([None, str(first)]))


_POSTING_FIGURES = Figures(
    "to_date(created_at)",
    {"total_jobs": "true", "active_jobs": "is_active", "data_jobs": "title_classification = 'Data'", "ranked_jobs": "ranking_position IS NOT NULL"},
    {"firms": "company_id"}, {"pay": "base_salary_min"},
)


@query("dashboard_from_partials", "A1 A2", """
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total_jobs, count(*) FILTER (WHERE is_active AND id % 6 <> 0) AS active_jobs,
 count(*) FILTER (WHERE title_classification = 'Data') AS data_jobs, count(*) FILTER (WHERE ranking_position IS NOT NULL) AS ranked_jobs
FROM @job_postings GROUP BY 1""")
def dashboard_from_partials(t):
    """Daily figures of two loads, one per source, and of a change: every sixth posting is closed."""
    jobs = t["job_postings"]
    kept = DailyFigures(t.spark, _folder(t, "posting-figures"), _POSTING_FIGURES)
    kept.start(jobs.where("source = 'linkedin'"))
    kept.add("second-load", jobs.where("source <> 'linkedin'"))
    closed = jobs.where("id % 6 = 0")
    kept.add("closed", changed(closed, closed.withColumn("is_active", F.lit(False))))
    return kept.by_day().select(F.date_format("day", "yyyy-MM-dd").alias("day"), *_POSTING_FIGURES.counts)


_SIZE_FIGURES = Figures(
    "to_date(ai_enriched_at)",
    {"total": "true", "classified": "size_category IS NOT NULL", "failed": "size_enrichment_error IS NOT NULL",
     "pending": "size_category IS NULL AND size_enrichment_error IS NULL", "enriched": "ai_enriched"},
)


@query("size_stats_from_partials", "A4 A5", """
SELECT count(*) AS total, count(size_category) AS classified, count(size_enrichment_error) AS failed,
 count(*) FILTER (WHERE size_category IS NULL AND size_enrichment_error IS NULL) AS pending, count(*) FILTER (WHERE ai_enriched) AS enriched FROM @company_master_data""")
def size_stats_from_partials(t):
    """Size classification over all master rows, which arrived as rows with and without an answer."""
    rows = t["company_master_data"]
    kept = DailyFigures(t.spark, _folder(t, "size-figures"), _SIZE_FIGURES)
    kept.start(rows.limit(0))
    kept.add("answered", rows.where("ai_enriched IS NOT NULL"))
    kept.add("open", rows.where("ai_enriched IS NULL"))
    return kept.total()
