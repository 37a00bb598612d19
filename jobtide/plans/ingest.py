"""One ingest batch as one plan.

The rows of a batch are meant to be applied in arrival order: a later row sees what an earlier one
wrote. That order is reproduced with aggregates over (key, arrival), never with a sorted window, so a
posting that makes up a third of a batch is pre-aggregated in every task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import location, text
from ..functions.changes import WATCHED, differs
from ..functions.dates import AsOf, instant
from ..session import store_wide
from ..sources import snapshots
from ..operators.ordering import best_row
from ..operators.override import vague_strings
from ..operators.skew import spread_join
from ..operators.lifecycle import RANKING_FIELDS
from ..operators.tables import append_history, insert_ignore, update_from, update_where

TABLES = (
    "companies", "locations", "job_postings", "job_sources", "job_descriptions", "job_posters", "llm_enrichment",
    "job_scrape_history",
)


# Posting columns that a record of the source does not carry, so an update leaves them.
KEPT_ON_UPDATE = {"linkedin": ("source", "indeed_job_id"), "indeed": ()}


@dataclass(frozen=True)
class IngestResult:
    tables: dict[str, DataFrame]
    results: DataFrame  # one row per raw record: arrival, status, job_id, error, has_changes
    added: dict[str, DataFrame]  # of the tables that only gain rows, the new ones
    asks_ranking: DataFrame  # requested_at: one row if all active postings have to be ranked again


def ingest_items(items: DataFrame, source: str, run_id: str, tables: Mapping[str, DataFrame], as_of: AsOf) -> IngestResult:
    """Raw snapshot items -> new table versions. Needs columns ``arrival`` and the item schema."""
    records = snapshots.type_records(snapshots.drop_error_items(items), source)
    valid, invalid = snapshots.split_valid(records, source)
    result = ingest_rows(snapshots.to_ingest_rows(valid, source), source, run_id, tables, as_of)
    errors = invalid.select(
        "arrival", F.lit("error").alias("status"), F.lit(None).cast("string").alias("job_id"),
        F.col("record_error").alias("error"), F.lit(None).cast("boolean").alias("has_changes"),
    )
    return IngestResult(result.tables, result.results.unionByName(errors), result.added, result.asks_ranking)


def _part(tables: Mapping[str, DataFrame], name: str, keys: DataFrame) -> DataFrame:
    """The stored rows that can have one of ``keys``: of growing tables only the buckets these fall into."""
    part = getattr(tables, "part", None)
    return part(name, keys) if part else tables[name]


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Store narrow rows and go on from there. A Parquet table is less than half the size of a checkpoint, and one made inside
    :func:`passing` goes with the batch."""
    return store_wide(rows)


def resolve_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """(rows with ``company_id`` and ``_created``, true for companies that are not stored yet).

    A record with a vendor id matches by that id only. One without matches by name: a stored company
    with a logo, then one with a vendor id, then one created earlier in this batch, then any stored
    one, else a new company.
    """
    by_id = companies.where(F.col("linkedin_company_id").isNotNull()).groupBy("linkedin_company_id").agg(
        F.min("id").alias("_by_id")
    )
    logo = F.coalesce(F.col("has_logo"), F.lit(False))
    known = F.col("linkedin_company_id").isNotNull()
    by_name = best_row(
        companies.select("name", "id", logo.alias("_logo"), known.alias("_known")),
        ["name"],
        [~F.col("_logo"), ~F.col("_known"), F.col("id")],
    ).select("name", F.col("id").alias("_by_name"), "_logo", "_known")
    keyed = rows.withColumns({"linkedin_company_id": F.col("company.linkedin_company_id"), "name": F.col("company.name")})
    named = keyed
    keyed = spread_join(keyed, by_id, ["linkedin_company_id"], "arrival").withColumn(
        "_own_id",
        F.when(
            F.coalesce(F.col("linkedin_company_id"), F.lit("")) != "",
            F.coalesce("_by_id", F.sha2(F.concat(F.lit("id:"), "linkedin_company_id"), 256)),
        ),
    )
    made = F.col("_own_id").isNotNull() & F.col("_by_id").isNull()
    created = keyed.where(made).groupBy("name").agg(
        F.min("arrival").alias("_made_at"), F.min_by("_own_id", "arrival").alias("_made_id")
    )
    first_is_strong = F.coalesce(F.col("_logo") | F.col("_known"), F.lit(False))
    earlier = F.when(F.col("_made_at") < F.col("arrival"), F.col("_made_id"))
    stored = F.when(
        F.col("_own_id").isNull(),
        F.when(first_is_strong | earlier.isNull(), F.col("_by_name")),
    ).otherwise(F.col("_by_id"))
    new_by_name = F.sha2(F.concat(F.lit("name:"), "name"), 256)
    return (
        spread_join(keyed, by_name.join(created, "name", "full_outer"), ["name"], "arrival", keys_from=named)
        .withColumns(
            {
                "company_id": F.coalesce(stored, F.col("_own_id"), earlier, new_by_name),
                "_created": stored.isNull(),
            }
        )
        .select(*rows.columns, "company_id", "_created")
    )


def new_companies(rows: DataFrame) -> DataFrame:
    """One row per new company, from the first record that named it."""
    return (
        rows.where("_created")
        .groupBy(F.col("company_id").alias("id"))
        .agg(F.min_by("company", "arrival").alias("c"))
        .select("id", "c.*", F.lit(False).alias("has_logo"))
    )


def place_rows(rows: DataFrame, companies: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows with company name, ``location_id`` and ``location_id_override``.

    What is known per place string and per company is put together first, so the rows take part in two joins. ``rows`` have their
    ``full_location_string``.
    """
    stored = tables["locations"].groupBy("full_location_string").agg(F.min("id").alias("_id"))
    strings = rows.select("full_location_string").distinct()
    places = strings.join(stored, "full_location_string", "left").select(
        "full_location_string", F.coalesce("_id", F.sha2("full_location_string", 256)).alias("location_id")
    )
    firms = companies.groupBy(F.col("id").alias("company_id")).agg(F.min("name").alias("company_name"))
    master = tables.get("company_master_data")
    if master is None:
        places = places.withColumn("_vague", F.lit(False))
        firms = firms.withColumns({"_seat": F.lit(None).cast("string"), "_seat_id": F.lit(None).cast("string")})
    else:
        vague = vague_strings(strings, "full_location_string", tables.get("vague_locations_config"))
        places = places.join(vague.withColumn("_vague", F.lit(True)), "full_location_string", "left")
        seats = (
            master.where(~text.is_placeholder(F.col("locatie_belgie"))).groupBy("company_id")
            .agg(text.strip(F.concat(F.min("locatie_belgie"), F.lit(", Belgium"))).alias("_seat"))
            .join(stored.withColumnRenamed("full_location_string", "_seat"), "_seat", "left")
            .select("company_id", "_seat", F.coalesce("_id", F.sha2("_seat", 256)).alias("_seat_id"))
        )
        firms = firms.join(seats, "company_id", "left")
    placed = spread_join(rows, places, ["full_location_string"], "arrival")
    placed = spread_join(placed, firms, ["company_id"], "arrival", keys_from=rows)
    return placed.withColumn("location_id_override", F.when(F.col("_vague"), F.col("_seat_id"))).drop("_vague", "_seat_id")


def new_locations(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """The locations that :func:`place_rows` named and that are not stored."""
    own = rows.select("full_location_string", F.col("location_id").alias("id"))
    seats = rows.where(F.col("location_id_override").isNotNull()).select(
        F.col("_seat").alias("full_location_string"), F.col("location_id_override").alias("id")
    )
    columns = location.location_columns(F.col("full_location_string"))
    return (
        own.unionByName(seats).distinct()
        .join(locations.select("full_location_string"), "full_location_string", "left_anti")
        .select("id", *[v.alias(k) for k, v in columns.items()], F.lit(False).alias("ai_enriched"))
    )


def winning_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Per dedup key, the batch row whose data the posting ends up with.

    A row replaces the stored data only when a watched field differs from the state before it, and the
    state always shows the watched fields of the row before. So the final data come from the first row
    after the last row that differed from the final one. ``stored`` has one row per key with the stored
    watched fields (``_old``) and whether this source was known (``_known_source``). ``rows`` need the watched fields of their
    posting only: the result names the row (``_row``) that has the whole posting.
    """
    watched = F.struct(*[F.col(f"posting.{f}") for f in WATCHED])
    spans = rows.groupBy("dedup_key", watched.alias("_watched")).agg(F.max("arrival").alias("_last"))
    # The last two states of each key; a task sends two rows per key to the shuffle, however often the key changed.
    newest = F.row_number().over(W.partitionBy("dedup_key").orderBy(F.desc("_last")))
    states = spans.withColumn("_k", newest).where("_k <= 2")
    final = states.where("_k = 1").select("dedup_key", F.col("_watched").alias("_final"))
    breaks = states.where("_k = 2").select("dedup_key", F.col("_last").alias("_break"))
    tail = spread_join(rows, breaks, ["dedup_key"], "arrival").where(
        F.col("_break").isNull() | (F.col("arrival") > F.col("_break"))
    )
    first = tail.groupBy("dedup_key").agg(
        F.min_by(F.struct("_row", "company_id", "location_id", "location_id_override"), "arrival").alias("_data"),
        F.max("_break").alias("_break"),
    )
    unchanged = (
        F.coalesce(F.col("_known_source"), F.lit(False))
        & F.col("_break").isNull()
        & F.col("_old").eqNullSafe(F.col("_final"))
    )
    return (
        first.join(final, "dedup_key")
        .join(stored, "dedup_key", "left")
        .select("dedup_key", "_data", (~F.coalesce(unchanged, F.lit(False))).alias("_replace"))
    )


def _as_stored(value: Column, name: str, incoming: DataFrame, stored: DataFrame) -> Column:
    """``value`` in the stored column's type; untouched when the types already agree."""
    target = stored.schema[name].dataType
    same = target.simpleString() == incoming.schema[name].dataType.simpleString()
    return value if same else value.cast(target)


def ingest_rows(rows: DataFrame, source: str, run_id: str, tables: Mapping[str, DataFrame], as_of: AsOf) -> IngestResult:
    """Apply typed rows to the tables.

    The rows are stored once as they come. Only their narrow part (keys and watched fields) goes through the
    key joins, and it is stored after each resolution step, because several branches read it. The whole posting is looked up once, for
    the row that wins its key.
    """
    now = instant(as_of)
    frozen = store_wide(rows.withColumn("_row", F.monotonically_increasing_id()))
    watched = F.struct(*[F.col(f"posting.{f}").alias(f) for f in WATCHED])
    place = text.strip(F.col("location_string")).alias("full_location_string")
    narrow = frozen.select("_row", "arrival", "source_job_id", place, "company", watched.alias("posting"))
    rows = cut_lineage(resolve_companies(narrow, tables["companies"]))
    own_companies = new_companies(rows)
    companies = tables["companies"].unionByName(own_companies, allowMissingColumns=True)
    title = F.col("posting.title")
    rows = cut_lineage(
        place_rows(rows.drop("company"), companies, tables).withColumn("dedup_key", text.dedup_key(title, F.col("company_name")))
    )
    own_locations = new_locations(rows, tables["locations"])

    keys = rows.select("dedup_key").distinct()
    postings = _part(tables, "job_postings", keys)
    oldest = F.struct(F.col("created_at"), F.col("id"))
    # Field types are aligned with the incoming ones, so "unchanged" compares like with like.
    incoming = {f: rows.schema["posting"].dataType[f].dataType for f in WATCHED}
    old_watched = F.struct(*[F.col(f).cast(incoming[f]).alias(f) for f in WATCHED])
    found = (
        postings.join(keys, "dedup_key", "left_semi")
        .groupBy("dedup_key")
        .agg(F.min_by(F.struct(F.col("id").alias("id"), old_watched.alias("old")), oldest).alias("_f"))
        .select("dedup_key", F.col("_f.id").alias("_stored_id"), F.col("_f.old").alias("_old"))
    )
    # A new posting's id is the hash of its key, a known one's is stored.
    touched = found.select(F.col("_stored_id").alias("job_posting_id")).union(keys.select(F.sha2("dedup_key", 256)))
    sources = _part(tables, "job_sources", touched)
    sightings = sources.where(F.col("source") == source).select(
        F.col("job_posting_id").alias("_stored_id"), F.lit(True).alias("_known_source")
    ).distinct()
    stored = found.join(sightings, "_stored_id", "left")

    firsts = rows.groupBy("dedup_key").agg(
        F.min("arrival").alias("_first"), F.min_by("source_job_id", "arrival").alias("_source_job_id")
    )
    jobs = cut_lineage(
        firsts.join(winning_rows(rows, stored), "dedup_key")
        .join(stored.select("dedup_key", "_stored_id"), "dedup_key", "left")
        .withColumn("_row", F.col("_data._row"))
        .join(frozen.select("_row", "posting"), "_row")
        .withColumn("id", F.coalesce("_stored_id", F.sha2("dedup_key", 256)))
    )
    data = jobs.select(
        "id", "dedup_key", F.col("_stored_id").isNull().alias("_new"), "_replace",
        text.ingest_title(F.col("posting.title")).alias("title_normalized"),
        "posting.*", "_data.company_id", "_data.location_id", "_data.location_id_override",
    )
    fresh = data.where("_new").drop("_new", "_replace").withColumns(
        {
            "is_active": F.lit(True), "created_at": now, "last_seen_at": now, "needs_ranking": F.lit(True),
            "ranking_position": F.lit(999999),
        }
    )
    changed = data.where(~F.col("_new"))
    kept_on_update = ("id", "_new", "_replace", "dedup_key", *KEPT_ON_UPDATE[source])
    fields = [c for c in data.columns if c not in kept_on_update and c in postings.columns]
    incoming_values = {c: _as_stored(F.col(f"src_{c}"), c, data, postings) for c in fields}
    asks_ranking = F.lit(False)
    for c in RANKING_FIELDS:
        if c in fields:
            asks_ranking = asks_ranking | differs(F.col(c), incoming_values[c])
    updated = update_from(
        postings,
        changed.select("id", "_replace", *fields),
        ["id"],
        {**incoming_values, "needs_ranking": F.when(asks_ranking, True).otherwise(F.col("needs_ranking"))},
        when=F.col("src__replace"),
    )
    # A new posting, or one changed in a ranking field, asks for a new ranking of all active ones.
    stored_values = postings.join(changed.select("id"), "id", "left_semi").select("id", F.struct(*RANKING_FIELDS).alias("_was"))
    was_changed = F.lit(False)
    for c in RANKING_FIELDS:
        if c in fields:
            was_changed = was_changed | differs(F.col(f"_was.{c}"), _as_stored(F.col(c), c, data, postings))
    any_changed = (
        changed.where("_replace").join(stored_values, "id").agg(F.coalesce(F.bool_or(was_changed), F.lit(False))).scalar()
    )
    any_new = jobs.agg(F.coalesce(F.bool_or(F.col("_stored_id").isNull()), F.lit(False))).scalar()
    updated = updated.withColumn(
        "needs_ranking", F.when(F.col("is_active") & (any_new | any_changed), True).otherwise(F.col("needs_ranking"))
    )
    updated = update_from(updated, changed.select("id").withColumn("seen", now), ["id"], {"last_seen_at": F.col("src_seen")})
    job_ids = jobs.select(
        "dedup_key", F.col("id").alias("job_posting_id"), F.col("_stored_id").isNull().alias("_new"), "_first", "_source_job_id", "_replace"
    )

    seen = job_ids.select("job_posting_id").withColumn("source", F.lit(source))
    bumped = update_from(sources, seen.withColumn("at", now), ["job_posting_id", "source"], {"last_seen_at": F.col("src_at")})
    new_sources = job_ids.select(
        "job_posting_id", F.lit(source).alias("source"), F.col("_source_job_id").alias("source_job_id"),
        now.alias("first_seen_at"), now.alias("last_seen_at"),
    )
    opening = job_ids.where("_new").select("job_posting_id", F.col("_first").alias("arrival"))
    descriptions = frozen.select("arrival", "description").join(opening, "arrival").select("job_posting_id", "description.*")
    posters = (
        frozen.where(F.col("poster").isNotNull()).select("arrival", "poster").join(opening, "arrival")
        .select("job_posting_id", "poster.*")
    )
    stubs = opening.select("job_posting_id").withColumn("created_at", now)

    results = (
        spread_join(rows.select("arrival", "dedup_key"), job_ids.drop("_source_job_id"), ["dedup_key"], "arrival", "inner")
        .select(
            "arrival",
            F.when(F.col("_new") & (F.col("arrival") == F.col("_first")), "new").otherwise("updated").alias("status"),
            F.col("job_posting_id").alias("job_id"),
            F.lit(None).cast("string").alias("error"),
            F.col("_replace").alias("has_changes"),
        )
    )
    sighted = results.select(F.col("job_id").alias("job_posting_id"), F.lit(run_id).alias("scrape_run_id"))
    added = {
        "companies": own_companies, "locations": own_locations, "job_descriptions": descriptions, "job_posters": posters, "llm_enrichment": stubs,
        "job_scrape_history": append_history(tables["job_scrape_history"].limit(0), sighted, now),
    }
    return IngestResult(
        {
            "job_postings": updated.unionByName(fresh, allowMissingColumns=True),
            "job_sources": insert_ignore(bumped, new_sources, ["job_posting_id", "source"]),
            **{n: tables[n].unionByName(rows, allowMissingColumns=True) for n, rows in added.items()},
        },
        results, added, keys.select(now.alias("requested_at")).where(any_new | any_changed).limit(1),
    )


def assign_run_type(assignments: DataFrame, results: DataFrame, job_type_id) -> DataFrame:
    """The run's type for every posting seen in it, unless the posting has that type already."""
    new = results.where(F.col("job_id").isNotNull()).select(
        F.col("job_id").cast(assignments.schema["job_posting_id"].dataType).alias("job_posting_id"),
        F.lit(job_type_id).cast(assignments.schema["job_type_id"].dataType).alias("job_type_id"),
        F.lit("scrape").alias("assigned_via"),
    )
    return insert_ignore(assignments, new, ["job_posting_id", "job_type_id"])


def close_run(runs: DataFrame, run_id, results: DataFrame, as_of: AsOf) -> DataFrame:
    """The run completed, with its counts and summary. The errors themselves stay rows of the results."""
    n = batch_summary(results).agg(F.first(F.struct("new_count", "updated_count", "skipped_count", "error_count"))).scalar()
    total = results.agg(F.count("*")).scalar()
    parts = (("New", "new_count"), ("Updated", "updated_count"), ("Skipped", "skipped_count"), ("Errors", "error_count"))
    summary = F.concat_ws(", ", *[F.concat(F.lit(f"{label}: "), n[c].cast("string")) for label, c in parts])
    return update_where(
        runs, F.col("id") == F.lit(run_id),
        {
            "status": "completed", "completed_at": instant(as_of), "jobs_found": total,
            "jobs_new": n["new_count"], "jobs_updated": n["updated_count"],
            "metadata": F.to_json(F.struct(n["error_count"].alias("jobs_error"), summary.alias("batch_summary"))),
        },
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts by status; the per-record outcomes stay in ``results`` as rows."""
    return results.agg(
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "updated").alias("updated_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_distinct("job_id").alias("distinct_jobs"),
    )


def batch_errors(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "error").select("arrival", "error")
