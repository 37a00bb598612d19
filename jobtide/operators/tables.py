"""Table mutation as pure functions: (old table, change) -> new table.

Plain Parquet has no in-place update, so each operator returns the full next table. Tables that grow by batches are in
module ``growing``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose key equals ``value`` (0 or 1 row for a unique key)."""
    return df.where(F.col(column) == F.lit(value))


def lookup_many(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The bulk form of :func:`lookup`: one join for all keys."""
    return keys.join(table, on, "left")


def last_per_key(df: DataFrame, keys: list[str], last_by: list[Column] | None = None) -> DataFrame:
    """One row per key: the last by ``last_by``; without an order, one that a hash of the row decides, the same in every run."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = F.struct(*(last_by or []), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_nulls: tuple[str, ...] = (), last_by: list[Column] | None = None) -> DataFrame:
    """Insert new keys, update known ones. A null in ``new`` keeps the old value, except in the
    columns ``keep_nulls``, where null overwrites. Columns that ``new`` lacks stay as they are. Of several new rows of a key the
    last one counts (:func:`last_per_key`)."""
    o, n = old.alias("o"), last_per_key(new, keys, last_by).withColumn("_hit", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    columns = []
    for c in old.columns:
        if c in keys:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        elif c not in new.columns:
            value = F.col(f"o.{c}")
        elif c in keep_nulls:
            value = F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        else:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        columns.append(value.alias(c))
    return o.join(n, on, "full_outer").select(*columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], first_by: list[Column] | None = None) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key is not there yet; one row per key.

    ``first_by`` decides which of several new rows with one key is kept (smallest wins).
    """
    row = F.struct(*[F.col(c) for c in new.columns])
    pick = F.min_by(row, F.struct(*first_by)) if first_by else F.min(row)
    fresh = new.groupBy(*keys).agg(pick.alias("_row")).select("_row.*").join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def get_or_create(dim: DataFrame, wanted: DataFrame, natural: str, key: str, defaults: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Dimension rows for every distinct ``natural`` value in ``wanted``.

    Returns (dimension with the missing rows added, mapping natural -> key). New keys are a hash of
    the natural value, so a repeated run creates the same keys.
    """
    names = wanted.select(natural).where(F.col(natural).isNotNull()).distinct()
    known = dim.groupBy(natural).agg(F.min(key).alias(key))
    missing = names.join(known, natural, "left_anti").withColumn(key, F.sha2(F.col(natural), 256))
    for column, value in (defaults or {}).items():
        missing = missing.withColumn(column, value)
    mapping = known.join(names, natural, "left_semi").unionByName(missing.select(natural, key))
    return dim.unionByName(missing, allowMissingColumns=True), mapping


def update_where(df: DataFrame, predicate: Column, values: Mapping[str, object]) -> DataFrame:
    """Set columns on the rows where ``predicate`` is true (null counts as false)."""
    hit = F.coalesce(predicate, F.lit(False))
    as_column = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    return df.withColumns(
        {
            c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) if c in df.columns else F.when(hit, v)
            for c, v in as_column.items()
        }
    )


def reset_columns(df: DataFrame, predicate: Column, columns: list[str], **fixed: object) -> DataFrame:
    """Null a group of columns, and set ``fixed`` ones, where ``predicate`` holds."""
    return update_where(df, predicate, {**{c: F.lit(None) for c in columns}, **fixed})


def update_from(df: DataFrame, source: DataFrame, on: list[str], set_columns: dict[str, Column], when: Column | None = None,
                last_by: list[Column] | None = None) -> DataFrame:
    """UPDATE ... FROM: columns of ``source`` (its last row per ``on``) feed ``set_columns``; rows without a
    match, or where ``when`` is not true, keep their values."""
    extra = [c for c in source.columns if c not in on]
    marked = last_per_key(source, on, last_by).select(*on, *[F.col(c).alias(f"src_{c}") for c in extra]).withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit") & (when if when is not None else F.lit(True)), F.lit(False))
    joined = df.join(marked, on, "left")
    return joined.select(
        *[F.when(hit, set_columns[c]).otherwise(F.col(c)).alias(c) if c in set_columns else F.col(c) for c in df.columns],
        *[F.when(hit, v).alias(c) for c, v in set_columns.items() if c not in df.columns],
    )


def remap(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed values of a column; others stay."""
    value = F.col(column)
    for old, new in mapping.items():
        value = F.when(F.col(column) == old, new).otherwise(value)
    return df.withColumn(column, value)


def fill_from(df: DataFrame, target: str, origin: str, drop_origin: bool = False) -> DataFrame:
    """Copy ``origin`` into ``target`` where ``target`` is null."""
    filled = df.withColumn(target, F.coalesce(F.col(target), F.col(origin)))
    return filled.drop(origin) if drop_origin else filled


def patch(base: DataFrame, changes: DataFrame, key: str, last_by: list[Column] | None = None) -> DataFrame:
    """Partial update: only non-null supplied fields win; unknown keys are not inserted. Of several changes of a key the
    last one counts."""
    fields = [c for c in changes.columns if c != key]
    renamed = last_per_key(changes, [key], last_by).select(key, *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def retain_since(postings: DataFrame, children: Mapping[str, DataFrame], cutoff: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete postings older than ``cutoff`` and their child rows. A null date is not older."""
    kept = postings.where(F.coalesce(F.col("posted_date") >= cutoff, F.lit(True)))
    ids = kept.select(F.col("id").alias("job_posting_id"))
    return kept, {n: c.join(ids, "job_posting_id", "left_semi") for n, c in children.items()}


def retention_report(postings: DataFrame, children: Mapping[str, DataFrame], cutoff: Column) -> DataFrame:
    """Rows before and after :func:`retain_since`, one line per table."""
    kept, kept_children = retain_since(postings, children, cutoff)

    def line(name: str, was: DataFrame, now: DataFrame) -> DataFrame:
        counts = was.agg(F.count("*").alias("rows_before")).withColumn("rows_after", now.agg(F.count("*")).scalar())
        return counts.select(
            F.lit(name).alias("table_name"), "rows_before", "rows_after",
            (F.col("rows_before") - F.col("rows_after")).alias("rows_deleted"),
        )

    report = line("job_postings", postings, kept)
    for name, child in children.items():
        report = report.unionByName(line(name, child, kept_children[name]))
    return report


def drop_childless(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")


def childless(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def retire_or_delete(parents: DataFrame, references: DataFrame, doomed: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Remove the ``doomed`` parents that nothing refers to; deactivate those in use."""
    counts = references.groupBy(F.col(ref_key).alias(key)).agg(F.count("*").alias("_refs"))
    marked = parents.join(counts, key, "left").join(doomed.select(key).distinct().withColumn("_doomed", F.lit(True)), key, "left")
    used = F.coalesce(F.col("_refs"), F.lit(0)) > 0
    kept = marked.where(F.col("_doomed").isNull() | used)
    return kept.withColumn("is_active", F.when(F.col("_doomed"), False).otherwise(F.col("is_active"))).select(*parents.columns)


def append_history(history: DataFrame, seen: DataFrame, detected_at: Column) -> DataFrame:
    """One row per (posting, run) sighting, stamped with one instant."""
    rows = seen.select("job_posting_id", "scrape_run_id").withColumn("detected_at", detected_at)
    return history.unionByName(rows, allowMissingColumns=True)

