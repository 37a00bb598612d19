"""Deletions that carry on to the rows that refer to the deleted ones, along a declared graph of references."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .sizing import sized_join


@dataclass(frozen=True)
class Reference:
    """``child.column`` holds the ``key`` of ``parent``. A child goes with its parent, or with ``clears`` only loses the value."""

    child: str
    column: str
    parent: str
    key: str = "id"
    clears: bool = False


# What the tables refer to and what becomes of a row whose parent is deleted.
REFERENCES = (
    Reference("job_sources", "job_posting_id", "job_postings"),
    Reference("job_descriptions", "job_posting_id", "job_postings"),
    Reference("job_posters", "job_posting_id", "job_postings"),
    Reference("llm_enrichment", "job_posting_id", "job_postings"),
    Reference("job_scrape_history", "job_posting_id", "job_postings"),
    Reference("job_type_assignments", "job_posting_id", "job_postings"),
    Reference("job_programming_languages", "job_posting_id", "job_postings"),
    Reference("job_ecosystems", "job_posting_id", "job_postings"),
    Reference("job_postings", "company_id", "companies"),
    Reference("company_master_data", "company_id", "companies"),
    Reference("job_type_assignments", "job_type_id", "job_types"),
    Reference("search_queries", "job_type_id", "job_types", clears=True),
    Reference("scrape_runs", "job_type_id", "job_types", clears=True),
    Reference("scrape_runs", "search_query_id", "search_queries", clears=True),
    Reference("job_scrape_history", "scrape_run_id", "scrape_runs"),
    Reference("job_programming_languages", "programming_language_id", "programming_languages"),
    Reference("job_ecosystems", "ecosystem_id", "ecosystems"),
)


def deleted_keys(
    tables: Mapping[str, DataFrame], references: Iterable[Reference], table: str, gone: DataFrame, key: str = "id"
) -> dict[str, DataFrame]:
    """Per table that others refer to, the keys (one column, its key's name) of the rows that go when the rows ``gone`` of ``table`` go.

    The graph is closed level by level: the keys found in one level are looked up in all tables that refer to theirs. A table that is met again (two
    ways to it, or a circle) goes on with the keys that are new; these are stored, and the search ends when a level has none.
    """
    references = [r for r in references if r.child in tables]
    own_key = {r.parent: r.key for r in references} | {table: key}
    found: dict[str, DataFrame] = {table: gone.select(key).distinct()}
    level = dict(found)
    while level:
        after: dict[str, DataFrame] = {}
        for r in references:
            if r.parent in level and not r.clears and r.child in own_key:
                name = own_key[r.child]
                parents = level[r.parent].select(F.col(r.key).alias(r.column))
                keys = sized_join(tables[r.child].select(name, r.column), parents, r.column, "left_semi").select(name).distinct()
                after[r.child] = after[r.child].union(keys).distinct() if r.child in after else keys
        level = {}
        for name, keys in after.items():
            if name in found:
                keys = cut_lineage(keys.join(found[name], own_key[name], "left_anti"))
                if keys.isEmpty():
                    continue
                found[name] = found[name].union(keys)
            else:
                found[name] = keys = cut_lineage(keys)
            level[name] = keys
    return found


def delete_cascading(
    tables: Mapping[str, DataFrame], references: Iterable[Reference], table: str, gone: DataFrame, key: str = "id"
) -> dict[str, DataFrame]:
    """The tables after the rows ``gone`` (a frame with ``key``) of ``table`` are deleted with all that hangs on them, at any depth. Only tables that
    change are returned; the order of ``tables`` does not matter. A null reference refers to nothing, so such a row stays."""
    references = [r for r in references if r.child in tables]
    found = deleted_keys(tables, references, table, gone, key)
    own_key = {r.parent: r.key for r in references} | {table: key}
    out: dict[str, DataFrame] = {n: _without(tables[n], keys, own_key[n]) for n, keys in found.items() if n in tables}
    for r in references:
        if r.parent not in found:
            continue
        rows = out.get(r.child, tables[r.child])
        parents = found[r.parent].select(F.col(r.key).alias("_gone"))
        if r.clears:
            marked = rows.join(parents.withColumn("_hit", F.lit(True)), F.col(r.column) == F.col("_gone"), "left")
            rows = marked.select(*[F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c == r.column else F.col(c) for c in rows.columns])
        elif r.child not in found:
            rows = _without(rows, parents.withColumnRenamed("_gone", r.column), r.column)
        out[r.child] = rows
    return out


def _without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return sized_join(rows, gone, column, "left_anti").select(*rows.columns)


def cascade_report(tables: Mapping[str, DataFrame], left: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows_before, rows_after, rows_deleted) of every table of ``left``."""
    report = None
    for name, frame in left.items():
        both = tables[name].select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(frame.select(F.lit(0), F.lit(1)))
        line = both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after")).select(
            F.lit(name).alias("table_name"), "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_deleted")
        )
        report = line if report is None else report.unionAll(line)
    return report
