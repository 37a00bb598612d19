"""Change detection between a stored and an incoming posting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fields whose change makes a posting 'changed', and fields in its content hash.
WATCHED = (
    "title", "num_applicants", "base_salary_min", "base_salary_max", "employment_type",
    "seniority_level", "application_available",
)
HASHED = ("base_salary_max", "base_salary_min", "employment_type", "num_applicants", "seniority_level", "title")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def any_changed(old: str, new: str, fields: tuple[str, ...] = WATCHED) -> Column:
    """True when any field differs between the struct columns ``old`` and ``new``."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | differs(F.col(f"{old}.{f}"), F.col(f"{new}.{f}"))
    return hit


def changed_fields(old: str, new: str, fields: tuple[str, ...]) -> Column:
    return F.array_compact(
        F.array(*[F.when(differs(F.col(f"{old}.{f}"), F.col(f"{new}.{f}")), F.lit(f)) for f in fields])
    )


def content_hash(fields: tuple[str, ...] = HASHED) -> Column:
    """md5 of the fields in a fixed text form, name=value joined by newlines, null as a lone '~'."""
    parts = [
        F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("~"))) for f in sorted(fields)
    ]
    return F.md5(F.concat_ws("\n", *parts))
