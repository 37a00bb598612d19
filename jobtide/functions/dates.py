"""Instants, ages, look-back windows and retry rules. Nothing here reads the clock: callers pass ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .text import contains_any

AsOf = Column | str | dt.datetime

# Search presets in days.
POSTED_PRESETS = {"today": 1, "week": 7, "month": 30}

# Words that decide whether a failed attempt is tried again.
QUOTA_WORDS = ("quota", "429")
RATE_WORDS = ("rate limit", "too many requests")
TIMEOUT_WORDS = ("timeout", "timed out")
PERMANENT_WORDS = ("parse", "json", "invalid", "validation")


def instant(as_of: AsOf) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def before(as_of: AsOf, **parts: int) -> Column:
    """``as_of`` minus days/hours/mins."""
    return instant(as_of) - F.make_dt_interval(
        F.lit(parts.get("days", 0)), F.lit(parts.get("hours", 0)), F.lit(parts.get("mins", 0))
    )


def lenient_timestamp(text: Column) -> Column:
    """ISO text to timestamp; the zone suffix is dropped, not converted; unreadable is null."""
    naive = F.regexp_replace(text, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
    has_time = text.rlike(r"\d{2}:\d{2}")
    return F.when(has_time, naive.try_cast("timestamp")).otherwise(text.try_cast("timestamp"))


def age_seconds(ts: Column, as_of: AsOf) -> Column:
    return (F.unix_micros(instant(as_of)) - F.unix_micros(ts)) / F.lit(1_000_000)


def age_hours(ts: Column, as_of: AsOf) -> Column:
    return age_seconds(ts, as_of) / F.lit(3600)


def age_whole_days(ts: Column, as_of: AsOf) -> Column:
    return F.floor(age_seconds(ts, as_of) / F.lit(86400)).cast("int")


def posted_within(posted: Column, preset: str | None, as_of: AsOf) -> Column:
    """True for every row when the preset is 'all', empty or unknown."""
    days = POSTED_PRESETS.get(preset or "all")
    return F.lit(True) if days is None else posted >= before(as_of, days=days)


def lookback_window(days: Column) -> Column:
    return F.when(days <= 1, "past_24h").when(days <= 7, "past_week").otherwise("past_month")


def incremental_days(days_since_success: Column) -> Column:
    """Days to fetch again; no earlier success, or a gap over 30 days, means 30."""
    return F.when(days_since_success <= 1, 1).when(days_since_success <= 7, 7).otherwise(30)


def is_quota_error(message: Column) -> Column:
    return F.coalesce(contains_any(F.lower(message), QUOTA_WORDS + ("rate limit",)), F.lit(False))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(F.coalesce(message, F.lit("")) == "", F.lit(None))
        .when(contains_any(low, QUOTA_WORDS), "quota")
        .when(contains_any(low, RATE_WORDS), "rate_limit")
        .when(contains_any(low, TIMEOUT_WORDS), "timeout")
        .when(contains_any(low, PERMANENT_WORDS), "permanent")
        .otherwise("unknown")
    )


def should_retry(message: Column, last_attempt: Column, as_of: AsOf, delay_hours: int = 24) -> Column:
    return (
        F.when(F.coalesce(message, F.lit("")) == "", False)
        .when(last_attempt.isNull(), True)
        .when(last_attempt > before(as_of, hours=delay_hours), False)
        .otherwise(error_class(message) != "permanent")
    )


def needs_first_or_retry(done: Column, message: Column, attempted_at: Column, as_of: AsOf, delay_hours: int = 24) -> Column:
    """The generic backlog filter: not done, or failed and old enough."""
    return ~F.coalesce(done, F.lit(False)) | (
        message.isNotNull() & F.coalesce(attempted_at < before(as_of, hours=delay_hours), F.lit(False))
    )
