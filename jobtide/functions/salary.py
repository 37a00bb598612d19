"""Salary texts of the two posting sources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE, strip

# Currency signs and codes.
CURRENCY_CODES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
DEFAULT_CURRENCY = "USD"

# Words that name the pay period, first match wins.
PERIOD_WORDS = (("year", "yearly"), ("annual", "yearly"), ("month", "monthly"), ("hour", "hourly"), ("week", "weekly"))

AMOUNT = rf"(\d+(?:,\d+)*(?:\.\d+)?){SPACE}*([kK])?"


def pay_range_columns(text: Column) -> dict[str, Column]:
    """``$120,000.00/yr - $150,000.00/yr``: exactly one dash, both amounts readable, else all null."""
    halves = F.split(text, "-")
    low = F.regexp_replace(F.get(halves, F.lit(0)), "[^0-9.]", "").try_cast("double")
    right = strip(F.get(halves, F.lit(1)))
    steps = F.split(right, "/")
    high = F.regexp_replace(F.get(steps, F.lit(0)), "[^0-9.]", "").try_cast("double")
    ok = (F.size(halves) == 2) & low.isNotNull() & high.isNotNull()
    sign = F.substring(text, 1, 1)
    return {
        "salary_currency": F.when(ok & sign.isin("$", "€", "£"), sign),
        "base_salary_min": F.when(ok, low),
        "base_salary_max": F.when(ok, high),
        "salary_period": F.when(ok & (F.size(steps) > 1), F.element_at(steps, -1)),
    }


def formatted_salary_columns(text: Column) -> dict[str, Column]:
    """``$50,000 - $70,000 a year``, ``€50k-€70k``, ``Up to $50k``: first two amounts, or one for both."""
    figures = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1))
    scales = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(2))

    def amount(i: Column) -> Column:
        value = F.replace(F.get(figures, i), F.lit(","), F.lit("")).try_cast("double")
        return F.when(F.get(scales, i) != "", value * 1000).otherwise(value)

    low = amount(F.lit(0))
    high = F.when(F.size(figures) >= 2, amount(F.lit(1))).otherwise(low)
    any_amount = F.size(figures) > 0
    sign = F.regexp_extract(text, "[$€£¥]", 0)
    code = F.lit(DEFAULT_CURRENCY)
    for symbol, iso in CURRENCY_CODES.items():
        code = F.when(sign == symbol, iso).otherwise(code)
    period = F.lit(None).cast("string")
    for word, name in reversed(PERIOD_WORDS):
        period = F.when(F.lower(text).contains(word), name).otherwise(period)
    return {
        "salary_currency": F.when(any_amount, code),
        "base_salary_min": F.when(any_amount, low),
        "base_salary_max": F.when(any_amount, high),
        "salary_period": F.when(any_amount, period),
    }
