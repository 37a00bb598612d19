"""Figures from partials: exact counts, stated errors of the sketches, batches that read only themselves."""

import pytest
from pyspark.sql import functions as F

from jobtide.operators.partials import DailyFigures, Figures, changed

FIGURES = Figures(
    "day", {"rows": "true", "active": "active"}, {"users": "user"}, {"pay": "pay"}
)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(60_000).select(
        i, F.when(i % 11 != 0, F.date_add(F.lit("2025-01-01").cast("date"), (i % 3).cast("int"))).alias("day"),
        F.when(i % 5 != 0, i % 2 == 0).alias("active"), (i * 7 % 20_000).alias("user"), F.when(i % 4 != 0, i * 31 % 60_000).alias("pay"))


@pytest.fixture
def kept(spark, rows, tmp_path):
    own = DailyFigures(spark, str(tmp_path / "figures"), FIGURES)
    own.start(rows.limit(0))
    for b in range(3):
        own.add(f"b{b}", rows.where(F.pmod(F.floor(F.col("id") / 7), F.lit(3)) == b))
    return own


def exact(rows):
    return {r["day"]: (r["rows"], r["active"]) for r in rows.groupBy("day").agg(F.count("*").alias("rows"), F.count_if("active").alias("active")).collect()}


def test_counts_and_sketches(rows, kept):
    assert {r["day"]: (r["rows"], r["active"]) for r in kept.by_day().collect()} == exact(rows)
    total = kept.total(fractions=(0.1, 0.5, 0.9)).first()
    assert (total["rows"], total["active"]) == tuple(map(sum, zip(*exact(rows).values())))
    assert abs(total["users"] - 20_000) <= 3 * 0.016 * 20_000
    for fraction, value in zip((0.1, 0.5, 0.9), total["pay"]):
        below = rows.where(F.col("pay") <= value).count() / rows.where("pay IS NOT NULL").count()
        assert abs(below - fraction) <= 0.03
    two = kept.total("2025-01-02", "2025-01-03").first()
    assert two["rows"] == sum(n for d, (n, _) in exact(rows).items() if d and d.isoformat() >= "2025-01-02")


def test_changes_and_repeats(spark, rows, kept):
    old = rows.where("id % 10 = 2")
    new = old.withColumn("active", ~F.coalesce("active", F.lit(False)))
    for _ in range(2):
        kept.add("change", changed(old, new))
    after = rows.where("id % 10 <> 2").unionAll(new)
    assert {r["day"]: (r["rows"], r["active"]) for r in kept.by_day().collect()} == exact(after)


def test_a_batch_adds_one_row_per_day(rows, kept):
    assert kept.tables["partials"].count() == 3 * 4
    kept.add("small", rows.where("id = 1"))
    assert kept.tables["partials"].count() == 13
    kept.add("none", rows.limit(0))
    assert kept.tables["partials"].count() == 13


def test_empty(spark, rows, tmp_path):
    own = DailyFigures(spark, str(tmp_path / "empty"), FIGURES)
    own.start(rows.limit(0))
    total = own.total().first()
    assert (total["rows"], total["active"], total["users"], total["pay"]) == (0, 0, 0, None) and own.by_day().count() == 0
