"""Pages by token: walking them gives every row once, in order, from few slices."""

import random

import pytest
from pyspark.sql import functions as F

from jobtide.operators.keyset import Key, KeysetPages


def walk(pages, limit):
    token, out, most = None, [], 0
    while True:
        page = pages.page(limit, token)
        rows = page.collect()
        if not rows:
            return out, most
        most = max(most, len(pages.slices(token, limit)))
        out.append(rows)
        token = pages.token(page)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, 1.5, 2.0, float("nan"), 3.25, -1.0]), None if i % 7 == 0 else i % 5) for i in range(400)]
    # Many rows agree in all but the id; times with micros.
    return spark.createDataFrame(values, "id long, score double, n int").withColumn(
        "seen", F.when(F.col("n") != 3, F.timestamp_micros(F.lit(1_700_000_000_123_457) + F.col("n"))))


@pytest.mark.parametrize("keys", [
    [Key("seen", True), Key("id")], [Key("seen"), Key("id", True)], [Key("score", True), Key("n"), Key("id")], [Key("score"), Key("id")],
])
def test_walk_equals_sort(spark, rows, tmp_path, keys):
    pages = KeysetPages(spark, str(tmp_path / "pages"), keys)
    pages.store(rows, 16)
    got, most = walk(pages, 60)
    assert [len(p) for p in got] == [60] * 6 + [40]
    assert [r["id"] for p in got for r in p] == [r["id"] for r in rows.orderBy(*[k.order for k in keys]).collect()]
    assert most <= 6  # 16 slices of about 25 rows


def test_only_the_slices_of_the_page_are_scanned(spark, rows, tmp_path):
    pages = KeysetPages(spark, str(tmp_path / "pages"), [Key("id")])
    pages.store(rows, 16)
    plan = pages.page(10, "[\"390\"]")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_slice" in plan or "PartitionFilters: [isnotnull(_slice" in plan
    assert len(pages.slices("[\"390\"]", 10)) == 1 and pages.page(10, "[\"399\"]").count() == 0


def test_empty_table_and_wrong_token(spark, rows, tmp_path):
    pages = KeysetPages(spark, str(tmp_path / "pages"), [Key("n"), Key("id")])
    pages.store(rows.limit(0))
    assert pages.page(5).count() == 0 and pages.token(pages.page(5)) is None
    with pytest.raises(ValueError):
        pages.page(5, "[\"1\"]")
