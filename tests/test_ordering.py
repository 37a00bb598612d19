"""Ranks against a plain sort, with a group and a score that hold most rows."""

import random

from pyspark.sql import functions as F

from jobtide.operators import ordering


def sample(n=3000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.5 else rng.choice([None, "", "a", "b", f"g{rng.randrange(200)}"])
        score = -9999.0 if rng.random() < 0.4 else float(rng.randrange(50))
        rows.append((f"id{i:05d}", group, score))
    rng.shuffle(rows)
    return rows


def test_global_position(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "id string, g string, s double").repartition(7)
    order = [F.col("s").desc(), F.col("id")]
    got = {r["id"]: r["p"] for r in ordering.global_position(df, order, "p").collect()}
    expected = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == expected


def test_global_position_of_few_rows(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "id string, s double")
    got = {r["id"]: r["p"] for r in ordering.global_position(df, [F.col("s").desc(), F.col("id")], "p").collect()}
    assert got == {"a": 1, "b": 2}
    assert ordering.global_position(df.limit(0), [F.col("id")], "p").count() == 0


def test_rank_in_groups(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "id string, g string, s double").repartition(5)
    order = [F.col("s").desc(), F.col("id")]
    ranked = ordering.rank_in_groups(ordering.slice_by_order(df, order), F.col("g"), order, "r")
    got = {r["id"]: r["r"] for r in ranked.collect()}
    counts, expected = {}, {}
    for i, g, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        counts[g] = counts.get(g, 0) + 1
        expected[i] = counts[g]
    assert got == expected


def test_deep_page_equals_near_page(spark):
    df = spark.createDataFrame(sample(), "id string, g string, s double")
    order = [F.col("s").desc(), F.col("id")]
    near = [r["id"] for r in ordering.page(df, order, 40, 700).collect()]
    assert sorted(r["id"] for r in ordering.page(df, order, 40, 700, deep=True).collect()) == sorted(near)


def test_best_row_and_page(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 9), (3, "b", None)], "id int, k string, v int")
    best = {r["k"]: r["id"] for r in ordering.best_row(df, ["k"], [-F.col("v"), F.col("id")]).collect()}
    assert best == {"a": 2, "b": 3}
    assert [r["id"] for r in ordering.page(df, [F.col("id").desc()], 1, 1).collect()] == [2]


def test_spread_join_equals_plain_join(spark):
    from jobtide.operators.skew import spread_join

    rows = sample()
    left = spark.createDataFrame(rows, "id string, g string, s double").repartition(6)
    right = left.where("g IS NOT NULL AND g <> 'a'").groupBy("g").agg(F.max("id").alias("top"))
    for how in ("left", "inner"):
        got = spread_join(left, right, ["g"], "id", how).select("id", "g", "top").collect()
        plain = left.join(right, "g", how).select("id", "g", "top").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, plain))


def test_spread_join_splits_null_and_hot_keys(spark):
    """90 % null keys, or 90 % one value: with adaptive execution off no task gets twice an even share."""
    from jobtide.operators.skew import spread_join

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "8"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
            spark.conf.set(k, v)
        right = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        for common in (None, 7):
            left = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 2000).otherwise(F.lit(common).cast("long")).alias("k"))
            got = spread_join(left, right, ["k"], "id").withColumn("task", F.spark_partition_id())
            sizes = [r["count"] for r in got.groupBy("task").count().collect()]
            assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
            assert got.where("NOT (v <=> k * 10)").count() == 0
            inner = spread_join(left, right, ["k"], "id", "inner")
            assert inner.count() == left.where("k IS NOT NULL").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
