"""Cascading deletions, merged master rows, and sinks and imports with several rows per key."""

from jobtide.operators import dedup, sinks, sizing
from jobtide.operators.cascade import Reference, delete_cascading
from jobtide.sources import company_csv

NOW = "2025-06-01 10:00:00"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_children_of_children_in_any_order_of_tables(spark):
    tables = {
        "leaves": spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, None)], "id int, b int"),
        "branches": spark.createDataFrame([(10, 100), (11, 101), (12, 100), (13, None)], "id int, t int"),
        "trees": spark.createDataFrame([(100, 1), (101, 2)], "id int, x int"),
        "notes": spark.createDataFrame([(1, 10, 5), (2, 11, 6)], "n int, branch int, y int"),
    }
    graph = [Reference("leaves", "b", "branches"), Reference("branches", "t", "trees"), Reference("notes", "branch", "branches", clears=True), Reference("absent", "t", "trees")]
    for order in (list(tables), list(reversed(tables))):
        left = delete_cascading({n: tables[n] for n in order}, graph[:: 1 if order[0] == "leaves" else -1], "trees", tables["trees"].where("id = 100"))
        assert values(left["trees"], "id") == [(101,)]
        assert values(left["branches"], "id") == [(11,), (13,)]
        assert values(left["leaves"], "id") == [(2,), (4,)]
        assert sorted(map(tuple, left["notes"].collect()), key=str) == [(1, None, 5), (2, 11, 6)]


def test_circles_and_empty_deletions(spark):
    tables = {"a": spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id int, next int")}
    graph = [Reference("a", "next", "a")]
    assert values(delete_cascading(tables, graph, "a", tables["a"].where("id = 1"))["a"], "id") == [(4,), (5,)]
    assert values(delete_cascading(tables, graph, "a", tables["a"].where("id = 4"))["a"], "id") == [(1,), (2,), (3,)]
    assert delete_cascading(tables, graph, "a", tables["a"].limit(0))["a"].count() == 5


def test_two_ways_to_one_table(spark):
    tables = {
        "top": spark.createDataFrame([(1,)], "id int"), "left": spark.createDataFrame([(1, 1), (2, None)], "id int, top int"),
        "mid": spark.createDataFrame([(1, None, 1), (2, 1, None), (3, 2, None)], "id int, l int, top int"),
        "end": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, mid int"),
    }
    graph = [Reference("left", "top", "top"), Reference("mid", "l", "left"), Reference("mid", "top", "top"), Reference("end", "mid", "mid")]
    left = delete_cascading(tables, graph, "top", tables["top"])
    assert values(left["mid"], "id") == [(3,)] and values(left["end"], "id") == [(3,)]


def test_master_rows_of_merged_companies(spark):
    master = spark.createDataFrame([(1, 10, "own"), (2, 11, "first copy"), (3, 12, "second copy"), (4, 21, "heir"), (5, 22, "late"), (6, 30, "apart")], "id int, company_id int, v string")
    mapping = spark.createDataFrame([(11, 10), (12, 10), (22, 20), (21, 20), (41, 40)], "id int, keep_id int")
    assert values(dedup.merge_master_rows(master, mapping), "company_id", "v") == [(10, "own"), (20, "heir"), (30, "apart")]


def test_repeated_answers(spark):
    from pyspark.sql import functions as F

    master = spark.createDataFrame([(1, True), (2, None), (3, False)], "company_id int, is_consulting boolean")
    answers = spark.createDataFrame(
        [(1, 1, '{"Consulting":false,"reasoning":"r"}'), (1, 2, '{"x":1}'), (2, 5, '{"Consulting":true,"reasoning":""}'), (2, 4, "broken"), (9, 1, '{"Consulting":true}')],
        "company_id int, line int, p string",
    )
    got = sinks.save_consulting(master, answers, "p", NOW, [F.col("line")]).collect()
    assert sorted((r["company_id"], r["is_consulting"], r["consulting_reasoning"], r["consulting_error"] is None) for r in got) == [
        (1, True, None, False), (2, True, None, True), (3, False, None, True),
    ]
    languages = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, relevance_score int")
    scores = spark.createDataFrame([(1, 1, "99"), (1, 2, "high"), (2, 9, " 12 "), (2, 3, "400"), (3, 1, None)], "id int, line int, answer string")
    got = sinks.save_relevance(languages, scores, [F.col("line")]).collect()
    assert sorted((r["id"], r["relevance_score"], r["relevance_error"]) for r in got) == [
        (1, 5, "Invalid score format: high"), (2, 12, None), (3, None, "Invalid score format: "),
    ]


def test_csv_rows_apply_in_file_order(spark, tmp_path):
    head = "LinkedIn Company ID,Company Name,Industry,Website\n"
    (tmp_path / "a.csv").write_text(head + '7,"Al\npha",Zoo,z.example\n7,Alpha,,m.example\n')
    (tmp_path / "b.csv").write_text(head + "7,Alpha,Art,\n8,Beta,Retail,\n8,Beta,,\n")
    companies = spark.createDataFrame([(1, "7"), (2, "8")], "id int, linkedin_company_id string")
    master = spark.createDataFrame([(5, 1, "Old")], "id int, company_id int, industry string")
    classified = company_csv.classify_import(company_csv.read_company_csv(spark, str(tmp_path)), companies, master)
    got = company_csv.apply_import(classified, master)
    assert values(got, "company_id", "industry", "website") == [(1, "Art", "m.example"), (2, "Retail", None)]


def test_partitions_of_a_deletion_follow_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "PART_BYTES", 1 << 12)
    for name, rows in (("p", spark.range(4000).selectExpr("id", "id % 7 AS g")), ("c", spark.range(40_000).selectExpr("IF(id % 10 = 0, NULL, id % 4000) AS p", "id AS n"))):
        rows.write.parquet(str(tmp_path / name))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("p", "c")}
    parts = sizing.input_parts(tables["c"])
    assert parts > 10 and sizing.input_parts(spark.range(3).toDF("id")) == 0
    left = delete_cascading(tables, [Reference("c", "p", "p")], "p", tables["p"].where("g < 3"))
    assert left["c"].columns == ["p", "n"] and left["c"].rdd.getNumPartitions() == parts
    assert values(left["c"], "n") == [(n,) for n in range(40_000) if n % 10 == 0 or n % 4000 % 7 >= 3]
    assert values(left["p"], "id") == [(n,) for n in range(4000) if n % 7 >= 3]


def test_import_rows_are_numbered_over_files(spark, tmp_path):
    for i in range(12):  # part 2 before part 10 by name, several files per task
        (tmp_path / f"part-{i:05d}.csv").write_text("LinkedIn Company ID,Industry,Website\n" + f"1,i{i}a,w{i}\n1,i{i}b,\n" + f"2,j{i},\n,x,y\n")
    rows = company_csv.read_company_csv(spark, str(tmp_path))
    assert dict(rows.dtypes)["place"] == "bigint" and rows.select("place").distinct().count() == 48
    companies = spark.createDataFrame([(7, "1"), (8, "2"), (9, None)], "id long, linkedin_company_id string")
    master = spark.createDataFrame([(1, 7, "old")], "id long, company_id long, industry string")
    classified = company_csv.classify_import(rows, companies, master)
    # The rows meet one table: what is known of companies and master rows is joined before.
    assert classified.groupBy("outcome").count().sort("outcome").collect() == [("master_data_created", 12), ("master_data_updated", 24), ("skipped", 12)]
    assert values(company_csv.apply_import(classified, master), "company_id", "industry", "website") == [(7, "i11b", "w11"), (8, "j11", None)]
