"""Text search from trigrams equals the scan, and tests few texts."""

import pytest
from pyspark.sql import functions as F

from jobtide.operators.textindex import TextIndex, literal_pieces

TEXTS = ["Data Engineer", "data engineer", "  Senior  DATA Engineer ", "Nurse", "", "a", "ab", "AB c", "100% remote", "50_50 split", "back\\slash",
         "Ingénieur Données", "ΟΔΟΣ", "İstanbul", "ŁÓDŹ", "x" * 300 + "needle", None, "tab\there", "%", "_"]


@pytest.fixture(scope="module")
def rows(spark):
    names = spark.range(3000).select(F.col("id"), F.concat(F.lit("Firm "), (F.col("id") * 37 % 1009).cast("string")).alias("name"))
    hot = spark.range(1500).select((F.col("id") + 10_000).alias("id"), F.lit("Data Engineer").alias("name"))
    own = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(TEXTS)], "id long, name string")
    return names.unionAll(hot).unionAll(own)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i"))
    made.store(rows, "id", "name", 16)
    return made


@pytest.mark.parametrize("needle", [
    "engineer", "ENGINEER", "firm 10", "m 100", "0", "a", "AB", "b ", "c", "", "%", "_", "100%", "da%eer", "0_5", "50\\_50", "needle", "ódź", "É", "σ", "οδοσ",
    "istanbul", "İ", "zzz", "qz", "\t", "a%b%c", "x" * 200, "  ",
])
def test_same_rows_as_the_scan(rows, index, needle):
    scan = sorted(map(tuple, rows.where(F.col("name").ilike(f"%{needle}%")).select("id", "name").collect()))
    assert sorted(map(tuple, index.search(needle).collect())) == scan


def test_few_texts_are_tested(index):
    texts = index.texts.select("text").distinct().count()
    for needle, matches in (("firm 100", 10), ("engineer", 3), ("needle", 1), ("zzz", 0)):
        assert index.candidates(needle).count() <= 3 * matches, needle
    assert texts > 1000 and index.candidates("%") is None


def test_literal_pieces():
    assert literal_pieces("a%bc_d\\%e") == ["a", "bc", "d", "e"] and literal_pieces("%_") == []


def test_lists_are_pruned_and_empty_tables_work(spark, rows, index, tmp_path):
    plan = index.search("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan
    assert "_part" in plan.split("PartitionFilters: [")[1]
    empty = TextIndex(spark, str(tmp_path / "e"))
    empty.store(rows.limit(0), "id", "name")
    assert [empty.search(n).count() for n in ("abc", "a", "")] == [0, 0, 0]
