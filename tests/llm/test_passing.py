"""Intermediate tables and shuffle files do not outlive their use."""

import glob
import random

from pyspark.sql import functions as F

from jobtide.llm import similarity, substring_dedup
from jobtide.session import _own_folder, passing, store_wide

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folders(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(s.getPath()) for s in system.listStatus(path)} if system.exists(path) else set()


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_UP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table = store_wide(counted)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEAN_UP, None) == setting
    # What was stored, and what it was made from, can be read as often as asked.
    assert {r.k: r.n for r in table.collect()} == {r.k: r.n for r in counted.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    assert counted.count() == 7


def test_tables_kept_pass_to_the_block_around(spark):
    before = folders(spark)
    with passing() as keep:
        store_wide(spark.range(3))
        with passing() as inner:
            store_wide(spark.range(4))
            kept = inner(store_wide(spark.range(5)))
        assert len(folders(spark) - before) == 2
        result = keep(store_wide(kept.where("id > 1")))
    assert len(folders(spark) - before) == 1
    assert [r.id for r in result.orderBy("id").collect()] == [2, 3, 4]
    free = store_wide(spark.range(2))  # outside a block it stays
    assert free.count() == 2 and len(folders(spark) - before) == 2


def test_a_block_that_fails_leaves_nothing(spark):
    before = folders(spark)
    try:
        with passing():
            store_wide(spark.range(3))
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before


def test_links_keep_their_labels_only(spark):
    rows = [(k, i, [100 * k + j for j in range(10)] + [1000 + i]) for k in range(3) for i in range(5 * k, 5 * k + 5)]
    members = store_wide(spark.createDataFrame([(k, i) for k, i, _ in rows], "key long, id long"))
    sets = spark.createDataFrame([(i, t) for _, i, t in rows], "id long, tokens array<long>")
    before = folders(spark)
    labels = similarity.link_components(members, lambda ids: sets.join(ids, "id", "left_semi"), 4, 5)
    assert len(folders(spark) - before) == 1
    assert {r.node: r.component for r in labels.collect()} == {i: 5 * k for k, i, _ in rows}


def test_substring_dedup_keeps_what_its_rows_read(spark, docs_of):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, near = text(60), [text(1) for _ in range(40)]
    rows = [(1, f"{text(20)} {passage} {text(20)}"), (2, f"{passage} {text(30)}"), (3, " ".join(near)), (4, " ".join([*near[:-1], "other"]))]
    before, files = folders(spark), shuffle_files(spark)
    repeated = substring_dedup.repeated_paragraphs(docs_of(rows))
    # The places, the windows beside them and the windows' first places.
    assert len(folders(spark) - before) <= 3
    assert len(shuffle_files(spark) - files) <= 8
    for _ in range(2):
        got = {r.doc_id: (r.spans, r.keep_ids) for r in substring_dedup.removals(repeated).collect()}
        assert got == {2: (f"0:{len(passage)}", [1]), 4: (f"0:{len(rows[3][1])}", [3])}
