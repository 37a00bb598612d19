"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, stored, texts


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACES, -1), "")


def _positions(size: Column, k: int) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str, k: int) -> Column:
    """One 64-bit hash per run of ``k`` words; a shorter text has its whole sequence as the only run."""
    return F.transform(
        _positions(F.size(words), k), lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(words), i + j) for j in range(k)])
    )


def shingle_texts(words: str, k: int) -> Column:
    return F.transform(_positions(F.size(words), k), lambda i: F.array_join(F.slice(F.col(words), i + 1, k), " "))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", k: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment) where a document holds ``threshold`` of an item's
    distinct shingles of ``k`` words, lower-cased.

    Items are partitioned by size into classes (2**p to 2**(p+1) - 1 shingles). The sketch of an item is its
    bottom-s MinHash, s = floor((1 - threshold) * largest size of the class) + 1: at the threshold at most s - 1
    shingles can be missing, so every pair meets in at least one sketch value and the search loses none. A pair
    goes on if it has as many sketch hits as the threshold implies, and is then verified by the texts of the
    shingles. Documents are compared by set containment of the short item, whatever their own length.

    Each document gives one row per shingle to a join with the sketches; only hits are shuffled where the
    sketches are small enough for Spark to broadcast them (by measured size, no hint). Null texts count as
    empty and match nothing, null ids are left out, rows that share an id count as one document (or item).
    """
    miss = round(1 - threshold, 9)
    given = texts(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", word_array(F.col("text")).alias("words"))
    wanted = (
        texts(items, item_col, item_text_col).where("doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("item_id"), word_array(F.col("text")).alias("words"))
    )
    item_rows = stored(
        wanted.select("item_id", F.explode(F.arrays_zip(shingle_hashes("words", k).alias("h"), shingle_texts("words", k).alias("s"))).alias("x"))
        .select("item_id", "x.h", "x.s").distinct()
    )
    sizes = item_rows.groupBy("item_id").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_set("h")).alias("hashes"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    sketch = stored(
        sizes.withColumn("s", (F.floor(largest * miss) + 1).cast("int"))
        .select("item_id", "n_item", F.slice("hashes", 1, F.col("s")).alias("sketch"))
        .select("item_id", (F.size("sketch") - F.floor(F.col("n_item") * miss)).alias("least"), F.explode("sketch").alias("h"))
    )
    hits = (
        given.select("doc_id", F.explode(shingle_hashes("words", k)).alias("h")).join(sketch, "h")
        .groupBy("doc_id", "item_id", "h").agg(F.first("least").alias("least"))
    )
    near = stored(
        hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least")
        .select("doc_id", "item_id")
    )
    opened = given.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (
        opened.select("doc_id", F.explode(F.array_distinct(shingle_texts("words", k))).alias("s")).distinct()
        .join(item_rows.select("item_id", "s").distinct(), "s")
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
        .join(near, ["doc_id", "item_id"], "left_semi")
    )
    n_item = item_rows.groupBy("item_id").agg(F.countDistinct("s").alias("n_item"))
    return (
        shared.join(n_item, "item_id").withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("containment") >= threshold).select("doc_id", "item_id", "n_shared", "n_item", "containment")
    )
