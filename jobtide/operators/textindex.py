"""``ILIKE '%needle%'`` from stored trigrams instead of a scan of all texts.

Every different text is listed under its trigrams (lower case, with two end marks, so that one or two characters are the prefix
of a trigram). A search takes the rarest trigrams of the needle, intersects their lists, fetches the texts left, and tests
those with the same ILIKE that a scan would use. The result is that of the scan; the trigrams only decide what is tested.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shuffle_width

GRAM = 3
RAREST = 3
PART = "_part"
END = "\u0000\u0000"


def _grams(lowered: Column) -> Column:
    """The different trigrams of a text, end marks included; an empty text has one."""
    marked = F.concat(lowered, F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - (GRAM - 1)), lambda i: F.substring(marked, i, GRAM)))


def literal_pieces(lowered: str) -> list[str]:
    """What a text must contain to match ``%lowered%``: the needle cut at its wildcards and escapes."""
    return [p for p in re.split(r"[%_\\]+", lowered) if p]


class TextIndex:
    """The different values of a text column below ``path``, with their trigrams and the ids of their rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, df: DataFrame, row_id: str, column: str, parts: int = 64) -> None:
        """Write the index of ``column``. ``parts`` is the number of folders of the texts; rows with a null text match nothing and are left out.

        A text that a third of the rows have is one entry of the lists. Lists and texts are sorted, so that a
        search reads the row groups of its trigrams; a trigram that most texts have is spread over files by text.
        """
        spark = self.spark
        rows = df.where(F.col(column).isNotNull()).select(F.col(row_id).alias("id"), F.col(column).cast("string").alias("text"))
        keyed = rows.withColumn("key", F.xxhash64("text"))
        # Rebalanced: adaptive execution splits a folder's rows by size, also where they all have one text.
        keyed.withColumn(PART, self._part(parts)).hint("rebalance", PART).sortWithinPartitions(PART, "key").write.mode("overwrite").partitionBy(
            PART).parquet(f"{self.path}/texts")
        rows.limit(0).withColumn("key", F.lit(0).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/schema")
        listed = keyed.select("key", "text").distinct().select("key", F.explode(_grams(F.lower("text"))).alias("gram"))
        listed.repartitionByRange(shuffle_width(spark), "gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(
            f"{self.path}/lists")
        sizes = self.lists.groupBy("gram").agg(F.count("*").alias("texts"))
        sizes.repartitionByRange(max(1, shuffle_width(spark) // 8), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/sizes")
        spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{self.path}/parts")

    @staticmethod
    def _part(parts: int) -> Column:
        return F.pmod(F.col("key"), F.lit(parts)).cast("int")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("key bigint, gram string").parquet(f"{self.path}/lists")

    @property
    def texts(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(T.StructType([*schema, T.StructField(PART, T.IntegerType())])).parquet(f"{self.path}/texts")

    def rarest(self, needle: str) -> list[str]:
        """The rarest trigrams of the needle; at most one size per character of the needle is gathered."""
        pieces = literal_pieces(self._lowered(needle))
        grams = {p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)}
        sizes = self.spark.read.schema("gram string, texts bigint").parquet(f"{self.path}/sizes")
        found = {r["gram"]: r["texts"] for r in sizes.where(F.col("gram").isin(*grams)).collect()} if grams else {}
        return sorted(grams, key=lambda g: (found.get(g, 0), g))[:RAREST]

    def _lowered(self, needle: str) -> str:
        return self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]

    def candidates(self, needle: str) -> DataFrame | None:
        """Keys of the texts that hold the needle's rarest trigrams; None if the needle has no literal character."""
        grams = self.rarest(needle)
        if grams:
            held = self.lists.where(F.col("gram").isin(*grams)).groupBy("key").agg(F.count("*").alias("_n"))
            # More, where two texts share a key: both are fetched and tested.
            return held.where(F.col("_n") >= len(grams)).select("key")
        pieces = literal_pieces(self._lowered(needle))
        if not pieces:
            return None
        longest = max(pieces, key=len)
        return self.lists.where(F.col("gram").startswith(longest)).select("key").distinct()

    def search(self, needle: str) -> DataFrame:
        """``id, text`` of the rows whose text matches ``ILIKE '%needle%'``, wildcards of the needle included.

        Only the folders that hold a candidate are read; their numbers, at most ``parts``, are gathered.
        """
        keys, texts = self.candidates(needle), self.texts
        if keys is not None:
            parts = self.spark.read.parquet(f"{self.path}/parts").first()["parts"]
            touched = [r[0] for r in keys.select(self._part(parts)).distinct().collect()]
            texts = texts.where(F.col(PART).isin(touched)).join(keys, "key", "left_semi")
        return texts.where(F.col("text").ilike(f"%{needle}%")).select("id", "text")
