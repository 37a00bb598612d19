"""Exact deduplication by 128-bit content hash with a byte comparison inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stored, texts


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower, content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the content hash *and* the normalised bytes, so two texts whose hashes collide end in two
    groups; the grouping is combined before the shuffle, so a group with a third of all rows sends one row per
    task. The groups are stored without their texts and joined back by two hashes, a join of two plain scans that
    adaptive execution splits at a hot key.

    A null text counts as empty. A null id never stays unless a group has no other; its ``kept`` is then true.
    Rows that repeat an id with an equal text share that id's decision. An empty table gives no rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = texts(docs, id_col, text_col).select("doc_id", normalise(F.col("text")).alias("norm"))
    hashed = rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("content"))
    groups = stored(
        hashed.groupBy("content", "norm")
        .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("content", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keys = hashed.select("doc_id", "content", F.sha2("norm", 256).alias("text_sha256"))
    return keys.join(groups, ["content", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
