"""Partition numbers that follow the size of the input.

Adaptive execution puts shuffled partitions together by their compressed bytes. Rows that are little more than a key are compressed to a few bytes, so
one task gets tens of millions of them, and sorts and hash tables of gigabytes. Here the number of partitions is taken from the files the
rows come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

PART_BYTES = 8 << 20  # of input files per partition: under a million rows where a row takes 10 bytes


def input_parts(df: DataFrame) -> int:
    """One per ``PART_BYTES`` of the files behind ``df``; 0 if it does not come from files."""
    context = df.sparkSession.sparkContext
    conf, jvm = context._jsc.hadoopConfiguration(), context._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // PART_BYTES)


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join by one column whose partitions keep their size as the tables grow. Where one side is a file or two it is left to
    the planner, which broadcasts the small side and splits hot keys."""
    parts, other = input_parts(left), input_parts(right)
    if parts <= 1 or other == 1:
        return left.join(right, on, how)
    n = max(parts, other)
    return left.repartition(n, on).join(right.repartition(n, on), on, how)
