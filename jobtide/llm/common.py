"""What the operators share: input columns, stored intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, passing, store_wide

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """The columns an operator works on, under fixed names: ``doc_id``, ``text`` and those of ``more``.

    A null text counts as empty. All other columns of ``df`` are left behind here, so none can clash with a
    working column.
    """
    own = [df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")]
    return df.select(*own, *[df[c].alias(k) for k, c in more.items()])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` also maps other letters, so it is used on all-ASCII texts alone."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def stored(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write once to the shared folder and go on from there: a lost executor rereads the same rows, and each
    reader scans only the columns it needs, and only the folders it needs where they are stored ``by`` a column."""
    return store_wide(df, by)


def drop_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column). Rows with a null id stay."""
    out = ids.select(ids[ids.columns[0]].alias("_jt_out"))
    return docs.join(out, docs[id_col] == out["_jt_out"], "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``node``, ``component`` (smallest node), for every node that has an edge.

    Alternating stars: each round links the neighbours of a node to the smallest of them, first the larger
    neighbours, then the smaller ones. The number of rounds grows with the logarithm of a component's size. Every
    round is a stored table, so nothing is gathered and a lost executor costs one round at most. Null nodes and
    loops are ignored; an empty input gives an empty result.
    """
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # The larger neighbours of each node are linked to its smallest neighbour (or itself).
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct())
        # The smaller neighbours of each node, and the node itself, are linked to the smallest of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select("u", "v").union(now.select("v", "v")).distinct().toDF("node", "component")


__all__ = ["WORD", "SPACES", "texts", "ascii_lower", "stored", "drop_rows", "components", "cut_lineage", "passing"]
