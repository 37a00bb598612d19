"""Exact Jaccard links inside candidate buckets, by a token-group matrix.

Documents that share a bucket are candidates. They are partitioned into groups of similar documents by linking
each to a leader of its buckets, a few rounds long; a group is (a part of) one connected component. What is
left are candidates in different components. For them each group's union of tokens is stored, the overlap of
a query's tokens with that union bounds its overlap with every member, and only groups whose bound reaches
the needed overlap are opened and compared member by member. One link is enough to join two components, so
no pair inside a component is made and a cluster of n near copies costs n comparisons, not n * n.

Tokens that no other candidate has bound the overlap too: with u of them, n tokens can share n - u at most. That drops
candidates without any partner, ranks the leaders (the original of a cluster of edited copies has the least u), and
forbids pairs that cannot share as many tokens as their sizes and the similarity ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import components, passing, stored

GROUP = 64
ROUNDS = 3


def _linked(a: str, b: str, num: int, den: int):
    both = F.size(F.array_intersect(a, b))
    return den * both >= num * (F.size(a) + F.size(b) - both)


def link_components(
    members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, group: int = GROUP, rounds: int = ROUNDS
) -> DataFrame:
    """Components (node, component) of the links between ids that share a bucket and have Jaccard >= num / den.

    ``members`` is a stored table (key, id); ``sets_of`` gives (id, tokens), the distinct tokens, for a frame of ids. Ids
    without a link are not returned. The result holds every link between two ids that share a bucket; there is no
    cap on buckets, partners or the search.
    """
    with passing() as keep:
        shared = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
        rows = stored(members.join(stored(shared), "key"))
        sets = stored(sets_of(rows.select("id").distinct()))
        alone = (
            sets.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("id"))
            .where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
        )
        sized = sets.select("id", F.size("tokens").cast("long").alias("n")).join(alone, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))
        able = stored(sized.where((F.col("n") - F.col("u")) * den >= F.col("n") * num))
        rows = stored(rows.join(able, "id"))
        left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
        links, labels = None, None
        for turn in range(rounds + 1):
            if labels is None:
                known = rows.withColumn("comp", F.col("id"))
            else:
                known = rows.join(labels, rows["id"] == labels["node"], "left").select("key", "id", "n", "u", F.coalesce("component", "id").alias("comp"))
            split = stored(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
            known = stored(known.join(split, "key"))
            if known.isEmpty():
                break
            if turn < rounds:
                pairs = _leader_pairs(known, turn, num, den)
                fresh = pairs.join(left, "a").join(right, "b").where(_linked("ta", "tb", num, den)).select("a", "b")
            else:
                fresh = _matrix_links(known, sets, num, den, group)
            fresh = stored(fresh)
            links = fresh if links is None else links.union(fresh)
            labels = stored(components(links))
        if labels is not None:
            return keep(labels)
    return members.sparkSession.createDataFrame([], members.select(F.col("id").alias("node"), F.col("id").alias("component")).schema)


def _apart(n, u, other_n, other_u, num: int, den: int):
    """Whether the tokens of their own keep two sets below the similarity: they share n - u tokens of either at most."""
    return F.least(n - u, other_n - other_u) * (den + num) < (n + other_n) * num


def _leader_pairs(known: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """One candidate pair per id: with the leader of one of its buckets, of another component and a size that can
    reach the similarity. Each round ranks the leaders differently: by tokens of their own and id first, then by a hash."""
    rank = F.struct("u", "id") if turn == 0 else F.struct(F.lit(0).cast("long").alias("u"), F.xxhash64(F.lit(turn), "id").alias("id"))
    lead = known.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "id", "n", "u", "comp")).alias("lead"))
    fits = (F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num) & (F.col("comp") != F.col("lead.comp"))
    fits &= ~_apart(F.col("n"), F.col("u"), F.col("lead.n"), F.col("lead.u"), num, den)
    # Of the leaders an id meets, the one with the most buckets in common: by MinHash the most similar one.
    met = known.join(stored(lead), "key").where(fits).groupBy("id", F.col("lead.id").alias("a")).agg(F.count("*").alias("c"))
    best = met.groupBy("id").agg(F.max(F.struct("c", "a")).alias("lead"))
    return best.select(F.col("id").alias("b"), F.col("lead.a").alias("a"))


def _matrix_links(known: DataFrame, sets: DataFrame, num: int, den: int, group: int) -> DataFrame:
    ids = known.select("id", "comp", "n", "u").distinct()
    alike = ids.groupBy("comp", "n", "u").agg(F.count("*").alias("alike"))
    sizes = alike.withColumn("size", F.sum("alike").over(W.partitionBy("comp")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("alike") / group)).cast("int")
    placed = stored(known.join(stored(sizes), ["comp", "n", "u"]).withColumn("part", F.struct("n", "u", part.alias("p"))))
    # The members of a group agree in size and in tokens of their own, so groups that these rule out are not asked. The query
    # is in the smaller component.
    columns = placed.select("key", F.col("comp").alias("gc"), F.col("part").alias("gp"), F.col("size").alias("gs")).distinct()
    smaller = F.struct("size", "comp") < F.struct(F.col("gs").alias("size"), F.col("gc").alias("comp"))
    fits = (F.least("n", "gp.n") * den >= F.greatest("n", "gp.n") * num) & ~_apart(F.col("n"), F.col("u"), F.col("gp.n"), F.col("gp.u"), num, den)
    asked = stored(placed.join(stored(columns), "key").where(smaller & fits).select("id", "gc", "gp").distinct())
    queried = asked.select("gc", "gp").distinct()
    inside = placed.select("id", F.col("comp").alias("gc"), F.col("part").alias("gp")).distinct().join(queried, ["gc", "gp"])
    members = stored(inside.join(sets, "id"))
    matrix = stored(members.groupBy("gc", "gp").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("all")))
    overlap = F.size(F.array_intersect("tokens", "all"))
    query = asked.join(sets, "id").join(matrix, ["gc", "gp"]).where(overlap * den >= F.size("tokens") * num)
    opened = query.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), "gc", "gp")
    inside = members.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), "gc", "gp")
    return opened.join(inside, ["gc", "gp"]).where(_linked("ta", "tb", num, den)).select("a", "b")
