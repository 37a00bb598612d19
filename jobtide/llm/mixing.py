"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import global_position, rank_in_groups, slice_by_order
from .common import WORD, stored

CHUNK = 4096
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source, n_docs, source_size, target. ``sizes`` has source and size.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until none is above.
    Each round is one aggregate over the table of sources, of which only three numbers come back.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    placed = stored(global_position(per, [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"), F.col("n_docs")], "position"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights)).cast("int"))
    limit = F.col("source_size") * float(most)
    ranked = placed.select("source", "position", "n_docs", "source_size", weight.alias("weight"), limit.alias("limit"))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None  # words per unit of weight
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= F.col("limit")
        used, left, n = ranked.agg(
            F.sum(F.when(capped, F.col("limit"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)
        ).first()
        now = (total - (used or 0.0)) / left if left else None
        if now is None or (level is not None and now <= level):
            break
        level = now
    target = F.col("limit") if now is None else F.least(F.col("limit"), F.col("weight") * float(level))
    return ranked.select("source", F.col("position").alias("source_no"), "n_docs", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, landing: bool = False) -> np.ndarray:
    """Move probabilities through the null space of (number, size) until at most two are fractional.

    Three fractional units always have a direction that keeps both totals: (b - c, c - a, a - b) for sizes a, b, c.
    A step goes to one of its two ends with the chances that keep every unit's expectation. The landing gives
    up the number first, then the size.
    """
    p = p.copy()
    x = size.astype(float)
    active: list[int] = []
    rest = iter(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist())
    draws = iter(())
    while True:
        while len(active) < 3 and (k := next(rest, None)) is not None:
            active.append(k)
        n = len(active)
        if n == 3:
            a, b, c = x[active[0]], x[active[1]], x[active[2]]
            u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        elif n == 2 and (x[active[0]] == x[active[1]]):
            u = (1.0, -1.0)
        elif not landing or not n:
            break
        elif n == 2 and x[active[0]] > 0 and x[active[1]] > 0:
            u = (x[active[1]], -x[active[0]])
        else:
            u = (1.0,) + (0.0,) * (n - 1)
        up = down = np.inf
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for k, d in zip(active, u):
            p[k] += step * d
        kept = []
        for k in active:
            if p[k] <= _EPS:
                p[k] = 0.0
            elif p[k] >= 1 - _EPS:
                p[k] = 1.0
            else:
                kept.append(k)
        active = kept
    return p


def settle(taken: np.ndarray, size: np.ndarray, wanted: float, swaps: int = 8) -> np.ndarray:
    """Exchange a taken unit for another one, at most ``swaps`` times, while that brings the size nearer to ``wanted``.
    The number of units stays."""
    taken = taken.copy()
    for _ in range(swaps):
        off = float(size[taken].sum()) - wanted
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(inside) or not len(outside):
            break
        outside = outside[np.argsort(size[outside], kind="stable")]
        at = np.searchsorted(size[outside], size[inside] - off)
        best = None
        for shift in (-1, 0):
            j = np.clip(at + shift, 0, len(outside) - 1)
            left = np.abs(off + size[outside[j]] - size[inside])
            k = int(left.argmin())
            if best is None or left[k] < best[0]:
                best = float(left[k]), inside[k], outside[j[k]]
        if best[0] >= abs(off) - _EPS:
            break
        taken[best[1]], taken[best[2]] = False, True
    return taken


def _fly(seed: int, level: int, landing: bool):
    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Largest first, so that the units left undecided at the end are small and land close to the totals.
        rows = rows.sort_values(["size", "place", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        before, size = rows["p"].to_numpy(float), rows["size"].to_numpy()
        after = flight(before, size, rng, landing)
        if landing:
            open_ = (before > _EPS) & (before < 1 - _EPS)
            after[open_] = settle(after[open_] > 0.5, size[open_], float((before * size)[open_].sum()))
        rows["p"] = after
        return rows

    return chunk


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (copies * size).

    Each document should be taken target / source_size times: the whole part of that is given to all documents, the
    rest is an inclusion probability. The cube method decides it: within chunks of about ``CHUNK`` documents of
    a source a flight keeps the number of documents and of words exactly, leaving at most two undecided; those are
    gathered into chunks again, level by level, until a source has one chunk, whose last two units land with
    the number given up first, and then trade places while that brings the words nearer to the target. Chunks are dealt by a hash of the id, so a source with a third of all rows is
    spread over as many tasks as it has chunks, and reruns agree.

    ``size`` defaults to the number of words of the text (null: 0). A null source is a source, a null id is allowed,
    repeated rows are documents of their own, sources without words take nothing. An empty table gives no rows.
    """
    count = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)) if size is None else size
    sizes = stored(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(count.cast("long"), F.lit(0)).alias("size")))
    targets = stored(source_targets(sizes, weights, share, most))
    chunks = targets.agg(F.max(F.ceil(F.col("n_docs") / CHUNK))).first()[0] or 1
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_s"), "source_no", "n_docs", "source_size", "target", times.alias("times"))
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    units = (
        sizes.join(t, sizes["source"].eqNullSafe(t["_s"])).drop("_s")
        .withColumns({"whole": F.floor(F.col("times") + _EPS).cast("long"), "place": place})
        .withColumn("p", F.greatest(F.lit(0.0), F.col("times") - F.col("whole")))
        .withColumn("own", F.ceil(F.col("n_docs") / CHUNK).cast("long"))
        .select("doc_id", "source_no", "size", "place", "whole", "p", "own")
    )
    decided, level = [], 0
    while True:
        landing = chunks <= 1
        own = units.schema
        flown = stored(
            units.withColumn("chunk", F.pmod(F.xxhash64("place", F.lit(level)), F.col("own")))
            .groupBy("source_no", "chunk").applyInPandas(_fly(seed, level, landing), own.add("chunk", "long"))
            .drop("chunk")
        )
        if landing:
            decided.append(flown)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~open_))
        left = lambda n: -(-2 * n // CHUNK)  # noqa: E731  two units a chunk at most
        units = flown.where(open_).withColumn("own", F.ceil(2 * F.col("own") / CHUNK).cast("long"))
        chunks, level = left(chunks), level + 1
    out = decided[0]
    for part in chain(decided[1:]):
        out = out.unionByName(part)
    copies = F.col("whole") + F.when(F.col("p") > 0.5, 1).otherwise(0)
    named = targets.select("source_no", "source", "source_size", "target")
    return out.join(named, "source_no").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated as often as ``mixed`` (of :func:`mix_sources`) takes it.

    Rows that agree in id, source and size share their copies: each gets the whole part of its share and the first ones, in any order, one of the
    rest, so the copies and words taken are those decided. Null ids and sources agree with one another.
    """
    share = mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).where("c > 0")
    share = stored(share.select(
        F.col("doc_id").alias("_jt_id"), F.col("source").alias("_jt_source"), F.col("size").alias("_jt_size"),
        F.floor(F.col("c") / F.col("n")).cast("int").alias("_jt_copies"), (F.col("c") % F.col("n")).alias("_jt_rest"),
    ))
    size = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD))
    same = lambda part: docs[id_col].eqNullSafe(part["_jt_id"]) & docs[source_col].eqNullSafe(part["_jt_source"]) & (size == part["_jt_size"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeat = lambda rows, copies: rows.withColumn("_jt_n", F.explode(F.sequence(F.lit(1), copies))).select(*columns)
    even, uneven = share.where("_jt_rest = 0"), share.where("_jt_rest > 0")
    out = repeat(docs.join(even, same(even)), F.col("_jt_copies"))
    if uneven.isEmpty():
        return out
    # The rows of such groups are numbered; one group may hold any part of the table, so that is done by slices.
    rows = stored(docs.join(uneven, same(uneven)).withColumn("_jt_row", F.monotonically_increasing_id()))
    order = [F.col("_jt_row")]
    keyed = rows.select("_jt_row", F.xxhash64("_jt_id", "_jt_source", "_jt_size", F.isnull("_jt_id"), F.isnull("_jt_source")).alias("_jt_group"))
    placed = rank_in_groups(slice_by_order(keyed, order), F.col("_jt_group"), order, "_jt_place").select("_jt_row", "_jt_place")
    copies = F.col("_jt_copies") + (F.col("_jt_place") <= F.col("_jt_rest")).cast("int")
    own = rows.join(placed, "_jt_row").withColumn("_jt_copies", copies).where("_jt_copies > 0")
    return out.union(repeat(own, F.col("_jt_copies")))
