"""Hard negatives by inner product: scores along a spanning tree of the anchors bound one another.

Anchors are dealt to blocks and all rows to chunks. Where a block meets a chunk, the block's anchors form a minimum
spanning tree. Moving from an anchor to its child changes the score of a row by at most the length of the edge times
the row's norm, so the (bounds of the) scores at the parent bound those at the child. A row is scored at the child only
where its bounds overlap a window that is still open there: the best positives so far, or the range of scores around a positive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

EXACT = float(2**53)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a minimum spanning tree by Euclidean distance, parents before children; the first is its own parent."""
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    if not n:
        return order, parent, edge
    at = int(np.argmin(np.square(points - points.mean(axis=0)).sum(axis=1)))
    near, by, open_ = np.full(n, np.inf), np.full(n, at), np.ones(n, bool)
    for i in range(n):
        order[i], parent[at], edge[at], open_[at] = at, by[at], 0.0 if i == 0 else math.sqrt(near[at]), False
        far = np.square(points - points[at]).sum(axis=1)
        closer = open_ & (far < near)
        near[closer], by[closer] = far[closer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(open_, near, np.inf)))
    return order, parent, edge


class Scores:
    """Exact integer scores of some rows with some anchors, and bounds on them along the tree."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        width = max(anchors.shape[1], rows.shape[1])
        self.anchors, self.rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
        with np.errstate(over="ignore"):
            self.norms = np.sqrt(np.square(self.rows).sum(axis=1))
            lengths = np.sqrt(np.square(self.anchors).sum(axis=1))
        # The sum of the absolute products is at most the product of the norms.
        self.plain = bool(lengths.max(initial=0) * self.norms.max(initial=0) < EXACT)
        if not self.plain:
            as_int = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
            self.wide_anchors, self.wide_rows = as_int(self.anchors), as_int(self.rows)
        self.low, self.high = np.empty((len(anchors), len(rows))), np.empty((len(anchors), len(rows)))
        self.scored = 0

    def widen(self, at: int, parent: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        # One more for the roundings of the bound itself.
        slack = edge * self.norms * (1 + 1e-9) + 1
        low, high = self.low[parent], self.high[parent]
        if not self.plain:
            slack = slack + np.maximum(np.abs(low), np.abs(high)) * 1e-9
        self.low[at], self.high[at] = low - slack, high + slack
        return self.low[at], self.high[at]

    def score(self, at: int, rows: np.ndarray) -> np.ndarray:
        """The scores of ``rows``, which replace their bounds."""
        self.scored += len(rows)
        if self.plain:
            own = (self.rows[rows] @ self.anchors[at]).astype(np.int64)
        else:
            own = (self.wide_rows[rows] * self.wide_anchors[at]).sum(axis=1) if len(rows) else np.zeros(0, object)
        self.low[at, rows] = self.high[at, rows] = own.astype(np.float64)
        return own


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _first(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; ``rows`` ascend, so ties go to the smaller one."""
    if len(scores) > 4 * k and scores.dtype == np.int64:
        keep = np.flatnonzero(scores >= _kth_largest(scores, k))
        return keep[np.argsort(-scores[keep], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def best_of_label(anchors: np.ndarray, anchor_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[list, int]:
    """(anchor, row, score) of the ``k`` best other rows of each anchor, and the number of scores made. All have one label;
    ``row_ids`` ascend."""
    made = Scores(anchors, rows)
    found, (order, parent, edge) = [], spanning_tree(anchors)
    for turn, at in enumerate(order):
        if turn == 0:
            some = np.arange(len(rows))
        else:
            low, high = made.widen(at, parent[at], edge[at])
            other = row_ids != anchor_ids[at]
            # k rows reach this at least; a row that cannot reach it is not among the best.
            some = np.flatnonzero(high >= _kth_largest(low[other], k))
        own = made.score(at, some)
        others = row_ids[some] != anchor_ids[at]
        some, own = some[others], own[others]
        first = _first(own, some, k)
        found += zip([anchor_ids[at]] * len(first), row_ids[some[first]].tolist(), own[first].tolist())
    return found, made.scored


def best_in_windows(
    anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, windows: list[list[tuple[int, int]]],
    rows: np.ndarray, row_ids: np.ndarray, row_labels: np.ndarray, k: int,
) -> tuple[list, int]:
    """(anchor, row, score): of each anchor's windows (from, to) of scores, the ``k`` best rows of another label in each, once;
    and the number of scores made."""
    made = Scores(anchors, rows)
    found, (order, parent, edge) = [], spanning_tree(anchors)
    for turn, at in enumerate(order):
        allowed = row_labels != anchor_labels[at]
        if turn == 0:
            some = np.arange(len(rows))
        else:
            low, high = made.widen(at, parent[at], edge[at])
            asked = np.zeros(len(rows), bool)
            for start, stop in windows[at]:
                inside = low[allowed & (low >= start) & (high <= stop)]  # these lie in the window for certain
                asked |= (high >= max(float(start), _kth_largest(inside, k))) & (low <= stop)
            some = np.flatnonzero(asked & allowed)
        own = made.score(at, some)
        some, own = some[allowed[some]], own[allowed[some]]
        picked = np.zeros(len(some), bool)
        for start, stop in windows[at]:
            hit = np.flatnonzero((own >= start) & (own <= stop))
            picked[hit[_first(own[hit], some[hit], k)]] = True
        found += zip([anchor_ids[at]] * int(picked.sum()), row_ids[some[picked]].tolist(), own[picked].tolist())
    return found, made.scored


def window(score: int, low: int, high: int, whole: int) -> tuple[int, int]:
    """The integer scores s with low * score <= whole * s <= high * score (none where the first is above the second)."""
    return -((-low * score) // whole), high * score // whole


FOUND = "anchor_id long, row_id long, score long"


def _found(rows: list) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "row_id", "score"])


def _by_id(table: pa.Table, id_col: str, label_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column(id_col).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], table.column(label_col).to_numpy()[order], matrix(table.column(vector_col))[order], order


def _rows(table: pa.Table):
    return _by_id(table, "id", "label", "vector")


def _anchors(table: pa.Table):
    return _by_id(table, "anchor_id", "anchor_label", "point")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100,
    chunk: int = 512, block: int = 1024, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``is_anchor`` holds.

    The score of a row is its inner product with the anchor; higher scores come first, ties by smaller id. The positives of an
    anchor are its ``positives`` first other rows of its label. For each of them the ``negatives`` first rows of another label with
    low * positive_score <= whole * negative_score <= high * positive_score are returned (all, if fewer; none for a negative positive score).

    Vectors hold whole numbers (as doubles); the shorter of two vectors counts as filled up with zeros. Rows with a null id, label or vector,
    or a null or non-finite component, take no part. Of rows that share an id the one with the smallest label, then vector, takes part. A score that does not fit
    a long is an error. An empty table gives no rows. Every row meets every anchor: a group of one block of about ``block`` anchors and
    one chunk of about ``chunk`` rows at a time, so a task's memory does not depend on the table, and equal vectors or a frequent label
    make no group larger.
    """
    given = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    given = given.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    given = stored(given.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*"))
    anchors = given.where("anchor").select(F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("point"))
    n_chunks, n_blocks = max(1, -(-given.count() // chunk)), max(1, -(-anchors.count() // block))
    key = ["block", "chunk"]
    chunk_of = F.pmod(F.xxhash64("id"), F.lit(n_chunks)).alias("chunk")
    block_of = F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(n_blocks)).alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = given.select("id", "label", "vector", chunk_of, every(n_blocks).alias("block"))

    def positives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _found([])
        (row_ids, row_labels, vectors, _), (ids, labels, points, _) = _rows(a), _anchors(b)
        out = []
        for own in np.unique(labels):
            here, there = labels == own, row_labels == own
            if there.any():
                out += best_of_label(points[here], ids[here], vectors[there], row_ids[there], positives)[0]
        return _found(out)

    right = anchors.select("*", block_of, every(n_chunks).alias("chunk"))
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(positives_of, FOUND)
    by = lambda *k: W.partitionBy(*k).orderBy(F.col("score").desc(), "row_id")
    best = near.withColumn("n", F.row_number().over(by("anchor_id"))).where(F.col("n") <= positives)
    best = stored(best.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")))

    def negatives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _found([])
        (row_ids, row_labels, vectors, _), (ids, labels, points, order) = _rows(a), _anchors(b)
        scores = b.column("scores").to_pylist()
        windows = [[w for w in {window(s, low, high, whole) for s in scores[i]} if w[0] <= w[1]] for i in order]
        return _found(best_in_windows(points, ids, labels, windows, vectors, row_ids, row_labels, negatives)[0])

    # At most ``positives`` scores per anchor.
    scores = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    right = anchors.join(scores, "anchor_id").select("*", block_of, every(n_chunks).alias("chunk"))
    far = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(negatives_of, FOUND)
    wide = lambda n, c: F.lit(n) * F.col(c).cast("decimal(20,0)")  # noqa: E731  products may leave a long
    inside = wide(whole, "score").between(wide(low, "positive_score"), wide(high, "positive_score"))
    pairs = stored(far).join(best, "anchor_id").where(inside)
    ranked = pairs.withColumn("rank", F.row_number().over(by("anchor_id", "positive_id"))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
