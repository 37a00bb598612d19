"""Hard negatives and centroid clusters against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import centroids, hard_negatives


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        clash = ("id", "vector", "anchor", "chunk", "block", "score", "cluster", "v", "n", "rank")
        return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3)

    return make


def whole_vectors(n, dim, seed, spread=40):
    rng = random.Random(seed)
    middles = [[rng.randrange(-100, 100) for _ in range(dim)] for _ in range(4)]
    return [[float(x + rng.randrange(-spread, spread)) for x in middles[i % 4]] for i in range(n)]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, positives, negatives, low, high, whole, every):
    known = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and sound(r[1])), key=lambda r: (r[2], r[1])):
        known.setdefault(i, ([int(x) for x in v], label))
    out = set()
    for a, (va, la) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in known.items() if i != a)
        for s, p in [(-s, i) for s, i, label in scored if label == la][:positives]:
            hits = [(-t, i) for t, i, label in scored if label != la and low * s <= whole * -t <= high * s][:negatives]
            out |= {(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(hits)}
    return out


def mined(df, **more):
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **more)
    return [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect()]


@pytest.mark.parametrize("chunk, block", [(512, 1024), (16, 4)])
def test_negatives_equal_brute_force(vectors_of, chunk, block):
    rows = [(i, v, i % 3) for i, v in enumerate(whole_vectors(120, 6, 1))]
    rows += [(200 + i, rows[5][1], i % 2) for i in range(40)]  # equal vectors: ties by id
    rows += [(None, rows[0][1], 0), (301, None, 0), (302, rows[0][1], None), (303, [None] * 6, 0), (304, [math.nan] * 6, 1), (305, [math.inf] * 6, 1)]
    rows += [(306, [1.0, 2.0], 1), (310, [], 1), rows[3], (4, rows[9][1], 7)]  # shorter ones, a repeated row and a repeated id
    got = mined(vectors_of(rows), positives=3, negatives=4, chunk=chunk, block=block)
    assert len(got) == len(set(got))
    assert set(got) == brute_negatives(rows, 3, 4, 30, 90, 100, 5)


def test_wide_numbers_stay_exact(vectors_of):
    rows = [(i, [float(2**29 + 3 * i), float(2**29 - i), 1.0], i % 2) for i in range(20)]
    got = mined(vectors_of(rows), positives=2, negatives=3, low=0, high=100)
    assert got and set(got) == brute_negatives(rows, 2, 3, 0, 100, 100, 5)


def test_no_anchors_and_no_rows(vectors_of):
    assert mined(vectors_of([])) == []
    assert mined(vectors_of([(1, [1.0], 0), (2, [2.0], 1)])) == []
    assert mined(vectors_of([(5, [1.0], 0)])) == []  # an anchor without positives


def test_bounds_hold_along_the_tree_and_spare_work():
    rng = np.random.default_rng(7)
    middles = rng.integers(-200, 200, (6, 16))
    rows = (middles[rng.integers(0, 6, 400)] + rng.integers(-20, 20, (400, 16))).astype(float)
    anchors = rows[:40]
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(40))
    made = hard_negatives.Scores(anchors, rows)
    exact = anchors @ rows.T
    made.score(order[0], np.arange(400))
    for at in order[1:]:
        low, high = made.widen(at, parent[at], edge[at])
        assert (low <= exact[at]).all() and (exact[at] <= high).all()
    ids, labels = np.arange(400), np.zeros(400, np.int64)
    labels[200:] = 1
    windows = [[hard_negatives.window(int(np.sort(r)[-2]), 30, 90, 100)] for r in exact]
    _, scored = hard_negatives.best_in_windows(anchors, ids[:40], labels[:40], windows, rows, ids, labels, 10)
    assert scored < 0.7 * 40 * 200


def brute_clusters(rows, k, rounds, size, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if sound(v) and len(v) == size]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    points = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(points))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        points = [tuple(sum(x) // len(own[n]) for x in zip(*own[n])) if n in own else c for n, c in enumerate(points)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    per = {n: sum(d for _, m, d in last if m == n) for n in range(len(points))}
    return sorted(((i, n, d, per[n], sum(per.values()), points[n]) for i, n, d in last), key=str)


def clustered(df, **more):
    found = centroids.centroid_clusters(df, **more).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in found), key=str)


def test_clusters_equal_brute_force(vectors_of):
    base = [[x / 64 for x in v] for v in whole_vectors(150, 5, 3, spread=90)]
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(900, 960)]  # many equal vectors
    rows += [(7, base[1]), (7, base[2]), (None, base[3]), (800, None), (801, [1.0]), (802, []), (803, [math.nan] * 5), (804, [None] * 5), (805, [-math.inf] * 5)]
    df = vectors_of([(i, v, 0) for i, v in rows])
    assert clustered(df, k=8, rounds=3, size=5, scale=64) == brute_clusters(rows, 8, 3, 5, 64)


def test_few_vectors_and_none(vectors_of):
    rows = [(i, [float(i % 2), 0.0]) for i in range(5)]  # fewer vectors than centroids, equal centroids that stay empty
    assert clustered(vectors_of([(i, v, 0) for i, v in rows]), k=16, rounds=2, size=2, scale=64) == brute_clusters(rows, 16, 2, 2, 64)
    assert clustered(vectors_of([]), size=2) == []
    assert clustered(vectors_of([(1, [0.5], None)]), size=2) == []


def test_search_ends_early_and_is_exact():
    rng = np.random.default_rng(5)
    points = rng.integers(-1000, 1000, (64, 3))
    rows = np.repeat(points, 10, axis=0) + rng.integers(-30, 30, (640, 3))
    here, dist, made = centroids.Centroids(points).nearest(rows)
    exact = np.square(rows[:, None, :] - points[None, :, :]).sum(axis=2)
    assert (here == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all()
    assert made < 0.6 * exact.size
    # Ties on the line between two centroids, met at exactly twice the distance.
    here, dist, _ = centroids.Centroids(np.array([[4], [0], [0]])).nearest(np.array([[2], [0], [5]]))
    assert here.tolist() == [0, 1, 0] and dist.tolist() == [4, 0, 1]
