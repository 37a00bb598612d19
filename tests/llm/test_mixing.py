"""Targets against a plain loop, and the balance of the sample."""

import numpy as np
import pytest

from jobtide.llm import mixing
from jobtide.llm.common import WORD  # noqa: F401


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()) * share, set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        free -= full
    return out


def rows_of(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.lognormal(3, 1)), "en", str(rng.choice(["big", "b", "é", "Z", "z9"], p=[0.5, 0.2, 0.1, 0.1, 0.1]))) for i in range(900)]
    rows += [(1000 + i, "v " * 7, "en", None) for i in range(40)] + [(2000, None, "en", "b"), (2001, "", "en", "void"), (None, "a b", "en", "b")]
    return rows + [(3000, "same text here", "en", "z9")] * 3 + [(4000, "long " * 20000, "en", "giant"), (4001, "x", "en", "giant")]


def test_mix(docs_of, monkeypatch):
    rows = rows_of()
    sizes, totals = {}, {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    monkeypatch.setattr(mixing, "CHUNK", 100)  # several chunks and levels
    docs = docs_of(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2.0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        totals[r.source] = totals.get(r.source, 0) + r.taken
    for s, t in totals.items():
        assert abs(t - want[s]) <= max(0.02 * want[s], 1.5) or s in (None, "giant"), (s, t, want[s])
    assert abs(totals[None] - want[None]) <= 7
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    mixed = mixing.mix_sources(docs)
    out = mixing.take(docs, mixed)
    assert out.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    taken = {}
    for r in out.select(docs["doc_id"]).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert {k: v for k, v in copies.items() if v} == taken


def test_every_decided_copy_is_taken(docs_of):
    rng = np.random.default_rng(2)
    text = lambda i: " ".join(f"w{i % 7}" for _ in range(1 + i % 5))
    rows = [(int(i), text(i), "en", f"s{i % 3}") for i in range(300)] + [(int(rng.integers(0, 40)), text(i), "en", "s1") for i in range(400)]
    rows += [(None, text(i) if i % 9 else None, "en", "s0" if i % 2 else None) for i in range(200)]
    docs = docs_of(rows)
    mixed = mixing.mix_sources(docs)
    decided, words = mixed.agg({"copies": "sum", "taken": "sum"}).select("sum(copies)", "sum(taken)").first()
    out = mixing.take(docs, mixed).select("doc_id", "text", "source").collect()
    assert (len(out), sum(len((r.text or "").split()) for r in out)) == (decided, words)
    per = {}
    for r in out:
        per[(r.doc_id, r.source)] = per.get((r.doc_id, r.source), 0) + 1
    want = {}
    for r in mixed.collect():
        if r.copies:
            want[(r.doc_id, r.source)] = want.get((r.doc_id, r.source), 0) + r.copies
    assert per == want
    assert mixing.take(docs.limit(0), mixing.mix_sources(docs.limit(0))).count() == 0


def test_flight_keeps_both_totals_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 300), np.full(300, 0.37)
    mean = np.zeros(300)
    for _ in range(300):
        q = mixing.flight(p, size, rng)
        open_ = (q > 1e-9) & (q < 1 - 1e-9)
        assert open_.sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
        mean += q / 300
    assert abs(mean - 0.37).max() < 0.12
