"""Jaccard components and repeated paragraphs against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from jobtide.llm import jaccard_join, kernels, similarity, substring_dedup
from jobtide.llm.kernels import Banding

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w]


def shingles(t, k):
    w = split(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(seed=4, bases=25, copies=10, words=120):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Ka", "lo", "mü", "ti", "re") for b in range(60)]
    rows, n = [], 0
    for _ in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 8, words, words * 3]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = "  ".join(w) if rng.random() < 0.5 else "\n".join(w).upper()
            rows.append((n, t))
            n += 1
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, LONG), (9004, LONG + "x"), (9005, "ONE"), (9006, "one"), (9007, "one two"), (9008, " one"), (9009, "One  two")]


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    linked = [(a, b) for x, (a, s) in enumerate(flat) for b, t in flat[:x] if den * len(s & t) >= num * len(s | t)]
    return closure(list(sets), linked)


@pytest.mark.parametrize("k,num,den,banding,rounds", [(3, 9, 10, Banding(20, 4), 3), (5, 4, 5, Banding(40, 4), 3), (3, 9, 10, Banding(20, 4), 0)])
def test_components(docs_of, monkeypatch, k, num, den, banding, rounds):
    # With no leader rounds all links come through the token-group matrix.
    own = similarity.link_components
    monkeypatch.setattr(jaccard_join, "link_components", lambda m, s, a, b: own(m, s, a, b, group=3, rounds=rounds))
    rows = near_copies()
    got = jaccard_join.jaccard_components(docs_of(rows), k, num, den, banding).collect()
    want = brute(rows, k, num, den)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, k)) for i, t in rows}
    assert len(set(want.values())) < len(rows) - 15


def test_chain_and_repeated_ids(docs_of):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(i, " ".join([f"x{j}" for j in range(i)] + w[i:])) for i in range(40)]  # each near the next only
    rows += [(70, rows[5][1]), (70, "entirely other words in this text"), (71, "entirely other words in this text"), (None, rows[6][1])]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(docs_of(rows), 3, 9, 10).collect()}
    want = brute([r for r in rows if r[0] is not None], 3, 9, 10)
    assert len(set(want.values())) == 1
    assert all(v == want[i] for (i, _), v in got.items() if i is not None) and {v for (i, _), v in got.items() if i is None} == {None}
    empty = jaccard_join.jaccard_components(docs_of([]))
    assert empty.count() == 0 and jaccard_join.jaccard_components(docs_of([(1, "a"), (2, None)])).count() == 2


def test_words_agree():
    texts = ["A bÉ c\x1fd\x0be", "", None, "  x ", "\n", LONG, "😀 É\té"]
    n = 0
    for row, to, data, begin in kernels.slices(pa.array(texts)):
        found = kernels.words(data, begin)
        hashes = found.hashes()
        for i in range(to - row):
            own = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts[found.first[i] : found.first[i + 1]], found.ends[found.first[i] : found.first[i + 1]])]
            assert own == split(texts[row + i])
            one = kernels.words(*[x for x in kernels.slices(pa.array([" ".join(own)]))][0][2:]).hashes() if own else []
            assert np.array_equal(hashes[found.first[i] : found.first[i + 1]], one)
            n += 1
    assert n == len(texts)


def passage_rows():
    rng = random.Random(12)
    word = lambda: f"{rng.choice('aeiou')}{rng.randrange(5000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(51, 90)) for _ in range(12)]
    rows, holds = [], {}
    for d in range(120):
        t = text(rng.randrange(0, 300))
        if d % 3 == 0:
            p = rng.randrange(12)
            holds.setdefault(p, []).append(d)
            t = f"{t} {passages[p]} {text(rng.randrange(0, 100))}"
        elif d % 3 == 1:
            t += "\nthe same short line that many documents have\n" + text(20)
        rows.append((d, t))
    near = text(60).split()
    for d in range(200, 206):
        w = list(near)
        w[d - 200] = "other"
        rows.append((d, f"{text(40)}\n{' '.join(w)}\n{text(30)}"))
    return rows + [(300, None), (301, ""), (302, "The " * 3000), (303, "The " * 3000), (304, LONG), (None, rows[0][1])], holds, passages


def test_repeated_passages(docs_of):
    rows, holds, passages = passage_rows()
    docs = docs_of(rows)
    repeated = substring_dedup.repeated_paragraphs(docs).collect()
    texts = dict(r for r in rows if r[0] is not None)
    loses = {r.doc_id for r in repeated if r.removed}
    for p, ids in holds.items():
        if len(ids) > 1:
            assert sorted(ids)[1:] == [d for d in sorted(ids) if d in loses], p
            assert {r.keep_id for r in repeated if r.doc_id in ids} == {min(ids)}
    allowed = {d for ids in holds.values() for d in ids} | set(range(200, 206)) | {302, 303}
    assert {r.doc_id for r in repeated} <= allowed
    assert loses & set(range(200, 206)) == set(range(201, 206)) and 303 in loses
    for r in repeated:
        own, kept = texts[r.doc_id][r.start : r.stop], texts[r.keep_id][r.keep_start :]
        if r.doc_id < 200:
            assert kept.startswith(own)
            assert any(own in p for p in passages)
    # every run of 50 shared words is seen
    by = {r.doc_id: r for r in substring_dedup.removals(substring_dedup.repeated_paragraphs(docs)).collect()}
    assert set(by) == loses
    for d, r in by.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert r.removed_chars == sum(b - a for a, b in spans) and set(r.keep_ids) == {x.keep_id for x in repeated if x.doc_id == d and x.removed}
    assert substring_dedup.repeated_paragraphs(docs_of([])).count() == 0


def test_recall_of_bands():
    rng = np.random.default_rng(2)
    for banding, s, least in ((Banding(20, 4), 0.9, 1.0), (Banding(40, 4), 0.8, 1.0), (Banding(10, 3), 0.8, 0.97)):
        hit = 0
        for _ in range(200):
            n = 180
            both = int(round(2 * n * s / (1 + s)))
            pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            hit += bool(set(banding.keys(a)) & set(banding.keys(b)))
        assert hit / 200 >= least
