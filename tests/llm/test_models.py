"""Toxicity chain, language-model scores and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from jobtide.llm import lm_score, toxicity

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def toxic_rows(n=900, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bad, junk = ["scum", "idiot", "moron"], ["%%%", "$$$buy", "click"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        low, tox = rng.random() < 0.25, False
        if low:
            w += [rng.choice(junk) for _ in range(6)]
        tox = rng.random() < (0.5 if low else 0.1)
        if tox:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad).title() + rng.choice([",", ".", "!", ""]))
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if low else 1, int(tox)))
    return rows, labels


def test_toxicity(spark, docs_of):
    rows, labels = toxic_rows()
    rows += [(5000, None), (5001, ""), (5002, LONG), (5003, "You SCUM! idiot,moron " * 3), (None, "scum idiot"), (3, rows[3][1])]
    given = [x for x in labels if x[0] % 2] + [(1, 1, None), (None, 1, 1), (7777, 1, 1), labels[1], (6001, None, 0)]
    table = spark.createDataFrame([(*x, "clash") for x in given], "doc_id long, quality int, toxic int, slots string")
    got = toxicity.toxicity(docs_of(rows), table, sample=400).collect()
    assert len(got) == len(rows)
    assert toxicity.toxicity(docs_of(rows), table, sample=400).collect() is not None
    truth = {i: (q == 0, t == 1) for i, q, t in labels}
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0]
    for j, name in enumerate(("low_quality", "toxic")):
        right = np.mean([r[name] == truth[r.doc_id][j] for r in unseen])
        assert right > 0.96, (name, right)
    by = {r.doc_id: r for r in got}
    assert by[5003].toxic and not by[5000].toxic and not by[5001].toxic and not by[5002].toxic
    assert all(0 <= r.p_toxic <= 1 for r in got)
    again = sorted(toxicity.toxicity(docs_of(rows).repartition(5), table, sample=400).collect(), key=str)
    assert [(r.doc_id, round(r.p_toxic, 9), r.toxic) for r in again] == [(r.doc_id, round(r.p_toxic, 9), r.toxic) for r in sorted(got, key=str)]
    none = toxicity.toxicity(docs_of(rows), table.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.toxic or r.low_quality for r in none)
    assert toxicity.toxicity(docs_of([]), table).count() == 0


def test_chain_uses_earlier_probabilities():
    # The second category is the first one turned round, and has no word of its own.
    rng = np.random.default_rng(5)
    first = rng.random(600) < 0.5
    lists = [np.unique(np.append(rng.integers(10, 200, 8), [1] if f else [2])) for f in first]
    labels = np.stack([first, ~first], 1)
    chain = toxicity.train_chain(lists, labels, np.arange(600) % 5, ("a", "b"), 10, 5)
    assert chain.models[1].earlier[0] < -0.5
    p = toxicity._predict(chain.models, toxicity.Rows(lists), 10)
    assert ((p[:, 1] > 0.5) == ~first).mean() > 0.98


def lm_rows():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)]
    pairs = {w: rng.choice(vocab) for w in vocab}
    rows = []
    for i in range(150):
        w = [rng.choice(vocab)]
        for _ in range(rng.randrange(0, 200)):
            w.append(pairs[w[-1]] if rng.random() < 0.8 else rng.choice(vocab))
        rows.append((i, (" " if i % 3 else "\n").join(w).title()))
    return rows + [(900, None), (901, ""), (902, LONG), (903, "É unseen Ünseen ünseen \x1c x"), (None, "a null id"), (5, rows[5][1])]


def test_lm_scores(docs_of):
    rows = lm_rows()
    got = lm_score.lm_scores(docs_of(rows), dictionary=250, table_bits=14).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, ends = {}, 0
    for i, t in rows:
        if not held(i):
            ends += 1
            for w in (t or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    texts = {}
    for i, t in rows:
        texts.setdefault(i, (t or "").encode().lower().split())
    for r in got:
        own = [counts.get(w, 0) for w in texts[r.doc_id]] + [ends]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c > 0 for c in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in own), abs=1e-6)
        assert r.score < 0
    unseen = [r for r in got if r.held_out and r.doc_id < 150]
    assert sum(r.score for r in unseen) > 0.9 * sum(r.base_score for r in unseen)  # contexts help
    assert lm_score.lm_scores(docs_of([])).count() == 0
    alone = lm_score.lm_scores(docs_of([(i, "x y") for i in range(40) if held(i)]))
    assert {(r.n_known, r.train_tokens) for r in alone.collect()} == {(0, 0)}


def test_code_lengths_are_a_distribution():
    words = [b"w%d" % i for i in range(40)]
    ranks = {w: i for i, w in enumerate(words)}
    size = lm_score.table_size(12)
    rng = np.random.default_rng(3)
    table = (np.arange(size), rng.integers(0, 9, size), rng.integers(0, 9, size))
    model = lm_score.make_model(ranks, np.ones(40), 3, table, 12)
    for prefix in ([], [words[3]], [b"strange", words[7], words[7], words[39]] * 3):
        total = 0.0
        for word in [*words, b"other"]:
            codes, _ = lm_score.encode([[*prefix, word, words[1]]], ranks)
            total += 2 ** -lm_score.code_lengths(model, codes)[len(prefix)]
        codes, _ = lm_score.encode([prefix], ranks)
        total += 2 ** -lm_score.code_lengths(model, codes)[len(prefix)]
        assert total <= 1 + 1e-6
        assert total > 0.01  # random tables give much to ranks and classes that this dictionary does not have


def test_pipeline(spark, docs_of, tmp_path):
    rows, labels = toxic_rows(400, 6)
    rng = random.Random(1)
    item = " ".join(f"item{rng.randrange(10**6)}" for _ in range(30))
    w = [f"w{rng.randrange(400)}" for _ in range(200)]
    extra = [(1000, " ".join(w)), (1001, " ".join(w[:199])), (1002, " ".join(w)), (1003, f"{rows[0][1]} {item} {rows[1][1]}"), (1004, None), (1005, "")]
    docs = docs_of([(i, t, "en", f"s{i % 3 if i else 0}") for i, t in rows + extra]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/step{k}")
        now = spark.read.parquet(f"{tmp_path}/step{k}")
        if k < 4:
            assert sorted(now.columns) == sorted(docs.columns)
        steps[name] = [r.doc_id for r in now.select("doc_id").collect()]
    truth = {i: t for i, _, t in labels}
    clean = [i for i in steps["toxicity"] if i < 400]
    assert np.mean([truth[i] for i in clean]) < 0.03 and len(clean) > 0.95 * sum(not t for t in truth.values())
    assert set(steps["toxicity"]) - set(steps["ngram_jaccard_join"]) == {1001, 1002}
    assert set(steps["ngram_jaccard_join"]) - set(steps["decontamination"]) == {1003}
    assert set(steps["mixing"]) <= set(steps["decontamination"]) and len(steps["mixing"]) > len(set(steps["mixing"]))
    assert sorted(steps["token_output"]) == sorted(steps["mixing"])
    done = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert done == {tuple(r) for r in now.collect()}
