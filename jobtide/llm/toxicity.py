"""Toxicity by a classifier chain of sparse linear models with out-of-fold inputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, texts
from .kernels import PUNCTUATED, slices, words

# Category, label column and the value that means "yes", in the order of the chain.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def word_features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct hashed words of each text."""
    for _, _, data, begin in slices(column):
        found = words(data, begin, PUNCTUATED)
        slot = (found.hashes() >> np.uint64(64 - bits)).astype(np.int64)
        for i in range(len(begin) - 1):
            yield np.unique(slot[found.first[i] : found.first[i + 1]])


@dataclass
class Linear:
    """A logistic model: sparse word weights, a weight for each earlier category, and a bias."""

    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, dense: np.ndarray, earlier: np.ndarray, rows: "Rows") -> np.ndarray:
        return rows.sums(dense) + earlier @ self.earlier + self.bias


@dataclass
class Rows:
    """Feature lists of documents, end to end."""

    lists: list[np.ndarray]
    flat: np.ndarray = field(init=False)
    counts: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self):
        self.counts = np.fromiter(map(len, self.lists), np.int64, len(self.lists))
        self.flat = np.concatenate(self.lists) if self.lists else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.lists)), self.counts)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], len(self.lists)) if len(self.flat) else np.zeros(len(self.lists))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, bits: int, penalty: float = 0.0025, rounds: int = 80) -> Linear:
    """Proximal gradient with momentum on the mean log loss plus ``penalty`` times the absolute word weights, so words
    without a bearing get the weight zero. With one class only the bias is set."""
    size = 1 << bits
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    w, e = np.zeros(size), np.zeros(earlier.shape[1])
    if len(y) and 0 < y.sum() < len(y):
        # Each word steps by its own curvature bound: a quarter of its share of the documents, times a margin for overlap.
        share = np.bincount(rows.flat, minlength=size) / len(y)
        step = 1 / (0.25 * np.maximum(share, 1 / len(y)) * 12 + 1e-4)
        last_w, last_e, last_b, t = w, e, bias, 1.0
        vw, ve, vb = w, e, bias
        for _ in range(rounds):
            r = (sigmoid(rows.sums(vw) + earlier @ ve + vb) - y) / len(y)
            grad = np.bincount(rows.flat, r[rows.owner], size)
            moved = vw - step * grad
            w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty * np.sqrt(share + 1e-12), 0)
            e, bias = ve - 0.5 * (earlier.T @ r), vb - 0.5 * r.sum()
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            m = (t - 1) / after
            vw, ve, vb = w + m * (w - last_w), e + m * (e - last_e), bias + m * (bias - last_b)
            last_w, last_e, last_b, t = w, e, bias, after
    slots = np.flatnonzero(w)
    return Linear(slots, w[slots], e, float(bias))


def _dense(model: Linear, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits)
    out[model.slots] = model.weights
    return out


def _predict(models: list[Linear], rows: Rows, bits: int) -> np.ndarray:
    """Probabilities (documents, categories); each model gets those of the models before it."""
    out = np.zeros((len(rows.lists), len(models)))
    for j, model in enumerate(models):
        out[:, j] = sigmoid(model.logits(_dense(model, bits), out[:, :j], rows))
    return out


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]
    bits: int


def train_chain(lists: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, names: tuple[str, ...], bits: int, folds: int) -> Chain:
    """Fit the chain. The probabilities that a later model is trained on are out of fold: each comes from a model
    that has not seen the document. A category's threshold gives the best F1 out of fold."""
    rows, n = Rows(lists), len(lists)
    outside = np.zeros((n, labels.shape[1]))
    models, thresholds = [], []
    for j in range(labels.shape[1]):
        earlier, y = outside[:, :j], labels[:, j].astype(float)
        for f in range(folds):
            held, own = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            part = fit(Rows([lists[i] for i in own]), earlier[own], y[own], bits)
            outside[held, j] = sigmoid(part.logits(_dense(part, bits), earlier[held], Rows([lists[i] for i in held])))
        models.append(fit(rows, earlier, y, bits))
        thresholds.append(best_threshold(outside[:, j], y))
    return Chain(names, models, thresholds, bits)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    if not len(y) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((p[order[k]] + after) / 2, 0.02, 0.98))


def toxicity(
    docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str, object], ...] = CHAIN, sample: int = 8000, bits: int = 18, folds: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability per category (p_<name>) and a decision per category (<name>).

    Each category of the chain has a linear model over the hashed words of the text (A-Z lower-cased, punctuation
    dropped) and the probabilities of the categories before it. The models are fitted on the driver on at most
    ``sample`` labelled documents, those with the smallest hash of their id; this is the only bounded step.
    Scoring reads every whole text.

    Null and empty texts have no words and get the bias. Labels that are null are left out; repeated labels of an id
    count once (the largest). Without labels every probability is that of the bias and no category is decided yes.
    An empty table gives no rows.
    """
    names = tuple(name for name, _, _ in chain)
    wanted = [F.max((labels[c] == value).cast("int")).alias(name) for name, c, value in chain]
    known = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*wanted).where("doc_id IS NOT NULL").dropna()
    given = texts(docs, id_col, text_col)
    # Semi-joined first, so that labels without a document do not use up the sample.
    there = known.join(given.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = stored(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    sampled = given.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of a few numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = list(word_features(batch.column("text"), bits))
            column = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(n) for n in names], column], ["doc_id", *names, "slots"])

    schema = "doc_id long, " + ", ".join(f"`{n}` int" for n in names) + ", slots array<int>"
    # One text per id; the order makes the fit the same in every run.
    rows = sampled.select("doc_id", *names, "text").mapInArrow(features, schema).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id").combine_chunks()
    ids = rows["doc_id"].to_numpy().astype(np.uint64)
    lists = [x.values.to_numpy().astype(np.int64) for x in rows["slots"]]
    fold = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % folds
    model = train_chain(lists, np.stack([rows[n].to_numpy().astype(float) for n in names], axis=1), fold, names, bits, folds)
    return score_chain(given, model, bool(len(lists)))


def score_chain(given: DataFrame, model: Chain, decide: bool = True) -> DataFrame:
    names = model.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _predict(model.models, Rows(list(word_features(batch.column("text"), model.bits))), model.bits)
            yes = [pa.array((p[:, j] >= t) & decide) for j, t in enumerate(model.thresholds)]
            columns = [batch.column("doc_id"), *[pa.array(p[:, j]) for j in range(len(names))], *yes]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"p_{n}" for n in names], *names])

    schema = "doc_id long, " + ", ".join(f"`p_{n}` double" for n in names) + ", " + ", ".join(f"`{n}` boolean" for n in names)
    return given.select("doc_id", "text").mapInArrow(score, schema)
