"""Toxicity by a classifier chain.

The labelled categories are predicted one after the other by linear models. A later model
also sees the earlier categories' log-odds: out-of-fold predictions while it is trained,
so that it learns how far to trust them, and the final models' predictions when texts are
scored. Inputs are a few shares of the whole text and marks: that a word or the beginning
of a word occurs, and that it is frequent (twice or more and a hundredth of the words).
Marks are hashed, and the most telling ones are chosen anew in each training set.

Models are fitted on the driver on at most ``SAMPLE`` labelled documents, those with the
least hash of their doc_id; scoring reads every text once, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .common import U64

SAMPLE = 6000
FOLDS = 5
N_MARKS = 200
RARE = 3
BEGINNINGS = (5, 7)
BITS = 20
THRESHOLD = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, mark) pairs as two arrays, each once, and the shares of every text."""
    t = words.tokenize(values)
    n = np.diff(t.at)
    doc = np.repeat(np.arange(len(values)), n)
    prefix = common.prefix_hash(t.lower)
    docs, marks = [doc], [t.hash]
    for size in BEGINNINGS:
        long = t.end - t.start > size
        docs.append(doc[long])
        marks.append(common.span_hash(prefix, t.start[long], t.start[long] + size) + U64(size))
    hashed = (common.mix(np.concatenate(marks)) >> U64(65 - BITS)).astype(np.int64)
    pairs, count = np.unique(np.concatenate(docs) * (1 << BITS) + 2 * hashed, return_counts=True)
    often = (count > 1) & (100 * count >= n[pairs >> BITS])
    pairs = np.sort(np.concatenate([pairs, pairs[often] + 1]))
    begin = np.cumsum([0] + [len(v) + 1 for v in values[:-1]])
    size = np.maximum(np.array([len(v) for v in values]), 1)
    shares = [np.log1p(n)]
    shares += [np.add.reduceat(flag[t.data].astype(np.int64), begin) / size for flag in (_UPPER, _SYMBOL, _DIGIT)]
    distinct = np.unique(doc * (1 << BITS) + (t.hash >> U64(64 - BITS)).astype(np.int64)) >> BITS
    shares.append(np.bincount(distinct, minlength=len(values)) / np.maximum(n, 1))
    return pairs >> BITS, pairs & ((1 << BITS) - 1), np.stack(shares, 1)


@dataclass
class Linear:
    """Log-odds linear in the presence of chosen marks, shares and earlier log-odds."""

    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def inputs(self, n: int, doc: np.ndarray, mark: np.ndarray, dense: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(self.chosen)))
        if len(self.chosen) and len(mark):
            column = np.full(max(int(mark.max()), int(self.chosen[-1])) + 1, -1, np.int16)
            column[self.chosen] = np.arange(len(self.chosen))
            slot = column[mark]
            there = slot >= 0
            x[doc[there], slot[there]] = 1
        return np.concatenate([x, (dense - self.mean) / self.scale], 1)

    def log_odds(self, n: int, doc: np.ndarray, mark: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(n, self.bias)
        return self.inputs(n, doc, mark, dense) @ self.weights + self.bias


def fit_linear(n: int, doc: np.ndarray, mark: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, n_marks: int = N_MARKS, ridge: float = 0.3) -> Linear:
    """Ridge logistic regression on the rows ``use``, by Newton steps."""
    rows = np.flatnonzero(use)
    pos, neg = int(y[rows].sum()), int(len(rows) - y[rows].sum())
    if not pos or not neg:
        return Linear(bias=float(np.log((pos + 0.5) / (neg + 0.5))))
    size = int(mark.max(initial=0)) + 1
    yes = np.bincount(mark[(use & (y > 0))[doc]], minlength=size)
    no = np.bincount(mark[(use & (y == 0))[doc]], minlength=size)
    share_yes, share_no = (yes + 0.5) / (pos + 1), (no + 0.5) / (neg + 1)
    both = (yes + no + 1) / (pos + neg + 2)
    z = np.abs(share_yes - share_no) / np.sqrt(both * (1 - both).clip(1e-9) * (1 / pos + 1 / neg))
    z[yes + no < RARE] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:n_marks])
    chosen = chosen[z[chosen] > 3]
    model = Linear(chosen, dense[rows].mean(0), dense[rows].std(0) + 1e-9)
    x = model.inputs(n, doc, mark, dense)[rows]
    x1 = np.concatenate([x, np.ones((len(rows), 1))], 1)
    target, w = y[rows].astype(float), np.zeros(x1.shape[1])
    w[-1] = np.log(pos / neg)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (target - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fit_chain(doc: np.ndarray, mark: np.ndarray, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model for each column of ``labels``, in order."""
    n, models = len(labels), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        models.append(fit_linear(n, doc, mark, dense, y, np.ones(n, bool)))
        held_out = np.zeros(n)
        for f in range(folds if k < labels.shape[1] - 1 else 0):
            part = fit_linear(n, doc, mark, dense, y, fold != f)
            held_out[fold == f] = part.log_odds(n, doc, mark, dense)[fold == f]
        dense = np.concatenate([dense, held_out.clip(-8, 8)[:, None]], 1)
    return models


def probabilities(models: list[Linear], values: list[bytes]) -> np.ndarray:
    doc, mark, dense = features(values)
    empty, out = dense[:, 0] == 0, []
    for model in models:
        odds = model.log_odds(len(values), doc, mark, dense)
        out.append(np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
        dense = np.concatenate([dense, odds.clip(-8, 8)[:, None]], 1)
    return np.stack(out, 1)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = SAMPLE, folds: int = FOLDS) -> list[Linear]:
    """Fit the chain for ``categories``, columns of ``labels`` (doc_id and 0 or 1 each)
    in their order. Rows with a null are not used; of several for a doc_id the largest, and
    of several texts the first in order."""
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*(F.max(c).alias(f"_{c}") for c in categories))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", *(f"_{c}" for c in categories)).agg(F.min("text").alias("text"))
    names = [f"_{c}" for c in categories]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            values = [common.utf8(t) for t in pdf["text"]]
            for lo, hi in common.batches_by_bytes(values):
                doc, mark, dense = features(values[lo:hi])
                cut = np.searchsorted(doc, np.arange(1, hi - lo))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].to_numpy(), "marks": np.split(mark.astype(np.int32), cut), "shares": list(dense), **{c: pdf[c].iloc[lo:hi].to_numpy() for c in names}})

    schema = "doc_id long, marks array<int>, shares array<double>" + "".join(f", `{c}` int" for c in names)
    got = rows.mapInPandas(run, schema).toPandas().sort_values("doc_id")
    if not len(got):
        return [Linear(bias=-30.0) for _ in categories]
    # Marks are numbered anew, without those too rare to be chosen: the driver then holds
    # 8 bytes for each mark of the sample and little more.
    count = np.zeros(1 << BITS, np.int32)
    for own in got["marks"]:
        count[own] += 1
    present = np.flatnonzero(count >= RARE)
    number = np.full(1 << BITS, -1, np.int32)
    number[present] = np.arange(len(present), dtype=np.int32)
    kept = [own[own >= 0] for own in (number[own] for own in got["marks"])]
    fold = (common.mix(got["doc_id"].to_numpy(np.int64).view(U64)) % U64(folds)).astype(int)
    dense, wanted = np.stack(list(got["shares"])), got[names].to_numpy(int)
    del got
    doc = np.repeat(np.arange(len(kept), dtype=np.int32), [len(own) for own in kept])
    models = fit_chain(doc, np.concatenate(kept), dense, wanted, fold, folds)
    for model in models:
        model.chosen = present[model.chosen]
    return models


def score(docs: DataFrame, models: list[Linear], categories: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` and ``p_<category>`` for each category.

    A text without a token (null, empty, only symbols) has probability 0. Existing
    columns of these names are replaced.
    """
    names = [f"p_{c}" for c in categories]
    kept = docs.select(*(c for c in docs.columns if c not in names))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = [probabilities(models, values) for _, _, values in common.text_batches(pdf["text"].tolist())]
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pdf.assign(**{c: p[:, i] for i, c in enumerate(names)})

    types = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes)
    return kept.mapInPandas(run, types + "".join(f", `{c}` double" for c in names))


CATEGORIES = ("low_quality", "toxic")


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs``, p_low_quality, p_toxic and toxic (p_toxic of
    ``threshold`` or more), every row of ``docs`` once; the chain is fitted on
    ``labels`` (doc_id, quality, toxic)."""
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    models = train(docs, marks, CATEGORIES, sample)
    return score(docs, models, CATEGORIES).withColumn("toxic", F.col("p_toxic") >= threshold)
