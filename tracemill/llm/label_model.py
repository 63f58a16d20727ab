"""Weak supervision: a generative model of voters and their correlations, and hashed linear scorers of its posteriors.

Votes are -1, 0 or 1. A class is a mixture of one or more components. Within a component, the model has
P(vote of a voter | component, vote of one other voter): the others are chosen as the tree of largest
conditional mutual information. So voters that repeat each other, or that speak of the same texts, don't
count twice. The model is estimated by expectation-maximisation from the counts of distinct vote
patterns of all documents, which Spark groups; no document's label is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lists, map_batches, text_of

Votes = Callable[[pa.Array], np.ndarray]
_PART = 1 << 15


@dataclass
class LabelModel:
    """side: the class, 0 or 1, of each component; parent: the voter that a voter depends on, or -1; table: voters x parent's vote x vote x component; marginal: voters x vote x component."""

    side: np.ndarray
    weight: np.ndarray  # of the components
    parent: np.ndarray
    table: np.ndarray
    marginal: np.ndarray
    information: np.ndarray  # voters x voters, conditional mutual information given the component, in nats

    @property
    def prior(self) -> float:
        """P(class 1)."""
        return float(self.weight[self.side == 1].sum())

    @property
    def accuracy(self) -> np.ndarray:
        """P(vote is right | voter votes), by voter."""
        mass = self.marginal * self.weight
        zero, one = mass[..., self.side == 0].sum(2), mass[..., self.side == 1].sum(2)
        right, wrong = zero[:, 0] + one[:, 2], one[:, 0] + zero[:, 2]
        return right / np.maximum(right + wrong, 1e-12)


def _shares(votes: np.ndarray, m: LabelModel) -> np.ndarray:
    """P(component | votes) of every row."""
    log = np.log(m.table)
    v = votes + 1
    z = np.tile(np.log(m.weight), (len(v), 1))
    for j, p in enumerate(m.parent):
        z += log[j, v[:, p] if p >= 0 else 0, v[:, j]]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def posteriors(votes: np.ndarray, m: LabelModel) -> np.ndarray:
    """P(class 1 | votes) of every row."""
    return np.clip(_shares(votes, m)[:, m.side == 1].sum(1), 1e-13, 1 - 1e-13)


def _joint(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of the votes of every pair of voters: voters x votes x voters x votes x components. weight: rows x components."""
    n, j = votes.shape
    out = np.zeros((3 * j, 3 * j, weight.shape[1]))
    for lo in range(0, n, _PART):
        one = np.stack([votes[lo : lo + _PART] == v for v in (-1, 0, 1)], 2).reshape(-1, 3 * j).astype(np.float64)
        for c in range(weight.shape[1]):
            out[:, :, c] += one.T @ (one * weight[lo : lo + _PART, c, None])
    return out.reshape(j, 3, j, 3, -1)


def _information(joint: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Conditional mutual information of every pair of voters given the component."""
    p = joint / mass.sum()
    own = np.einsum("jvjvc->jvc", p)
    of = own[:, :, None, None, :] * own[None, None, :, :, :] / np.maximum(mass / mass.sum(), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(p / of), 0.0)
    return terms.sum((1, 3, 4))


def _tree(information: np.ndarray, least: float) -> np.ndarray:
    """Parents in a forest of largest information, of links that carry at least so much."""
    j = len(information)
    parent, inside = np.full(j, -1), np.zeros(j, bool)
    for _ in range(j):
        open_ = np.where(inside[:, None] & ~inside[None, :], information, -1.0)
        a, b = np.unravel_index(open_.argmax(), open_.shape) if inside.any() else (0, 0)
        if inside.any() and open_[a, b] >= least:
            parent[b] = a
        else:
            b = int(np.flatnonzero(~inside)[0])
        inside[b] = True
    return parent


def fit_label_model(votes: np.ndarray, counts: np.ndarray | None = None, accuracy: float = 0.8, prior: float = 0.5, start: np.ndarray | None = None, groups: np.ndarray | None = None, rounds: int = 60, least: float = 0.05, strength: float = 4.0) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, from independent voters of equal accuracy.

    The tree is chosen anew every ten rounds, in the first third of links between near copies of one
    voter only. A conditional table leans to the voter's marginal one with the weight of `strength` rows.
    start: where given, each voter's P(1 | class 1) / P(1 | class 0), by which the first posteriors weigh
    votes of 1, in place of equal accuracies. groups: the group of each voter, or -1; class 1 then has
    one component for each group, whose voters fire on the same texts, and starts from texts on which one fires.
    """
    n, j = votes.shape
    counts = np.ones(n) if counts is None else counts.astype(float)
    total = counts.sum()
    if start is not None:
        z = (votes == 1) @ np.log(start)
    else:
        share = (np.stack([((votes == v) * counts[:, None]).sum(0) for v in (-1, 0, 1)]) + 1) / (total + 3)
        agree = np.array([[accuracy, 1 - accuracy], [0.5, 0.5], [1 - accuracy, accuracy]])
        whole = share.T @ agree  # voters x classes: what makes each class's votes add up to 1
        z = votes.sum(1) * np.log(accuracy / (1 - accuracy)) - np.log(whole[:, 1] / whole[:, 0]).sum()
    p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + z, -30, 30)))
    if groups is not None:
        p = np.where((votes[:, groups >= 0] == 1).any(1), p, 1e-3)
    kinds = max(int(groups.max()) + 1, 1) if groups is not None else 1
    part = np.ones((n, kinds))
    for g in range(kinds if groups is not None else 0):
        part[:, g] = (votes[:, groups == g] == 1).sum(1) + 0.01
    both = np.concatenate([1 - p[:, None], p[:, None] * part / part.sum(1, keepdims=True)], 1)
    m = LabelModel(np.array([0] + [1] * kinds), np.zeros(1 + kinds), np.full(j, -1), np.zeros((j, 3, 3, 1 + kinds)), np.zeros((j, 3, 1 + kinds)), np.zeros((j, j)))
    for step in range(rounds):
        both = (_shares(votes, m) if step else both) * counts[:, None]
        mass = both.sum(0)
        joint = _joint(votes, both)
        m.marginal = (np.einsum("jvjvc->jvc", joint) + 0.1) / (mass + 0.3)
        m.weight = (mass + 1e-3) / (total + 1e-3 * len(mass))
        if step % 10 == 0:
            m.information = _information(joint, mass)
            m.parent = _tree(m.information, least if step >= rounds // 3 else max(least, 0.25))
        for k, up in enumerate(m.parent):
            if up < 0:
                m.table[k] = m.marginal[k][None]
            else:
                pair = joint[up, :, k]
                m.table[k] = (pair + strength * m.marginal[k][None]) / (pair.sum(1, keepdims=True) + strength)
    return m


def encode(votes: np.ndarray) -> np.ndarray:
    """One number for each row's pattern of votes."""
    return ((votes + 1) * 3 ** np.arange(votes.shape[1], dtype=np.int64)).sum(1).astype(np.int64)


def decode(codes: np.ndarray, voters: int) -> np.ndarray:
    """The votes of patterns, a byte each, voter by voter."""
    out = np.empty((len(codes), voters), np.int8)
    for k in range(voters):
        out[:, k] = codes // 3**k % 3 - 1
    return out


def pattern_counts(texts: DataFrame, votes: Votes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns of all rows with a text, and how many rows have each.

    There are at most as many as the voters allow, whatever the corpus.
    """

    def run(batch: pa.RecordBatch):
        code, n = np.unique(encode(votes(text_of(batch))), return_counts=True)
        yield {"pattern": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())}

    found = map_batches(texts.select("text"), run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    code, n = np.asarray(found.column("pattern"), np.int64), np.asarray(found.column("n"), np.int64)
    order = np.argsort(code)
    return code[order], n[order]


@dataclass
class Sample:
    """Features of sampled texts by row, and the posteriors that a scorer learns."""

    rows: np.ndarray
    features: np.ndarray
    values: np.ndarray | None
    target: np.ndarray


def sampled(texts: DataFrame, votes: Votes, features: Callable, model: LabelModel, rates: tuple[float, float], most: int) -> Sample:
    """Features and posteriors of a part of the rows (h, text), of each likelier class by its rate; h: a hash below 2**30.

    Votes and features are those of whole texts, found in tasks; only hashed features come here. `most`
    bounds the rows where repeated ones have equal hashes: the first by h, then by the text's digest, so
    that the sample doesn't depend on the partitioning.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    limit = np.array(rates) * (1 << 30)

    def run(batch: pa.RecordBatch):
        p = posteriors(votes(text_of(batch)), shared.value)
        on = np.flatnonzero(np.asarray(batch.column(0)) < limit[(p >= 0.5).astype(int)])
        if len(on):
            row, bucket, value = features(text_of(batch).take(pa.array(on)))
            count = np.bincount(row, minlength=len(on))
            order = np.argsort(row, kind="stable")
            value = np.zeros(0, np.float32) if value is None else value[order].astype(np.float32)
            yield {"h": batch.column(0).take(pa.array(on)), "digest": batch.column(1).take(pa.array(on)), "target": pa.array(p[on]), "bucket": lists(bucket[order].astype(np.int32), count, pa.int32()), "value": lists(value, count if len(value) else 0 * count, pa.float32())}

    rows = texts.select("h", F.xxhash64("text").alias("digest"), "text")
    drawn = map_batches(rows, run, "h long, digest long, target double, bucket array<int>, value array<float>")
    found = drawn.orderBy("h", "digest").limit(most).toArrow().sort_by([("h", "ascending"), ("digest", "ascending")])
    bucket, value = found.column("bucket").combine_chunks(), found.column("value").combine_chunks()
    count = np.diff(np.asarray(bucket.offsets)) if len(bucket) else np.zeros(0, np.int64)
    values = np.asarray(value.flatten()) if len(value) and len(value.flatten()) else None
    return Sample(np.repeat(np.arange(len(count), dtype=np.int32), count), np.asarray(bucket.flatten(), np.int32), values, np.asarray(found.column("target")))


@dataclass
class Scorer:
    weights: np.ndarray  # by feature bucket
    bias: float

    def probability(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
        w = self.weights[features]
        z = self.bias + np.bincount(rows, w if values is None else w * values, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(s: Sample, size: int, rounds: int = 120, rate: float = 0.3, lasso: float = 2e-4, least_df: int = 3, positive: bool = False) -> Scorer:
    """A logistic scorer of soft targets, with few weights other than 0 (adaptive steps, soft thresholds).

    positive: weights are never below 0, so that a long text can't outweigh what it holds.
    """
    target, n = s.target, len(s.target)
    df = np.bincount(s.features, minlength=size)
    ok = df[s.features] >= least_df
    rows, features = s.rows[ok], s.features[ok]
    values = np.float32(1) if s.values is None else s.values[ok]
    used, place = np.flatnonzero(df >= least_df), np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    features = place[features]
    w, bias = np.zeros(len(used)), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    squares, bias_squares = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(rows, w[features] * values, n)
        left = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.bincount(features, left[rows] * values, len(used))
        squares += g**2
        bias_squares += left.sum() ** 2
        step = rate / np.sqrt(squares)
        w = w - step * g
        w = np.maximum(w - step * lasso, 0) if positive else np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
        bias -= rate * left.sum() / np.sqrt(bias_squares)
    out = np.zeros(size, np.float32)
    out[used] = w
    return Scorer(out, bias)
