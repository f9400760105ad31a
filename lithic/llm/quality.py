"""Document quality by Bradley-Terry ranking.

A document's worth is a weighted sum of surface features; the weights maximise the likelihood of preference pairs (a
document labelled 1 over one labelled 0), a logistic loss on feature differences. The cut is the quantile of the training scores at the
share of label 0, and scores are shifted and squashed so that the cut becomes `CUT`.

The model is fitted on the driver on at most `max_labelled` labelled rows, those with the smallest hash of the id, and
`max_pairs` pairs drawn with a fixed seed; only their feature vectors are collected. Every text is scored whole.

Null texts count as empty and get a score like any other. Labels that are null or neither 0 nor 1 are not used; without both
labels every score is `CUT`. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import bounded_batches, lower_words

CUT = 0.7
_CLASS = np.full(256, 7)  # byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 beyond ASCII, 7 other marks
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[[ord(c) for c in ".,;:'\"()-?"]], _CLASS[128:] = 3, 4, 5, 6


def features(text: str | None) -> list[float]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=8) / max(len(raw), 1)
    words = lower_words(text)
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in (text or "").split("\n") if x]
    letters = share[0] + share[1] + share[6]
    return [
        *share,
        share[1] / max(letters, 1e-6),
        math.log1p(len(raw)),
        math.log1p(len(words)),
        min(sum(map(len, words)) / n, 30) / 10,
        len(counts) / n,
        math.log1p(n) * len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in counts.items() if not w[:1].isalnum() and not w[-1:].isalnum()) / n,
        sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1:] not in ".,;:'\")?") / n,
        1.0 if words else 0.0,
    ]


feature_vectors = F.pandas_udf(lambda s: s.map(features), T.ArrayType(T.DoubleType()))


class Ranker:
    """Fitted weights: a document is worth (features - mean) / spread . weights, and `cut` is kept."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.spread, self.weights, self.cut = mean, spread, weights, cut

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -20, 20) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.worth(x) - self.cut, -30, 30)
        score = 1 / (1 + np.exp(-(raw + math.log(CUT / (1 - CUT)))))
        return np.where(raw >= 0, np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))

    def column(self, text: Column) -> Column:
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.array([features(t) for t in texts], float).reshape(len(texts), -1)), dtype=float)

        return F.pandas_udf(score, "double")(text)


def rank_pairs(x: np.ndarray, y: np.ndarray, max_pairs: int, rounds: int = 40, ridge: float = 1e-3) -> Ranker:
    """Newton steps on the mean logistic loss of seeded random pairs (one of each label)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1] if x.ndim == 2 else len(features(""))
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / spread, -20, 20)
    rng = np.random.default_rng(7)
    n = min(max_pairs, 20 * max(len(good), len(bad)))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = -(diff * p[:, None]).mean(0) + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    order = np.sort(z @ w)
    cut = (order[len(bad) - 1] + order[min(len(bad), len(order) - 1)]) / 2
    return Ranker(mean, spread, w, float(cut))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_pairs: int = 40_000) -> Ranker:
    """docs: doc_id, text; labels: doc_id, quality. Only rows of these labels are learned from."""
    bounded_batches(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled rows are sent
    got = rows.select("doc_id", "quality", feature_vectors("text").alias("x")).toPandas().sort_values(["doc_id", "quality"])
    x = np.array(got.x.tolist(), float)
    return rank_pairs(x, got.quality.to_numpy(), max_pairs)
