"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything in the training fold,
labelled or not, is unlabelled text. With class prior p the non-negative risk
is ``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])`` for the logistic loss l,
so the sigmoid of g estimates the probability of label 1. The prior is the
share of positives among labelled documents of the training fold; labels 0
have no other use.

The features are shares of bytes by kind and repetition figures of the whole
text. The fit takes at most ``POSITIVES`` and ``UNLABELLED`` rows, those with
the least hashed ids, and only their features reach the driver.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import crc_mod, limit_batches, text_of

#: Bounds of the fit, in rows.
POSITIVES = 10_000
UNLABELLED = 20_000

#: Score from which a document counts as good.
THRESHOLD = 0.7

PUNCTUATION = [ord(c) for c in string.punctuation]
N_FEATURES = len(PUNCTUATION) + 15


def features(text: str) -> np.ndarray:
    """Square roots of shares, and repetition figures; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(N_FEATURES)
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    n = len(words)
    kinds = [
        count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[32], count[10],
        count[:32].sum() - count[10], count[128:].sum(), count[PUNCTUATION].sum(),
    ]
    k = len(PUNCTUATION)
    out[:k] = np.sqrt(count[PUNCTUATION] / len(raw))
    out[k : k + 8] = np.sqrt(np.array(kinds) / len(raw))
    distinct = len(set(words))
    out[k + 8 :] = (
        distinct / n,
        np.log1p(distinct) / np.log1p(n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(set(lines)) / len(lines),
        np.log1p(n) / 10,
        min(4.0, len(raw) / n / 10),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    risk: float  # infinite for a model that had nothing to learn from

    @property
    def trained(self) -> bool:
        return bool(np.isfinite(self.risk))

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fit_features(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk of a linear model by full-batch Adam steps.

    Where the risk on negatives falls below 0, the step undoes that part
    instead (its gradient with the sign turned), as the method prescribes.
    """
    mean = unlabelled.mean(axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)
    shape = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = shape(positive), shape(unlabelled)
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -40, 40)))
    risk = 0.0
    for step in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        slope_negative = -(slope(-gu) @ u) / len(u) + prior * (slope(-gp) @ p) / len(p)
        if negative >= 0:
            grad = prior * (slope(gp) @ p) / len(p) + slope_negative
        else:
            grad = -slope_negative
        grad[:-1] += decay * w[:-1]
        risk = prior * loss(gp).mean() + max(0.0, negative)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior, float(risk))


def _features_of(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(x) for x in batch], dtype=object)

    limit_batches(rows.sparkSession)
    return rows.select("positive", run(text_of()).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, training: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on rows of ``docs`` where ``training`` (over doc_id) holds; ``labels`` has doc_id and quality.

    Labels of rows without text in ``docs`` are harmless; null ids and labels are left out, and
    repeated ids count once (of several texts under one id the smallest is read), so no more than
    ``positives + unlabelled`` rows reach the driver. Without a positive label, or without its
    document, there is nothing to learn: the model is ``untrained`` and gives every text the prior
    (0.5 where no label is known at all).
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(training)
    prior, n = known.agg(F.avg((F.col("quality") > 0).cast("double")), F.count(F.lit(1))).first()
    if not n or not prior:
        return untrained(0.5 if not n else 0.01)
    prior = min(max(prior, 0.01), 0.99)
    order = F.xxhash64("doc_id")
    trusted = known.where("quality > 0").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    anyone = docs.select("doc_id").where("doc_id is not null").where(training).distinct().orderBy(order, "doc_id").limit(unlabelled)
    picked = trusted.select("doc_id", F.lit(True).alias("positive")).unionByName(anyone.select("doc_id", F.lit(False).alias("positive")))
    # at most positives + unlabelled ids, so the broadcast has a fixed bound; one text an id, combined map-side
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive").agg(F.min(text_of()).alias("text"))
    rows = _features_of(texts).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    chosen = rows["positive"].to_numpy(bool)
    if not chosen.any():
        return untrained(prior)
    return fit_features(x[chosen], x[~chosen] if (~chosen).any() else x, prior)


def untrained(prior: float) -> Model:
    """Gives the prior whatever the text."""
    none = np.zeros(N_FEATURES)
    return Model(none, none + 1, none, float(np.log(prior / (1 - prior))), prior, float("inf"))


def score(text: Column | str, model: Model) -> Column:
    """Probability of label 1 for each text, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch]).reshape(len(batch), N_FEATURES)
            yield pd.Series(model.score(x))

    return run(text_of(text))


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return crc_mod(doc_id, 4) != 2
