"""Labelled samples and an optimiser for the small models trained here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents, half of each class at most.

    Those of least id hash are taken. Null ids, labels and texts are left out, and
    so are ids with both labels.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    y = y.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    chosen: list[tuple[int, int]] = []
    for label in (0, 1):
        part = y.filter(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(most // 2)
        chosen += [(r.id, r.y) for r in part.collect()]
    picked = docs.sparkSession.createDataFrame(chosen or [(None, None)], "id long, y int")
    rows = texts(docs)
    return rows.join(F.broadcast(picked), rows.doc_id == picked.id).select("doc_id", "text", "y")


class Adam:
    """Adam over a dict of arrays, with decoupled weight decay for those named."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: dict[str, float]):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay.get(k, 0) * self.p[k])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of scores with the best F1 of class 1; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(s[1:] < s[:-1], True)  # a threshold lies between different scores
    f1 = np.where(last, f1, -1)
    best = np.flatnonzero(f1 == f1.max())
    low = np.append(s[1:], 0.0)[best]
    k = int(np.argmax(s[best] - low))
    return float((s[best][k] + low[k]) / 2)
