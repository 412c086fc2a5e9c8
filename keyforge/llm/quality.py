"""Quality classifier: gated attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE tokens. Each passage is encoded,
gated attention weights are learned from the documents' labels alone, and the
weighted mean of the passages is scored (Ilse, Tomczak and Welling, 2018).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import importable, table
from .learn import Adam, best_threshold, labelled, sigmoid

#: Production parameters: tokens of a passage, hashed word dimensions, widths of the encoding and the attention, labelled documents to train on at most, seed.
PASSAGE, HASHED, WIDTH, ATTENTION, TRAIN_DOCS, SEED = 64, 32, 32, 16, 4000, 9

_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?", "table": b"|\t<>{}[]=_", "symbol": b"#$%&*@^~\\+/-\"'()`",
    "line": b"\n",
}
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_CLASS = np.zeros(256, np.int64)
for _k, _v in enumerate(_BYTES.values(), 1):
    _CLASS[list(_v)] = _k
_CLASS[128:] = len(_BYTES) + 1
_KINDS = len(_BYTES) + 2
FEATURES = _KINDS + 7 + HASHED


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, offsets by row); a text without tokens is one empty passage."""
    raw, offs = T.buffers(column)
    n = len(raw)
    solid, edge, before = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    solid[:n] = ~_SPACE[raw]
    edge[offs] = True
    before[1:] = solid[:-1]
    s, e = np.flatnonzero(solid & (~before | edge)), np.flatnonzero(before & (~solid | edge))
    words = T._spans_hash(T._BYTE[raw], s, e, T._P)
    first = np.searchsorted(s, offs)
    count = np.diff(first)
    each = np.maximum(1, -(-count // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(len(count)), each)
    start = first[:-1][row] + (np.arange(bags[-1]) - bags[row]) * PASSAGE
    stop = np.minimum(start + PASSAGE, first[1:][row])
    tokens = stop - start
    of = np.repeat(np.arange(bags[-1]), tokens)  # passage of each token
    length = e - s
    size = np.maximum(1, np.bincount(of, length, bags[-1]))
    some = np.maximum(1, tokens)
    kind = _CLASS[raw]
    byte_of = np.searchsorted(s[start[tokens > 0]], np.arange(n), "right") - 1
    byte_of = np.flatnonzero(tokens > 0)[np.maximum(byte_of, 0)] if (tokens > 0).any() else np.zeros(n, np.int64)
    x = np.zeros((bags[-1], FEATURES), np.float32)
    x[:, :_KINDS] = np.bincount(byte_of * _KINDS + kind, minlength=bags[-1] * _KINDS).reshape(-1, _KINDS) / size[:, None] * 4
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    order = np.argsort(words, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    loud = np.bincount(of, (kind[np.minimum(s, n - 1)] == 1) if n else None, bags[-1]) if len(of) else np.zeros(bags[-1])
    ends = np.bincount(of, ~np.isin(kind[e - 1], (0, 1, 2, _KINDS - 1)), bags[-1]) if len(of) else np.zeros(bags[-1])
    x[:, _KINDS : _KINDS + 7] = np.stack([size / some / 10, np.bincount(of, same, bags[-1]) / some * 3, np.bincount(of[order], new, bags[-1]) / some * 2, np.bincount(of, length == 1, bags[-1]) / some * 2, np.bincount(of, length > 20, bags[-1]) / some * 2, loud / some, ends / some], 1)
    dim, sign = (words >> np.uint64(32)) % np.uint64(HASHED), np.where(words >> np.uint64(63), 1.0, -1.0)
    x[:, _KINDS + 7 :] = np.bincount(of * HASHED + dim.astype(np.int64), sign, bags[-1] * HASHED).reshape(-1, HASHED) / np.sqrt(some)[:, None] / 4
    return x, bags


@dataclass
class Model:
    """Parameters: encoder (e, eb), attention (v, u, w), score (c, cb)."""

    p: dict[str, np.ndarray]
    threshold: float

    def forward(self, x: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, offs[:-1])[bag])
        a /= np.add.reduceat(a, offs[:-1])[bag]
        z = np.add.reduceat(h * a[:, None], offs[:-1])
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["cb"])}

    def score(self, x: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.forward(x, offs)["y"] if len(offs) > 1 else np.zeros(0)


def fit(x: np.ndarray, offs: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = SEED) -> Model:
    """Learn encoder, attention and score together; a fifth of the bags is held out for the threshold.

    Without both labels the model is constant, close to the one label (1 without any).
    """
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    p = {"e": draw(FEATURES, WIDTH), "eb": np.zeros(WIDTH, np.float32), "v": draw(WIDTH, ATTENTION), "u": draw(WIDTH, ATTENTION), "w": draw(ATTENTION), "c": draw(WIDTH), "cb": np.zeros(1, np.float32)}
    model, n = Model(p, 0.5), len(y)
    if not 0 < y.sum() < n:
        p["c"][:], p["cb"][:] = 0, -8 if n and not y.any() else 8
        return model
    held = rng.permutation(n) < max(1, n // 5)
    train = np.flatnonzero(~held)
    adam = Adam(p, 0.003, {k: 0.01 for k in ("e", "v", "u", "w", "c")})
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-6), 0.5 / max(1 - y[train].mean(), 1e-6)).astype(np.float32)

    def take(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = offs[b + 1] - offs[b]
        o = np.concatenate([[0], np.cumsum(size)])
        return x[np.repeat(offs[b] - o[:-1], size) + np.arange(o[-1])], o

    for _ in range(epochs):
        for b in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            xb, o = take(b)
            f = model.forward(xb, o)
            bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
            d = (weight[b] * (f["y"] - y[b]) / len(b)).astype(np.float32)
            dz = d[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            ds = a * (da - np.add.reduceat(a * da, o[:-1])[bag])
            dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            adam.step({"e": xb.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "c": f["z"].T @ d, "cb": d.sum(keepdims=True)})
    xb, o = take(np.flatnonzero(held))
    bad = best_threshold(1 - model.score(xb, o), 1 - y[held])  # F1 of the rarer class, poor documents
    model.threshold = 1 - bad
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch):
            x, offs = passages(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "x": T.lists(x.reshape(-1), offs * FEATURES)})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most `most` labelled documents (learn.labelled)."""
    rows = labelled(docs, labels, "quality", most).mapInArrow(_features, "doc_id long, y int, x array<float>").toArrow().sort_by("doc_id")
    chunks = rows.column("x").chunks
    x = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in chunks)]).reshape(-1, FEATURES)
    size = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in chunks)]).astype(np.int64) // FEATURES
    return fit(x, np.concatenate([[0], np.cumsum(size)]), rows.column("y").to_numpy())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                score = model.score(*passages(part.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "quality": score, "keep": score >= model.threshold})

    return run


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, quality in 0..1, keep) of each document.

    Null texts count as empty ones, a bag of one empty passage; a null id is scored
    like any other, and rows that repeat an id each get a score. Labels without
    documents, null labels and ids labelled both ways aren't learnt from.
    Other columns are ignored.
    """
    model = model or train(docs, labels)
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, quality double, keep boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole documents table."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
