"""Toxicity by a factorization machine over hashed terms.

logit = w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2) over a document's
distinct terms: the pairwise part learns what terms mean together, such as an
insult with the mention of a group, where each alone is harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import cut, importable, table, texts, without
from .learn import best_threshold, labelled, sigmoid

#: Least distance of the threshold from the score of no evidence.
MARGIN = 0.15
#: Production parameters: hash bits of a term, factors, epochs, folds for threshold and trust, labelled documents to train on at most, and the seed.
BITS, FACTORS, EPOCHS, FOLDS, TRAIN_DOCS, SEED = 40, 8, 8, 3, 4000, 3
#: How far a term's own evidence sets its weight: TRUSTS are tried, 0 (all alike) and 1 - FLOOR. Chi-squared of half the weight, documents of half the weight.
FLOOR, EVIDENCE, SUPPORT = 0.01, 20.0, 5.0
TRUSTS = (1 - FLOOR, 0.0)
_STEP, _DECAY, _DAMP, _BATCH, _START = 0.3, 1e-4, 0.1, 64, 0.05
_HINT = 20


@dataclass
class Machine:
    terms: np.ndarray  #: sorted term hashes
    w0: float
    w: np.ndarray
    v: np.ndarray
    threshold: float

    def logits(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, from distinct (row, index of term)."""
        out = np.full(n, self.w0) + np.bincount(rows, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out


def _terms(words: T.Words) -> np.ndarray:
    return words.hash >> np.uint64(64 - BITS)


def known(terms: np.ndarray, rows: np.ndarray, vocabulary: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into the sorted vocabulary) of the terms that are in it."""
    maybe = hint[terms & np.uint64((1 << _HINT) - 1)]
    terms, rows = terms[maybe], rows[maybe]
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    same = vocabulary[at] == terms
    pair = np.unique(rows[same] * len(vocabulary) + at[same])
    return pair // len(vocabulary), pair % len(vocabulary)


def hints(vocabulary: np.ndarray) -> np.ndarray:
    hint = np.zeros(1 << _HINT, bool)
    hint[vocabulary & np.uint64((1 << _HINT) - 1)] = True
    return hint


def fit(terms: np.ndarray, offs: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Train on documents' distinct terms.

    All terms take part. A term counts by the documents that have it and, where that
    tells more on documents held out, by its own evidence too; where toxic is what terms mean
    together and not alone, the folds choose the machine to which all terms are alike. The
    threshold is chosen on the scores that machines trained on the other folds
    give; it is MARGIN above the score of a document
    without known terms at least (or 0.5). Without both labels the machine is constant, and
    rejects nothing unless all labels do.
    """
    n, rows = len(y), np.repeat(np.arange(len(y)), np.diff(offs))
    if not n or not 0 < y.sum() < n:
        return Machine(np.zeros(1, np.uint64), 8.0 if n and y.all() else -8.0, np.zeros(1), np.zeros((1, factors)), 0.5)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    best: tuple[float, float, np.ndarray] = (-1.0, TRUSTS[0], np.zeros(n))
    for trust in TRUSTS:
        score, so_far = np.zeros(n), np.zeros(n, bool)
        for k in range(FOLDS):
            m = _train(terms, rows, y, np.flatnonzero(fold != k), factors, epochs, seed, trust)
            score[fold == k] = sigmoid(m.logits(*known(terms, rows, m.terms, hints(m.terms)), n))[fold == k]
            so_far |= fold == k
            if best[0] >= 0 and _f1(score[so_far], y[so_far]) < _f1(best[2][so_far], y[so_far]) - 0.1:
                break  # far behind the other one
        f1 = _f1(score, y) if so_far.all() else -1.0
        if f1 > best[0]:
            best = (f1, trust, score)
    machine = _train(terms, rows, y, np.arange(n), factors, epochs, seed, best[1])
    machine.threshold = max(best_threshold(best[2], y), min(0.5, float(sigmoid(np.array(machine.w0))) + MARGIN))
    return machine


def _f1(score: np.ndarray, y: np.ndarray) -> float:
    """Of class 1, at the best threshold."""
    if not 0 < y.sum() < len(y):
        return 0.0
    hit = score > best_threshold(score, y)
    return float(2 * y[hit].sum() / (hit.sum() + y.sum()))


def _train(terms: np.ndarray, rows: np.ndarray, y: np.ndarray, train: np.ndarray, factors: int, epochs: int, seed: int, trust: float) -> Machine:
    """A machine from the documents `train`, by stochastic gradient steps that are damped for long documents.

    rows has the document of each term. The weights of the terms go into the machine's parameters.
    """
    rng = np.random.default_rng(seed)
    n, rate = len(train), y[train].mean()
    used = np.isin(rows, train)
    vocabulary, at = np.unique(terms[used], return_inverse=True)
    rows = rows[used]
    first = np.searchsorted(rows, np.arange(len(y) + 1))
    df, pos = np.bincount(at).astype(float), np.bincount(at, y[rows])
    if not len(vocabulary) or not 0 < rate < 1:
        return Machine(np.zeros(1, np.uint64), 8.0 if rate == 1 else -8.0, np.zeros(1), np.zeros((1, factors)), 0.5)
    chi = (pos - df * rate) ** 2 / (df * rate * (1 - rate)) / np.maximum(1 - df / n, 1 / n)
    size_of = df / (df + SUPPORT) * (1 - trust + trust * (chi / (chi + EVIDENCE)) ** 2)
    w0, w, v = 0.0, np.zeros(len(df)), rng.normal(0, _START, (len(df), factors))
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    batches = []
    for b in np.array_split(rng.permutation(train), max(1, n // _BATCH)):
        size = first[b + 1] - first[b]
        i = at[np.repeat(first[b] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        r, x = np.repeat(np.arange(len(b)), size), size_of[i]
        batches.append((b, i, r, x, np.bincount(r, x * x, len(b)), *np.unique(i, return_inverse=True)))
    for epoch in range(epochs):
        step = _STEP * (1.05 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            b, i, r, x, norm, u, inv = batches[k]
            vx = v[i] * x[:, None]
            total = np.stack([np.bincount(r, vx[:, f], len(b)) for f in range(factors)], 1)
            square = (total**2).sum(1)
            z = w0 + np.bincount(r, w[i] * x, len(b)) + 0.5 * (square - np.bincount(r, (vx**2).sum(1), len(b)))
            g = weight[b] * (sigmoid(z) - y[b]) / (1 + _DAMP * norm * (1 + square))
            e = g[r] * x
            rest = (total[r] - vx) * e[:, None]
            w[u] -= step * (np.bincount(inv, e, len(u)) + _DECAY * w[u])
            v[u] -= step * (np.stack([np.bincount(inv, rest[:, f], len(u)) for f in range(factors)], 1) + _DECAY * v[u])
            w0 -= step * g.mean()
    w, v = w * size_of, v * size_of[:, None]
    # what can't move a score by a thousandth is left out
    keep = (np.abs(w) >= 1e-3) | (np.abs(v).max(1) >= 1e-2)
    keep[np.argmax(np.abs(w))] = True
    return Machine(vocabulary[keep], float(w0), w[keep], v[keep], 0.5)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch):
            words = T.Words(part.column("text"))
            terms, offs = T.unique_by_row(_terms(words), words.first)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "terms": T.lists(T.signed(terms), offs)})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Machine:
    """Fit on at most `most` labelled documents (learn.labelled)."""
    rows = labelled(docs, labels, "toxic", most).mapInArrow(_features, "doc_id long, y int, terms array<long>").toArrow().sort_by("doc_id")
    lists = rows.column("terms").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    return fit(lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), rows.column("y").to_numpy())


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = hints(machine.terms)
        for batch in batches:
            for part in T.slices(batch):
                words = T.Words(part.column("text"))
                rows, at = known(_terms(words), words.row(), machine.terms, hint)
                score = sigmoid(machine.logits(rows, at, part.num_rows))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "toxicity": score, "toxic": score > machine.threshold})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(doc_id, toxicity in 0..1, toxic) of each document.

    Null texts count as empty ones; a null id is scored like any other, and rows that
    repeat an id each get a score. Labels without documents, null labels and ids
    labelled both ways aren't learnt from. Other columns are ignored.
    """
    machine = machine or train(docs, labels)
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(machine), "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """docs without the toxic ones; a row with a null id stays.

    Of rows that repeat an id, all go if one is toxic.
    """
    bad = toxicity(texts(docs), labels, machine).filter("toxic").select("doc_id").distinct()
    return without(docs, cut(bad))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole documents table."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
