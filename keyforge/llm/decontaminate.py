"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size into powers of two. For the partition of items
up to s shingles, a document is covered by windows of 2 s shingles, a step of
s apart, so that each run of s lies within one. An item of that partition
that a window contains to `threshold` has a Jaccard similarity of about
threshold / (5 - threshold) with it or more, whatever the document's length: bands for
that similarity find it. Hits are verified on the whole document's shingles.

The least windows have 32 shingles, of which that holds from 8 shingles on. Smaller
items are joined exactly, on as many of their shingles as a document that contains
them to `threshold` can't lack all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import cut, small, table, texts, without
from .jaccard_join import bands_for

#: Production parameters: word 5-grams; share of an item's shingles; recall for an item at that share; least window step.
NGRAM, THRESHOLD, RECALL, LEAST = 5, 0.8, 0.999, 16
#: Keys and shingles of the items, and candidates, are each broadcast up to this many bytes; beyond it they are shuffled. The rows are the same.
ITEM_BYTES = 32 << 20
#: Bits of the filter that drops documents' keys which no item has.
FILTER_BITS = 22


#: Items of fewer shingles are joined on their shingles.
SMALL = LEAST // 2


def needed(total: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles of an item of `total` that a document must have."""
    return np.maximum(np.ceil(total * threshold - 1e-9), 1).astype(int)


class Sketch:
    """Keys of items, and band keys of documents' windows."""

    def __init__(self, threshold: float, recall: float):
        self.threshold = threshold
        self.bands, self.rows = bands_for(threshold / (5 - threshold), recall, most=128)
        rng = np.random.default_rng(11)
        self.mult = rng.integers(1, 1 << 62, self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _keys(self, lows: list[np.ndarray], level: int) -> np.ndarray:
        keys = np.zeros((len(lows[0]), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(lows[0]), level * 1000 + band, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                key = T.mix(key ^ lows[k])
            keys[:, band] = key
        return keys

    def items(self, grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, their offsets by item): by band, or of a small item its first shingles.

        An item without shingles must not be among them.
        """
        size = np.diff(offs)
        first = np.where(size < SMALL, size - needed(size, self.threshold) + 1, 0)
        to = np.concatenate([[0], np.cumsum(np.where(first > 0, first, self.bands))])
        keys = np.zeros(to[-1], np.uint64)
        item = np.repeat(np.arange(len(size)), np.diff(to))
        at = np.flatnonzero(first[item])
        keys[at] = grams[offs[item[at]] + at - to[item[at]]]
        keys[first[item] == 0] = self._banded(grams, offs)[first == 0].reshape(-1)
        return keys, to

    def _banded(self, grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Keys by item and band."""
        level = np.ceil(np.log2(np.maximum(np.diff(offs), LEAST) / LEAST)).astype(int)
        lows = [T.reduce_rows(np.minimum, grams * m, offs, 0) for m in self.mult]
        out = np.zeros((len(level), self.bands), np.uint64)
        for at in np.unique(level):
            out[level == at] = self._keys([x[level == at] for x in lows], int(at))
        return out

    def windows(self, grams: np.ndarray, offs: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of each window, its keys by band), level by level."""
        blocks = -(-np.diff(offs) // LEAST)
        row = np.repeat(np.arange(len(blocks)), blocks)
        if not len(row) or not levels:
            return
        first = np.concatenate([[0], np.cumsum(blocks)])
        start = offs[:-1][row] + (np.arange(len(row)) - first[row]) * LEAST
        lows = [np.minimum.reduceat(grams * m, start) for m in self.mult]
        for level in range(levels):
            after = np.concatenate([row[1:] == row[:-1], [False]])
            nxt = np.minimum(np.arange(len(row)) + after, len(row) - 1)
            yield row, self._keys([np.minimum(x, x[nxt]) for x in lows], level)
            even = (np.arange(len(row)) - np.searchsorted(row, row)) % 2 == 0
            lows = [np.minimum(x, x[nxt])[even] for x in lows]
            row = row[even]


def _item_rows(sketch: Sketch, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                grams, offs = T.unique_by_row(*T.Words(part.column("text")).grams(n))
                some = np.flatnonzero(np.diff(offs) > 0)
                offs = np.append(offs[some], offs[-1])
                keys, to = sketch.items(grams, offs)
                yield pa.RecordBatch.from_pydict({
                    "item_id": part.column("item_id").take(pa.array(some)),
                    "grams": T.lists(T.signed(grams), offs),
                    "keys": T.lists(T.signed(keys), to),
                })

    return run


def _document_keys(sketch: Sketch, levels: int, small_items: bool, seen, n: int):
    """(doc_id, key) of the windows, and for small items of the shingles, of which some item may have the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint, mask = np.unpackbits(seen.value).astype(bool), np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            for part in T.slices(batch):
                ids = part.column("doc_id").to_numpy()
                grams, offs = T.Words(part.column("text")).grams(n)
                for row, k in sketch.windows(grams, offs, levels):
                    w, b = np.nonzero(hint[k & mask])
                    if len(w):
                        yield pa.RecordBatch.from_pydict({"doc_id": ids[row[w]], "key": T.signed(k[w, b])})
                if small_items:
                    at = np.flatnonzero(hint[grams & mask])
                    if len(at):
                        yield pa.RecordBatch.from_pydict({"doc_id": ids[np.searchsorted(offs, at, "right") - 1], "key": T.signed(grams[at])})

    return run


def _verify(n: int):
    """(doc_id, item_id, shared, total) of candidates (doc_id, text, item_id, grams); rows of one text follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                text = part.column("text")
                new = np.ones(part.num_rows, bool)
                new[1:] = pc.not_equal(text.slice(1), text.slice(0, part.num_rows - 1)).to_numpy(zero_copy_only=False)
                of = np.cumsum(new) - 1
                grams, offs = T.unique_by_row(*T.Words(text.filter(pa.array(new))).grams(n))
                want = part.column("grams")
                size = want.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                shared = [np.isin(want[r].values.to_numpy().view(np.uint64), grams[offs[k] : offs[k + 1]], assume_unique=True).sum() for r, k in enumerate(of)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "item_id": part.column("item_id"), "shared": np.array(shared, np.int64), "total": size})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, containment) for each benchmark item found in a document.

    containment is the share of the item's distinct word n-grams that the
    document has, `threshold` at least. A text of 1 to n - 1 words has one
    n-gram, of all its words: such an item is found in equal documents only.

    Null ids, null texts and texts without words take no part. Of rows that
    repeat a doc_id or item_id, the best containment is reported. Other
    columns are ignored. With no items, or no documents, there are no rows.
    """
    sketch = Sketch(threshold, recall)
    docs = texts(docs)
    items = texts(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").distinct()
    items = cut(items.mapInArrow(_item_rows(sketch, n), "item_id long, grams array<long>, keys array<long>"))
    least, most = items.agg(F.min(F.size("grams")), F.max(F.size("grams"))).first()
    levels = int(np.ceil(np.log2(max(most, LEAST) / LEAST))) + 1 if (most or 0) >= SMALL else 0
    keys = items.select("item_id", F.explode("keys").alias("key"))
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[keys.select(F.col("key").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    seen = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    asked = docs.mapInArrow(_document_keys(sketch, levels, (least or SMALL) < SMALL, seen, n), "doc_id long, key long")
    pairs = cut(asked.join(small(keys, 16, item_bytes), "key").select("doc_id", "item_id").distinct())
    full = docs.join(small(pairs, 16, item_bytes), "doc_id").join(small(items.select("item_id", "grams"), 16 + 8 * F.size("grams"), item_bytes), "item_id")
    found = full.select("doc_id", "item_id", "text", "grams").mapInArrow(_verify(n), "doc_id long, item_id long, shared long, total long")
    found = found.filter(F.col("shared") >= F.ceil(F.col("total") * F.lit(threshold) - 1e-9))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.col("shared") / F.col("total")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item is found; rows with a null id or text stay."""
    return without(docs, cut(contaminated(docs, benchmark).select("doc_id").distinct()))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the whole documents table."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_GRAMS = """
SELECT {id} AS id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS gram
FROM (SELECT {id}, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM {table} WHERE {id} IS NOT NULL AND text IS NOT NULL)
"""
SQL = f"""
WITH d AS ({_GRAMS.format(id="doc_id", table="documents")}), i AS ({_GRAMS.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS total FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::DOUBLE / any_value(n.total) AS containment
FROM d JOIN i USING (gram) JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= ceil(any_value(n.total) * 0.8 - 1e-9)
"""
