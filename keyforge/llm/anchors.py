"""Winnowed anchors, and the text around those that repeat.

Of the `length - k + 1` k-grams in each window of `length` words, the one of
least hash is the window's anchor. Equal windows have equal anchors at equal
places, so a window that repeats has an anchor that repeats. Only text around
repeated anchors needs a closer look; the rest can't hold a repeat of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import cut, small

_LOW = np.uint64((1 << 24) - 1)


def runs(words: T.Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor word, first window, windows, anchor hash) of consecutive windows with one anchor.

    Words and windows are counted within the row.
    """
    empty = np.zeros(0, np.int64)
    hashes, offs = words.windows(k)
    w = length - k + 1
    each = np.maximum(np.diff(offs) - w + 1, 0)
    total = int(each.sum())
    if not total:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    at = np.arange(len(hashes)) - np.repeat(offs[:-1], np.diff(offs))
    low = (T.mix(hashes) & ~_LOW) | (at.astype(np.uint64) & _LOW)  # the leftmost of equal ones is least
    size = 1
    while size < w:
        step = min(size, w - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    row = np.repeat(np.arange(len(each)), each)
    start = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(each)[:-1]]), each)
    least = low[offs[:-1][row] + start]
    anchor = start + ((least - start.astype(np.uint64)) & _LOW).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    row, anchor = row[first], anchor[first]
    return row, anchor, start[first], np.diff(np.append(first, total)), hashes[offs[:-1][row] + anchor]


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                row, anchor, _, _, h = runs(T.Words(part.column("text")), length, k)
                yield pa.RecordBatch.from_pydict({"hash": T.signed(h), "doc_id": part.column("doc_id").take(pa.array(row)), "word": anchor.astype(np.int32)})

    return run


def with_repeats(docs: DataFrame, length: int, k: int, most: int) -> DataFrame:
    """(doc_id, text, words, hot) of documents (texts()) with anchors that occur more than once: their places.

    hot has, for anchors with more than `most` occurrences, their place and into how many parts the occurrences are split.
    """
    anchors = docs.mapInArrow(_anchors(length, k), "hash long, doc_id long, word int")
    again = anchors.withColumn("n", F.count("*").over(Window.partitionBy("hash"))).filter("n > 1")
    hot = F.when(F.col("n") > most, F.struct("word", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    places = cut(again.groupBy("doc_id").agg(F.sort_array(F.collect_list("word")).alias("words"), F.collect_list(hot).alias("hot")))
    return docs.join(small(places, 32 + 4 * F.size("words") + 8 * F.size("hot")), "doc_id")


def chosen(part: pa.RecordBatch, length: int, k: int):
    """words and runs() of a part of with_repeats(), for the places in its column words."""
    words = T.Words(part.column("text"))
    row, anchor, first, count, h = runs(words, length, k)
    lists = part.column("words")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    want = np.repeat(np.arange(part.num_rows), size) * (1 << 40) + lists.flatten().to_numpy()
    keep = np.isin(row * (1 << 40) + anchor, want)
    return words, row[keep], anchor[keep], first[keep], count[keep], h[keep]


def parts_of(part: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Into how many parts the occurrences of each chosen anchor are split."""
    hot = part.column("hot")
    size = hot.value_lengths().to_numpy(zero_copy_only=False)
    out = np.ones(len(row), np.int64)
    if size.sum():
        word, parts = (x.to_numpy() for x in hot.flatten().flatten())
        at = np.repeat(np.arange(part.num_rows), size) * (1 << 40) + word
        order = np.argsort(at)
        mine = row * (1 << 40) + anchor
        k = np.minimum(np.searchsorted(at[order], mine), len(at) - 1)
        out = np.where(at[order][k] == mine, parts[order][k], 1)
    return out


def covered(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of the unions of spans that touch or overlap within a group."""
    if not len(start):
        return np.zeros(0, np.int64), start, end
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    shift = (np.cumsum(np.concatenate([[False], g[1:] != g[:-1]]))) * np.int64(1 << 40)
    reach = np.maximum.accumulate(e + shift)
    new = np.concatenate([[True], s[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return g[first], s[first], reach[last] - shift[last]


#: Windows of 50 words in SQL: (d, p, h), document, first word and hash, by place.
WINDOWS_SQL = """
t AS (SELECT doc_id AS d, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT d, w, unnest(range(len(w) - 49)) AS p FROM t WHERE len(w) >= 50),
v AS (SELECT d, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM i)"""
