"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations by node, so that a hub's edges spill instead of
being held by one process; the number of steps grows with the logarithm of the
longest path. Partitions first shrink their own edges to spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of these edges but the least."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
            if len(a) > 1 << 19:
                yield pa.RecordBatch.from_pydict({"u": a, "v": b})
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_pydict({"u": a, "v": b})


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    return both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small(e: DataFrame) -> DataFrame:
    e = e.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    back = e.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return e.select("u", F.col("m").alias("v")).unionByName(back).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; roots are left out.

    edges: two long columns, in either order. Null ends and loops are ignored.
    """
    a, b = edges.columns
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = cut(e.filter("u <> v").mapInArrow(_forests, "u long, v long"))
    before = None
    while True:
        e = cut(_small(_large(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
