"""Session and DataFrame helpers of the corpus operators."""

from __future__ import annotations

import gc
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, scratch, ship

__all__ = ["cut", "importable", "one_row_per_id", "scratch", "small", "table", "texts", "tidy", "without"]

#: A side is broadcast up to this estimate of its bytes; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Rows of a batch that is read from Parquet: a text may have 100 KB, and each task holds a batch, twice while it grows.
READ_ROWS = 256
_BATCH, _READ = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
_MALLOC = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def importable(spark: SparkSession) -> SparkSession:
    """Prepare the session's Python workers, which live long and are many on a host.

    They can import the package, return freed memory to the system instead of keeping it, and get
    batches of a few MB, unless the session sets spark.sql.execution.arrow.maxBytesPerBatch itself. Nor are
    thousands of texts read at once, unless it sets spark.sql.parquet.columnarReaderBatchSize.
    """
    ship(spark)
    for name, value in _MALLOC.items():
        if name not in os.environ:
            spark.sparkContext.environment.setdefault(name, value)
    for name, value in ((_BATCH, BATCH_BYTES), (_READ, READ_ROWS)):
        if not spark._jsparkSession.sessionState().conf().contains(name):
            spark.conf.set(name, value)
    return spark


def small(df: DataFrame, row_bytes: int | Column, limit: int | None = None) -> DataFrame:
    """A checkpointed df, marked for broadcast if its rows are small enough together.

    row_bytes: bytes of a row, or an expression for them where rows hold lists.
    """
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= (BROADCAST_BYTES if limit is None else limit) else df


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is checkpointed: it does so when the driver collects its garbage, which happens to be seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of the rows that have both."""
    importable(docs.sparkSession)
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return got.filter("doc_id IS NOT NULL AND text IS NOT NULL")


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, with one row of those that share an id (the least text); null ids all stay.

    Only repeated ids are shuffled with their rows, and only where there are any. Of rows
    with one id and text, the one whose other columns hash least is taken.
    """
    many = cut(docs.groupBy(id_col).count().filter(F.col(id_col).isNotNull() & (F.col("count") > 1)).select(id_col))
    if many.isEmpty():
        return docs
    many = small(many, 16)
    # maps have no hash, and any name may be taken by a column
    hashed = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in docs.dtypes]
    rows = docs.join(many, id_col, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col("text").alias("text"), F.xxhash64(*hashed).alias("tie"))
    rank = Window.partitionBy("id").orderBy(F.col("text").asc_nulls_last(), "tie")
    first = rows.withColumn("place", F.row_number().over(rank)).filter("place = 1").select("row.*")
    return docs.join(many, id_col, "left_anti").select(docs.columns).unionByName(first)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id isn't among `ids` (checkpointed; one long column of that name)."""
    return docs.join(small(ids, 16), id_col, "left_anti").select(docs.columns)
