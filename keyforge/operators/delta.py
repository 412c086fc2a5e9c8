"""What is left to copy: deltas, resumption and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import dense_ids


def new_rows(source: DataFrame, mapping: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Rows of source whose key isn't mapped yet. Updates and deletes aren't seen."""
    known = mapping.filter(F.col("table_name") == table).select(F.col("old_uuid").alias(key))
    return source.join(known, key, "left_anti").select(source.columns)


def skip_known(source: DataFrame, existing: DataFrame, mapping: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Rows whose key is neither in `existing` (column key) nor mapped."""
    known = mapping.filter(F.col("table_name") == table).select(F.col("old_uuid").alias(key)).unionByName(existing.select(key)).distinct()
    return source.join(known, key, "left_anti").select(source.columns)


def resume_after(source: DataFrame, last: str | None, key: str = "id") -> DataFrame:
    """Rows after the last key that was done, in the byte order of the lower-case text."""
    return source if last is None else source.filter(F.col(key) > last.lower())


def batch_plan(keys: DataFrame, size: int, key: str = "old_uuid") -> DataFrame:
    """(batch, n_rows, last_uuid) of batches of `size` rows in key order."""
    numbered = dense_ids(keys, key)
    batch = F.floor((F.col("new_id") - 1) / size) + 1
    return numbered.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_rows"), F.max(key).alias("last_uuid"))


def already_copied(counts: DataFrame) -> DataFrame:
    """counts (table_name, source, target, mapped) with `done`: nothing is left to copy."""
    return counts.withColumn("done", (F.col("source") == F.col("target")) & (F.col("source") == F.col("mapped")))


def split_half(order: DataFrame) -> DataFrame:
    """order (table_name, place from 1) with `half`: first for the leading half of the tables, rounded down, second for the others."""
    return order.crossJoin(F.broadcast(order.agg(F.floor(F.count("*") / 2).alias("__n")))).withColumn("half", F.when(F.col("place") <= F.col("__n"), "first").otherwise("second")).drop("__n")
