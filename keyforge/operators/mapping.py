"""Surrogate keys: dense ids in key order, and the mapping from legacy keys to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

_PLACES = 33  # bits of a row's place within its partition in monotonically_increasing_id


def dense_ids(keys: DataFrame, key: str = "old_uuid", high_water: int | Column = 0, ranges: int | None = None) -> DataFrame:
    """Each distinct key, with new_id: high_water + 1, +2, ... in the order of the keys.

    The keys are cut into as many ranges as there are shuffle partitions, by Spark's sample of them, so
    that no range is large whatever the keys look like (random, ordered in time, with a common prefix). Each is
    sorted by a task, which numbers it; the ranges' counts give each its first id. The
    numbered keys are kept once in the shared folder, so that counts and numbers agree. Ids depend only on
    the keys, not on ranges. Null keys are dropped.
    """
    n = ranges or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.select(key, F.shiftright("__at", _PLACES).alias("__range"), F.col("__at").bitwiseAND((1 << _PLACES) - 1).alias("__place"))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    # a row for each range: one task suffices, and they are broadcast
    upto = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(upto, F.lit(0)).alias("__start"))
    base = (high_water if isinstance(high_water, Column) else F.lit(high_water)).cast("long")
    return rows.join(F.broadcast(starts), "__range").select(key, (base + F.col("__start") + F.col("__place") + 1).alias("new_id"))


def build(table: str, keys: DataFrame, high_water: int = 0) -> DataFrame:
    """(table_name, old_uuid, new_id) for a table's keys (column old_uuid); repeated keys get one id."""
    return dense_ids(keys, high_water=high_water).select(F.lit(table).alias("table_name"), "old_uuid", "new_id")


def append_ignore(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that were added: keys that are mapped keep their first id."""
    first = new.groupBy("table_name", "old_uuid").agg(F.min("new_id").alias("new_id"))
    return first.join(mapping, ["table_name", "old_uuid"], "left_anti")


def high_water(mapping: DataFrame) -> DataFrame:
    """(table_name, high_water): the largest id given so far."""
    return mapping.groupBy("table_name").agg(F.max("new_id").alias("high_water"))


def with_override(mapping: DataFrame, override: DataFrame) -> DataFrame:
    """mapping with the ids of `override` (old_uuid, new_id), which hold for any table."""
    over = override.groupBy("old_uuid").agg(F.max("new_id").alias("over_id"))
    got = mapping.join(over, "old_uuid", "left")
    return got.select("table_name", "old_uuid", F.coalesce("over_id", "new_id").alias("new_id"))


def reverse(mapping: DataFrame, ids: DataFrame, table: str) -> DataFrame:
    """(new_id, old_uuid) of `ids` (new_id) in a table."""
    return mapping.filter(F.col("table_name") == table).join(ids, "new_id", "left_semi").select("new_id", "old_uuid")


def lookup(mapping: DataFrame, table: str, uuids: list[str]) -> DataFrame:
    """(old_uuid, new_id) of a few keys; the filter reaches the scan."""
    return mapping.filter((F.col("table_name") == table) & F.col("old_uuid").isin([u.lower() for u in uuids])).select("old_uuid", "new_id")


def rekey_chain(changes: DataFrame) -> DataFrame:
    """(table_name, first_uuid, last_uuid) of key changes (table_name, lsn, old_uuid, new_uuid).

    Chains u1 -> u2 -> u3 are followed to their end, whatever batches they are in:
    heads are keys that no change leads to, and pointers double until none moves.
    """
    step = changes.select("table_name", F.col("old_uuid").alias("first_uuid"), F.col("new_uuid").alias("last_uuid"))
    heads = step.join(step.select("table_name", F.col("last_uuid").alias("first_uuid")), ["table_name", "first_uuid"], "left_anti")
    while True:
        hop = step.select("table_name", F.col("first_uuid").alias("last_uuid"), F.col("last_uuid").alias("further"))
        moved = step.join(hop, ["table_name", "last_uuid"], "left").select("table_name", "first_uuid", F.coalesce("further", "last_uuid").alias("last_uuid"), F.col("further").isNotNull().alias("went"))
        if moved.filter("went").isEmpty():
            return step.join(heads.select("table_name", "first_uuid"), ["table_name", "first_uuid"], "left_semi")
        step = moved.drop("went")
