"""Change records: runs, net changes, and applying them by rewriting tables.

A change record is (lsn long, table_name, op I|U|D, ts, old map, new map), the maps
from column to text. Records are ordered by lsn. Applying is an upsert or delete by
legacy key, and the last record wins, so that a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mapping as M
from .rekey import split_missing

SCHEMA = "lsn long, table_name string, op string, ts timestamp_ntz, old map<string,string>, new map<string,string>"


def runs(changes: DataFrame, batch: int = 1000) -> DataFrame:
    """(batch, run, table_name, op, first_lsn, last_lsn, n_events) of consecutive records with one table and op.

    Runs end with a batch of `batch` log positions, as records are applied; so the
    work is split by batch.
    """
    rows = changes.withColumn("batch", F.floor(F.col("lsn") / batch))
    w = Window.partitionBy("batch").orderBy("lsn")
    new = (F.lag("table_name").over(w) != F.col("table_name")) | (F.lag("op").over(w) != F.col("op"))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("batch", "run", "table_name", "op").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("n_events"))


def key_of(changes: DataFrame, column: str = "id") -> DataFrame:
    """changes with old_key (of the old row, or the new one without it) and key (after the change; a delete's is the old one)."""
    old, new = F.element_at("old", F.lit(column)), F.element_at("new", F.lit(column))
    return changes.withColumn("old_key", F.coalesce(old, new)).withColumn("key", F.when(F.col("op") == "D", F.coalesce(old, new)).otherwise(F.coalesce(new, old)))


def key_changes(changes: DataFrame) -> DataFrame:
    """(table_name, lsn, old_uuid, new_uuid) of updates that change the key."""
    return key_of(changes).filter("op = 'U' AND old_key <> key").select("table_name", "lsn", F.col("old_key").alias("old_uuid"), F.col("key").alias("new_uuid"))


def net(changes: DataFrame, column: str = "id") -> DataFrame:
    """The last record of each (table_name, key): op 'U' (upsert) or 'D', its lsn, and the columns it leaves (new).

    A column that the record doesn't hold, as an unchanged large value, comes from the
    latest record before it that does, back to the last delete.
    """
    rows = key_of(changes, column)
    by = Window.partitionBy("table_name", "key").orderBy("lsn")
    died = F.sum(F.when(F.col("op") == "D", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("life", F.coalesce(died, F.lit(0)))
    last = F.max(F.struct("life", "lsn", "op"))
    ends = rows.groupBy("table_name", "key").agg(last.alias("l")).select("table_name", "key", "l.*")
    values = rows.filter("op <> 'D'").select("table_name", "key", "life", "lsn", F.explode("new").alias("c", "v"))
    values = values.groupBy("table_name", "key", "life", "c").agg(F.max_by("v", "lsn").alias("v"))
    new = values.groupBy("table_name", "key", "life").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("new"))
    got = ends.join(new, ["table_name", "key", "life"], "left")
    return got.select("table_name", "key", F.when(F.col("op") == "D", "D").otherwise("U").alias("op"), "lsn", F.when(F.col("op") != "D", F.col("new")).alias("new"))


def apply_net(target: DataFrame, changes: DataFrame, key: str = "id", few: bool = False) -> DataFrame:
    """target (columns as text or castable from it) after net changes of its table: an overlay by key.

    Columns that a change leaves out keep their value. few: the changes were checked
    to be small, and are broadcast, so that the target isn't shuffled; otherwise one full join does it.
    """
    names, kind = target.columns, target.schema[key].dataType
    side = changes.select(F.col("key").cast(kind).alias("__key"), F.col("op").alias("__op"), F.col("new").alias("__new"))
    if few:
        got = target.join(F.broadcast(side), F.col(key) == F.col("__key"), "left")
        there = target.select(F.col(key).alias("__key")).join(F.broadcast(side.select("__key")), "__key", "left_semi")
        fresh = side.join(there, "__key", "left_anti")
        got = got.unionByName(fresh.select(*(F.lit(None).cast(target.schema[c].dataType).alias(c) for c in names), "__key", "__op", "__new"))
    else:
        got = target.join(side, F.col(key) == F.col("__key"), "full")
    got = got.filter("__op IS NULL OR __op <> 'D'")
    out = [F.coalesce(F.col(key), F.col("__key")).alias(key)]
    for c in names:
        if c != key:
            value = F.element_at("__new", F.lit(c)).cast(target.schema[c].dataType)
            out.append(F.when(F.coalesce(F.map_contains_key("__new", F.lit(c)), F.lit(False)), value).otherwise(F.col(c)).alias(c))
    return got.select(*out).select(names)


def resolve(changes: DataFrame, mapping: DataFrame, parents: dict[str, str], table: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(upserts, rejects, new mapping rows) of the net changes of a table.

    Upserts are (id, key, lsn, one long column for each parent column): new keys get ids
    after the largest so far. A record with a key whose parent has no id is
    rejected, with `missing`, and makes no id.
    """
    rows = changes.filter((F.col("table_name") == table) & (F.col("op") == "U"))
    flat = rows.select("key", "lsn", *(F.element_at("new", F.lit(c)).alias(c) for c in parents))
    good, bad = split_missing(flat, mapping, parents)
    known = mapping.filter(F.col("table_name") == table)
    fresh = good.select(F.col("key").alias("old_uuid")).distinct().join(known, "old_uuid", "left_anti")
    top = known.agg(F.coalesce(F.max("new_id"), F.lit(0)).alias("__top"))
    ids = M.dense_ids(fresh).crossJoin(F.broadcast(top)).select(F.lit(table).alias("table_name"), "old_uuid", (F.col("new_id") + F.col("__top")).alias("new_id"))
    every = known.unionByName(ids).select(F.col("old_uuid").alias("key"), F.col("new_id").alias("id"))
    return good.join(every, "key").select("id", "key", "lsn", *parents), bad, ids


def rekey_mapping(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """mapping after key changes: a row keeps its id under the last key of its chain."""
    chains = M.rekey_chain(key_changes(changes)).withColumnRenamed("first_uuid", "old_uuid")
    got = mapping.join(chains, ["table_name", "old_uuid"], "left")
    return got.select("table_name", F.coalesce("last_uuid", "old_uuid").alias("old_uuid"), "new_id")


def results(changes: DataFrame, known: DataFrame) -> DataFrame:
    """(lsn, table_name, op, success, error): an update or delete of a key that isn't in `known` (table_name, key) fails."""
    rows = key_of(changes).join(known.select("table_name", F.col("key").alias("old_key"), F.lit(True).alias("found")).distinct(), ["table_name", "old_key"], "left")
    fine = (F.col("op") == "I") | F.col("found").isNotNull()
    return rows.select("lsn", "table_name", "op", fine.alias("success"), F.when(~fine, F.concat(F.lit("no mapping for "), "table_name", F.lit("."), "old_key")).alias("error"))


def success(results_: DataFrame) -> DataFrame:
    """(n_events, n_applied, n_failed, last_lsn, success_rate): the last position that was applied; rate 100 of no events."""
    n, ok = F.count("*"), F.count_if("success")
    return results_.agg(n.alias("n_events"), ok.alias("n_applied"), (n - ok).alias("n_failed"), F.max(F.when(F.col("success"), F.col("lsn"))).alias("last_lsn"), F.when(n > 0, ok / n * 100).otherwise(100.0).alias("success_rate"))
