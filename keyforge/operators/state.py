"""Run state as an append-only log: the latest row of a (migration, table) counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "seq long, migration_id string, table_name string, status string, total_rows long, processed_rows long, last_uuid string, "
    "batch_number long, attempt long, error string, completed_at long, updated_at long"
)
STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "RETRYING")
#: From which statuses a status may follow; None is the start.
FOLLOWS = {
    "PENDING": (None, "COMPLETED", "FAILED", "IN_PROGRESS", "RETRYING"),
    "IN_PROGRESS": ("PENDING", "IN_PROGRESS", "RETRYING"),
    "COMPLETED": ("IN_PROGRESS",),
    "FAILED": ("IN_PROGRESS", "RETRYING"),
    "RETRYING": ("FAILED", "IN_PROGRESS"),
}


def latest(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("migration_id", "table_name").orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ordered(log: DataFrame, migration: str) -> DataFrame:
    """Latest states of a migration: those at work first, completed ones last, then by name."""
    rank = F.when(F.col("status") == "IN_PROGRESS", 1).when(F.col("status") == "RETRYING", 2).when(F.col("status") == "FAILED", 3).when(F.col("status") == "PENDING", 4).otherwise(5)
    return latest(log).filter(F.col("migration_id") == migration).withColumn("status_rank", rank.cast("long")).orderBy("status_rank", "table_name")


def resume_context(log: DataFrame, migration: str) -> DataFrame:
    """One row: (checkpoint_table, checkpoint_uuid, failed, pending, completed), names in order.

    The checkpoint is the table at work, or tried again, that was updated last (ties: greatest name).
    """
    rows = latest(log).filter(F.col("migration_id") == migration)
    at = F.col("status").isin("IN_PROGRESS", "RETRYING")
    names = lambda *s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin(*s), F.col("table_name")))), ",")
    last = F.max(F.when(at, F.struct("updated_at", "table_name", "last_uuid")))
    return rows.agg(last.alias("l"), names("FAILED").alias("failed"), names("PENDING").alias("pending"), names("COMPLETED").alias("completed")).select(
        F.col("l.table_name").alias("checkpoint_table"), F.col("l.last_uuid").alias("checkpoint_uuid"), "failed", "pending", "completed")


def last_active(log: DataFrame) -> DataFrame:
    """(migration_id) of the migration at work that was updated last."""
    rows = latest(log).filter(F.col("status").isin("IN_PROGRESS", "RETRYING"))
    return rows.orderBy(F.desc("updated_at"), F.desc("migration_id")).limit(1).select("migration_id")


def to_do(order: DataFrame, log: DataFrame, migration: str) -> DataFrame:
    """Tables of `order` (table_name, depth) that aren't completed."""
    open_ = latest(log).filter((F.col("migration_id") == migration) & (F.col("status") != "COMPLETED"))
    return order.join(open_, "table_name", "left_semi").orderBy("depth", "table_name")


def rollback_suffix(log: DataFrame, migration: str, table: str) -> DataFrame:
    """(table_name, place) to roll back to before `table`: it and all completed after it, last first."""
    done = latest(log).filter((F.col("migration_id") == migration) & (F.col("status") == "COMPLETED"))
    at = done.filter(F.col("table_name") == table).select(F.col("completed_at").alias("from_at"), F.col("table_name").alias("from_table"))
    later = F.struct("completed_at", "table_name") >= F.struct("from_at", "from_table")
    got = done.join(F.broadcast(at), later, "inner")
    w = Window.orderBy(F.desc("completed_at"), F.desc("table_name"))  # a migration has tens of tables
    return got.select("table_name", F.row_number().over(w).cast("long").alias("place"))


def row(seq: int, migration: str, table: str, status: str, **more) -> tuple:
    """A log row; what isn't given is null, and counts are 0."""
    if status not in STATUSES:
        raise ValueError(status)
    base = dict(total_rows=0, processed_rows=0, last_uuid=None, batch_number=0, attempt=0, error=None, completed_at=None, updated_at=seq)
    base |= more
    return (seq, migration, table, status, *base.values())


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Log rows whose status may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy("migration_id", "table_name").orderBy("seq"))
    rows, fine = log.withColumn("before", before), F.lit(False)
    for status, allowed in FOLLOWS.items():
        ok = F.col("before").isin([a for a in allowed if a])
        ok = F.coalesce(ok, F.lit(None in allowed))
        fine = fine | ((F.col("status") == status) & ok)
    return rows.filter(~fine)


def log_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)
