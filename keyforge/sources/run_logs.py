"""Run logs: CSV metric files in a folder for each run, and a JSON manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "batch": "elapsed_ms long, table_name string, batch long, records long, insert_ms long, mapping_ms long, commit_ms long, duration_ms long, records_per_sec long",
    "mapping": "elapsed_ms long, table_name string, batch long, records_saved long, duration_ms long",
    "pool": "elapsed_ms long, active_connections long, idle_connections long, waiting long",
    "batch_phase": "elapsed_ms long, table_name string, batch long, phase string, duration_ms long, records long, records_per_sec long",
    "mapping_lookup": "elapsed_ms long, strategy string, table_name string, duration_ms long, found boolean",
    "cache": "elapsed_ms long, strategy string, cache_size long, pinned_size long, hit_rate double, requests long, misses long",
    "adaptive": "elapsed_ms long, table_name string, batch long, size_before long, size_after long, duration_ms long, target_ms long, reason string",
    "schema_inventory": "elapsed_ms long, table_name string, pk_columns string, pk_types string, eligible boolean, skip_reason string",
    "dependencies": "elapsed_ms long, record_type string, tables string, details string",
    "jvm": "elapsed_ms long, heap_used long, heap_committed long, heap_max long, gc_count long, gc_ms long, processors long",
    "wal_sync": "elapsed_ms long, slot string, events_read long, events_applied long, events_failed long, read_ms long, apply_ms long, total_ms long, last_lsn string",
}


def write(df: DataFrame, folder: str, run: str, kind: str) -> None:
    df.select([c.split(" ")[0] for c in SCHEMAS[kind].split(", ")]).coalesce(1).write.mode("append").csv(f"{folder}/{run}/{kind}", header=True)


def jvm(spark: SparkSession, elapsed_ms: int = 0) -> DataFrame:
    """A row of kind jvm: the driver's memory and collections now."""
    lang = spark._jvm.java.lang
    heap, beans = lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage(), lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    row = (elapsed_ms, heap.getUsed(), heap.getCommitted(), heap.getMax(), sum(b.getCollectionCount() for b in beans), sum(b.getCollectionTime() for b in beans), lang.Runtime.getRuntime().availableProcessors())
    return spark.createDataFrame([row], SCHEMAS["jvm"])


def read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of all runs, with `run` from the path; the schema is given, not inferred."""
    rows = spark.read.csv(f"{folder}/*/{kind}", schema=SCHEMAS[kind], header=True)
    return rows.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -3))


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the run whose name is last."""
    last = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(last), "run", "left_semi")


def manifest(spark: SparkSession, folder: str, run: str, properties: dict[str, str]) -> None:
    spark.createDataFrame([(run, properties)], "run string, properties map<string,string>").coalesce(1).write.mode("overwrite").json(f"{folder}/{run}/manifest")
