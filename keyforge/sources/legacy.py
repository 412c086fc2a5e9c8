"""Legacy views of the star schema: its integer keys shown as uuid text, and derived feeds."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import legacy_uuid
from ..operators import mapping as M
from ..schema import STAR
from ..shared import scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legacy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with `id` as its legacy key and foreign keys as those of their parents."""
    key, parents = STAR[name]
    df = read(spark, sf_dir, name)
    new = {c: legacy_uuid(p, F.col(c)) for c, p in parents.items()}
    cols = [legacy_uuid(name, F.col(key)).alias("id")] if key else []
    return df.select(*cols, *(new.get(c, F.col(c)).alias(c) for c in df.columns if c != key))


def keys(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """old_uuid of each row; reads the key column only."""
    return read(spark, sf_dir, name).select(legacy_uuid(name, F.col(STAR[name][0])).alias("old_uuid"))


def built(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The mapping of these tables, built anew."""
    return reduce(DataFrame.unionByName, [M.build(n, keys(spark, sf_dir, n)) for n in names])


def _stamp(spark: SparkSession, path: str) -> str:
    """Changes with the file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return hashlib.md5(repr(files).encode()).hexdigest()


def mapping(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The mapping of these tables, as a migration keeps it: built once in an application and written to the shared folder.

    It is in key order, so that a lookup of a few keys reads the row groups that may have
    them. A table whose files change is built again.
    """
    held = spark.sparkContext.__dict__.setdefault("_keyforge_mappings", {})
    out = []
    for n in names:
        stamp = (n, _stamp(spark, f"{sf_dir}/{n}.parquet"))
        if stamp not in held:
            path = f"{scratch(spark, 'mapping')}/{n}"
            built(spark, sf_dir, n).sortWithinPartitions("old_uuid").write.parquet(path)
            held[stamp] = path
        out.append(spark.read.schema("table_name string, old_uuid string, new_id long").parquet(held[stamp]))
    return reduce(DataFrame.unionByName, out)


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of customers, made of the events: of ten, seven inserts, two updates, one delete."""
    e = read(spark, sf_dir, "events")
    id_ = legacy_uuid("customer", F.col("user_id"))
    k = F.col("event_id") % 10
    op = F.when(k < 7, "I").when(k < 9, "U").otherwise("D")
    none = F.lit(None).cast("map<string,string>")
    old = F.when(op != "I", F.create_map(F.lit("id"), id_)).otherwise(none)
    new = F.when(op != "D", F.create_map(F.lit("id"), id_, F.lit("c_acctbal"), F.col("value").cast("string"))).otherwise(none)
    return e.select(F.col("event_id").alias("lsn"), F.lit("customer").alias("table_name"), op.alias("op"), "ts", old.alias("old"), new.alias("new"))


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric rows: (table_name, seq, records, rows, duration_ms)."""
    e = read(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(F.col("event_type").alias("table_name"), F.col("event_id").alias("seq"), (F.col("event_id") % 997 + 1).alias("records"), (F.col("event_id") % 997 + 1).alias("rows"), (cents % 400).alias("duration_ms"), F.col("user_id"), F.col("ts"))
