"""Integrity of a re-keyed copy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one pass for each table and none over the rows' columns."""
    each = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, source_rows, target_rows, counts_match); a table that one side lacks has 0."""
    got = source.withColumnRenamed("n_rows", "s").join(target.withColumnRenamed("n_rows", "t"), "table_name", "full")
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    return got.select("table_name", s.alias("source_rows"), t.alias("target_rows"), (s == t).alias("counts_match"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose foreign key isn't null and has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def orphan_counts(checks: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """(table_name, column_name, parent_table, n_orphans) for (table, rows, column, parent, parent rows, parent key)."""
    each = []
    for table, rows, column, parent, parents, key in checks:
        n = orphans(rows, column, parents, key).agg(F.count("*").alias("n_orphans"))
        each.append(n.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(parent).alias("parent_table"), "n_orphans"))
    return reduce(DataFrame.unionByName, each)


def missing_mappings(keys: DataFrame, mapping: DataFrame, table: str) -> DataFrame:
    """Distinct source keys (old_uuid) without an id."""
    known = mapping.filter(F.col("table_name") == table).select("old_uuid")
    return keys.select("old_uuid").filter("old_uuid IS NOT NULL").distinct().join(known, "old_uuid", "left_anti")


def summary(compared: DataFrame, orphaned: DataFrame, missing: DataFrame) -> DataFrame:
    """(table_name, source_rows, target_rows, n_orphans, n_missing, valid) for compare_counts(), orphan_counts() and (table_name, n_missing)."""
    o = orphaned.groupBy("table_name").agg(F.sum("n_orphans").alias("n_orphans"))
    got = compared.join(o, "table_name", "left").join(missing, "table_name", "left").fillna(0, ["n_orphans", "n_missing"])
    valid = F.col("counts_match") & (F.col("n_orphans") == 0) & (F.col("n_missing") == 0)
    return got.select("table_name", "source_rows", "target_rows", "n_orphans", "n_missing", valid.alias("valid"))


def roll_up(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of a unique index that occur more than once, with n_rows; nulls don't collide."""
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return rows.filter(some).groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
