"""Analytics over run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import per_second


def batch_stats(batches: DataFrame) -> DataFrame:
    """(table_name, n_batches, n_records, min_ms, max_ms, total_ms) of (table_name, records, duration_ms)."""
    d = F.col("duration_ms")
    return batches.groupBy("table_name").agg(F.count("*").alias("n_batches"), F.sum("records").alias("n_records"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.sum(d).alias("total_ms"))


def speed_ranges(batches: DataFrame) -> DataFrame:
    """(table_name, avg_speed, min_speed, max_speed): whole records a second, overall and by batch."""
    speed = per_second(F.col("records"), F.col("duration_ms"))
    got = batches.withColumn("s", speed).groupBy("table_name").agg(F.sum("records").alias("r"), F.sum("duration_ms").alias("d"), F.min("s").alias("min_speed"), F.max("s").alias("max_speed"))
    return got.select("table_name", per_second(F.col("r"), F.col("d")).alias("avg_speed"), "min_speed", "max_speed")


def op_stats(ops: DataFrame) -> DataFrame:
    """(operation, n_calls, total_ms, avg_ms, min_ms, max_ms, per_sec), most time first, of (operation, duration_ms)."""
    d = F.col("duration_ms")
    got = ops.groupBy("operation").agg(F.count("*").alias("n_calls"), F.sum(d).alias("total_ms"), F.avg(d).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))
    return got.withColumn("per_sec", F.when(F.col("total_ms") > 0, F.col("n_calls") * 1000.0 / F.col("total_ms")).otherwise(0.0)).orderBy(F.desc("total_ms"), "operation")


def database_share(ops: DataFrame, prefix: str = "db") -> DataFrame:
    """(db_ms, total_ms, db_share, threads): share of time in operations named so, and the threads worth having."""
    db, total = F.sum(F.when(F.col("operation").startswith(prefix), F.col("duration_ms")).otherwise(0)), F.sum("duration_ms")
    share = F.when(total > 0, db / total * 100).otherwise(0.0)
    return ops.agg(db.alias("db_ms"), total.alias("total_ms"), share.alias("db_share"), F.when(share > 80, 16).when(share > 50, 8).otherwise(4).cast("long").alias("threads"))


def connection_usage(log: DataFrame, top: int = 20) -> DataFrame:
    """(operation, n_uses, max_active, wait_ms, avg_wait_ms, n_slow) of (operation, active, wait_ms, duration_ms), most used first."""
    slow = (F.col("wait_ms") > 100) | (F.col("duration_ms") > 1000)
    got = log.groupBy("operation").agg(F.count("*").alias("n_uses"), F.max("active").alias("max_active"), F.sum("wait_ms").alias("wait_ms"), F.avg("wait_ms").alias("avg_wait_ms"), F.count_if(slow).alias("n_slow"))
    return got.orderBy(F.desc("n_uses"), "operation").limit(top)


def counter_rate(samples: DataFrame, by: str = "table_name") -> DataFrame:
    """(by, at, increase, per_sec) of a counter's samples (by, at in seconds, value); a fall is a restart from 0."""
    w = Window.partitionBy(by).orderBy("at")
    before, since = F.lag("value").over(w), F.lag("at").over(w)
    grown = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    got = samples.withColumn("increase", F.when(before.isNotNull(), grown)).withColumn("seconds", F.col("at") - since)
    return got.filter("increase IS NOT NULL").select(by, "at", "increase", F.when(F.col("seconds") > 0, F.col("increase") / F.col("seconds")).otherwise(0.0).alias("per_sec"))


def counter_increase(samples: DataFrame, by: str = "table_name", window: int = 300) -> DataFrame:
    """(by, window_start, increase, per_sec): a counter's growth in each `window` seconds, as sum by, increase and rate give it.

    A sample's growth since the one before it counts in its own window; per_sec is the increase over the window's length.
    """
    start = (F.floor(F.col("at") / window) * window).cast("long")
    got = counter_rate(samples, by).groupBy(by, start.alias("window_start")).agg(F.sum("increase").alias("increase"))
    return got.withColumn("per_sec", F.col("increase") / F.lit(window))


def sum_by(rows: DataFrame, by: str, column: str, top: int | None = None) -> DataFrame:
    """(by, place, total) of the `top` largest sums; place counts from 1, largest first, ties by name."""
    got = rows.groupBy(by).agg(F.sum(column).alias("total"))
    got = got.orderBy(F.desc("total"), by).limit(top) if top else got
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), by)).cast("long"))  # a row a group


def sync_totals(batches: DataFrame) -> DataFrame:
    """(table_name, records, duration_ms, records_per_sec) by table, and of all as table_name null; the last a whole number."""
    got = batches.rollup("table_name").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
    return got.withColumn("records_per_sec", per_second(F.col("records"), F.col("duration_ms")))


def rollback_totals(rollbacks: DataFrame) -> DataFrame:
    """(n_tables, records, duration_ms) of (table_name, records, duration_ms)."""
    return rollbacks.agg(F.count_distinct("table_name").alias("n_tables"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))


def offline_means(batches: DataFrame, pool: DataFrame) -> DataFrame:
    """(mean_records_per_sec, max_active) of run logs: batches with records_per_sec, and pool samples with active_connections."""
    return batches.agg(F.avg("records_per_sec").alias("mean_records_per_sec")).crossJoin(pool.agg(F.max("active_connections").alias("max_active")))


#: What a run must reach: measure -> (least value of each grade, from the best one down).
GRADES = {"rows_per_sec": (20_000, 10_000, 5_000), "sync_percent": (99, 95, 90), "rollback_tables_per_min": (12, 6, 2)}


def graded(measured: DataFrame) -> DataFrame:
    """(measure, value, grade, passed) of (measure, value): EXCELLENT, TARGET, MINIMUM or FAILED by GRADES."""
    grade = F.lit(None).cast("string")
    for name, least in GRADES.items():
        kind = F.lit("FAILED")
        for k, word in reversed(list(zip(least, ("EXCELLENT", "TARGET", "MINIMUM")))):
            kind = F.when(F.col("value") >= k, word).otherwise(kind)
        grade = F.when(F.col("measure") == name, kind).otherwise(grade)
    return measured.withColumn("grade", grade).withColumn("passed", F.coalesce(F.col("grade") != "FAILED", F.lit(False)))


def adaptive_batches(batches: DataFrame, by: str, start: int = 1000, target_ms: int = 150, least: int = 100, most: int = 4000, warm_up: int = 2, least_rows: int = 5000) -> DataFrame:
    """(by, final_size, n_changes): the batch size that a controller would end with, over (by, seq, rows, duration_ms).

    After `warm_up` batches and `least_rows` rows, a batch longer than 1.5 targets halves
    the size, and one shorter than half a target adds a quarter, at least 1.
    """
    long = lambda n: F.lit(n).cast("long")
    init = F.struct(F.greatest(long(least), F.least(long(most), long(max(1, start)))).alias("size"), long(0).alias("n"), long(0).alias("rows"), long(0).alias("changes"))

    def step(a: Column, x: Column) -> Column:
        n, rows = a["n"] + 1, a["rows"] + F.greatest(x["rows"], long(0))
        live = (x["duration_ms"] > 0) & (n > warm_up) & (rows >= least_rows)
        slow, fast = x["duration_ms"] > target_ms * 3 // 2, x["duration_ms"] < target_ms // 2
        half = F.greatest(F.floor(a["size"] / 2), long(least))
        more = F.least(a["size"] + F.greatest(F.floor(a["size"] / 4), long(1)), long(most))
        size = F.when(live & slow, half).when(live & fast, more).otherwise(a["size"])
        return F.struct(size.alias("size"), n.alias("n"), rows.alias("rows"), (a["changes"] + (size != a["size"]).cast("long")).alias("changes"))

    items = F.array_sort(F.collect_list(F.struct("seq", F.col("rows").cast("long").alias("rows"), F.col("duration_ms").cast("long").alias("duration_ms"))))
    got = batches.groupBy(by).agg(items.alias("items"))
    end = F.aggregate("items", init, step)
    return got.select(by, end["size"].alias("final_size"), end["changes"].alias("n_changes"))


def pinned_tables(counts: DataFrame, limit: int) -> DataFrame:
    """(table_name, n_rows): the smallest tables that fit half of a cache of `limit` rows together."""
    upto = F.sum("n_rows").over(Window.orderBy("n_rows", "table_name").rowsBetween(Window.unboundedPreceding, 0))  # a row a table
    return counts.filter("n_rows > 0").withColumn("upto", upto).filter(F.col("upto") <= max(1, limit // 2)).select("table_name", "n_rows")


def index_size_model(batches: DataFrame) -> DataFrame:
    """(n_records, uuid_mb, bigint_mb, saved_percent): key index sizes at 37 and 21 MB a million rows."""
    n = F.sum("records")
    u, b = n * 37.0 / 1e6, n * 21.0 / 1e6
    return batches.agg(n.alias("n_records"), u.alias("uuid_mb"), b.alias("bigint_mb"), F.when(n > 0, (1 - b / u) * 100).otherwise(0.0).alias("saved_percent"))


def run_efficiency(runs: DataFrame) -> DataFrame:
    """(run, bigint_size, uuid_size, efficiency) of (run, kind bigint|uuid, size): 1 - bigint / uuid, 0 without uuid ones."""
    b, u = (F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)) for k in ("bigint", "uuid"))
    return runs.groupBy("run").agg(b.alias("bigint_size"), u.alias("uuid_size"), F.when(u > 0, 1 - b / u).otherwise(0.0).alias("efficiency"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, n_before, n_after, n_added) of two counts."""
    got = before.withColumnRenamed("n_rows", "b").join(after.withColumnRenamed("n_rows", "a"), "table_name", "full")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return got.select("table_name", b.alias("n_before"), a.alias("n_after"), (a - b).alias("n_added"))
