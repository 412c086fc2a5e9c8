"""Queries over whole runs: stores, migrations that break off, roll-backs, replication into re-keyed tables, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, metrics, state
from ..schema import STAR, TableSpec
from ..shared import scratch
from ..sources import pgoutput, run_logs, synthetic
from ..sources.legacy import batch_log, change_feed, legacy, read
from ..sources.store import Store
from ..streaming.replicate import replicate_rekeyed
from .migrate import Migration, generate
from .queries_cdc import _FEED, ALL
from .queries_keys import rekeyed_sql
from .queries_meta import _LATEST, _log
from .queries_metrics import _LOG, _ops, _samples, _OPS
from .sqltext import KEYS, uuid, values
from .sqltext import mapping as map_sql

_COLUMNS = {"nation": ["n_name", "n_regionkey"], "customer": ["c_name", "c_nationkey", "c_acctbal"], "orders": ["o_custkey", "o_totalprice"]}


class _Breaks(Store):
    """A store that fails instead of making its next commits: `at` has which, counted from the first."""

    def commit(self, change) -> None:
        self.made = getattr(self, "made", 0) + 1
        if self.made in self.at:
            raise OSError(f"commit {self.made} broke off")
        super().commit(change)


def _stores(spark: SparkSession, d: str, names: list[str], kind=Store) -> tuple[Store, Store, tuple[TableSpec, ...]]:
    """(source with these tables by legacy key, empty target, specs); parents that aren't named aren't foreign keys."""
    root = scratch(spark, "run")
    source = Store(spark, f"{root}/source")
    specs = []
    for n in names:
        source.replace(n, legacy(spark, d, n).select("id", *_COLUMNS[n]))
        parents = {c: p for c, p in STAR[n][1].items() if p in names}
        specs.append(TableSpec(n, {"id": "uuid", **dict.fromkeys(_COLUMNS[n], "text")}, ("id",), parents))
    return source, kind(spark, f"{root}/target"), tuple(specs)


def _interrupted(spark, d):
    """Customers and orders, copied in slices by a run of which three commits break off, and resumed each time."""
    source, target, specs = _stores(spark, d, ["customer", "orders"], _Breaks)
    target.at = (4, 8, 11)
    while True:
        m = Migration(spark, source, target, specs, slices=2)
        try:
            m.resume() if target.exists("run_state") else m.copy()
            break
        except (OSError, RuntimeError):
            continue
    return target.read("orders")


def _copied(spark, d, names):
    source, target, specs = _stores(spark, d, names)
    m = Migration(spark, source, target, specs)
    m.copy()
    return m


def _rolled_back(spark, d):
    m = _copied(spark, d, ["customer", "orders"])
    m.rollback_to("orders")
    return m.status().select("table_name", "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("counts_match"))


def _recopied(spark, d):
    """After a roll-back the ids go on where they were."""
    m = _copied(spark, d, ["customer", "orders"])
    m.rollback_to("orders")
    m.resume()
    return m.target.read("orders")


def _skips(spark, d):
    """Which tables copy_missing() leaves alone, after one mapping row of the orders was lost."""
    m = _copied(spark, d, ["nation", "customer", "orders"])
    m.target.replace("mapping_orders", m.target.read("mapping_orders").filter("new_id > 1"))
    counts = [(t, m.source.read(t).count(), m.target.read(t).count(), m.target.read(f"mapping_{t}").count()) for t in m.scope().order]
    return delta.already_copied(spark.createDataFrame(counts, "table_name string, source long, target long, mapped long"))


def _validated(spark, d):
    m = _copied(spark, d, ["customer", "orders"])
    m.source.append("customer", legacy(spark, d, "customer").limit(5).select(F.concat("id", F.lit("-new")).alias("id"), *_COLUMNS["customer"]))
    return m.validate()


def _feed(spark, d):
    """The change feed of customers with a nation each; nation 25 isn't there."""
    e = read(spark, d, "events").select(F.col("event_id").alias("lsn"), (F.col("user_id") % 26).alias("k"))
    nation = e.withColumn("nation", _legacy("nation")).select("lsn", "nation")
    got = change_feed(spark, d).join(nation, "lsn")
    return got.withColumn("new", F.when(F.col("op") != "D", F.map_concat("new", F.create_map(F.lit("c_nationkey"), "nation")))).drop("nation")


def _legacy(table: str):
    from ..functions.scalars import legacy_uuid

    return legacy_uuid(table, F.col("k"))


def _messages(spark, d):
    columns = ["id", "c_acctbal", "c_nationkey"]
    first = spark.createDataFrame([(-1, None, pgoutput.encode_relation(7, "customer", columns))], pgoutput.SCHEMA)
    return first.unionByName(pgoutput.encode_rows(_feed(spark, d), 7, columns))


def _replicated(spark, d):
    """Raw messages, streamed twice over onto re-keyed customers."""
    m = _copied(spark, d, ["nation", "customer"])
    folder = scratch(spark, "feed")
    _messages(spark, d).repartition("lsn").write.mode("overwrite").parquet(folder)
    order = [m.by_name[t] for t in m.scope().order]
    for k in range(2):
        replicate_rekeyed(spark, folder, m.target, order, f"{folder}-checkpoint{k}", raw=True, files=ALL).awaitTermination()
    return m.target


_GOOD = f"(SELECT f.* FROM {_FEED} f WHERE (user_id IN (SELECT c_custkey FROM customer) OR user_id IN (SELECT user_id FROM {_FEED} WHERE op = 'I')) AND (op = 'D' OR user_id % 26 < 25))"
_END = f"(SELECT * FROM {_GOOD} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) = 1)"
_REPLICATED = f"""SELECT m.new_id AS id, CASE WHEN e.op IS NULL THEN c_acctbal ELSE e.value END AS c_acctbal, n.new_id AS c_nationkey
FROM customer c JOIN {map_sql('customer')} m ON m.old_uuid = {uuid('customer', 'c.c_custkey')} LEFT JOIN {_END} e ON e.user_id = c.c_custkey
LEFT JOIN {map_sql('nation')} n ON n.old_uuid = {uuid('nation', "(CASE WHEN e.op IS NULL THEN c.c_nationkey ELSE e.user_id % 26 END)")} WHERE e.op IS DISTINCT FROM 'D'
UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY key), value, n.new_id FROM {_END} e LEFT JOIN {map_sql('nation')} n ON n.old_uuid = {uuid('nation', '(e.user_id % 26)')}
WHERE op <> 'D' AND user_id NOT IN (SELECT c_custkey FROM customer)"""
_LOST = f"SELECT lsn, op FROM {_FEED} WHERE (op <> 'I' AND user_id NOT IN (SELECT c_custkey FROM customer) AND user_id NOT IN (SELECT user_id FROM {_FEED} WHERE op = 'I')) OR (op <> 'D' AND user_id % 26 = 25)"


def _logs(spark, d):
    """Batch logs, written as CSV and read back."""
    folder = scratch(spark, "logs")
    zero = [F.lit(0).cast("long").alias(c) for c in ("insert_ms", "mapping_ms", "commit_ms")]
    rows = batch_log(spark, d).select(F.col("seq").alias("elapsed_ms"), "table_name", F.col("seq").alias("batch"), "records", *zero, "duration_ms", (F.col("seq") % 900).alias("records_per_sec"))
    run_logs.write(rows, folder, "run-1", "batch")
    return run_logs.read(spark, folder, "batch")


def _pool(spark, d):
    return batch_log(spark, d).select((F.col("seq") % 31).alias("active_connections"))


def _placed(df: DataFrame) -> DataFrame:
    """An ordered result of a few rows, with each row's place in it."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


def _generated(spark, d):
    store = Store(spark, scratch(spark, "generated"))
    generate(spark, store, 300)
    rows = [(t, store.read(t).count()) for t in store.tables()]
    return spark.createDataFrame(rows, "table_name string, n_rows long")


def _truncated(spark, d):
    store = Store(spark, scratch(spark, "truncated"))
    for t in ("region", "nation"):
        store.replace(t, read(spark, d, t))
    rows = [(t, n, store.read(t).count()) for t, n in sorted(store.truncate_all().items())]
    return spark.createDataFrame(rows, "table_name string, n_before long, n_after long")


def _snapshots(spark, d):
    """Two backups, of which the first is restored: what the table has then, and the backups, newest first."""
    store = Store(spark, scratch(spark, "snapshots"))
    store.replace("nation", read(spark, d, "nation"))
    store.backup("first")
    store.append("nation", read(spark, d, "nation"))
    store.backup("second")
    store.restore("first")
    n = store.read("nation").count()
    return spark.createDataFrame([(k, b, n) for k, b in enumerate(store.backups(), 1)], "place long, name string, n_rows long")


_SHAPES = values([(t, n, k) for t, (n, k, _, _) in synthetic.SHAPES.items()] + [(s.name, 1, 100 if s.name in ("legacy_integer_audit", "staging_events") else 1000) for s in synthetic.ODD], "t", "n", "k")
_ORDER = [(t, k) for k, t in enumerate(KEYS, 1)]
_MEASURED = [("rows_per_sec", 24_000.0), ("rows_per_sec", 10_000.0), ("rows_per_sec", 5_001.0), ("rows_per_sec", 4_999.0), ("sync_percent", 100.0), ("sync_percent", 89.0), ("other", 1.0)]

CATALOGUE = {
    "interrupted_copy": (_interrupted, rekeyed_sql("orders", _COLUMNS["orders"])),
    "rollback_run": (_rolled_back, "SELECT 'orders' AS table_name, count(*)::BIGINT AS source_rows, 0::BIGINT AS target_rows, count(*) = 0 AS counts_match FROM orders UNION ALL SELECT 'customer', count(*), count(*), true FROM customer"),
    "rollback_recopied": (_recopied, f"SELECT id + (SELECT count(*) FROM orders) AS id, o_custkey, o_totalprice FROM ({rekeyed_sql('orders', _COLUMNS['orders'])})"),
    "skip_by_counts": (
        _skips,
        "SELECT table_name, n AS source, n AS target, n - (table_name = 'orders')::BIGINT AS mapped, table_name <> 'orders' AS done FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n FROM {t}" for t in ("nation", "customer", "orders")) + ")",
    ),
    "validate_run": (
        _validated,
        f"""SELECT 'customer' AS table_name, count(*) + least(count(*), 5) AS source_rows, count(*) AS target_rows, 0::BIGINT AS n_orphans, least(count(*), 5)::BIGINT AS n_missing, false AS valid FROM customer
        UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), 0, 0, true""",
    ),
    "rekeyed_replay": (lambda s, d: _replicated(s, d).read("customer").select("id", "c_acctbal", "c_nationkey"), _REPLICATED),
    "rekeyed_rejects": (lambda s, d: _replicated(s, d).read("rejects").select("lsn", "op"), _LOST),
    "wal_decode": (
        lambda s, d: pgoutput.decode_messages(_messages(s, d)).select("lsn", "table_name", "op", F.coalesce(F.element_at("new", F.lit("id")), F.element_at("old", F.lit("id"))).alias("key"), F.element_at("new", F.lit("c_acctbal")).cast("double").alias("value"), F.element_at("new", F.lit("c_nationkey")).alias("nation")),
        f"SELECT lsn, 'customer' AS table_name, op, key, CASE WHEN op <> 'D' THEN value END AS value, CASE WHEN op <> 'D' THEN {uuid('nation', '(user_id % 26)')} END AS nation FROM {_FEED}",
    ),
    "run_logs_read": (_logs, f"SELECT seq AS elapsed_ms, table_name, seq AS batch, records, 0::BIGINT AS insert_ms, 0::BIGINT AS mapping_ms, 0::BIGINT AS commit_ms, duration_ms, seq % 900 AS records_per_sec, 'run-1' AS run FROM {_LOG}"),
    "offline_means": (lambda s, d: metrics.offline_means(_logs(s, d), _pool(s, d)), f"SELECT sum(seq % 900)::DOUBLE / count(*) AS mean_records_per_sec, max(seq % 31) AS max_active FROM {_LOG}"),
    "sync_totals": (
        lambda s, d: metrics.sync_totals(batch_log(s, d)),
        f"SELECT table_name, sum(records)::BIGINT AS records, sum(duration_ms)::BIGINT AS duration_ms, (CASE WHEN sum(duration_ms) > 0 THEN sum(records)::BIGINT * 1000 // sum(duration_ms)::BIGINT ELSE 0 END)::BIGINT AS records_per_sec FROM {_LOG} GROUP BY ROLLUP (table_name)",
    ),
    "rollback_totals": (lambda s, d: metrics.rollback_totals(batch_log(s, d)), f"SELECT count(DISTINCT table_name)::BIGINT AS n_tables, sum(records)::BIGINT AS records, sum(duration_ms)::BIGINT AS duration_ms FROM {_LOG}"),
    "counter_increase": (
        lambda s, d: metrics.counter_increase(_samples(s, d), window=300),
        f"""SELECT table_name, "at" // 300 * 300 AS window_start, sum(increase)::BIGINT AS increase, sum(increase)::DOUBLE / 300::DOUBLE AS per_sec FROM (SELECT table_name, seq AS "at", CASE WHEN lag(v) OVER w IS NULL THEN NULL WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE v END AS increase
        FROM (SELECT *, seq * 7 % 5000 AS v FROM {_LOG}) WINDOW w AS (PARTITION BY table_name ORDER BY seq)) WHERE increase IS NOT NULL GROUP BY 1, 2""",
    ),
    "sum_by_top": (lambda s, d: metrics.sum_by(_ops(s, d), "operation", "duration_ms", 5), f"SELECT operation, sum(duration_ms)::BIGINT AS total, row_number() OVER (ORDER BY sum(duration_ms) DESC, operation) AS place FROM {_OPS} GROUP BY operation ORDER BY place LIMIT 5"),
    "split_half": (
        lambda s, d: delta.split_half(s.createDataFrame(_ORDER, "table_name string, place long")),
        f"SELECT table_name, place::BIGINT AS place, CASE WHEN place <= {len(_ORDER) // 2} THEN 'first' ELSE 'second' END AS half FROM {values(_ORDER, 'table_name', 'place')}",
    ),
    "graded_run": (
        lambda s, d: metrics.graded(s.createDataFrame(_MEASURED, "measure string, value double")),
        f"""SELECT *, coalesce(grade <> 'FAILED', false) AS passed FROM (SELECT measure, value::DOUBLE AS value, CASE measure WHEN 'rows_per_sec' THEN CASE WHEN value >= 20000 THEN 'EXCELLENT' WHEN value >= 10000 THEN 'TARGET' WHEN value >= 5000 THEN 'MINIMUM' ELSE 'FAILED' END
        WHEN 'sync_percent' THEN CASE WHEN value >= 99 THEN 'EXCELLENT' WHEN value >= 95 THEN 'TARGET' WHEN value >= 90 THEN 'MINIMUM' ELSE 'FAILED' END END AS grade FROM {values(_MEASURED, 'measure', 'value')})""",
    ),
    "generated_tables": (_generated, f"SELECT t AS table_name, greatest(1, 300 * n // k)::BIGINT AS n_rows FROM {_SHAPES}"),
    "truncate_all": (_truncated, "SELECT 'region' AS table_name, count(*)::BIGINT AS n_before, 0::BIGINT AS n_after FROM region UNION ALL SELECT 'nation', count(*), 0 FROM nation"),
    "backups_newest_first": (_snapshots, "SELECT place::BIGINT AS place, name, (SELECT count(*) FROM nation) AS n_rows FROM (VALUES (1, 'second'), (2, 'first')) t(place, name)"),
    # results whose order counts: with the place of each row
    "ordered_join": (
        lambda s, d: _placed(_orders_by_key(s, d)),
        "SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1000",
    ),
    "ordered_states": (
        lambda s, d: _placed(state.ordered(_log(s), "m1").select("table_name", "status")),
        f"SELECT table_name, status, row_number() OVER (ORDER BY CASE status WHEN 'IN_PROGRESS' THEN 1 WHEN 'RETRYING' THEN 2 WHEN 'FAILED' THEN 3 WHEN 'PENDING' THEN 4 ELSE 5 END, table_name) AS place FROM {_LATEST} WHERE migration_id = 'm1'",
    ),
    "ordered_operations": (lambda s, d: _placed(metrics.op_stats(_ops(s, d)).select("operation", "total_ms")), f"SELECT operation, sum(duration_ms)::BIGINT AS total_ms, row_number() OVER (ORDER BY sum(duration_ms) DESC, operation) AS place FROM {_OPS} GROUP BY operation"),
}


def _orders_by_key(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name").orderBy("o_orderkey").limit(1000)
