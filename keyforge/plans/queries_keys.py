"""Queries over surrogate keys: mapping, re-keying, deltas, validation and lookups."""

from __future__ import annotations

import hashlib
from functools import reduce
from uuid import UUID

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, metrics, validate
from ..operators import mapping as M
from ..operators.rekey import Strategy, cache_stats, remap, split_missing
from ..schema import STAR
from ..sources.legacy import built, keys, legacy, mapping, read
from .sqltext import KEYS, uuid
from .sqltext import mapping as map_sql

_NAMES = [*KEYS, "lineitem"]


def rekeyed(spark: SparkSession, d: str, table: str, strategy: Strategy = Strategy.HYBRID) -> DataFrame:
    """A table with its id and foreign keys as dense ids."""
    key, parents = STAR[table]
    rows = remap(legacy(spark, d, table), mapping(spark, d, *dict.fromkeys(parents.values())), parents, strategy) if parents else legacy(spark, d, table)
    if key is None:
        return rows
    own = mapping(spark, d, table).select(F.col("old_uuid").alias("__old"), "new_id")
    names = [c for c in rows.columns if c != "id"]
    return rows.join(own, F.col("id") == F.col("__old")).select(F.col("new_id").alias("id"), *names)


def rekeyed_sql(table: str, columns: list[str]) -> str:
    key, parents = STAR[table]
    joins = "".join(f" LEFT JOIN {map_sql(p)} m_{c} ON m_{c}.old_uuid = {uuid(p, 't.' + c)}" for c, p in parents.items())
    cols = [f"m_{c}.new_id AS {c}" if c in parents else f"t.{c}" for c in columns]
    own = f" JOIN {map_sql(table)} o ON o.old_uuid = {uuid(table, 't.' + key)}" if key else ""
    return f"SELECT {'o.new_id AS id, ' if key else ''}{', '.join(cols)} FROM {table} t{joins}{own}"


_REKEYED = {
    "region": ["r_name"], "nation": ["n_name", "n_regionkey"], "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _holey(spark: SparkSession, d: str) -> DataFrame:
    """The customers' mapping without every tenth id."""
    return mapping(spark, d, "customer").filter("new_id % 10 <> 0")


_HOLEY = f"(SELECT * FROM {map_sql('customer')} WHERE new_id % 10 <> 0)"
_ORDER = f"(SELECT {uuid('orders', 'o_orderkey')} AS id, {uuid('customer', 'o_custkey')} AS o_custkey, o_totalprice FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return legacy(spark, d, "orders").select("id", "o_custkey", "o_totalprice")


def _reject(spark, d):
    return split_missing(_orders(spark, d), _holey(spark, d), {"o_custkey": "customer"})[1].select("id", F.array_join("missing", ",").alias("missing"))


def _accept(spark, d):
    return split_missing(_orders(spark, d), _holey(spark, d), {"o_custkey": "customer"})[0]


def _half(spark: SparkSession, d: str) -> DataFrame:
    """The orders' mapping for two thirds of the orders."""
    return mapping(spark, d, "orders").filter("new_id % 3 <> 0")


_HALF = f"(SELECT * FROM {map_sql('orders')} WHERE new_id % 3 <> 0)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts({t: read(spark, d, t) for t in _NAMES})


_COUNTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_rows FROM {t}" for t in _NAMES) + ")"


def _append(spark, d):
    m = _half(spark, d)
    water = m.agg(F.coalesce(F.max("new_id"), F.lit(0))).first()[0]
    new = M.build("orders", keys(spark, d, "orders"), water)
    return M.append_ignore(m, new).select("old_uuid", "new_id")


def _override(spark, d):
    over = mapping(spark, d, "customer").filter("new_id % 5 = 0").select("old_uuid", (-F.col("new_id")).alias("new_id"))
    return M.with_override(mapping(spark, d, "customer"), over)


def _validated(spark, d):
    """Orders against customers of whom every tenth is gone."""
    m = _holey(spark, d)
    compared = validate.compare_counts(_counts(spark, d).filter("table_name IN ('orders', 'customer')"), _partial(spark, d))
    orphaned = validate.orphan_counts([("orders", legacy(spark, d, "orders"), "o_custkey", "customer", m, "old_uuid")])
    missing = validate.missing_mappings(keys(spark, d, "customer"), m, "customer").agg(F.count("*").alias("n_missing")).select(F.lit("customer").alias("table_name"), "n_missing")
    return validate.summary(compared, orphaned, missing)


def _partial(spark, d):
    return validate.counts({"orders": read(spark, d, "orders"), "customer": _holey(spark, d)})


_SUMMARY = f"""(SELECT * FROM (
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS target_rows, (SELECT count(*) FROM {_ORDER} o WHERE NOT EXISTS (SELECT 1 FROM {_HOLEY} m WHERE m.old_uuid = o.o_custkey)) AS n_orphans, 0::BIGINT AS n_missing
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM {_HOLEY}), 0::BIGINT, (SELECT count(*) FROM {map_sql('customer')} WHERE new_id % 10 = 0)))"""
_VALID = "(source_rows = target_rows AND n_orphans = 0 AND n_missing = 0)"


def _bench_join2(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice").orderBy("o_orderkey").limit(1000)


def _bench_join3(spark, d):
    o, c, l = (read(spark, d, t) for t in ("orders", "customer", "lineitem"))
    got = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    got = got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", "l_quantity")
    return got.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(1000)


def _bench_uuid_join(spark, d):
    """The two-table join over text keys."""
    o = legacy(spark, d, "orders").select("id", "o_custkey", "o_totalprice")
    c = legacy(spark, d, "customer").select(F.col("id").alias("c_id"), "c_name")
    return o.join(c, o.o_custkey == c.c_id).select("id", "c_name", "o_totalprice").orderBy("id").limit(1000)


def _text_uuid(table: str, key: int) -> str:
    """The legacy key of a row, as a constant."""
    return str(UUID(hashlib.md5(f"{table}:{key}".encode()).hexdigest()))


_DEC = "decimal(18,2)"
_SOME = [uuid("customer", str(k)) for k in (0, 7, 11, 149, 10**9)]

CATALOGUE = {
    "legacy_customer": (lambda s, d: legacy(s, d, "customer").select("id", "c_nationkey", "c_name"), f"SELECT {uuid('customer', 'c_custkey')} AS id, {uuid('nation', 'c_nationkey')} AS c_nationkey, c_name FROM customer"),
    "legacy_orders": (_orders, f"SELECT * FROM {_ORDER}"),
    "mapping_build": (lambda s, d: built(s, d, *KEYS), " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM {map_sql(t)}" for t in KEYS)),
    "mapping_append_ignore": (_append, f"SELECT {uuid('orders', 'o_orderkey')} AS old_uuid, (SELECT max(new_id) FROM {_HALF}) + row_number() OVER (ORDER BY {uuid('orders', 'o_orderkey')}) AS new_id FROM orders QUALIFY old_uuid NOT IN (SELECT old_uuid FROM {_HALF})"),
    "mapping_override": (_override, f"SELECT 'customer' AS table_name, old_uuid, CASE WHEN new_id % 5 = 0 THEN -new_id ELSE new_id END AS new_id FROM {map_sql('customer')}"),
    "mapping_reverse": (lambda s, d: M.reverse(mapping(s, d, "customer"), s.range(5, 40, 5).withColumnRenamed("id", "new_id"), "customer"), f"SELECT new_id, old_uuid FROM {map_sql('customer')} WHERE new_id IN (5, 10, 15, 20, 25, 30, 35)"),
    "mapping_high_water": (lambda s, d: M.high_water(mapping(s, d, "customer", "part")), "SELECT 'customer' AS table_name, count(*)::BIGINT AS high_water FROM customer UNION ALL SELECT 'part', count(*) FROM part"),
    "mapping_counts": (lambda s, d: mapping(s, d, *KEYS).groupBy("table_name").agg(F.count("*").alias("n_mapped")), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_mapped FROM {t}" for t in KEYS)),
    "mapping_cache_stats": (
        lambda s, d: cache_stats(legacy(s, d, "orders"), _holey(s, d), "o_custkey", "customer"),
        f"SELECT count(*)::BIGINT AS requests, count(new_id)::BIGINT AS hits, (count(*) - count(new_id))::BIGINT AS misses, count(new_id)::DOUBLE / count(*) AS hit_rate FROM (SELECT DISTINCT o_custkey FROM {_ORDER}) o LEFT JOIN {_HOLEY} m ON m.old_uuid = o.o_custkey",
    ),
    **{f"rekey_{t}": ((lambda s, d, t=t: rekeyed(s, d, t)), rekeyed_sql(t, c)) for t, c in _REKEYED.items()},
    **{f"rekey_orders_{st.name.lower()}": ((lambda s, d, st=st: rekeyed(s, d, "orders", st)), rekeyed_sql("orders", _REKEYED["orders"])) for st in (Strategy.EAGER, Strategy.LAZY, Strategy.SORTED)},
    "rekey_missing_null": (lambda s, d: remap(_orders(s, d), _holey(s, d), {"o_custkey": "customer"}), f"SELECT o.id, m.new_id AS o_custkey, o_totalprice FROM {_ORDER} o LEFT JOIN {_HOLEY} m ON m.old_uuid = o.o_custkey"),
    "rekey_missing_accept": (_accept, f"SELECT o.id, m.new_id AS o_custkey, o_totalprice FROM {_ORDER} o JOIN {_HOLEY} m ON m.old_uuid = o.o_custkey"),
    "rekey_missing_reject": (_reject, f"SELECT o.id, 'o_custkey=' || o_custkey AS missing FROM {_ORDER} o WHERE o_custkey NOT IN (SELECT old_uuid FROM {_HOLEY})"),
    "delta_anti": (lambda s, d: delta.new_rows(_orders(s, d), _half(s, d), "orders"), f"SELECT * FROM {_ORDER} WHERE id NOT IN (SELECT old_uuid FROM {_HALF})"),
    "delta_skip_known": (
        lambda s, d: delta.skip_known(_orders(s, d), mapping(s, d, "orders").filter("new_id % 2 = 0").select(F.col("old_uuid").alias("id")), _half(s, d), "orders").select("id"),
        f"SELECT old_uuid AS id FROM {map_sql('orders')} WHERE new_id % 3 = 0 AND new_id % 2 <> 0",
    ),
    "delta_counts": (
        lambda s, d: metrics.before_after(_half(s, d).agg(F.count("*").alias("n_rows")).select(F.lit("orders").alias("table_name"), "n_rows"), _counts(s, d).filter("table_name = 'orders'")),
        f"SELECT 'orders' AS table_name, (SELECT count(*) FROM {_HALF}) AS n_before, (SELECT count(*) FROM orders) AS n_after, (SELECT count(*) FROM orders) - (SELECT count(*) FROM {_HALF}) AS n_added",
    ),
    "resume_after_uuid": (lambda s, d: delta.resume_after(_orders(s, d), "7FFFFFFF-0000-0000-0000-000000000000"), f"SELECT * FROM {_ORDER} WHERE id > '7fffffff-0000-0000-0000-000000000000'"),
    "batch_plan": (lambda s, d: delta.batch_plan(keys(s, d, "orders"), 1000), f"SELECT (new_id - 1) // 1000 + 1 AS batch, count(*)::BIGINT AS n_rows, max(old_uuid) AS last_uuid FROM {map_sql('orders')} GROUP BY 1"),
    "id_sample": (lambda s, d: keys(s, d, "orders").orderBy("old_uuid").limit(25), f"SELECT old_uuid FROM {map_sql('orders')} ORDER BY old_uuid LIMIT 25"),
    "skip_already_copied": (
        lambda s, d: delta.already_copied(_counts(s, d).filter("table_name <> 'lineitem'").select("table_name", F.col("n_rows").alias("source"), F.col("n_rows").alias("target"), F.when(F.col("table_name") == "orders", F.col("n_rows") - 1).otherwise(F.col("n_rows")).alias("mapped"))),
        f"SELECT table_name, n_rows AS source, n_rows AS target, n_rows - (table_name = 'orders')::BIGINT AS mapped, table_name <> 'orders' AS done FROM {_COUNTS} WHERE table_name <> 'lineitem'",
    ),
    "table_counts": (_counts, f"SELECT * FROM {_COUNTS}"),
    "validate_counts": (lambda s, d: validate.compare_counts(_counts(s, d), _partial(s, d)), f"SELECT table_name, n_rows AS source_rows, t AS target_rows, n_rows = t AS counts_match FROM (SELECT *, CASE table_name WHEN 'orders' THEN n_rows WHEN 'customer' THEN (SELECT count(*) FROM {_HOLEY}) ELSE 0 END AS t FROM {_COUNTS})"),
    "fk_orphans": (lambda s, d: validate.orphans(_orders(s, d), "o_custkey", _holey(s, d), "old_uuid").select("id", "o_custkey"), f"SELECT id, o_custkey FROM {_ORDER} o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_HOLEY} m WHERE m.old_uuid = o.o_custkey)"),
    "missing_mappings": (lambda s, d: validate.missing_mappings(keys(s, d, "customer"), _holey(s, d), "customer"), f"SELECT old_uuid FROM {map_sql('customer')} EXCEPT SELECT old_uuid FROM {_HOLEY}"),
    "validation_summary": (_validated, f"SELECT *, {_VALID} AS valid FROM {_SUMMARY}"),
    "validation_roll_up": (lambda s, d: validate.roll_up(_validated(s, d)), f"SELECT count(*) FILTER ({_VALID})::BIGINT AS n_valid, count(*) FILTER (NOT {_VALID})::BIGINT AS n_invalid FROM {_SUMMARY}"),
    "unique_index_check": (lambda s, d: validate.duplicates(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "pinned_tables": (lambda s, d: metrics.pinned_tables(_counts(s, d), 8000), f"SELECT table_name, n_rows FROM (SELECT *, sum(n_rows) OVER (ORDER BY n_rows, table_name ROWS UNBOUNDED PRECEDING) AS upto FROM {_COUNTS} WHERE n_rows > 0) WHERE upto <= 4000"),
    "status_progress": (
        lambda s, d: reduce(DataFrame.crossJoin, [_counts(s, d).agg(F.sum("n_rows").alias("source_rows")), _partial(s, d).agg(F.sum("n_rows").alias("target_rows"))]).withColumn("percent", F.col("target_rows") / F.col("source_rows") * 100),
        f"SELECT a::BIGINT AS source_rows, b::BIGINT AS target_rows, b::DOUBLE / a::DOUBLE * 100 AS percent FROM (SELECT (SELECT sum(n_rows) FROM {_COUNTS}) AS a, (SELECT count(*) FROM orders) + (SELECT count(*) FROM {_HOLEY}) AS b)",
    ),
    "rollback_effect": (
        lambda s, d: validate.compare_counts(_counts(s, d).filter("table_name IN ('orders', 'customer')"), validate.counts({"orders": read(s, d, "orders").limit(0), "customer": read(s, d, "customer")})),
        "SELECT 'orders' AS table_name, count(*)::BIGINT AS source_rows, 0::BIGINT AS target_rows, count(*) = 0 AS counts_match FROM orders UNION ALL SELECT 'customer', count(*), count(*), true FROM customer",
    ),
    "bench_join2": (_bench_join2, "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1000"),
    "bench_join2_uuid": (_bench_uuid_join, f"SELECT {uuid('orders', 'o_orderkey')} AS id, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY id LIMIT 1000"),
    "bench_join3": (_bench_join3, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY 1, 2, 3, 4 LIMIT 1000"),
    "bench_groupby": (
        lambda s, d: read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast(_DEC)).cast("double").alias("total")),
        f"SELECT o_custkey, count(*)::BIGINT AS n_orders, sum(o_totalprice::{_DEC})::DOUBLE AS total FROM orders GROUP BY o_custkey",
    ),
    "bench_point_lookup": (lambda s, d: read(s, d, "customer").filter(F.col("c_custkey") == 77).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77"),
    "bench_multi_lookup": (
        lambda s, d: M.lookup(mapping(s, d, "customer"), "customer", [_text_uuid("customer", k) for k in (0, 7, 11, 149, 10**9)]),
        f"SELECT old_uuid, new_id FROM {map_sql('customer')} WHERE old_uuid IN ({', '.join(_SOME)})",
    ),
    "bench_prefix_filter": (lambda s, d: read(s, d, "customer").filter(F.col("c_name").startswith("Customer#00000001")).agg(F.count("*").alias("n")), "SELECT count(*)::BIGINT AS n FROM customer WHERE c_name LIKE 'Customer#00000001%'"),
}
