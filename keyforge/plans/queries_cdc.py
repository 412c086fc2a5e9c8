"""Queries over the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc
from ..operators import mapping as M
from ..shared import scratch
from ..sources.legacy import change_feed, legacy, mapping
from ..sources.store import Store
from ..streaming.replicate import replicate
from .sqltext import mapping as map_sql
from .sqltext import uuid

_FEED = f"(SELECT event_id AS lsn, CASE WHEN event_id % 10 < 7 THEN 'I' WHEN event_id % 10 < 9 THEN 'U' ELSE 'D' END AS op, {uuid('customer', 'user_id')} AS key, value, user_id FROM events)"
_LAST = f"(SELECT * FROM {_FEED} QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)"
_FINAL = f"""SELECT {uuid('customer', 'c_custkey')} AS id, CASE WHEN op IS NULL THEN c_acctbal ELSE value END AS c_acctbal FROM customer LEFT JOIN {_LAST} l ON l.user_id = c_custkey WHERE op IS DISTINCT FROM 'D'"""
_CHAIN = [("users", 1, "a1", "a2"), ("users", 2, "b1", "b2"), ("users", 3, "a2", "a3"), ("users", 4, "a3", "a4"), ("orders", 5, "a1", "z9")]


def _target(spark: SparkSession, d: str) -> DataFrame:
    return legacy(spark, d, "customer").select("id", "c_acctbal")


def _final(spark, d):
    return cdc.apply_net(_target(spark, d), cdc.net(change_feed(spark, d)))


def _holey(spark, d):
    return mapping(spark, d, "customer").filter("new_id % 10 <> 0")


_HOLEY = f"(SELECT * FROM {map_sql('customer')} WHERE new_id % 10 <> 0)"


def _results(spark, d):
    return cdc.results(change_feed(spark, d), _holey(spark, d).withColumnRenamed("old_uuid", "key"))


_RESULTS = f"(SELECT lsn, op, key, op = 'I' OR m.old_uuid IS NOT NULL AS success FROM {_FEED} f LEFT JOIN {_HOLEY} m ON m.old_uuid = f.key)"


def _resolved(spark, d):
    """New profiles, as changes whose parent is the customer of the event: some parents are missing."""
    feed = change_feed(spark, d).filter("op = 'I'")
    rows = feed.select("lsn", F.lit("profile").alias("table_name"), "op", "ts", "old", F.create_map(F.lit("id"), F.concat(F.lit("p"), F.lpad(F.col("lsn").cast("string"), 9, "0")), F.lit("owner"), F.element_at("new", F.lit("id"))).alias("new"))
    return cdc.resolve(cdc.net(rows), _holey(spark, d), {"owner": "customer"}, "profile")


def _chains(spark, d):
    return M.rekey_chain(spark.createDataFrame(_CHAIN, "table_name string, lsn long, old_uuid string, new_uuid string"))


#: Files of a feed that a batch takes: all, as files come in no order of positions. How many they are goes with the feed, and each is a task's work.
ALL = 1 << 30


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The feed as files, streamed twice over into a store: the same table as applying it once."""
    root = scratch(spark, "replay")
    store = Store(spark, f"{root}/tables")
    store.replace("customer", _target(spark, d))
    change_feed(spark, d).repartitionByRange("lsn").write.mode("overwrite").parquet(f"{root}/feed")
    for k in range(2):
        query = replicate(spark, f"{root}/feed", store, ["customer"], f"{root}/checkpoint{k}", files=ALL)
        query.awaitTermination()
    return store.read("customer")


CATALOGUE = {
    "cdc_feed": (lambda s, d: cdc.key_of(change_feed(s, d)).select("lsn", "op", "key", F.element_at("new", F.lit("c_acctbal")).cast("double").alias("value")), f"SELECT lsn, op, key, CASE WHEN op <> 'D' THEN value END AS value FROM {_FEED}"),
    "cdc_op_filter": (lambda s, d: change_feed(s, d).filter("op = 'U'").select("lsn", "op"), f"SELECT lsn, op FROM {_FEED} WHERE op = 'U'"),
    "cdc_runs": (
        lambda s, d: cdc.runs(change_feed(s, d)),
        f"""SELECT batch, run::BIGINT AS run, 'customer' AS table_name, op, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*)::BIGINT AS n_events FROM (
        SELECT *, sum(new) OVER (PARTITION BY batch ORDER BY lsn) AS run FROM (SELECT *, lsn // 1000 AS batch, (op IS DISTINCT FROM lag(op) OVER (PARTITION BY lsn // 1000 ORDER BY lsn))::BIGINT AS new FROM {_FEED})) GROUP BY batch, run, op""",
    ),
    "cdc_net": (lambda s, d: cdc.net(change_feed(s, d)).select("key", "op", "lsn", F.element_at("new", F.lit("c_acctbal")).cast("double").alias("value")), f"SELECT key, CASE op WHEN 'D' THEN 'D' ELSE 'U' END AS op, lsn, CASE WHEN op <> 'D' THEN value END AS value FROM {_LAST}"),
    "cdc_apply_final": (_final, _FINAL),
    "cdc_delete_effect": (lambda s, d: _target(s, d).join(_final(s, d), "id", "left_anti").select("id"), f"SELECT key AS id FROM {_LAST} WHERE op = 'D'"),
    "cdc_results": (lambda s, d: _results(s, d).select("lsn", "op", "success", "error"), f"SELECT lsn, op, success, CASE WHEN NOT success THEN 'no mapping for customer.' || key END AS error FROM {_RESULTS}"),
    "cdc_success_rate": (
        lambda s, d: cdc.success(_results(s, d)),
        f"SELECT count(*)::BIGINT AS n_events, count(*) FILTER (success)::BIGINT AS n_applied, count(*) FILTER (NOT success)::BIGINT AS n_failed, max(lsn) FILTER (success) AS last_lsn, count(*) FILTER (success)::DOUBLE / count(*) * 100 AS success_rate FROM {_RESULTS}",
    ),
    "cdc_rejects": (lambda s, d: _resolved(s, d)[1].select("key", F.array_join("missing", ",").alias("missing")), f"SELECT 'p' || lpad(lsn::VARCHAR, 9, '0') AS key, 'owner=' || key AS missing FROM {_FEED} WHERE op = 'I' AND key NOT IN (SELECT old_uuid FROM {_HOLEY})"),
    "cdc_resolved": (lambda s, d: _resolved(s, d)[0], f"SELECT row_number() OVER (ORDER BY lsn)::BIGINT AS id, 'p' || lpad(lsn::VARCHAR, 9, '0') AS key, lsn, m.new_id AS owner FROM {_FEED} f JOIN {_HOLEY} m ON m.old_uuid = f.key WHERE op = 'I'"),
    "cdc_rekey_chain": (_chains, "SELECT * FROM (VALUES ('users', 'a1', 'a4'), ('users', 'b1', 'b2'), ('orders', 'a1', 'z9')) t(table_name, first_uuid, last_uuid)"),
    "stream_replay": (stream_replay, _FINAL),
}
