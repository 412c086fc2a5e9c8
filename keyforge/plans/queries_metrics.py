"""Queries over run metrics, made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.legacy import batch_log, read

_LOG = "(SELECT event_type AS table_name, event_id AS seq, event_id % 997 + 1 AS records, round(value * 100)::BIGINT % 400 AS duration_ms, user_id FROM events)"
_SPEED = "CASE WHEN duration_ms > 0 THEN records * 1000 // duration_ms ELSE 0 END"


def _ops(s, d):
    return batch_log(s, d).select(F.concat(F.when(F.col("user_id") % 2 == 0, "db.").otherwise("app."), "table_name").alias("operation"), "duration_ms")


_OPS = f"(SELECT CASE user_id % 2 WHEN 0 THEN 'db.' ELSE 'app.' END || table_name AS operation, duration_ms FROM {_LOG})"


def _usage(s, d):
    return batch_log(s, d).select(F.col("table_name").alias("operation"), (F.col("seq") % 9).alias("active"), (F.col("duration_ms") % 150).alias("wait_ms"), (F.col("duration_ms") * 4).alias("duration_ms"))


_USAGE = f"(SELECT table_name AS operation, seq % 9 AS active, duration_ms % 150 AS wait_ms, duration_ms * 4 AS duration_ms FROM {_LOG})"


def _samples(s, d):
    return batch_log(s, d).select("table_name", F.col("seq").alias("at"), ((F.col("seq") * 7) % 5000).alias("value"))


def _runs(s, d):
    e = read(s, d, "events")
    return e.select((F.col("event_id") % 5).alias("run"), F.when(F.col("user_id") % 2 == 0, "bigint").otherwise("uuid").alias("kind"), (F.col("event_id") % 1000).alias("size"))


CATALOGUE = {
    "batch_stats": (lambda s, d: metrics.batch_stats(batch_log(s, d)), f"SELECT table_name, count(*)::BIGINT AS n_batches, sum(records)::BIGINT AS n_records, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, sum(duration_ms)::BIGINT AS total_ms FROM {_LOG} GROUP BY table_name"),
    "speed_ranges": (
        lambda s, d: metrics.speed_ranges(batch_log(s, d)),
        f"SELECT table_name, (CASE WHEN sum(duration_ms) > 0 THEN sum(records)::BIGINT * 1000 // sum(duration_ms)::BIGINT ELSE 0 END)::BIGINT AS avg_speed, min({_SPEED}) AS min_speed, max({_SPEED}) AS max_speed FROM {_LOG} GROUP BY table_name",
    ),
    "op_stats": (
        lambda s, d: metrics.op_stats(_ops(s, d)),
        f"SELECT operation, count(*)::BIGINT AS n_calls, sum(duration_ms)::BIGINT AS total_ms, sum(duration_ms)::DOUBLE / count(*) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, CASE WHEN sum(duration_ms) > 0 THEN count(*)::DOUBLE * 1000.0::DOUBLE / sum(duration_ms)::DOUBLE ELSE 0 END AS per_sec FROM {_OPS} GROUP BY operation",
    ),
    "database_share": (
        lambda s, d: metrics.database_share(_ops(s, d)),
        f"SELECT *, CASE WHEN db_share > 80 THEN 16 WHEN db_share > 50 THEN 8 ELSE 4 END::BIGINT AS threads FROM (SELECT db_ms, total_ms, db_ms::DOUBLE / total_ms::DOUBLE * 100 AS db_share FROM (SELECT sum(duration_ms) FILTER (operation LIKE 'db%')::BIGINT AS db_ms, sum(duration_ms)::BIGINT AS total_ms FROM {_OPS}))",
    ),
    "connection_usage": (
        lambda s, d: metrics.connection_usage(_usage(s, d)),
        f"SELECT operation, count(*)::BIGINT AS n_uses, max(active) AS max_active, sum(wait_ms)::BIGINT AS wait_ms, sum(wait_ms)::DOUBLE / count(*) AS avg_wait_ms, count(*) FILTER (wait_ms > 100 OR duration_ms > 1000)::BIGINT AS n_slow FROM {_USAGE} GROUP BY operation ORDER BY n_uses DESC, operation LIMIT 20",
    ),
    "counter_rate": (
        lambda s, d: metrics.counter_rate(_samples(s, d)),
        f"""SELECT table_name, "at", increase, increase::DOUBLE / seconds::DOUBLE AS per_sec FROM (SELECT table_name, seq AS "at", CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE v END AS increase, seq - lag(seq) OVER w AS seconds
        FROM (SELECT *, seq * 7 % 5000 AS v FROM {_LOG}) WINDOW w AS (PARTITION BY table_name ORDER BY seq)) WHERE seconds IS NOT NULL""",
    ),
    "adaptive_fold": (
        lambda s, d: metrics.adaptive_batches(batch_log(s, d), "table_name"),
        f"""SELECT table_name, r.size AS final_size, r.changes AS n_changes FROM (SELECT table_name, list_reduce(list_prepend({{'size': 1000::BIGINT, 'n': 0::BIGINT, 'rows': 0::BIGINT, 'changes': 0::BIGINT, 'd': 0::BIGINT}}, l), lambda a, x:
          {{'size': CASE WHEN NOT (x.d > 0 AND a.n + 1 > 2 AND a.rows + x.rows >= 5000) THEN a.size WHEN x.d > 225 THEN greatest(a.size // 2, 100) WHEN x.d < 75 THEN least(a.size + greatest(a.size // 4, 1), 4000) ELSE a.size END,
            'n': a.n + 1, 'rows': a.rows + x.rows,
            'changes': a.changes + (CASE WHEN NOT (x.d > 0 AND a.n + 1 > 2 AND a.rows + x.rows >= 5000) THEN a.size WHEN x.d > 225 THEN greatest(a.size // 2, 100) WHEN x.d < 75 THEN least(a.size + greatest(a.size // 4, 1), 4000) ELSE a.size END <> a.size)::BIGINT,
            'd': x.d}}) AS r FROM (SELECT table_name, list({{'size': 0::BIGINT, 'n': 0::BIGINT, 'rows': records, 'changes': 0::BIGINT, 'd': duration_ms}} ORDER BY seq) AS l FROM {_LOG} GROUP BY table_name))""",
    ),
    "index_size_model": (lambda s, d: metrics.index_size_model(batch_log(s, d)), f"SELECT n_records, n_records * 37.0::DOUBLE / 1e6::DOUBLE AS uuid_mb, n_records * 21.0::DOUBLE / 1e6::DOUBLE AS bigint_mb, (1 - (n_records * 21.0::DOUBLE / 1e6::DOUBLE) / (n_records * 37.0::DOUBLE / 1e6::DOUBLE)) * 100 AS saved_percent FROM (SELECT sum(records)::BIGINT AS n_records FROM {_LOG})"),
    "run_efficiency": (
        lambda s, d: metrics.run_efficiency(_runs(s, d)),
        "SELECT run, b AS bigint_size, u AS uuid_size, CASE WHEN u > 0 THEN 1 - b::DOUBLE / u::DOUBLE ELSE 0 END AS efficiency FROM (SELECT event_id % 5 AS run, coalesce(sum(event_id % 1000) FILTER (user_id % 2 = 0), 0)::BIGINT AS b, coalesce(sum(event_id % 1000) FILTER (user_id % 2 <> 0), 0)::BIGINT AS u FROM events GROUP BY 1)",
    ),
}
