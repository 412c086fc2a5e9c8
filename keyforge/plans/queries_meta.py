"""Queries over schemas, the table graph and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..operators import graph, state
from ..sources.legacy import read
from .sqltext import values

_COLS = values([(s.name, c, k, t) for s in S.SHOP for k, (c, t) in enumerate(s.columns.items(), 1)], "table_name", "column_name", "ordinal", "column_type")
_PK = values([(s.name, c, k) for s in S.SHOP for k, c in enumerate(s.key or (None,), 1)], "table_name", "column_name", "position")
_FK = values([(s.name, c, p) for s in S.SHOP for c, p in s.parents.items()], "table_name", "column_name", "parent_table")
_IDX = values([(s.name, n, k, c, u, p) for s in S.SHOP for n, cols, u, p in s.indexes for k, c in enumerate(cols)], "table_name", "index_name", "place", "column_name", "is_unique", "predicate")
_IDENTITY = f"""(
SELECT table_name, count(column_name) AS n, min(column_name) AS c, min(column_type) AS t, string_agg(column_name, ',' ORDER BY position) AS pk_columns, string_agg(column_type, ',' ORDER BY position) AS pk_types,
  CASE WHEN count(column_name) = 0 THEN 'NO_PRIMARY_KEY' WHEN count(column_name) > 1 THEN 'COMPOSITE_PRIMARY_KEY'
       WHEN min(column_name) <> 'id' THEN 'PRIMARY_KEY_NOT_ID' WHEN min(column_type) <> 'uuid' THEN 'NON_UUID_PRIMARY_KEY' END AS skip_reason
FROM {_PK} p LEFT JOIN {_COLS} c USING (table_name, column_name) GROUP BY table_name)"""
_GRAPH = f"""
v AS (SELECT table_name AS t FROM {_IDENTITY} WHERE skip_reason IS NULL),
e AS (SELECT DISTINCT parent_table AS p, table_name AS c FROM {_FK} WHERE parent_table IN (FROM v) AND table_name IN (FROM v)),
reach AS (SELECT p AS a, c AS b FROM e UNION SELECT r.a, e.c FROM reach r JOIN e ON e.p = r.b),
cyc AS (SELECT a AS t FROM reach WHERE a = b),
blk AS (SELECT t FROM cyc UNION SELECT b FROM reach WHERE a IN (FROM cyc))"""


def _eligible(spark: SparkSession) -> DataFrame:
    return S.identity(spark).filter("skip_reason IS NULL").select("table_name")


def _identity(spark, _):
    return S.identity(spark).select("table_name", F.array_join("pk_columns", ",").alias("pk_columns"), F.array_join("pk_types", ",").alias("pk_types"), "skip_reason")


_STATE = [
    state.row(1, "m1", "users", "PENDING"), state.row(2, "m1", "orders", "PENDING"), state.row(3, "m1", "items", "PENDING"), state.row(4, "m1", "notes", "PENDING"),
    state.row(5, "m1", "users", "IN_PROGRESS", processed_rows=10, last_uuid="0a", batch_number=1), state.row(6, "m1", "users", "COMPLETED", processed_rows=20, completed_at=6),
    state.row(7, "m1", "orders", "IN_PROGRESS"), state.row(8, "m1", "orders", "COMPLETED", completed_at=8), state.row(9, "m1", "items", "IN_PROGRESS", processed_rows=7, last_uuid="7f", batch_number=3),
    state.row(10, "m2", "users", "PENDING"), state.row(11, "m2", "users", "IN_PROGRESS", last_uuid="c1"), state.row(12, "m2", "users", "FAILED", error="disk"), state.row(13, "m2", "users", "RETRYING", last_uuid="c1", attempt=1, updated_at=9),
    state.row(14, "m2", "orders", "COMPLETED", completed_at=14),
]
_LOG = values(_STATE, "seq", "migration_id", "table_name", "status", "total_rows", "processed_rows", "last_uuid", "batch_number", "attempt", "error", "completed_at", "updated_at")
_LATEST = f"(SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY migration_id, table_name ORDER BY seq DESC) = 1)"


def _log(spark: SparkSession) -> DataFrame:
    return state.log_frame(spark, _STATE)


def _scalar(spark, d):
    """The text functions over names that need quoting."""
    c = read(spark, d, "customer")
    odd = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 1, F.lit("\\N")).when(F.col("c_custkey") % 7 == 2, F.concat("c_name", F.lit(',"x"'))).when(F.col("c_custkey") % 7 == 3, F.concat("c_name", F.lit("\\y"))).otherwise(F.col("c_name")).cast("string")
    return c.select("c_custkey", odd.alias("v"))


_ODD = """(SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '\\N' WHEN 2 THEN c_name || ',"x"' WHEN 3 THEN c_name || '\\y' ELSE c_name END AS v FROM customer)"""
_WAL = [(k, v) for k, v in enumerate(["42", "-3.5", "t", "F", "null", "pending", "'plain text'", "'0A0b0c0d-0000-4000-8000-00000000000f'", "0a0b0c0d-0000-4000-8000-00000000000F", "NULL", "1.2.3", "", "'", "007", "99999999999999999999"])] + [(99, None)]
_U = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_URLS = ["jdbc:postgresql://db.example:6543/shop?ssl=true", "jdbc:postgresql://localhost/x", "nonsense", "jdbc:postgresql://h:1/"]

CATALOGUE = {
    "schema_inventory": (lambda s, d: S.columns(s), f"SELECT table_name, column_name, ordinal::BIGINT AS ordinal, column_type FROM {_COLS}"),
    "eligibility": (_identity, f"SELECT table_name, coalesce(pk_columns, '') AS pk_columns, coalesce(pk_types, '') AS pk_types, skip_reason FROM {_IDENTITY}"),
    "skip_reason_histogram": (
        lambda s, d: S.identity(s).groupBy("skip_reason").agg(F.count("*").alias("n_tables")).filter("skip_reason IS NOT NULL").orderBy("skip_reason"),
        f"SELECT skip_reason, count(*)::BIGINT AS n_tables FROM {_IDENTITY} WHERE skip_reason IS NOT NULL GROUP BY skip_reason",
    ),
    "fk_columns": (lambda s, d: S.foreign_keys(s), f"SELECT * FROM {_FK}"),
    "fk_edges": (lambda s, d: S.edges(s), f"SELECT DISTINCT parent_table AS parent, table_name AS child FROM {_FK}"),
    "target_schema": (
        lambda s, d: S.target_columns(s),
        f"""SELECT c.table_name, ordinal::BIGINT AS ordinal, column_name, CASE WHEN column_name = 'id' THEN 'BIGSERIAL PRIMARY KEY' WHEN f.parent_table IS NOT NULL THEN 'BIGINT' ELSE column_type END AS target_type
        FROM {_COLS} c LEFT JOIN {_FK} f USING (table_name, column_name) WHERE c.table_name IN (SELECT table_name FROM {_IDENTITY} WHERE skip_reason IS NULL)""",
    ),
    "index_inventory": (
        lambda s, d: S.indexes(s).withColumn("columns", F.array_join("columns", ",")),
        f"SELECT table_name, index_name, is_unique, predicate, string_agg(column_name, ',' ORDER BY place) AS columns FROM {_IDX} GROUP BY ALL",
    ),
    "fk_index_names": (lambda s, d: S.foreign_key_indexes(s), f"SELECT 'idx_' || table_name || '_' || column_name AS index_name, table_name, column_name FROM {_FK}"),
    "catalogue_tables": (lambda s, d: S.catalogue_tables(s), f"SELECT table_name, count(*)::BIGINT AS n_columns, min(column_name) FILTER (ordinal = 1) AS first_column FROM {_COLS} GROUP BY table_name"),
    "migration_depth": (
        lambda s, d: graph.depths(s, _eligible(s), S.edges(s)),
        f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT t, 0 AS depth FROM v WHERE t NOT IN (FROM blk) UNION SELECT e.c, w.depth + 1 FROM w JOIN e ON e.p = w.t WHERE e.c NOT IN (FROM blk))
        SELECT t AS table_name, max(depth)::BIGINT AS depth FROM w GROUP BY t""",
    ),
    "cycle_components": (
        lambda s, d: graph.cycle_members(s, _eligible(s), S.edges(s)),
        f"""WITH RECURSIVE {_GRAPH} SELECT (SELECT string_agg(DISTINCT r.a, ',' ORDER BY r.a) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.b = cyc.t) AS component, t AS table_name FROM cyc""",
    ),
    "blocked_tables": (lambda s, d: graph.blocked(s, _eligible(s), S.edges(s)), f"WITH RECURSIVE {_GRAPH} SELECT t AS table_name FROM blk"),
    "blocked_relations": (lambda s, d: graph.blocked_relations(s, _eligible(s), S.edges(s)), f"WITH RECURSIVE {_GRAPH} SELECT p AS parent, c AS child FROM e WHERE p IN (FROM blk) OR c IN (FROM blk)"),
    "state_latest": (lambda s, d: state.latest(_log(s)).select("migration_id", "table_name", "status", "processed_rows", "last_uuid"), f"SELECT migration_id, table_name, status, processed_rows::BIGINT AS processed_rows, last_uuid FROM {_LATEST}"),
    "state_ordered": (
        lambda s, d: state.ordered(_log(s), "m1").select("status_rank", "table_name", "status"),
        f"SELECT CASE status WHEN 'IN_PROGRESS' THEN 1 WHEN 'RETRYING' THEN 2 WHEN 'FAILED' THEN 3 WHEN 'PENDING' THEN 4 ELSE 5 END::BIGINT AS status_rank, table_name, status FROM {_LATEST} WHERE migration_id = 'm1' ORDER BY 1, 2",
    ),
    "resume_context": (
        lambda s, d: state.resume_context(_log(s), "m1"),
        f"""SELECT arg_max(table_name, updated_at) FILTER (status IN ('IN_PROGRESS', 'RETRYING')) AS checkpoint_table, arg_max(last_uuid, updated_at) FILTER (status IN ('IN_PROGRESS', 'RETRYING')) AS checkpoint_uuid,
        coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (status = 'FAILED'), '') AS failed, coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (status = 'PENDING'), '') AS pending,
        coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (status = 'COMPLETED'), '') AS completed FROM {_LATEST} WHERE migration_id = 'm1'""",
    ),
    "last_active": (lambda s, d: state.last_active(_log(s)), f"SELECT migration_id FROM {_LATEST} WHERE status IN ('IN_PROGRESS', 'RETRYING') ORDER BY updated_at DESC, migration_id DESC LIMIT 1"),
    "rollback_suffix": (
        lambda s, d: state.rollback_suffix(_log(s), "m1", "users"),
        f"SELECT table_name, row_number() OVER (ORDER BY completed_at DESC, table_name DESC)::BIGINT AS place FROM {_LATEST} WHERE migration_id = 'm1' AND status = 'COMPLETED' AND completed_at >= 6",
    ),
    "invalid_transitions": (lambda s, d: state.invalid_transitions(_log(s)).select("seq", "status"), f"SELECT seq::BIGINT AS seq, status FROM {_LOG} WHERE seq = 14"),
    "tables_to_do": (
        lambda s, d: state.to_do(s.createDataFrame([("users", 0), ("items", 2), ("orders", 1), ("notes", 1)], "table_name string, depth long"), _log(s), "m1"),
        f"SELECT table_name, depth::BIGINT AS depth FROM {values([('users', 0), ('items', 2), ('orders', 1), ('notes', 1)], 'table_name', 'depth')} JOIN {_LATEST} l USING (table_name) WHERE migration_id = 'm1' AND status <> 'COMPLETED'",
    ),
    "csv_value": (
        lambda s, d: _scalar(s, d).select("c_custkey", X.csv_value(F.col("v")).alias("field")),
        f"""SELECT c_custkey, CASE WHEN v IS NULL THEN '\\N' WHEN v = '\\N' OR regexp_matches(v, '[,"\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS field FROM {_ODD}""",
    ),
    "log_csv_value": (lambda s, d: _scalar(s, d).select("c_custkey", X.csv_value(F.col("v"), False).alias("field")), f"""SELECT c_custkey, CASE WHEN regexp_matches(v, '[,"\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS field FROM {_ODD}"""),
    "quote_identifier": (lambda s, d: _scalar(s, d).select("c_custkey", X.quote_identifier(F.col("v")).alias("quoted")), f"""SELECT c_custkey, '"' || replace(v, '"', '""') || '"' AS quoted FROM {_ODD}"""),
    "json_text": (lambda s, d: _scalar(s, d).select("c_custkey", X.json_text(F.col("v")).alias("json")), f"""SELECT c_custkey, '"' || replace(replace(v, '\\', '\\\\'), '"', '\\"') || '"' AS json FROM {_ODD}"""),
    "wal_parse_values": (
        lambda s, d: s.createDataFrame(_WAL, "k long, v string").withColumn("p", X.infer_wal_value(F.col("v"))).select("k", "p.*"),
        f"""SELECT k::BIGINT AS k, kind, CASE WHEN kind = 'long' THEN v::BIGINT END AS long, CASE WHEN kind = 'double' THEN v::DOUBLE END AS double, CASE WHEN kind = 'bool' THEN lower(v) = 't' END AS bool,
        CASE kind WHEN 'uuid' THEN lower(inner_) WHEN 'text' THEN CASE WHEN quoted THEN inner_ ELSE v END END AS text FROM (
        SELECT *, CASE WHEN v IS NULL OR lower(v) = 'null' THEN 'null' WHEN quoted AND regexp_full_match(inner_, '{_U}') THEN 'uuid' WHEN quoted THEN 'text' WHEN regexp_full_match(v, '-?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL THEN 'long'
        WHEN regexp_full_match(v, '-?[0-9]+\\.[0-9]+') THEN 'double' WHEN lower(v) IN ('t', 'f') THEN 'bool' WHEN regexp_full_match(v, '{_U}') THEN 'uuid' ELSE 'text' END AS kind
        FROM (SELECT k, v, coalesce(v LIKE '''%''' AND length(v) > 1, false) AS quoted, regexp_replace(v, '^''|''$', '', 'g') AS inner_ FROM {values(_WAL, 'k', 'v')}))""",
    ),
    "size_pretty": (
        lambda s, d: read(s, d, "events").select("event_id", X.pretty_size(F.col("event_id") * F.col("event_id") * 37).alias("size"), X.pretty_lag(F.col("event_id") * F.col("event_id") * 37).alias("lag")),
        """SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || ' KB' WHEN n < 1073741824 THEN (n // 1048576) || ' MB' ELSE (n // 1073741824) || ' GB' END AS size,
        CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN (n // 1024) || ' KB' ELSE (n // 1048576) || ' MB' END AS lag FROM (SELECT event_id, event_id * event_id * 37 AS n FROM events)""",
    ),
    "lsn_lag": (
        lambda s, d: read(s, d, "events").select("event_id", (X.lsn(F.concat(F.hex(F.col("event_id") % 16), F.lit("/"), F.hex(F.col("event_id") * 4099))) - F.col("event_id")).alias("lag")),
        "SELECT event_id, (event_id % 16) * 4294967296 + event_id * 4099 - event_id AS lag FROM events",
    ),
    "jdbc_parts": (
        lambda s, d: s.createDataFrame([(u,) for u in _URLS], "url string").select("url", *(X.jdbc_part(F.col("url"), p).alias(p) for p in ("host", "port", "database"))),
        f"""SELECT url, coalesce(nullif(regexp_extract(url, 'jdbc:postgresql://([^:/]+)', 1), ''), 'localhost') AS host, coalesce(nullif(regexp_extract(url, 'jdbc:postgresql://[^:]+:([0-9]+)', 1), ''), '5432') AS port,
        coalesce(nullif(regexp_extract(url, 'jdbc:postgresql://[^/]+/([^?]+)', 1), ''), 'source_db') AS database FROM {values([(u,) for u in _URLS], 'url')}""",
    ),
    "rows_per_sec": (
        lambda s, d: read(s, d, "events").select("event_id", X.per_second(F.col("event_id"), F.col("event_id") % 50).alias("per_sec"), X.clamp(F.col("event_id"), F.lit(10), F.lit(500)).alias("clamped"), X.ratio(F.col("event_id") % 50, F.col("event_id") % 3).alias("ratio")),
        """SELECT event_id, CASE WHEN event_id % 50 > 0 THEN event_id * 1000 // (event_id % 50) ELSE 0 END AS per_sec, least(greatest(event_id, 10), 500) AS clamped,
        CASE WHEN event_id % 3 > 0 THEN (event_id % 50)::DOUBLE / (event_id % 3) * 100.0 ELSE 0.0::DOUBLE END AS ratio FROM events""",
    ),
    "option_and_names": (
        lambda s, d: read(s, d, "nation").select("n_nationkey", X.truthy(F.element_at(F.array(F.lit("Yes"), F.lit("no"), F.lit("TRUE")), F.col("n_nationkey") % 3 + 1)).alias("on"), X.without_schema(F.concat(F.lit("public."), "n_name")).alias("bare"), X.is_uuid(X.legacy_uuid("nation", F.col("n_nationkey"))).alias("is_uuid")),
        "SELECT n_nationkey, n_nationkey % 3 <> 1 AS \"on\", n_name AS bare, true AS is_uuid FROM nation",
    ),
}
