"""Named queries and the SQL that they must agree with.

Each query takes (spark, sf_dir); its SQL runs on the same Parquet tables in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_cdc, queries_keys, queries_meta, queries_metrics, queries_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (queries_meta, queries_keys, queries_cdc, queries_metrics, queries_runs):
    for _name, (_query, _sql) in _module.CATALOGUE.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE[_name] = _sql
