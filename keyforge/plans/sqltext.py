"""Pieces of the DuckDB SQL that the queries are compared with."""

from __future__ import annotations


def uuid(table: str, key: str) -> str:
    """The legacy key of a row."""
    h = f"md5('{table}:' || {key}::VARCHAR)"
    return f"(CASE WHEN {key} IS NOT NULL THEN concat_ws('-', {', '.join(f'substr({h}, {at}, {n})' for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))}) END)"


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def mapping(table: str) -> str:
    """(old_uuid, new_id) of a table."""
    u = uuid(table, KEYS[table])
    return f"(SELECT {u} AS old_uuid, row_number() OVER (ORDER BY {u})::BIGINT AS new_id FROM {table})"


def values(rows: list[tuple], *columns: str) -> str:
    """A table of literals; None is null."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({', '.join(columns)}))"
