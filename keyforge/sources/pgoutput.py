"""Decoder of logical-replication messages (the public pgoutput format, version 1)."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Relations = dict[int, tuple[str, list[str]]]
#: Of raw messages.
SCHEMA = "lsn long, ts timestamp_ntz, data binary"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        out = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out

    def row(self, columns: list[str]) -> tuple[dict[str, str | None], list[str]]:
        """(values, columns whose large value didn't change)."""
        out, kept = {}, []
        for k in range(self.take("h")):
            name, kind = columns[k] if k < len(columns) else f"column_{k}", self.take("c")
            if kind == b"u":
                kept.append(name)
            elif kind == b"n":
                out[name] = None
            else:
                size = self.take("i")
                out[name] = self.data[self.at : self.at + size].decode()
                self.at += size
        return out, kept


def relation(data: bytes) -> tuple[int, str, list[str]] | None:
    """(id, table, columns) of a relation message."""
    r = _Reader(data)
    if r.take("c") != b"R":
        return None
    rid, _, name, _, n = r.take("I"), r.text(), r.text(), r.take("b"), r.take("h")
    columns = []
    for _ in range(n):
        r.take("b")
        columns.append(r.text())
        r.take("ii")
    return rid, name, columns


def decode(data: bytes, relations: Relations) -> tuple[str, str, dict | None, dict | None] | None:
    """(table, op, old, new) of a row message; None for any other, or of an unknown relation.

    A value that didn't change is taken from the old row, and is left out without one.
    """
    r = _Reader(data)
    op = r.take("c").decode()
    if op not in "IUD" or (rid := r.take("I")) not in relations:
        return None
    table, columns = relations[rid]
    old = new = None
    kind = r.take("c")
    if op == "U" and kind in (b"O", b"K"):
        old, _ = r.row(columns)
        kind = r.take("c")
    if op == "D":
        old, _ = r.row(columns)
    elif kind == b"N":
        new, kept = r.row(columns)
        new |= {c: old[c] for c in kept if old and c in old}
    return table, op, old, new


def encode_relation(rid: int, table: str, columns: list[str]) -> bytes:
    """A relation message; columns are text."""
    out = b"R" + struct.pack(">I", rid) + b"public\0" + table.encode() + b"\0f" + struct.pack(">h", len(columns))
    return out + b"".join(b"\0" + c.encode() + b"\0" + struct.pack(">ii", 25, -1) for c in columns)


def _number(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * size, "0"))


def _row(values: Column, columns: list[str]) -> Column:
    parts = [_number(F.lit(len(columns)), 2)]
    for c in columns:
        v = F.element_at(values, F.lit(c))
        parts.append(F.when(v.isNull(), F.lit(b"n")).otherwise(F.concat(F.lit(b"t"), _number(F.octet_length(v), 4), v.cast("binary"))))
    return F.concat(*parts)


def encode_rows(changes: DataFrame, rid: int, columns: list[str]) -> DataFrame:
    """Messages (SCHEMA) of one table's change records: what decode_messages() reads."""
    head, new, old = _number(F.lit(rid), 4), F.concat(F.lit(b"N"), _row(F.col("new"), columns)), F.concat(F.lit(b"O"), _row(F.col("old"), columns))
    data = F.when(F.col("op") == "I", F.concat(F.lit(b"I"), head, new)).when(F.col("op") == "D", F.concat(F.lit(b"D"), head, old))
    return changes.select("lsn", F.col("ts").cast("timestamp_ntz").alias("ts"), data.otherwise(F.concat(F.lit(b"U"), head, F.when(F.col("old").isNotNull(), old).otherwise(F.lit(b"")), new)).alias("data"))


def relations(messages: DataFrame) -> DataFrame:
    """(lsn, relation_id, table_name, columns) of the relation messages that change what was known of their relation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lsn, *relation(data)) for lsn, data in zip(*(batch.column(c).to_pylist() for c in ("lsn", "data")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _RELATION)], schema=_RELATION)

    got = messages.filter(F.substring("data", 1, 1) == F.lit(b"R")).select("lsn", "data").mapInArrow(run, "lsn long, relation_id long, table_name string, columns array<string>")
    now = F.struct("table_name", "columns")
    before = F.lag(now).over(Window.partitionBy("relation_id").orderBy("lsn"))
    return got.withColumn("same", F.coalesce(before == now, F.lit(False))).filter("NOT same").drop("same")


_RELATION = pa.schema([("lsn", pa.int64()), ("relation_id", pa.int64()), ("table_name", pa.string()), ("columns", pa.list_(pa.string()))])
_CHANGE = pa.schema([("lsn", pa.int64()), ("table_name", pa.string()), ("op", pa.string()), ("ts", pa.timestamp("us")), ("old", pa.map_(pa.string(), pa.string())), ("new", pa.map_(pa.string(), pa.string()))])


def decode_messages(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Change records of messages (lsn long, ts, data binary), by Arrow batches.

    known: relations(), of these messages unless given, which come to the driver: a row for each
    version of a table's columns. A row message is decoded by the last version at or
    before its position; one before its relation's first version by that.
    """
    history: dict[int, tuple[list[int], list[tuple[str, list[str]]]]] = {}
    for r in sorted((known if known is not None else relations(messages)).collect(), key=lambda r: r.lsn):
        at, versions = history.setdefault(r.relation_id, ([], []))
        at.append(r.lsn)
        versions.append((r.table_name, list(r.columns)))

    def as_of(data: bytes, lsn: int) -> Relations:
        rid = struct.unpack_from(">I", data, 1)[0] if len(data) >= 5 else -1
        if rid not in history:
            return {}
        at, versions = history[rid]
        return {rid: versions[max(0, bisect.bisect_right(at, lsn) - 1)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lsn, ts, data in zip(*(batch.column(c).to_pylist() for c in ("lsn", "ts", "data"))):
                got = decode(data, as_of(data, lsn)) if data and lsn is not None else None
                if got:
                    table, op, old, new = got
                    rows.append((lsn, table, op, ts, old and list(old.items()), new and list(new.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _CHANGE)], schema=_CHANGE)

    return messages.select("lsn", F.col("ts").cast("timestamp_ntz").alias("ts"), "data").mapInArrow(run, "lsn long, table_name string, op string, ts timestamp_ntz, old map<string,string>, new map<string,string>")
