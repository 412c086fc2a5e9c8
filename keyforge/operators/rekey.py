"""Re-keying rows: foreign keys become dense ids by one join each."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Strategy(Enum):
    """How the mapping is joined; the rows are the same with each."""

    EAGER = "broadcast"  #: of a mapping whose size was checked
    LAZY = "shuffle_hash"
    SORTED = "merge"
    HYBRID = None  #: broadcast for pinned tables and mappings that fit, else left to the optimizer and its statistics


#: EAGER broadcasts a mapping whose keys and ids have at most so many bytes; a larger one is shuffled.
EAGER_BYTES = 64 << 20
#: One strategy for all parents, or one for each parent table (HYBRID where it has none).
Strategies = Strategy | dict[str, Strategy]


def hybrid(pinned: list[str]) -> dict[str, Strategy]:
    """HYBRID by table: the mappings of pinned tables (metrics.pinned_tables) are broadcast."""
    return dict.fromkeys(pinned, Strategy.EAGER)


_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def compact(key: Column) -> Column:
    """A text key as bytes, which differ where texts do: 16 of a uuid in lower case, of any other text its own after 17 zeros."""
    return F.when(key.rlike(_UUID), F.unhex(F.replace(key, F.lit("-")))).otherwise(F.concat(F.lit(bytes(17)), key.cast("binary")))


def _fits(side: DataFrame) -> bool:
    """Whether keys and ids of a mapping may be broadcast; a large one isn't read for this, if its statistics tell."""
    return side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= EAGER_BYTES and _bytes(side) <= EAGER_BYTES


def _bytes(side: DataFrame) -> int:
    return side.agg(F.coalesce(F.sum(F.octet_length("__old") + 24), F.lit(0))).first()[0]


def _side(mapping: DataFrame, table: str, strategy: Strategies) -> DataFrame:
    side = mapping.filter(F.col("table_name") == table).select(F.col("old_uuid").alias("__old"), F.col("new_id").alias("__new"))
    if isinstance(strategy, dict):
        strategy = strategy.get(table, Strategy.HYBRID)
    if strategy is Strategy.EAGER:
        return F.broadcast(side) if _bytes(side) <= EAGER_BYTES else side
    return side.hint(strategy.value) if strategy.value else side


def remap(rows: DataFrame, mapping: DataFrame, parents: dict[str, str], strategy: Strategies = Strategy.HYBRID) -> DataFrame:
    """rows with each column of `parents` (column -> table) replaced by the id of its key.

    A key without an id becomes null, as does null. Rows are shuffled with their keys as bytes; a mapping that fits
    is broadcast with any strategy but a shuffling one.
    """
    names = rows.columns
    text = {c for c in parents if dict(rows.dtypes)[c] == "string"}
    rows = rows.withColumns({c: compact(F.col(c)) for c in text})
    for column, table in parents.items():
        side = _side(mapping, table, strategy)
        own = strategy.get(table, Strategy.HYBRID) if isinstance(strategy, dict) else strategy
        fits = own is Strategy.HYBRID and _fits(side)
        if column in text:
            side = side.withColumn("__old", compact(F.col("__old")))
        rows = rows.join(F.broadcast(side) if fits else side, F.col(column) == F.col("__old"), "left")
        rows = rows.withColumn(column, F.col("__new")).drop("__old", "__new")
    return rows.select(names)


def split_missing(rows: DataFrame, mapping: DataFrame, parents: dict[str, str], strategy: Strategies = Strategy.HYBRID) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): re-keyed rows without a missing parent, and the others as they came, with `missing`.

    missing is an array of column=key. A null foreign key isn't missing.
    """
    names, faults = rows.columns, []
    got = rows
    for k, (column, table) in enumerate(parents.items()):
        side = _side(mapping, table, strategy).withColumnRenamed("__old", f"__old{k}").withColumnRenamed("__new", f"__new{k}")
        got = got.join(side, F.col(column) == F.col(f"__old{k}"), "left")
        faults.append(F.when(F.col(column).isNotNull() & F.col(f"__new{k}").isNull(), F.concat(F.lit(f"{column}="), F.col(column))))
    got = got.withColumn("missing", F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"))
    new: dict[str, Column] = {c: F.col(c) for c in names}
    new |= {column: F.col(f"__new{k}") for k, column in enumerate(parents)}
    return got.filter(F.size("missing") == 0).select([v.alias(c) for c, v in new.items()]), got.filter(F.size("missing") > 0).select(*names, "missing")


def cache_stats(rows: DataFrame, mapping: DataFrame, column: str, table: str) -> DataFrame:
    """(requests, hits, misses, hit_rate) of looking up a column's distinct keys."""
    side = mapping.filter(F.col("table_name") == table).select(F.col("old_uuid").alias(column), F.lit(1).alias("hit"))
    asked = rows.select(column).filter(F.col(column).isNotNull()).distinct().join(side, column, "left")
    n, hits = F.count("*"), F.count("hit")
    return asked.agg(n.alias("requests"), hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"))
