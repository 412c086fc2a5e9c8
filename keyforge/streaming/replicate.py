"""Replication: a stream of change records applied to a store, exactly once by log position.

A batch is one commit: changes, mappings, rejects and positions are published together. It
costs what the batch holds, as changes are laid over the tables (sources.store) and not worked into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc
from ..operators import mapping as M
from ..schema import TableSpec
from ..sources import pgoutput
from ..sources.store import Store

MAPPING, WATER, REJECTS, RELATIONS = "mapping_", "high_water", "rejects", "relations"
#: Keys of a batch are broadcast to find them in a mapping, up to so many records.
FEW = 500_000


def changes(spark: SparkSession, folder: str, files: int = 1000, raw: bool = False) -> DataFrame:
    """A stream of the change files (cdc.SCHEMA; raw: pgoutput.SCHEMA) that arrive in a folder; `files` at most in a batch."""
    return spark.readStream.schema(pgoutput.SCHEMA if raw else cdc.SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def high_water(store: Store, table: str) -> int:
    """The largest id that the table ever had, rolled back ones too."""
    if not store.exists(WATER):
        return 0
    return store.read(WATER).filter(F.col("table_name") == table).agg(F.coalesce(F.max("high_water"), F.lit(0))).first()[0]


def water_row(spark: SparkSession, table: str, water: int) -> DataFrame:
    return spark.createDataFrame([(table, water)], "table_name string, high_water long")


def _only(keys: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of keys (key, ...) that a batch of n records asks for; keys isn't shuffled for a small batch."""
    wanted = wanted.filter("key IS NOT NULL").distinct()
    return keys.join(F.broadcast(wanted) if n <= FEW else wanted, "key", "left_semi")


def _asked(rows: DataFrame) -> DataFrame:
    """The keys of records, before and after."""
    keyed = cdc.key_of(rows)
    return keyed.select("key").unionByName(keyed.select(F.col("old_key").alias("key")))


def _seen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(key): keys that exist, or come in the batch by inserts and key changes."""
    return known.select("key").unionByName(cdc.key_of(rows).filter("op = 'I'").select("key")).unionByName(cdc.key_changes(rows).select(F.col("new_uuid").alias("key"))).distinct()


def _unknown(rows: DataFrame, known: DataFrame, table: str) -> DataFrame:
    """(lsn, table_name, op, error) of updates and deletes of keys that neither exist nor come in the batch."""
    return cdc.results(rows, _seen(rows, known).withColumn("table_name", F.lit(table))).filter("NOT success").drop("success")


def _checked(rows: DataFrame, known: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """rows with ids as foreign keys, whether a record is wrong, and its error: an unknown key, or a parent without an id.

    sides: (key, new_id) of the parent of each foreign key. One join for the key and one for each parent, as records hold whole rows.
    """
    names = rows.columns
    got = cdc.key_of(rows).drop("key").join(_seen(rows, known).select(F.col("key").alias("__seen")), F.col("old_key") == F.col("__seen"), "left")
    unknown = F.coalesce((F.col("op") != "I") & F.col("__seen").isNull(), F.lit(False))
    lives, faults = F.col("op") != "D", []
    for k, (c, side) in enumerate(sides.items()):
        key = F.when(lives, F.element_at("new", F.lit(c)))
        got = got.join(side.select(F.col("key").alias(f"__old{k}"), F.col("new_id").alias(f"__new{k}")), key == F.col(f"__old{k}"), "left")
        faults.append(F.when(key.isNotNull() & F.col(f"__new{k}").isNull(), F.concat(F.lit(f"{c}="), key)))
    missing = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    new = F.col("new")
    if sides:
        ids = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(f"__new{k}").cast("string")) for k, c in enumerate(sides))))
        rest = F.map_filter("new", lambda c, _: ~c.isin(*sides))
        new = F.when(lives, F.map_concat(rest, F.map_filter(ids, lambda c, _: F.map_contains_key("new", c))))
    error = F.when(unknown, F.concat(F.lit("no mapping for "), "table_name", F.lit("."), "old_key")).otherwise(F.concat(F.lit("no mapping for "), F.array_join(missing, ", ")))
    wrong = unknown | (F.size(missing) > 0)
    return got.select(*(new.alias(c) if c == "new" else F.col(c) for c in names), wrong.alias("wrong"), F.when(wrong, error).alias("error"))


def _records(table: str, lsn: Column | str, op: Column | str, old: Column, new: Column) -> list[Column]:
    return [F.col(lsn) if isinstance(lsn, str) else lsn, F.lit(table).alias("table_name"), op if isinstance(op, Column) else F.col(op), F.lit(None).cast("timestamp_ntz").alias("ts"), old.alias("old"), new.alias("new")]


_NONE = "map<string,string>"
_NEVER = (1 << 63) - 1


def apply_batch(store: Store, tables: list[str], batch: DataFrame) -> dict[str, int]:
    """Apply a batch to the store's tables (keys as legacy text in id): records by table.

    Records at or before a table's position are done already, whatever batch they
    come in now. Records of other tables are ignored, as they aren't published.
    Records of unknown keys are put in the table `rejects` and don't stop the others.
    """
    done = {}
    # a few passes over a batch that is cached, not the source again
    batch = batch.persist()
    try:
        with store.transaction() as t:
            for table in tables:
                rows = batch.filter((F.col("table_name") == table) & (F.col("lsn") > store.position(table)))
                n, last = rows.agg(F.count("*"), F.max("lsn")).first()
                if not n:
                    continue
                known = _only(store.read(table).select(F.col("id").alias("key")), _asked(rows), n)
                bad = _unknown(rows, known, table)
                good = rows.join(bad.select("lsn"), "lsn", "left_anti")
                moved = cdc.key_changes(good).select(*_records(table, "lsn", F.lit("D").alias("op"), F.create_map(F.lit("id"), "old_uuid"), F.lit(None).cast(_NONE)))
                net = cdc.net(good.unionByName(moved))
                t.append(REJECTS, bad)
                t.merge(table, net.select(*_records(table, "lsn", "op", F.create_map(F.lit("id"), "key"), F.map_concat(F.map_filter("new", lambda k, _: k != "id"), F.create_map(F.lit("id"), "key")))), position=last)
                done[table] = n
    finally:
        batch.unpersist()
    return done


def follow(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows (key, at, ...) with `key` as it is after all key changes later than `at`.

    moves: (lsn, old_uuid, new_uuid). A key that is left may be taken again: what comes
    later under it is another row.
    """
    names = rows.columns
    moves = moves.select(F.col("lsn").alias("__lsn"), F.col("old_uuid").alias("__from"), F.col("new_uuid").alias("__to"))
    while True:
        step = rows.join(moves, (F.col("key") == F.col("__from")) & (F.col("__lsn") > F.col("at")), "left")
        first = step.groupBy(*names).agg(F.min(F.when(F.col("__to").isNotNull(), F.struct("__lsn", "__to"))).alias("to"))
        rows = first.persist()
        if rows.filter("to IS NOT NULL").isEmpty():
            return rows.drop("to")
        rows = rows.withColumn("key", F.coalesce("to.__to", "key")).withColumn("at", F.coalesce("to.__lsn", "at")).drop("to")


def apply_rekeyed(store: Store, specs: list[TableSpec], batch: DataFrame) -> dict[str, int]:
    """Apply a batch of legacy-key records to re-keyed tables, parents before children: records by table.

    Inserts get ids and mapping rows, updates and deletes go by the mapping, foreign keys
    become ids, and a key change moves the mapping row to the new key. Inserting a key that
    is mapped updates its row. A record of an unknown key, or whose parent has
    no id, is put in `rejects` with what is wrong and doesn't stop the others. All is one commit.
    A deleted row keeps its mapping row. Records at or before a table's position are done.
    """
    done: dict[str, int] = {}
    mappings: dict[str, DataFrame] = {}
    spark, batch = store.spark, batch.persist()
    try:
        with store.transaction() as t:
            for spec in specs:
                table = spec.name
                rows = batch.filter((F.col("table_name") == table) & (F.col("lsn") > store.position(table)))
                n, last = rows.agg(F.count("*"), F.max("lsn")).first()
                if not n:
                    continue
                mapping = store.read(MAPPING + table).select(F.col("old_uuid").alias("key"), "new_id")
                known = _only(mapping, _asked(rows), n).persist()
                # foreign keys, by the mappings as this batch leaves them
                parents = {c: p for c, p in spec.parents.items() if store.exists(MAPPING + p)}
                sides = {}
                for c, p in parents.items():
                    of = mappings[p] if p in mappings else store.read(MAPPING + p).select("table_name", "old_uuid", "new_id")
                    asked = rows.filter("op <> 'D'").select(F.element_at("new", F.lit(c)).alias("key"))
                    sides[c] = _only(of.withColumnRenamed("old_uuid", "key"), asked, n).select("key", "new_id").distinct()
                checked = _checked(rows, known, sides).persist()
                bad = checked.filter("wrong").select("lsn", "table_name", "op", "error")
                good = checked.filter("NOT wrong").drop("wrong", "error")
                keyed = cdc.key_of(good).select("key", F.col("lsn").alias("at"), F.col("lsn").alias("record"))
                moves = cdc.key_changes(good).select("lsn", "old_uuid", "new_uuid")
                after = known.withColumn("old_uuid", F.col("key"))
                if moves.isEmpty():
                    final = cdc.key_of(good).withColumnRenamed("key", "final")
                else:
                    keyed = follow(keyed, moves)
                    after = follow(after.withColumn("at", F.lit(-1).cast("long")), moves).drop("at")
                    final = good.join(keyed.select(F.col("record").alias("lsn"), F.col("key").alias("final")), "lsn")
                name = F.create_map(F.lit("id"), "final")
                net = cdc.net(final.select(*_records(table, "lsn", "op", name, F.map_concat(F.map_filter("new", lambda k, _: k != "id"), name)))).persist()
                # a mapping row goes with its key; keys without one get ids
                t.merge(MAPPING + table, after.filter("key <> old_uuid").select(*_records(MAPPING + table, F.lit(last).alias("lsn"), F.lit("U").alias("op"), F.create_map(F.lit("new_id"), F.col("new_id").cast("string")), F.create_map(F.lit("new_id"), F.col("new_id").cast("string"), F.lit("old_uuid"), F.col("key"), F.lit("table_name"), F.lit(table)))), key="new_id")
                water = high_water(store, table)
                fresh = net.filter("op = 'U'").select("key").join(after, "key", "left_anti").select(F.col("key").alias("old_uuid"))
                added = t.append(MAPPING + table, M.build(table, fresh, water))
                t.append(WATER, water_row(spark, table, water + added.count()))
                every = after.select("key", "new_id").unionByName(added.select(F.col("old_uuid").alias("key"), "new_id"))
                id_ = F.create_map(F.lit("id"), F.col("new_id").cast("string"))
                out = net.join(every, "key").select(*_records(table, "lsn", "op", id_, F.when(F.col("op") != "D", F.map_concat(F.map_filter("new", lambda k, _: k != "id"), id_))))
                t.merge(table, out, position=last)
                t.append(REJECTS, bad)
                old = store.read(MAPPING + table).join(after.filter("key <> old_uuid").select("new_id"), "new_id", "left_anti")
                mappings[table] = old.select("table_name", "old_uuid", "new_id").unionByName(every.select(F.lit(table).alias("table_name"), F.col("key").alias("old_uuid"), "new_id"))
                done[table] = n
    finally:
        batch.unpersist()
    return done


def _ahead(store: Store, specs: list[TableSpec], messages: DataFrame, known: DataFrame) -> DataFrame:
    """The messages that may hold a row beyond its table's position: the others needn't be decoded."""
    done, at = {s.name: store.position(s.name) for s in specs}, {}
    for r in known.select("relation_id", "table_name").distinct().collect():
        at[r.relation_id] = min(at.get(r.relation_id, _NEVER), done.get(r.table_name, _NEVER))
    rid = F.conv(F.hex(F.substring("data", 2, 4)), 16, 10).cast("long")
    after = F.coalesce(*(F.when(rid == k, F.lit(v)) for k, v in at.items()), F.lit(_NEVER))
    return messages.filter((F.octet_length("data") < 5) | (F.col("lsn") > after))


def apply_messages(store: Store, specs: list[TableSpec], messages: DataFrame) -> dict[str, int]:
    """Apply a batch of raw messages (pgoutput.SCHEMA) to re-keyed tables.

    The relations that came with earlier batches are kept in the table `relations`; rows are
    decoded by the relation as of their position.
    """
    messages = messages.persist()
    try:
        new = pgoutput.relations(messages)
        if not new.isEmpty():
            store.append(RELATIONS, new)  # before the rows: a batch that is tried again adds the same ones
        known = store.read(RELATIONS) if store.exists(RELATIONS) else new
        return apply_rekeyed(store, specs, pgoutput.decode_messages(_ahead(store, specs, messages, known), known))
    finally:
        messages.unpersist()


def _start(stream: DataFrame, apply, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda df, _: apply(df) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def replicate(spark: SparkSession, folder: str, store: Store, tables: list[str], checkpoint: str, once: bool = True, interval: str = "5 seconds", files: int = 1000) -> StreamingQuery:
    """Start applying to legacy-key tables; once: all that is there now, then stop; else every `interval`."""
    return _start(changes(spark, folder, files), lambda df: apply_batch(store, tables, df), checkpoint, once, interval)


def replicate_rekeyed(spark: SparkSession, folder: str, store: Store, specs: list[TableSpec], checkpoint: str, raw: bool = False, once: bool = True, interval: str = "5 seconds", files: int = 1000) -> StreamingQuery:
    """The same for re-keyed tables, of change records or (raw) of messages."""
    apply = apply_messages if raw else apply_rekeyed
    return _start(changes(spark, folder, files, raw), lambda df: apply(store, specs, df), checkpoint, once, interval)


def drop_replication(spark: SparkSession, checkpoint: str) -> bool:
    """Forget how far a stream has read; whether there was anything. Tables keep their positions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lag(store: Store, table: str, newest: int) -> int:
    """Bytes of log between the newest record and what the table has: positions are byte addresses of the log."""
    return max(0, newest - store.position(table))
