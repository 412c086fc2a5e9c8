"""The commands: init, copy, sync, resume, replicate, validate, rollback, status, backup, generate."""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import per_second
from ..operators import delta, graph, metrics, state, validate
from ..operators import mapping as M
from ..operators.rekey import Strategies, Strategy, hybrid, remap, split_missing
from ..schema import TableSpec
from ..sources import synthetic
from ..sources import run_logs
from ..sources.store import Store, Transaction
from ..streaming import replicate as R

MAPPING, LOG, WATER = R.MAPPING, "run_state", R.WATER
#: Tables in which a run keeps what it did: one row for each slice, and one for each unique index.
BATCHES, INDEXES, ROLLBACKS = "run_batches", "index_checks", "run_rollbacks"
#: Rows of pinned tables together are at most half of this.
PINNED_ROWS = 1_000_000


@dataclass
class Migration:
    """Re-keys the tables of `source` into `target`. Tables of one depth run at the same time.

    A table is copied in `slices` of its key order. A slice is one commit: rows, mapping, rejected
    rows, ids used and progress are published together, so that a run that breaks off
    anywhere goes on where it was.

    on_missing: 'null' sets a foreign key without a parent to null; 'reject' puts the
    row in the target table `<table>_rejects`, which holds those that still lack a parent.
    """

    spark: SparkSession
    source: Store
    target: Store
    specs: tuple[TableSpec, ...]
    run: str = "run"
    strategy: Strategy = Strategy.HYBRID
    on_missing: str = "null"
    slices: int = 1
    _seq: int = field(default=0, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        if self.on_missing not in ("null", "reject"):
            raise ValueError(self.on_missing)
        self.by_name = {s.name: s for s in self.specs}
        if self.target.exists(LOG):
            self._seq = self.target.read(LOG).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    # planning

    def scope(self) -> graph.Analysis:
        """Order, cycles and blocked tables of those that can be re-keyed."""
        fine = [r[0] for r in S.identity(self.spark, self.specs).filter("skip_reason IS NULL").collect()]
        return graph.analyze(fine, [(r.parent, r.child) for r in S.edges(self.spark, self.specs).collect()])

    def init(self) -> DataFrame:
        """(table_name, skip_reason, depth, blocked): the report before anything is done."""
        a = self.scope()
        depth = self.spark.createDataFrame(sorted(a.depth.items()), "table_name string, depth long")
        blocked = self.spark.createDataFrame([(t, True) for t in a.blocked], "table_name string, blocked boolean")
        got = S.identity(self.spark, self.specs).select("table_name", "skip_reason").join(depth, "table_name", "left").join(blocked, "table_name", "left")
        return got.withColumn("blocked", F.coalesce("blocked", F.lit(False)))

    # state

    def _states_of(self, *rows: tuple[str, str, dict]) -> DataFrame:
        out = []
        for table, status, more in rows:
            with self._lock:
                self._seq += 1
                seq = self._seq
            out.append(state.row(seq, self.run, table, status, **({"updated_at": time.time_ns() // 1000} | more)))
        return state.log_frame(self.spark, out)

    def _log(self, *rows: tuple[str, str, dict]) -> None:
        if rows:
            self.target.append(LOG, self._states_of(*rows))

    def states(self) -> DataFrame:
        return state.latest(self.target.read(LOG)) if self.target.exists(LOG) else state.log_frame(self.spark, [])

    def mapping(self) -> DataFrame:
        """The mapping of all tables."""
        names = [t for t in self.target.tables() if t.startswith(MAPPING)]
        out = self.spark.createDataFrame([], "table_name string, old_uuid string, new_id long")
        for t in names:
            out = out.unionByName(self.target.read(t))
        return out

    def _mapping_of(self, table: str) -> DataFrame | None:
        name = MAPPING + table
        return self.target.read(name) if self.target.exists(name) else None

    def high_water(self, table: str) -> int:
        """The largest id that the table ever had, rolled back ones too."""
        return R.high_water(self.target, table)

    # copying

    def _strategy(self) -> Strategies:
        """HYBRID broadcasts the mappings of the smallest tables, as many as stay under half of the limit together."""
        if self.strategy is not Strategy.HYBRID:
            return self.strategy
        there = [t for t in self.scope().order if self.source.exists(t)]
        counted = validate.counts({t: self.source.read(t) for t in there})
        return hybrid([r.table_name for r in metrics.pinned_tables(counted, PINNED_ROWS).collect()])

    def _bounds(self, rows: DataFrame) -> list[tuple[str | None, str | None]]:
        """(after, up to) of `slices` ranges of the key, about equal, from a sample by hash; the last is open."""
        if self.slices < 2:
            return [(None, None)]
        keys = sorted(r.id for r in rows.select("id").filter("id IS NOT NULL").orderBy(F.xxhash64("id")).limit(100 * self.slices).collect())
        ends = sorted({keys[len(keys) * k // self.slices] for k in range(1, self.slices)}) if keys else []
        return list(zip([None, *ends], [*ends, None]))

    def _slice(self, t: Transaction, table: str, rows: DataFrame, strategy: Strategies) -> int:
        """Write a slice's rows that aren't mapped yet into the transaction; returns how many."""
        spec, names = self.by_name[table], rows.columns
        known = self._mapping_of(table)
        if known is not None:
            rows = delta.new_rows(rows, known, table)
        parents = {c: p for c, p in spec.parents.items() if self._mapping_of(p) is not None}
        out = rows
        if parents and self.on_missing == "reject":
            out, bad = split_missing(rows, self.mapping(), parents, strategy)
            name = f"{table}_rejects"
            if self.target.exists(name):  # rows of this slice that were rejected before are judged anew
                bad = self.target.read(name).join(rows.select("id"), "id", "left_anti").select(bad.columns).unionByName(bad)
            t.replace(name, bad)
        elif parents:
            out = remap(rows, self.mapping(), parents, strategy)
        water = self.high_water(table)
        added = t.append(MAPPING + table, M.build(table, out.select(F.col("id").alias("old_uuid")), water))
        ids = added.select(F.col("old_uuid").alias("__old"), F.col("new_id").alias("__new"))
        t.append(table, out.join(ids, F.col("id") == F.col("__old")).withColumn("id", F.col("__new")).select(names))
        n = added.count()
        t.append(WATER, R.water_row(self.spark, table, water + n))
        return n

    def _copy_table(self, table: str, last: str | None, strategy: Strategies) -> int:
        rows, total = delta.resume_after(self.source.read(table), last), 0
        whole = rows.count()
        for k, (after, upto) in enumerate(self._bounds(rows), 1):
            part = rows if after is None else rows.filter(F.col("id") > after)
            part = part if upto is None else part.filter(F.col("id") <= upto)
            began = time.perf_counter()
            with self.target.transaction() as t:
                n = self._slice(t, table, part, strategy)
                total += n
                took = time.perf_counter() - began
                t.append(BATCHES, self.spark.createDataFrame([(self.run, table, k, n, round(took * 1000))], "migration_id string, table_name string, batch long, records long, duration_ms long"))
                t.append(LOG, self._states_of((table, "IN_PROGRESS", {"total_rows": whole, "processed_rows": total, "last_uuid": upto or last, "batch_number": k})))
        return total

    def check_indexes(self, table: str) -> DataFrame | None:
        """(table_name, index_name, n_duplicates) of the table's unique indexes without a predicate; None without any."""
        out = None
        for name, columns, unique, predicate in self.by_name[table].indexes:
            if unique and not predicate:
                n = validate.duplicates(self.target.read(table), list(columns)).agg(F.count("*").alias("n_duplicates"))
                n = n.select(F.lit(table).alias("table_name"), F.lit(name).alias("index_name"), "n_duplicates")
                out = n if out is None else out.unionByName(n)
        return out

    def _copy(self, tables: list[str], last: dict[str, str | None]) -> dict[str, int]:
        if not tables:
            return {}
        depth, done, strategy = self.scope().depth, {}, self._strategy()
        for level in sorted({depth[t] for t in tables}):
            now = [t for t in tables if depth[t] == level]
            self._log(*((t, "IN_PROGRESS", {"last_uuid": last.get(t)}) for t in now))
            with ThreadPoolExecutor(max_workers=4) as pool:
                futures = {t: pool.submit(self._copy_table, t, last.get(t), strategy) for t in now}
            reached = {r.table_name: r for r in self.states().filter(F.col("migration_id") == self.run).collect()}
            ends = []
            for t, f in futures.items():
                at = {"last_uuid": reached[t].last_uuid, "batch_number": reached[t].batch_number}
                if f.exception():
                    ends.append((t, "FAILED", at | {"error": str(f.exception())[:1000], "attempt": reached[t].attempt, "processed_rows": reached[t].processed_rows}))
                else:
                    done[t] = f.result()
                    ends.append((t, "COMPLETED", at | {"last_uuid": None, "processed_rows": done[t], "total_rows": reached[t].total_rows, "completed_at": self._seq + 1 + len(ends)}))
            self._log(*ends)
            if any(e[1] == "FAILED" for e in ends):
                raise RuntimeError(f"failed: {[e[0] for e in ends if e[1] == 'FAILED']}") from next(f.exception() for f in futures.values() if f.exception())
        checks = [c for t in tables if (c := self.check_indexes(t)) is not None]
        if checks:
            self.target.replace(INDEXES, reduce(DataFrame.unionByName, checks))
        return done

    def totals(self) -> DataFrame:
        """(table_name, records, duration_ms, records_per_sec) of the run's tables, and their sum as table_name null."""
        return metrics.sync_totals(self.target.read(BATCHES).filter(F.col("migration_id") == self.run))

    def copy(self) -> dict[str, int]:
        """Copy all tables that aren't copied yet: rows by table."""
        order = self.scope().order
        log = {r.table_name: r.status for r in self.states().filter(F.col("migration_id") == self.run).collect()}
        self._log(*((t, "PENDING", {}) for t in order if log.get(t) != "COMPLETED"))
        return self._copy([t for t in order if log.get(t) != "COMPLETED"], {})

    def sync(self) -> dict[str, int]:
        """Copy rows that came since: inserts only."""
        order = self.scope().order
        self._log(*((t, "PENDING", {}) for t in order))
        return self._copy(order, {})

    def resume(self) -> dict[str, int]:
        """Go on with tables that aren't completed, after the last key that was copied. Rows that are mapped are skipped."""
        log = {r.table_name: r for r in self.states().filter(F.col("migration_id") == self.run).collect()}
        left = [t for t in self.scope().order if t in log and log[t].status != "COMPLETED"]
        self._log(*((t, "RETRYING", {"attempt": log[t].attempt + 1, "last_uuid": log[t].last_uuid}) for t in left if log[t].status in ("FAILED", "IN_PROGRESS")))
        return self._copy(left, {t: log[t].last_uuid for t in left})

    def copy_missing(self) -> dict[str, int]:
        """Copy tables by their counts, whatever the log says: those of which source, target and mapping don't have the same rows."""
        order = [t for t in self.scope().order if self.source.exists(t)]
        there = {t: self.target.exists(t) for t in order}
        n = lambda df: df.count()
        counted = [(t, n(self.source.read(t)), n(self.target.read(t)) if there[t] else 0, n(self._mapping_of(t)) if there[t] else 0) for t in order]
        done = delta.already_copied(self.spark.createDataFrame(counted, "table_name string, source long, target long, mapped long"))
        left = {r.table_name for r in done.filter("NOT done").collect()}
        self._log(*((t, "PENDING", {}) for t in order if t in left))
        return self._copy([t for t in order if t in left], {})

    # checking

    def validate(self) -> DataFrame:
        """(table_name, source_rows, target_rows, n_orphans, n_missing, valid) of the copied tables."""
        done = [t for t in self.scope().order if self.target.exists(t)]
        compared = validate.compare_counts(validate.counts({t: self.source.read(t) for t in done}), validate.counts({t: self.target.read(t) for t in done}))
        checks = [(t, self.target.read(t), c, p, self.target.read(p), "id") for t in done for c, p in self.by_name[t].parents.items() if p in done]
        orphaned = validate.orphan_counts(checks) if checks else self.spark.createDataFrame([], "table_name string, column_name string, parent_table string, n_orphans long")
        mapping, missing = self.mapping(), self.spark.createDataFrame([], "table_name string, n_missing long")
        for t in done:
            n = validate.missing_mappings(self.source.read(t).select(F.col("id").alias("old_uuid")), mapping, t).agg(F.count("*").alias("n_missing"))
            missing = missing.unionByName(n.select(F.lit(t).alias("table_name"), "n_missing"))
        return validate.summary(compared, orphaned, missing)

    def status(self) -> DataFrame:
        """(table_name, source_rows, target_rows, percent) of all tables in order."""
        order = self.scope().order
        src = validate.counts({t: self.source.read(t) for t in order if self.source.exists(t)})
        there = [t for t in order if self.target.exists(t)]
        dst = validate.counts({t: self.target.read(t) for t in there}) if there else src.filter("false")
        got = validate.compare_counts(src, dst)
        return got.select("table_name", "source_rows", "target_rows", F.when(F.col("source_rows") > 0, F.col("target_rows") / F.col("source_rows") * 100).otherwise(100.0).alias("percent"))

    def pinned(self, limit: int) -> DataFrame:
        return metrics.pinned_tables(validate.counts({t: self.source.read(t) for t in self.scope().order}), limit)

    # undoing

    def rollback(self, table: str) -> int:
        """Empty a target table, its mapping with it; returns its rows. Its ids aren't given again."""
        return self._roll_back([table])[table]

    def _roll_back(self, tables: list[str]) -> dict[str, int]:
        """Each table with its mapping is one commit."""
        out = {}
        for table in tables:
            began = time.perf_counter()
            rows, mapping = self.target.read(table), self._mapping_of(table)
            out[table] = rows.count()
            with self.target.transaction() as t:
                t.replace(table, rows.limit(0))
                t.replace(MAPPING + table, mapping.limit(0))
                t.append(LOG, self._states_of((table, "PENDING", {})))
                t.append(ROLLBACKS, self.spark.createDataFrame([(self.run, table, out[table], round((time.perf_counter() - began) * 1000))], "migration_id string, table_name string, records long, duration_ms long"))
        return out

    def rollback_to(self, table: str) -> dict[str, int]:
        """Roll back this table and all that were completed after it, last first."""
        return self._roll_back([r.table_name for r in state.rollback_suffix(self.target.read(LOG), self.run, table).orderBy("place").collect()])

    def rollback_all(self) -> dict[str, int]:
        done = self.states().filter((F.col("migration_id") == self.run) & (F.col("status") == "COMPLETED")).orderBy(F.desc("completed_at"), F.desc("table_name"))
        return self._roll_back([r.table_name for r in done.select("table_name").collect()])

    def rollback_totals(self) -> DataFrame:
        """(n_tables, records, duration_ms) of the run's roll-backs."""
        return metrics.rollback_totals(self.target.read(ROLLBACKS).filter(F.col("migration_id") == self.run))

    def validate_rollback(self, table: str) -> bool:
        """Whether nothing of the table is left."""
        return self.target.read(table).isEmpty() and self._mapping_of(table).isEmpty()

    # the rest

    def replicate(self, folder: str, checkpoint: str, tables: list[str] | None = None, raw: bool = False, once: bool = True):
        """Apply the change files (raw: message files) that are in a folder to the re-keyed target; see streaming.replicate."""
        order = [t for t in self.scope().order if self.target.exists(t) and (tables is None or t in tables)]
        return R.replicate_rekeyed(self.spark, folder, self.target, [self.by_name[t] for t in order], checkpoint, raw, once)

    def write_logs(self, folder: str, command: str = "copy") -> list[str]:
        """The run's logs by kind (run_logs.SCHEMAS), and a manifest with the command and the strategy; returns the kinds."""
        zero = F.lit(0).cast("long")
        keys = S.identity(self.spark, self.specs)
        a = self.scope()
        found = [("order", ",".join(a.order), ""), ("blocked", ",".join(sorted(a.blocked)), "")]
        frames = {
            "schema_inventory": keys.select(zero.alias("elapsed_ms"), "table_name", F.array_join("pk_columns", ",").alias("pk_columns"), F.array_join("pk_types", ",").alias("pk_types"), F.isnull("skip_reason").alias("eligible"), "skip_reason"),
            "dependencies": self.spark.createDataFrame([(0, *r) for r in found], run_logs.SCHEMAS["dependencies"]),
            "jvm": run_logs.jvm(self.spark),
        }
        if self.target.exists(BATCHES):
            b = self.target.read(BATCHES).filter(F.col("migration_id") == self.run)
            elapsed = F.sum("duration_ms").over(Window.partitionBy("table_name").orderBy("batch"))
            speed = per_second(F.col("records"), F.col("duration_ms"))
            frames["batch"] = b.select(elapsed.alias("elapsed_ms"), "table_name", "batch", "records", *(zero.alias(f"{c}_ms") for c in ("insert", "mapping", "commit")), "duration_ms", speed.alias("records_per_sec"))
            frames["batch_phase"] = b.select(elapsed.alias("elapsed_ms"), "table_name", "batch", F.lit("slice").alias("phase"), "duration_ms", "records", speed.alias("records_per_sec"))
            frames["mapping"] = b.select(elapsed.alias("elapsed_ms"), "table_name", "batch", F.col("records").alias("records_saved"), "duration_ms")
        for kind, df in frames.items():
            run_logs.write(df, folder, self.run, kind)
        run_logs.manifest(self.spark, folder, self.run, {"command": command, "strategy": self.strategy.name, "on_missing": self.on_missing, "slices": str(self.slices)})
        return sorted(frames)

    def backup(self, name: str) -> None:
        self.target.backup(name)

    def restore(self, name: str) -> None:
        self.target.restore(name)


def generate(spark: SparkSession, store: Store, base: int, seed: int = 42, tables: list[str] | None = None) -> dict[str, int]:
    """Fill a store with synthetic tables, of all 25 unless some are named: rows of those that can be re-keyed."""
    for t in tables or synthetic.SHAPES:
        store.replace(t, synthetic.generate(spark, t, base, seed))
    if not tables:
        for s in synthetic.ODD:
            store.replace(s.name, synthetic.generate_odd(spark, s.name, base, seed))
    return {t: synthetic.size(t, base) for t in tables or synthetic.SHAPES}


def full_cycle(spark: SparkSession, root: str, base: int, seed: int = 42, tables: list[str] | None = None) -> DataFrame:
    """(scenario, n_rows, seconds, ok) of what changes the target in suite(): copy, sync, validate, resume and rollback."""
    return suite(spark, root, base, seed, tables).filter("scenario NOT IN ('status', 'analysis')").select("scenario", "n_rows", "seconds", "ok")


def suite(spark: SparkSession, root: str, base: int, seed: int = 42, tables: list[str] | None = None) -> DataFrame:
    """(scenario, n_rows, seconds, measure, value, grade, passed, ok) of a whole cycle over synthetic tables.

    Generate, copy, add 1 % of the users (1000 at least, or all there are), sync, validate, status,
    resume a copy that stops after half of the tables, write and read the logs, roll back. ok: the rows are
    right; grade and passed judge the speed (metrics.GRADES), where a scenario has one.
    """
    src, dst = Store(spark, f"{root}/source"), Store(spark, f"{root}/target")
    names = tables or list(synthetic.SHAPES)
    specs = tuple(s for s in synthetic_specs() if s.name in names)
    m = Migration(spark, src, dst, specs)
    out = []

    def scenario(name, work, ok, measure=None, value=None):
        began = time.perf_counter()
        n = work()
        took = time.perf_counter() - began
        out.append((name, int(n), took, measure, float(value(n, took)) if value else None, bool(ok(n))))

    made = generate(spark, src, base, seed, names)
    total = sum(made.values())
    added = min(max(1000, base // 100), synthetic.size("users", base))
    scenario("copy", lambda: sum(m.copy().values()), lambda n: n == total, "rows_per_sec", lambda n, s: n / s)
    src.append("users", synthetic.generate(spark, "users", base, seed, start=synthetic.size("users", base)).limit(added))
    scenario("sync", lambda: sum(m.sync().values()), lambda n: n == added, "sync_percent", lambda n, s: n / added * 100)
    scenario("validate", lambda: m.validate().filter("NOT valid").count(), lambda n: n == 0)
    scenario("status", lambda: m.status().filter("percent <> 100").count(), lambda n: n == 0)
    order = [(t, k) for k, t in enumerate(m.scope().order, 1)]
    half = [r.table_name for r in delta.split_half(spark.createDataFrame(order, "table_name string, place long")).filter("half = 'first'").collect()]
    again = Migration(spark, src, Store(spark, f"{root}/again"), specs, run="again")
    again._log(*((t, "PENDING", {}) for t, _ in order))
    again._copy([t for t, _ in order if t in half], {})
    rest = total + added - sum(src.read(t).count() for t in half)
    scenario("resume", lambda: sum(again.resume().values()), lambda n: n == rest)
    scenario("analysis", lambda: len(m.write_logs(f"{root}/logs")) and run_logs.read(spark, f"{root}/logs", "batch").agg(F.sum("records")).first()[0], lambda n: n == total + added)
    scenario("rollback", lambda: sum(m.rollback_all().values()), lambda n: n == total + added, "rollback_tables_per_min", lambda n, s: len(names) / s * 60)
    got = spark.createDataFrame(out, "scenario string, n_rows long, seconds double, measure string, value double, ok boolean")
    return metrics.graded(got).select("scenario", "n_rows", "seconds", "measure", "value", "grade", "passed", "ok")


def synthetic_specs() -> tuple[TableSpec, ...]:
    """The specs of the synthetic tables, with those that can't be re-keyed."""
    return synthetic.ODD + tuple(TableSpec(t, {"id": "uuid", **dict.fromkeys(p, "uuid"), **dict.fromkeys(o, "text")}, ("id",), p) for t, (_, _, p, o) in synthetic.SHAPES.items())


SAMPLE_CONFIG = """# strategy: HYBRID | EAGER | LAZY | SORTED
strategy: HYBRID
# on_missing: null | reject
on_missing: null
source: /data/source
target: /data/target
run: run
"""


def config(text: str) -> dict[str, str]:
    """Settings of `key: value` lines; # begins a comment."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if ":" in line:
            key, _, value = line.partition(":")
            out[key.strip()] = value.strip()
    return out
