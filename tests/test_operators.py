"""Behaviour that the catalogue's data doesn't show."""

from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyforge import schema
from keyforge.functions import scalars
from keyforge.operators import cdc, delta, graph, metrics, rekey, state, validate
from keyforge.operators import mapping as M
from keyforge.sources import pgoutput, run_logs, synthetic
from keyforge.sources.store import Store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cycle_is_isolated_with_what_is_below_it():
    a = graph.analyze(["a", "b", "blocked_child", "dictionary"], [("a", "b"), ("b", "a"), ("b", "blocked_child")])
    assert a.cycles == [["a", "b"]]
    assert a.blocked == ["a", "b", "blocked_child"]
    assert a.order == ["dictionary"]


def test_self_reference_is_blocked():
    a = graph.analyze(["department", "employee"], [("employee", "employee"), ("department", "employee")])
    assert (a.blocked, a.order) == (["employee"], ["department"])


def test_order_puts_parents_first_and_ignores_unknown_tables():
    specs = [(p, t) for t, (_, _, parents, _) in synthetic.SHAPES.items() for p in parents.values()]
    a = graph.analyze(list(synthetic.SHAPES), [*specs, ("nowhere", "users")])
    assert len(a.order) == 20 and not a.blocked
    assert all(a.order.index(p) < a.order.index(c) for p, c in specs)
    assert graph.analyze([], []).order == []


@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6))))
@settings(max_examples=60, deadline=None)
def test_graph_splits_all_tables_into_ordered_and_blocked(edges):
    names = [f"t{k}" for k in range(7)]
    a = graph.analyze(names, [(f"t{x}", f"t{y}") for x, y in edges])
    assert sorted(a.order + a.blocked) == names
    assert all(a.order.index(f"t{x}") < a.order.index(f"t{y}") for x, y in edges if f"t{y}" in a.order)


def test_ids_are_dense_in_key_order_whatever_the_partitions(spark):
    keys = [f"{k:08x}-0000" for k in (5, 1, 2**31, 9, 2**32 - 1)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "old_uuid string")
    want = [(k, 100 + i) for i, k in enumerate(sorted(k for k in keys if k), 1)]
    for part in (df, df.repartition(3), df.coalesce(1)):
        assert sorted(map(tuple, M.dense_ids(part, high_water=100).select("old_uuid", "new_id").collect()), key=lambda r: r[1]) == want
    assert M.dense_ids(df.limit(0)).count() == 0


def test_first_mapping_wins_and_only_new_rows_return(spark):
    s = "table_name string, old_uuid string, new_id long"
    m = spark.createDataFrame([("users", "a", 100)], s)
    new = spark.createDataFrame([("users", "a", 200), ("users", "b", 10), ("users", "b", 11), ("orders", "a", 7)], s)
    assert rows(M.append_ignore(m, new)) == [("orders", "a", 7), ("users", "b", 10)]


def test_override_beats_the_table(spark):
    m = spark.createDataFrame([("users", "a", 111), ("users", "b", 5)], "table_name string, old_uuid string, new_id long")
    over = spark.createDataFrame([("a", 999)], "old_uuid string, new_id long")
    assert rows(M.with_override(m, over)) == [("users", "a", 999), ("users", "b", 5)]
    assert rows(M.lookup(m, "users", ["A", "zz"])) == [("a", 111)]


@pytest.mark.parametrize("strategy", rekey.Strategy)
def test_strategies_give_the_same_rows(spark, strategy):
    m = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 9)], "table_name string, old_uuid string, new_id long")
    df = spark.createDataFrame([("x", "a", "a"), ("y", None, "b"), ("z", "zz", "a")], "id string, f string, g string")
    assert rows(rekey.remap(df, m, {"f": "p", "g": "q"}, strategy)) == [("x", 1, 9), ("y", None, None), ("z", None, 9)]
    good, bad = rekey.split_missing(df, m, {"f": "p", "g": "q"}, strategy)
    assert rows(good) == [("x", 1, 9)]
    assert rows(bad) == [("y", None, "b", ["g=b"]), ("z", "zz", "a", ["f=zz"])]


def test_resume_is_in_byte_order(spark):
    df = spark.createDataFrame([("7fff",), ("8000",), ("f000",), ("0000",)], "id string")
    assert rows(delta.resume_after(df, "7FFF")) == [("8000",), ("f000",)]
    assert delta.resume_after(df, None).count() == 4


@pytest.mark.parametrize(
    ("durations", "size", "want", "changes"),
    [
        ([(9999, 300)] * 3, 1000, 500, 1),
        ([(9999, 20)] * 3, 1000, 1250, 1),
        ([(9999, 150)] * 9, 1000, 1000, 0),
        ([(9999, 20)] * 2, 1000, 1000, 0),
        ([(1000, 20)] * 4, 1000, 1000, 0),
        ([(1000, 20)] * 5, 1000, 1250, 1),
        ([(9999, 999)] * 50, 1000, 100, 4),
        ([(9999, 1)] * 50, 1000, 4000, 7),
        ([(9999, 0)] * 5, 1000, 1000, 0),
    ],
)
def test_adaptive_batches(spark, durations, size, want, changes):
    df = spark.createDataFrame([("t", k, r, d) for k, (r, d) in enumerate(durations)], "t string, seq long, rows long, duration_ms long")
    assert rows(metrics.adaptive_batches(df, "t", size)) == [("t", want, changes)]


def test_state_machine(spark):
    log = state.log_frame(spark, [state.row(1, "m", "t", "PENDING"), state.row(2, "m", "t", "COMPLETED"), state.row(3, "m", "u", "PENDING")])
    assert [r.seq for r in state.invalid_transitions(log).collect()] == [2]
    with pytest.raises(ValueError):
        state.row(1, "m", "t", "DONE")
    empty = state.resume_context(state.log_frame(spark, []), "m").first()
    assert empty.checkpoint_table is None and empty.pending == ""


def _record(lsn, op, key, new_key=None, **values):
    old = {"id": key} if op != "I" else None
    new = {"id": new_key or key, **values} if op != "D" else None
    return (lsn, "users", op, None, old, new)


def test_net_change_keeps_unchanged_values_and_forgets_deleted_ones(spark):
    feed = [_record(1, "I", "a", email="1", bio="long"), _record(2, "U", "a", email="2"), _record(3, "I", "b", email="x", bio="y"), _record(4, "D", "b"), _record(5, "I", "b", email="z"), _record(6, "D", "c")]
    got = {r.key: (r.op, r.lsn, r.new) for r in cdc.net(spark.createDataFrame(feed, cdc.SCHEMA)).collect()}
    assert got["a"] == ("U", 2, {"id": "a", "email": "2", "bio": "long"})
    assert got["b"] == ("U", 5, {"id": "b", "email": "z"})
    assert got["c"] == ("D", 6, None)
    target = spark.createDataFrame([("a", "0", "0"), ("c", "1", "1"), ("d", "2", "2")], "id string, email string, bio string")
    once = cdc.apply_net(target, cdc.net(spark.createDataFrame(feed, cdc.SCHEMA)))
    assert rows(once) == [("a", "2", "long"), ("b", "z", None), ("d", "2", "2")]
    assert rows(cdc.apply_net(once, cdc.net(spark.createDataFrame(feed, cdc.SCHEMA)))) == rows(once)


def test_chained_key_changes(spark):
    feed = [_record(k, "U", f"u{k}", f"u{k + 1}") for k in range(50)]
    df = spark.createDataFrame(feed, cdc.SCHEMA)
    assert rows(M.rekey_chain(cdc.key_changes(df))) == [("users", "u0", "u50")]
    m = spark.createDataFrame([("users", "u0", 7), ("users", "v", 8)], "table_name string, old_uuid string, new_id long")
    assert rows(cdc.rekey_mapping(m, df)) == [("users", "u50", 7), ("users", "v", 8)]


def test_missing_parent_is_rejected(spark):
    feed = spark.createDataFrame([(1, "profiles", "I", None, None, {"id": "p1", "user_id": "nobody"}), (2, "profiles", "I", None, None, {"id": "p2", "user_id": "u"})], cdc.SCHEMA)
    m = spark.createDataFrame([("users", "u", 3), ("profiles", "p0", 41)], "table_name string, old_uuid string, new_id long")
    good, bad, ids = cdc.resolve(cdc.net(feed), m, {"user_id": "users"}, "profiles")
    assert rows(bad.select("key", "missing")) == [("p1", ["user_id=nobody"])]
    assert rows(ids) == [("profiles", "p2", 42)]
    assert rows(good) == [(42, "p2", 2, 3)]


def _text(s):
    return s.encode() + b"\0"


def _tuple(*values):
    out = struct.pack(">h", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v.encode())) + v.encode()
    return out


def test_pgoutput_messages(spark):
    rel = b"R" + struct.pack(">I", 9) + _text("public") + _text("users") + b"f" + struct.pack(">h", 2)
    rel += b"".join(b"\1" + _text(c) + struct.pack(">ii", 25, -1) for c in ("id", "bio"))
    head = struct.pack(">I", 9)
    messages = [
        (1, rel), (2, b"B" + b"\0" * 20), (3, b"I" + head + b"N" + _tuple("a", None)), (4, b"U" + head + b"O" + _tuple("a", "é") + b"N" + _tuple("b", ...)),
        (5, b"U" + head + b"N" + _tuple("b", ...)), (6, b"D" + head + b"K" + _tuple("b", None)), (7, b"I" + struct.pack(">I", 8) + b"N" + _tuple("x")), (8, None),
    ]
    df = spark.createDataFrame([(k, None, d) for k, d in messages], "lsn long, ts timestamp, data binary")
    got = {r.lsn: (r.table_name, r.op, r.old, r.new) for r in pgoutput.decode_messages(df).collect()}
    assert got == {
        3: ("users", "I", None, {"id": "a", "bio": None}),
        4: ("users", "U", {"id": "a", "bio": "é"}, {"id": "b", "bio": "é"}),
        5: ("users", "U", None, {"id": "b"}),
        6: ("users", "D", {"id": "b", "bio": None}, None),
    }


def test_scalars_on_nulls(spark):
    df = spark.createDataFrame([(None,)], "v string")
    got = df.select(scalars.csv_value(F.col("v")), scalars.csv_value(F.col("v"), False), scalars.legacy_uuid("t", F.col("v")), scalars.lsn(F.col("v"))).first()
    assert tuple(got) == ("\\N", None, None, None)


def test_validation_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert validate.orphans(empty, "parent", empty).count() == 0
    assert validate.counts({"a": empty}).first().n_rows == 0
    assert rows(cdc.success(cdc.results(spark.createDataFrame([], cdc.SCHEMA), spark.createDataFrame([], "table_name string, key string")))) == [(0, 0, 0, None, 100.0)]


def test_target_types(spark):
    got = {(r.table_name, r.column_name): r.target_type for r in schema.target_columns(spark).collect()}
    assert got["orders", "id"] == "BIGSERIAL PRIMARY KEY" and got["orders", "customer_id"] == "BIGINT"
    assert got["products", "trace"] == "uuid" and got["products", "price"] == "numeric"
    assert not any(t == "staging" for t, _ in got)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.range(3))
    store.append("t", spark.range(3, 5))
    store.backup("b1")
    assert store.read("t").count() == 5 and store.tables() == ["t"] and store.position("t") == -1
    store.replace("t", store.read("t").filter("id > 3"), position=12)
    assert rows(store.read("t")) == [(4,)] and store.position("t") == 12
    assert store.truncate("t") == 1 and store.read("t").isEmpty() and store.position("t") == 12
    assert store.vacuum("t") == 1
    store.restore("b1")
    assert store.read("t").count() == 5 and store.backups() == ["b1"] and store.sizes().first().n_bytes > 0
    store.delete_backup("b1")
    assert store.backups() == []
    with pytest.raises(FileNotFoundError):
        store.restore("b1")
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_synthetic_tables_refer_to_each_other(spark):
    for t, (_, _, parents, _) in synthetic.SHAPES.items():
        df = synthetic.generate(spark, t, 200)
        assert df.count() == synthetic.size(t, 200) == df.select("id").distinct().count()
        for c, p in parents.items():
            assert validate.orphans(df, c, synthetic.generate(spark, p, 200)).count() == 0
    assert sum(synthetic.size(t, 30_000) for t in synthetic.SHAPES) == 199_860
    assert rows(synthetic.generate(spark, "users", 20)) == rows(synthetic.generate(spark, "users", 20).repartition(3))
    load = {r.op: r["count"] for r in synthetic.mixed_load(spark, 2000, 100).groupBy("op").count().collect()}
    assert load["I"] > load["U"] > load["D"]


def test_run_logs(spark, tmp_path):
    for run in ("run-1", "run-2"):
        df = spark.createDataFrame([(1, "t", 1, 10, 1, 1, 1, 3, 3333)], run_logs.SCHEMAS["batch"])
        run_logs.write(df, str(tmp_path), run, "batch")
    run_logs.manifest(spark, str(tmp_path), "run-2", {"a": "b"})
    got = run_logs.read(spark, str(tmp_path), "batch")
    assert sorted(r.run for r in got.collect()) == ["run-1", "run-2"]
    assert [r.run for r in run_logs.latest(got).collect()] == ["run-2"]
