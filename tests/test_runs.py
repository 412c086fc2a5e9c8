"""Runs that break off, writers at the same time, replication into re-keyed tables, and ids of any keys."""

from __future__ import annotations

import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_migrate import SPECS, _ids, _more, stores  # noqa: F401

from keyforge.functions.scalars import legacy_uuid
from keyforge.operators import cdc, mapping
from keyforge.operators import rekey as rekey_module
from keyforge.operators.rekey import Strategy, hybrid, remap
from keyforge.plans import queries_cdc, queries_runs
from keyforge.plans.migrate import BATCHES, INDEXES, Migration, full_cycle, suite
from keyforge.schema import TableSpec
from keyforge.shared import is_local, scratch, shared_dir
from keyforge.sources import pgoutput, run_logs, store as store_module
from keyforge.sources.store import Conflict, Store
from keyforge.streaming import replicate as replicate_module
from keyforge.streaming.replicate import MAPPING, REJECTS, apply_messages, apply_rekeyed, drop_replication, follow, replicate_rekeyed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Breaking(Store):
    """Fails instead of making commit number `at`."""

    at, made = 0, 0

    def commit(self, change):
        self.made += 1
        if self.made == self.at:
            raise OSError("broken off")
        super().commit(change)


@pytest.mark.parametrize("at", [1, 2, 3, 4, 5])
def test_a_copy_that_breaks_off_at_any_commit_is_resumed(spark, tmp_path, at):
    """The commits are: pending, at work, two slices, done."""
    src, dst = Store(spark, str(tmp_path / "s")), Breaking(spark, str(tmp_path / "t"))
    src.replace("users", _ids(spark, "users", 0, 50).select("id", F.concat(F.lit("e"), "n").alias("email")))
    dst.at = at
    with pytest.raises((OSError, RuntimeError)):
        Migration(spark, src, dst, SPECS[:1], slices=2).copy()
    again = Migration(spark, src, dst, SPECS[:1], slices=2)
    if dst.exists("run_state"):
        again.resume()
    else:
        again.copy()
    got = dst.read("users")
    assert sorted(r.id for r in got.collect()) == list(range(1, 51))
    joined = got.join(dst.read("mapping_users"), got.id == F.col("new_id")).join(src.read("users").withColumnRenamed("id", "old_uuid").withColumnRenamed("email", "e"), "old_uuid")
    assert joined.filter("email = e").count() == 50
    assert {r.status for r in again.states().collect()} == {"COMPLETED"} and again.validate().filter("NOT valid").isEmpty()
    order = [r.old_uuid for r in dst.read("mapping_users").orderBy("new_id").collect()]
    assert order == sorted(order)


def test_progress_is_logged_by_slice(spark, stores):  # noqa: F811
    src, dst = stores
    _more(spark, src, 10, 40)
    m = Migration(spark, src, dst, SPECS, slices=3)
    m.copy()
    log = [r for r in dst.read("run_state").orderBy("seq").collect() if r.table_name == "users"]
    assert [r.status for r in log] == ["PENDING", "IN_PROGRESS", "IN_PROGRESS", "IN_PROGRESS", "IN_PROGRESS", "COMPLETED"]
    assert [r.processed_rows for r in log[2:]] == sorted(r.processed_rows for r in log[2:]) and log[-1].processed_rows == 40
    assert log[2].last_uuid < log[3].last_uuid and log[2].updated_at > 1_600_000_000_000_000
    total = {r.table_name: r.records for r in m.totals().collect()}
    assert total["users"] == 40 and total[None] == 40 + 12 + 5
    assert dst.read(BATCHES).filter("table_name = 'users'").count() == 3


def test_rejected_rows_come_once_and_leave_when_their_parent_comes(spark, stores):  # noqa: F811
    src, dst = stores
    Migration(spark, src, dst, SPECS, on_missing="reject").copy()
    Migration(spark, src, dst, SPECS, on_missing="reject").sync()
    assert dst.read("orders_rejects").count() == 2
    _more(spark, src, 10, 11)
    assert Migration(spark, src, dst, SPECS, on_missing="reject").sync() == {"users": 1, "orders": 1, "items": 0}
    assert dst.read("orders_rejects").count() == 1 and dst.read("orders").count() == 11


def test_unique_indexes_are_checked(spark, tmp_path):
    src, dst = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "t"))
    src.replace("users", _ids(spark, "users", 0, 10).select("id", (F.col("n") % 9).cast("string").alias("email")))
    spec = TableSpec("users", {"id": "uuid", "email": "text"}, ("id",), {}, (("by_email", ("email",), True, None), ("some", ("email",), True, "email > 'a'"), ("plain", ("email",), False, None)))
    Migration(spark, src, dst, (spec,)).copy()
    assert rows(dst.read(INDEXES)) == [("users", "by_email", 1)]


def test_copy_by_counts(spark, stores):  # noqa: F811
    src, dst = stores
    m = Migration(spark, src, dst, SPECS)
    m.copy()
    assert m.copy_missing() == {}
    _more(spark, src, 10, 13)
    assert m.copy_missing() == {"users": 3}
    m.rollback("items")
    assert m.copy_missing() == {"items": 5}
    assert rows(m.rollback_totals().select("n_tables", "records")) == [(1, 5)]


def test_pinned_tables_are_broadcast(spark):
    m = spark.createDataFrame([("a", f"k{k}", k) for k in range(20)] + [("b", f"k{k}", 100 + k) for k in range(20)], "table_name string, old_uuid string, new_id long")
    df = spark.createDataFrame([("k1", "k2"), (None, "zz")], "x string, y string")
    got = remap(df, m, {"x": "a", "y": "b"}, hybrid(["a"]))
    assert rows(got) == [(1, 102), (None, None)]
    plan = got._jdf.queryExecution().logical().toString()
    assert plan.count("strategy=broadcast") == 1
    assert rows(remap(df, m, {"x": "a", "y": "b"}, Strategy.EAGER)) == rows(got)


# the store


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.range(1))
    many = [threading.Thread(target=lambda k=k: Store(spark, str(tmp_path)).append("t", spark.range(10 * k, 10 * k + 10))) for k in range(1, 7)]
    for t in many:
        t.start()
    for t in many:
        t.join()
    assert sorted(r.id for r in store.read("t").collect()) == [0, *range(10, 70)]


def test_a_transaction_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("a", spark.range(1))
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.append("a", spark.range(5))
        t.append("b", spark.range(5))
        raise RuntimeError
    assert store.tables() == ["a"] and store.read("a").count() == 1
    with pytest.raises(Conflict), store.transaction() as t:
        t.append("b", spark.range(5))
        t.replace("a", store.read("a"))
        store.append("a", spark.range(7, 8))
    assert store.tables() == ["a"] and rows(store.read("a")) == [(0,), (7,)]


def test_versions_are_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.range(1))
    for k in range(1, 2 * store_module.MERGE + 1):
        store.append("t", spark.range(k, k + 1))
    assert len(store._pointer("t")["versions"]) == 3
    assert sorted(r.id for r in store.read("t").collect()) == list(range(2 * store_module.MERGE + 1))
    assert store.vacuum("t") == 2 * store_module.MERGE


@pytest.mark.parametrize("fold", [0.0, 1e9])
@pytest.mark.parametrize("few", [0, 1 << 30])
def test_changes_lie_over_the_table_or_are_folded_in(spark, tmp_path, monkeypatch, fold, few):
    monkeypatch.setattr(store_module, "FOLD_SHARE", fold)
    monkeypatch.setattr(store_module, "FEW_BYTES", few)
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, name string, n int"))
    make = lambda *x: spark.createDataFrame([(k, "t", op, None, {"id": i}, new) for k, op, i, new in x], cdc.SCHEMA)
    for records, position in ((make((5, "U", "1", {"id": "1", "name": None}), (6, "D", "2", None)), 6), (make((7, "U", "9", {"id": "9", "name": "z"}), (8, "U", "1", {"id": "1", "n": "11"})), 8)):
        with store.transaction() as t:
            t.merge("t", records, position=position)
    assert rows(store.read("t")) == [(1, None, 11), (3, "c", 30), (9, "z", None)] and store.position("t") == 8
    assert bool(store._pointer("t")["changes"]) == (fold > 1)
    store.append("t", spark.createDataFrame([(4, "d", 40)], store.read("t").schema))
    assert store.read("t").count() == 4 and store.truncate("t") == 4 and store.read("t").isEmpty()


# replication into re-keyed tables


def change(lsn, table, op, old, new):
    return (lsn, table, op, None, old, new)


def U(table, k):
    return f"{table}-{k:04d}"


@pytest.fixture
def shop(spark, tmp_path):
    """Users u0..u9 and orders o0..o9, each of the user of its number, re-keyed."""
    src, dst = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "t"))
    src.replace("users", spark.createDataFrame([(U("u", k), f"e{k}") for k in range(10)], "id string, email string"))
    src.replace("orders", spark.createDataFrame([(U("o", k), U("u", k), "new") for k in range(10)], "id string, user_id string, status string"))
    m = Migration(spark, src, dst, SPECS[:2])
    m.copy()
    return m


def test_replication_into_rekeyed_tables(spark, shop, tmp_path):
    u, o = lambda k: U("u", k), lambda k: U("o", k)
    feed = [
        change(1, "users", "U", {"id": u(0)}, {"id": u(0), "email": "changed"}),
        change(2, "users", "D", {"id": u(1)}, None),
        change(3, "users", "I", None, {"id": u(20), "email": "new"}),
        change(4, "users", "U", None, {"id": "nobody", "email": "x"}),
        change(5, "users", "U", {"id": u(2)}, {"id": u(30), "email": "moved"}),
        change(6, "users", "U", {"id": u(30)}, {"id": u(31), "email": "moved on"}),
        change(7, "users", "I", None, {"id": u(2), "email": "the key again"}),
        change(8, "users", "D", {"id": "nobody either"}, None),
        change(9, "orders", "I", None, {"id": o(20), "user_id": u(20), "status": "of a new user"}),
        change(10, "orders", "I", None, {"id": o(21), "user_id": "lost", "status": "x"}),
        change(11, "orders", "U", {"id": o(3)}, {"id": o(3), "status": "paid"}),
        change(12, "orders", "U", {"id": o(4)}, {"id": o(4), "user_id": u(31)}),
        change(13, "orders", "I", None, {"id": o(22), "user_id": None, "status": "of nobody"}),
        change(14, "orders", "D", {"id": o(5)}, None),
        change(15, "elsewhere", "I", None, {"id": "q"}),
        change(16, "users", "I", None, {"id": u(40), "email": "short"}),
        change(17, "users", "D", {"id": u(40)}, None),
    ]
    folder, dst = str(tmp_path / "feed"), shop.target
    spark.createDataFrame(feed, cdc.SCHEMA).repartition(3).write.parquet(folder)
    for k in range(2):  # with a new checkpoint the files come again
        shop.replicate(folder, str(tmp_path / f"c{k}")).awaitTermination()
        users = {r.id: r.email for r in dst.read("users").collect()}
        # ids 1..10 were u0..u9; new keys get 11 on, in the order of their keys
        assert users == {1: "changed", 3: "moved on", **{k: f"e{k - 1}" for k in range(4, 11)}, 11: "the key again", 12: "new"}
        ids = {r.old_uuid: r.new_id for r in dst.read(MAPPING + "users").collect()}
        assert ids[u(31)] == 3 and ids[u(2)] == 11 and ids[u(20)] == 12 and u(30) not in ids and u(40) not in ids and ids[u(1)] == 2
        orders = {r.id: (r.user_id, r.status) for r in dst.read("orders").collect()}
        assert orders == {**{k: (k, "new") for k in (1, 2, 3, 7, 8, 9, 10)}, 4: (4, "paid"), 5: (3, "new"), 11: (12, "of a new user"), 12: (None, "of nobody")}
        assert sorted(r.lsn for r in dst.read(REJECTS).collect()) == [4, 8, 10]
        assert dst.position("users") == 17 and dst.position("orders") == 14
    # a later batch goes on from there
    apply_rekeyed(dst, list(SPECS[:2]), spark.createDataFrame([change(18, "users", "U", {"id": u(31)}, {"id": u(31), "email": "later"}), change(19, "users", "I", None, {"id": u(50), "email": "n"})], cdc.SCHEMA))
    users = {r.id: r.email for r in dst.read("users").collect()}
    assert users[3] == "later" and users[13] == "n" and len(users) == 12
    assert drop_replication(spark, str(tmp_path / "c0")) and not drop_replication(spark, str(tmp_path / "c0"))


def test_a_batch_that_fails_leaves_nothing(spark, shop):
    dst = Breaking(spark, shop.target.root)
    dst.at = 1
    feed = spark.createDataFrame([change(1, "users", "I", None, {"id": U("u", 20), "email": "n"}), change(2, "orders", "I", None, {"id": U("o", 20), "user_id": U("u", 20), "status": "s"}), change(3, "users", "D", {"id": "x"}, None)], cdc.SCHEMA)
    with pytest.raises(OSError):
        apply_rekeyed(dst, list(SPECS[:2]), feed)
    assert dst.read("users").count() == 10 and dst.position("users") == -1 and not dst.exists(REJECTS)
    apply_rekeyed(dst, list(SPECS[:2]), feed)
    assert dst.read("users").count() == 11 == dst.read("orders").count() and dst.read(REJECTS).count() == 1
    assert dst.read("orders").filter("id = 11").first().user_id == 11


def test_raw_messages_with_a_change_of_columns(spark, shop, tmp_path):
    one, two = ["id", "email"], ["email", "id"]
    new = lambda lsn, k: spark.createDataFrame([change(lsn, "users", "I", None, {"id": U("u", k), "email": f"m{k}"})], cdc.SCHEMA)
    rel = lambda lsn, cols: spark.createDataFrame([(lsn, None, pgoutput.encode_relation(5, "users", cols))], pgoutput.SCHEMA)
    first = rel(1, one).unionByName(pgoutput.encode_rows(new(2, 20), 5, one)).unionByName(rel(3, one)).unionByName(rel(4, two)).unionByName(pgoutput.encode_rows(new(5, 21), 5, two))
    assert [(r.lsn, r.columns) for r in pgoutput.relations(first).orderBy("lsn").collect()] == [(1, one), (4, two)]
    apply_messages(shop.target, list(SPECS[:2]), first)
    later = pgoutput.encode_rows(new(6, 22), 5, two)  # its relation came with the batch before
    folder = str(tmp_path / "messages")
    later.write.parquet(folder)
    replicate_rekeyed(spark, folder, shop.target, list(SPECS[:2]), str(tmp_path / "c"), raw=True).awaitTermination()
    got = {r.id: r.email for r in shop.target.read("users").filter("id > 10").collect()}
    assert got == {11: "m20", 12: "m21", 13: "m22"}


def test_following_key_changes(spark):
    moves = spark.createDataFrame([(3, "a", "b"), (5, "b", "c"), (9, "a", "z")], "lsn long, old_uuid string, new_uuid string")
    df = spark.createDataFrame([("a", 0, 1), ("a", 4, 2), ("b", 1, 3), ("b", 6, 4), ("q", 0, 5)], "key string, at long, n long")
    assert {r.n: r.key for r in follow(df, moves).collect()} == {1: "c", 2: "z", 3: "c", 4: "b", 5: "q"}


# ids


@pytest.mark.parametrize("kind", ["random", "in time", "one prefix", "few", "repeated", "numbers"])
def test_dense_ids_of_any_keys(spark, kind):
    n = spark.range(3000)
    key = {
        "random": legacy_uuid("t", F.col("id")), "in time": F.concat(F.lit("018f3a7c-"), F.lpad(F.col("id").cast("string"), 8, "0")), "one prefix": F.concat(F.lit("customer_" * 5), F.md5(F.col("id").cast("string"))),
        "few": F.concat(F.lit("k"), (F.col("id") % 3).cast("string")), "repeated": legacy_uuid("t", F.col("id") % 700), "numbers": F.col("id").cast("string"),
    }[kind]
    keys = n.select(F.when(F.col("id") % 50 != 7, key).alias("old_uuid"))
    want = sorted({r.old_uuid for r in keys.collect()} - {None})
    for ranges in (1, 7, 64, None):
        got = {r.old_uuid: r.new_id for r in mapping.dense_ids(keys, high_water=10, ranges=ranges).collect()}
        assert got == {k: 11 + i for i, k in enumerate(want)}
    assert mapping.dense_ids(keys.limit(0)).isEmpty()


# the rest


def test_suite_and_logs(spark, tmp_path):
    got = {r.scenario: r for r in suite(spark, str(tmp_path), 100, tables=["regions", "users", "profiles"]).collect()}
    assert list(got) == ["copy", "sync", "validate", "status", "resume", "analysis", "rollback"] and all(r.ok for r in got.values())
    assert got["sync"].value == 100 and got["sync"].grade == "EXCELLENT" and got["copy"].grade in ("FAILED", "MINIMUM", "TARGET", "EXCELLENT")
    assert run_logs.read(spark, f"{tmp_path}/logs", "schema_inventory").filter("eligible").count() == 3
    assert run_logs.read(spark, f"{tmp_path}/logs", "jvm").first().heap_used > 0


def test_the_shared_folder(spark):
    assert shared_dir(spark) and scratch(spark, "x") != scratch(spark, "x")
    assert full_cycle and spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"


def test_a_local_cluster_shares_this_machine():
    of = lambda master: is_local(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
    assert of("local[4]") and of("local") and of("local-cluster[3,2,1024]")
    assert not of("yarn") and not of("spark://host:7077") and not of("k8s://host")


@pytest.mark.parametrize("query, module, starts", [("stream_replay", queries_cdc, "replicate"), ("rekeyed_replay", queries_runs, "replicate_rekeyed")])
def test_a_larger_feed_has_more_files(spark, monkeypatch, query, module, starts):
    files, real = [], getattr(module, starts)
    monkeypatch.setattr(module, starts, lambda s, folder, *a, **k: files.append(len(s.read.parquet(folder).inputFiles())) or real(s, folder, *a, **k))
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert module.CATALOGUE[query][0](spark, "/root/testdata/sf0.001").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) == 2 and min(files) > 8  # four files, before, whatever the feed's size


def test_messages_that_are_done_are_not_decoded(spark, stores, monkeypatch):
    """And a batch's records are joined with keys and parents once, not with themselves."""
    source, target = stores
    Migration(spark, source, target, SPECS).copy()
    r = [(1, pgoutput.encode_relation(7, "orders", ["id", "status", "user_id"])), (2, pgoutput.encode_relation(8, "other", ["id"]))]
    change = spark.createDataFrame([(k, "orders", "I", None, None, {"id": f"n{k}", "status": "s", "user_id": user}) for k, user in ((3, "none"), (4, None))], cdc.SCHEMA)
    messages = spark.createDataFrame([(k, None, x) for k, x in r], pgoutput.SCHEMA).unionByName(pgoutput.encode_rows(change, 7, ["id", "status", "user_id"]))
    decoded, joined, real, checked = [], [], pgoutput.decode_messages, replicate_module._checked
    monkeypatch.setattr(pgoutput, "decode_messages", lambda m, known: decoded.append(m.filter("lsn > 2").count()) or real(m, known))
    monkeypatch.setattr(replicate_module, "_checked", lambda *a: joined.append(checked(*a)) or joined[-1])
    orders = [s for s in SPECS if s.name == "orders"]
    assert apply_messages(target, orders, messages) == {"orders": 2} and apply_messages(target, orders, messages) == {}
    assert decoded == [2, 0] and len(joined) == 1
    assert rows(joined[0].select("lsn", "wrong", "error")) == [(3, True, "no mapping for user_id=none"), (4, False, None)]


def test_keys_are_shuffled_as_bytes_and_small_mappings_are_not(spark, monkeypatch, tmp_path):
    keys = ["00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000A", "0" * 32, "", "fifteen letters", "sixteen letters!", "\0" * 16, "é-key", "a\n00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000a\n"]
    known = spark.createDataFrame([("t", k, i) for i, k in enumerate(keys) if i % 2 == 0], "table_name string, old_uuid string, new_id long")
    known.write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    facts = spark.createDataFrame([(i, k) for i, k in enumerate([*keys, None])], "n long, k string")
    want = [(i, i if i < len(keys) and i % 2 == 0 else None) for i in range(len(keys) + 1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for most, join in ((0, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")):
            monkeypatch.setattr(rekey_module, "EAGER_BYTES", most)
            got = remap(facts, known, {"k": "t"})
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "unhex" in plan
            assert rows(got) == rows(spark.createDataFrame(want, "n long, k long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
