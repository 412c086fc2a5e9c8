"""Whole runs over stores."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from keyforge.__main__ import main
from keyforge.functions.scalars import legacy_uuid
from keyforge.operators import cdc
from keyforge.plans.migrate import Migration, config, full_cycle, generate, synthetic_specs
from keyforge.schema import TableSpec
from keyforge.sources.store import Store
from keyforge.streaming.replicate import lag, replicate

SPECS = (
    TableSpec("users", {"id": "uuid", "email": "text"}, ("id",)),
    TableSpec("orders", {"id": "uuid", "user_id": "uuid", "status": "text"}, ("id",), {"user_id": "users"}),
    TableSpec("items", {"id": "uuid", "order_id": "uuid"}, ("id",), {"order_id": "orders"}),
    TableSpec("staging", {"payload": "text"}),
)


def _ids(spark, table, lo, hi):
    return spark.range(lo, hi).select(legacy_uuid(table, F.col("id")).alias("id"), F.col("id").alias("n"))


@pytest.fixture
def stores(spark, tmp_path):
    src, dst = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "t"))
    src.replace("users", _ids(spark, "users", 0, 10).select("id", F.concat(F.lit("e"), "n").alias("email")))
    src.replace("orders", _ids(spark, "orders", 0, 12).select("id", legacy_uuid("users", F.col("n")).alias("user_id"), F.lit("new").alias("status")))
    src.replace("items", _ids(spark, "items", 0, 5).select("id", legacy_uuid("orders", F.col("n")).alias("order_id")))
    return src, dst


def _more(spark, src, lo, hi):
    src.append("users", _ids(spark, "users", lo, hi).select("id", F.concat(F.lit("e"), "n").alias("email")))


def test_copy_sync_validate_roll_back(spark, stores):
    src, dst = stores
    m = Migration(spark, src, dst, SPECS)
    assert {r.table_name: r.skip_reason for r in m.init().collect()}["staging"] == "NO_PRIMARY_KEY"
    assert m.copy() == {"users": 10, "orders": 12, "items": 5}
    assert m.copy() == {}
    got = {r.table_name: r for r in m.validate().collect()}
    assert all(r.n_missing == 0 and r.source_rows == r.target_rows and r.n_orphans == 0 for r in got.values())
    assert dst.read("orders").filter("user_id IS NULL").count() == 2  # orders of unknown users
    joined = dst.read("orders").withColumnRenamed("id", "o").join(dst.read("users"), F.col("user_id") == F.col("id"))
    assert joined.count() == 10
    before = {r.old_uuid: r.new_id for r in m.mapping().filter("table_name = 'users'").collect()}
    _more(spark, src, 10, 15)
    assert Migration(spark, src, dst, SPECS).sync() == {"users": 5, "orders": 0, "items": 0}
    after = {r.old_uuid: r.new_id for r in m.mapping().filter("table_name = 'users'").collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, 16))
    m = Migration(spark, src, dst, SPECS)
    assert {r.percent for r in m.status().collect()} == {100.0}
    assert m.rollback_to("orders") == {"items": 5, "orders": 12}
    assert m.validate_rollback("orders") and not m.validate_rollback("users")
    assert m.resume() == {"orders": 12, "items": 5}
    assert dst.read("orders").agg(F.min("id"), F.max("id")).first() == (13, 24)  # ids aren't given again
    assert sum(m.rollback_all().values()) == 15 + 12 + 5


def test_five_rounds_of_sync(spark, stores):
    src, dst = stores
    m = Migration(spark, src, dst, SPECS)
    m.copy()
    for k in range(2):
        _more(spark, src, 10 + 20 * k, 30 + 20 * k)
        m.sync()
        assert dst.read("users").count() == 10 + 20 * (k + 1)


def test_rejecting_rows_without_parents(spark, stores):
    src, dst = stores
    m = Migration(spark, src, dst, SPECS, on_missing="reject")
    m.copy()
    assert dst.read("orders").count() == 10 and dst.read("orders_rejects").count() == 2
    with pytest.raises(ValueError):
        Migration(spark, src, dst, SPECS, on_missing="maybe")


def test_a_failed_table_is_resumed(spark, stores):
    src, dst = stores
    good = src.read("orders")
    src.replace("orders", good.drop("user_id"))
    m = Migration(spark, src, dst, SPECS)
    with pytest.raises(RuntimeError):
        m.copy()
    assert {r.table_name: r.status for r in m.states().collect()} == {"users": "COMPLETED", "orders": "FAILED", "items": "PENDING"}
    src.replace("orders", good)
    assert Migration(spark, src, dst, SPECS).resume() == {"orders": 12, "items": 5}


def test_synthetic_run(spark, tmp_path):
    src, dst = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "t"))
    some = ["regions", "users", "customers", "orders"]
    made = generate(spark, src, 100, tables=some)
    m = Migration(spark, src, dst, tuple(s for s in synthetic_specs() if s.name in some))
    assert m.copy() == made
    assert all(r.valid for r in m.validate().collect())
    assert [r.table_name for r in m.pinned(60).collect()] == ["regions", "customers"]


def test_replication_applies_once_and_isolates_errors(spark, stores, tmp_path):
    src, _ = stores
    key = [r.id for r in src.read("users").orderBy("email").collect()]
    feed = [
        (1, "users", "U", None, {"id": key[0]}, {"id": key[0], "email": "changed"}),
        (2, "users", "D", None, {"id": key[1]}, None),
        (3, "users", "I", None, None, {"id": "new", "email": "n"}),
        (4, "users", "U", None, {"id": "nobody"}, {"id": "nobody", "email": "x"}),
        (5, "users", "U", None, {"id": key[2]}, {"id": "moved", "email": "m"}),
        (6, "elsewhere", "I", None, None, {"id": "q"}),
    ]
    folder = str(tmp_path / "feed")
    spark.createDataFrame(feed, cdc.SCHEMA).repartition(2).write.parquet(folder)
    for k in range(2):  # with a new checkpoint the files come again
        replicate(spark, folder, src, ["users"], str(tmp_path / f"c{k}"), files=1000).awaitTermination()
        got = {r.id: r.email for r in src.read("users").collect()}
        assert got[key[0]] == "changed" and key[1] not in got and got["new"] == "n" and got["moved"] == "m" and key[2] not in got and "nobody" not in got
        assert len(got) == 10 and src.position("users") == 5
        assert [r.lsn for r in src.read("rejects").collect()] == [4]
    assert lag(src, "users", 9) == 4


def test_full_cycle(spark, tmp_path):
    got = full_cycle(spark, str(tmp_path), 100, tables=["regions", "users", "profiles"])
    assert [(r.scenario, r.ok) for r in got.collect()] == [(s, True) for s in ("copy", "sync", "validate", "resume", "rollback")]


def test_command_line(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    main(["generate", "--source", a, "--count", "100"], spark)
    spec = tmp_path / "specs.json"
    spec.write_text(json.dumps([{"name": s.name, "columns": s.columns, "key": s.key, "parents": s.parents} for s in synthetic_specs() if s.name in ("customers", "orders")]))
    stores = ["--source", a, "--target", b, "--specs", str(spec)]
    for command in ("init", "copy", "status", "validate"):
        main([command, *stores], spark)
    main(["backup", *stores, "--name", "n"], spark)
    main(["rollback", *stores, "--table", "orders"], spark)
    main(["restore", *stores, "--name", "n"], spark)
    main(["config-init"], spark)
    assert "customers" in capsys.readouterr().out
    assert Store(spark, b).read("orders").count() == 100


def test_config():
    assert config("a: b # c\n# d: e\nf: g:h") == {"a": "b", "f": "g:h"}
