"""Synthetic shop tables: values are hashes of (table, row), so any part can be made anywhere, alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import legacy_uuid
from ..schema import TableSpec

#: table -> (numerator, denominator of its share of the base count, parents by column, other columns).
SHAPES: dict[str, tuple[int, int, dict[str, str], tuple[str, ...]]] = {
    "regions": (1, 100, {}, ("name",)),
    "users": (1, 1, {"region_id": "regions"}, ("email",)),
    "profiles": (1, 2, {"user_id": "users"}, ("bio",)),
    "user_settings": (1, 2, {"user_id": "users"}, ("key", "value")),
    "suppliers": (1, 100, {}, ("name",)),
    "categories": (1, 100, {}, ("title",)),
    "products": (1, 10, {"category_id": "categories", "supplier_id": "suppliers"}, ("name", "price")),
    "warehouse_stocks": (1, 10, {"product_id": "products"}, ("quantity",)),
    "customers": (1, 10, {}, ("name",)),
    "orders": (1, 1, {"customer_id": "customers"}, ("created_at",)),
    "order_items": (2, 1, {"order_id": "orders", "product_id": "products"}, ("qty",)),
    "shipments": (1, 10, {"order_id": "orders"}, ("address",)),
    "product_reviews": (1, 10, {"product_id": "products", "user_id": "users"}, ("rating",)),
    "audit_logs": (1, 1, {"user_id": "users"}, ("action",)),
    "discount_coupons": (1, 100, {}, ("code", "discount_pct")),
    "order_coupons": (1, 100, {"order_id": "orders", "coupon_id": "discount_coupons"}, ()),
    "support_tickets": (1, 100, {"user_id": "users"}, ("subject",)),
    "ticket_messages": (1, 10, {"ticket_id": "support_tickets"}, ("body",)),
    "marketing_campaigns": (1, 1000, {"region_id": "regions"}, ("name",)),
    "campaign_stats": (1, 1000, {"campaign_id": "marketing_campaigns"}, ("clicks",)),
}
#: Tables that can't be re-keyed: a cycle, and keys that aren't one uuid column id.
ODD = (
    TableSpec("cycle_a", {"id": "uuid", "b_id": "uuid", "note": "text"}, ("id",), {"b_id": "cycle_b"}),
    TableSpec("cycle_b", {"id": "uuid", "a_id": "uuid", "note": "text"}, ("id",), {"a_id": "cycle_a"}),
    TableSpec("legacy_integer_audit", {"id": "bigserial", "message": "text"}, ("id",)),
    TableSpec("external_reference_codes", {"code": "text", "description": "text"}, ("code",)),
    TableSpec("staging_events", {"event_id": "text", "payload": "text"}),
)
_RANGES = {"quantity": (1, 999), "qty": (1, 9), "rating": (1, 5), "discount_pct": (5, 49), "clicks": (100, 99_999)}


def size(table: str, base: int) -> int:
    """Rows of a table: its share of the base count, 1 at least."""
    n, d, _, _ = SHAPES[table]
    return max(1, base * n // d)


def _draw(seed: int, name: str, low: int, high: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), F.col("n")), F.lit(high - low + 1)) + low).cast("long")


def generate(spark: SparkSession, table: str, base: int, seed: int = 42, start: int = 0) -> DataFrame:
    """A table's rows, from row `start` on; parents are rows of the base count's tables."""
    _, _, parents, others = SHAPES[table]
    rows = spark.range(start, start + size(table, base)).withColumnRenamed("id", "n")
    cols = [legacy_uuid(f"{seed}:{table}", F.col("n")).alias("id")]
    for c, p in parents.items():
        cols.append(legacy_uuid(f"{seed}:{p}", _draw(seed, f"{table}.{c}", 0, size(p, base) - 1)).alias(c))
    for c in others:
        if c in _RANGES:
            cols.append(_draw(seed, f"{table}.{c}", *_RANGES[c]).cast("int").alias(c))
        elif c == "price":
            cols.append((_draw(seed, f"{table}.{c}", 1000, 1_000_000) / 100).cast("decimal(10,2)").alias(c))
        elif c == "email":
            cols.append(F.concat(F.lit("user"), "n", F.lit("_"), _draw(seed, "email", 0, 99_999), F.lit("@example.com")).alias(c))
        elif c == "created_at":
            cols.append(F.timestamp_seconds(_draw(seed, f"{table}.{c}", 1_600_000_000, 1_700_000_000)).cast("timestamp_ntz").alias(c))
        else:
            cols.append(F.concat(F.lit(f"{table}_{c}_"), "n").alias(c))
    return rows.select(*cols)


def generate_odd(spark: SparkSession, table: str, base: int, seed: int = 42) -> DataFrame:
    """Rows of a table of ODD: a hundredth of the base count, or a thousandth, 1 at least. Rows of the cycle refer to each other."""
    share = 100 if table in ("legacy_integer_audit", "staging_events") else 1000
    rows = spark.range(max(1, base // share)).withColumnRenamed("id", "n")
    text = lambda s: F.concat(F.lit(f"{s} "), "n")
    if table.startswith("cycle_"):
        other = {"a": "b", "b": "a"}[table[-1]]
        return rows.select(legacy_uuid(f"{seed}:{table}", F.col("n")).alias("id"), legacy_uuid(f"{seed}:cycle_{other}", F.col("n")).alias(f"{other}_id"), text(table).alias("note"))
    if table == "legacy_integer_audit":
        return rows.select((F.col("n") + 1).alias("id"), text("audit").alias("message"))
    if table == "external_reference_codes":
        return rows.select(F.concat(F.lit("REF_"), "n", F.lit("_"), _draw(seed, "ref", 0, 2**31 - 1)).alias("code"), text("reference").alias("description"))
    return rows.select(F.concat(F.lit("evt_"), "n", F.lit("_"), _draw(seed, "evt", 0, 2**31 - 1)).alias("event_id"), F.to_json(F.struct(F.col("n").alias("count"))).alias("payload"))


def mixed_load(spark: SparkSession, operations: int, base: int, seed: int = 42) -> DataFrame:
    """Change records in the proportions 70 inserts, 20 updates, 10 deletes, of users."""
    rows = spark.range(operations).withColumnRenamed("id", "n")
    roll, who = _draw(seed, "roll", 0, 99), _draw(seed, "who", 0, size("users", base) - 1)
    op = F.when(roll < 70, "I").when(roll < 90, "U").otherwise("D")
    key = legacy_uuid(f"{seed}:users", F.when(op == "I", F.col("n") + size("users", base)).otherwise(who))
    none = F.lit(None).cast("map<string,string>")
    email = F.concat(F.lit("load"), "n", F.lit("@example.com"))
    return rows.select(
        F.col("n").alias("lsn"), F.lit("users").alias("table_name"), op.alias("op"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")).cast("timestamp_ntz").alias("ts"),
        F.when(op != "I", F.create_map(F.lit("id"), key)).otherwise(none).alias("old"), F.when(op != "D", F.create_map(F.lit("id"), key, F.lit("email"), email)).otherwise(none).alias("new"))
