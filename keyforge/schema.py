"""Table specifications: keys that Parquet doesn't carry, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import index_name


@dataclass(frozen=True)
class TableSpec:
    """name, columns with types, primary key columns, and foreign keys: column -> parent table."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    parents: dict[str, str] = field(default_factory=dict)
    indexes: tuple[tuple[str, tuple[str, ...], bool, str | None], ...] = ()


#: The star schema of the test data, its integer keys standing for uuid ones: column -> the table it names.
STAR = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}

_t = TableSpec
#: A shop's schema, with the cases that can't be re-keyed.
SHOP = (
    _t("regions", {"id": "uuid", "name": "text"}, ("id",)),
    _t("users", {"id": "uuid", "email": "text", "region_id": "uuid"}, ("id",), {"region_id": "regions"}, (("users_email_key", ("email",), True, None), ("users_region_email", ("region_id", "email"), False, "email IS NOT NULL"))),
    _t("profiles", {"id": "uuid", "user_id": "uuid", "bio": "text"}, ("id",), {"user_id": "users"}),
    _t("suppliers", {"id": "uuid", "name": "text"}, ("id",)),
    _t("categories", {"id": "uuid", "title": "text"}, ("id",)),
    _t("products", {"id": "uuid", "category_id": "uuid", "supplier_id": "uuid", "name": "text", "price": "numeric", "trace": "uuid"}, ("id",), {"category_id": "categories", "supplier_id": "suppliers"}),
    _t("customers", {"id": "uuid", "name": "text"}, ("id",)),
    _t("orders", {"id": "uuid", "customer_id": "uuid", "created_at": "timestamp"}, ("id",), {"customer_id": "customers"}, (("orders_created", ("created_at",), False, None),)),
    _t("order_items", {"id": "uuid", "order_id": "uuid", "product_id": "uuid", "qty": "int4"}, ("id",), {"order_id": "orders", "product_id": "products"}, (("items_pair", ("order_id", "product_id"), True, None),)),
    _t("cycle_a", {"id": "uuid", "b_id": "uuid"}, ("id",), {"b_id": "cycle_b"}),
    _t("cycle_b", {"id": "uuid", "a_id": "uuid"}, ("id",), {"a_id": "cycle_a"}),
    _t("cycle_notes", {"id": "uuid", "a_id": "uuid"}, ("id",), {"a_id": "cycle_a"}),
    _t("employees", {"id": "uuid", "manager_id": "uuid"}, ("id",), {"manager_id": "employees"}),
    _t("legacy_audit", {"id": "bigserial", "note": "text"}, ("id",)),
    _t("reference_codes", {"code": "text", "note": "text"}, ("code",)),
    _t("pair_links", {"left_id": "uuid", "right_id": "uuid"}, ("left_id", "right_id")),
    _t("staging", {"payload": "text"}),
)


def columns(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, column_name, ordinal, column_type)."""
    rows = [(s.name, c, k, t) for s in specs for k, (c, t) in enumerate(s.columns.items(), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal long, column_type string")


def foreign_keys(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, column_name, parent_table), in order."""
    rows = sorted((s.name, c, p) for s in specs for c, p in s.parents.items())
    return spark.createDataFrame(rows, "table_name string, column_name string, parent_table string")


def edges(spark: SparkSession, specs=SHOP) -> DataFrame:
    """Distinct (parent, child), ordered."""
    return foreign_keys(spark, specs).select(F.col("parent_table").alias("parent"), F.col("table_name").alias("child")).distinct().orderBy("parent", "child")


def keys(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, column_name, position) of primary keys; a null column for a table without one."""
    rows = [(s.name, c, k) for s in specs for k, c in enumerate(s.key or (None,), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position long")


def identity(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, pk_columns, pk_types, skip_reason): skip_reason is null for a table that can be re-keyed."""
    types = columns(spark, specs)
    pk = keys(spark, specs).join(types.drop("ordinal"), ["table_name", "column_name"], "left")
    pk = pk.groupBy("table_name").agg(F.array_sort(F.collect_list(F.when(F.col("column_name").isNotNull(), F.struct("position", "column_name", "column_type")))).alias("k"))
    names, kinds = F.transform("k", lambda x: x["column_name"]), F.transform("k", lambda x: x["column_type"])
    reason = (
        F.when(F.size("k") == 0, "NO_PRIMARY_KEY")
        .when(F.size("k") > 1, "COMPOSITE_PRIMARY_KEY")
        .when(F.get("pk_columns", F.lit(0)) != "id", "PRIMARY_KEY_NOT_ID")
        .when(F.get("pk_types", F.lit(0)) != "uuid", "NON_UUID_PRIMARY_KEY")
    )
    return pk.select("table_name", "k", names.alias("pk_columns"), kinds.alias("pk_types")).withColumn("skip_reason", reason).drop("k")


def target_columns(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, ordinal, column_name, target_type) of the tables that can be re-keyed.

    Only keys change: id to a generated bigint, foreign keys to bigint. Any other uuid column stays.
    """
    fine = identity(spark, specs).filter("skip_reason IS NULL").select("table_name")
    fk = foreign_keys(spark, specs).select("table_name", "column_name", F.lit(True).alias("fk"))
    got = columns(spark, specs).join(fine, "table_name", "left_semi").join(fk, ["table_name", "column_name"], "left")
    kind = F.when(F.col("column_name") == "id", "BIGSERIAL PRIMARY KEY").when(F.col("fk"), "BIGINT").otherwise(F.col("column_type"))
    return got.select("table_name", "ordinal", "column_name", kind.alias("target_type"))


def indexes(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(table_name, index_name, columns, is_unique, predicate), columns in their order, of non-primary indexes.

    Built as a catalogue has it: attribute numbers in an array, names in another table.
    """
    number = {(s.name, c): k for s in specs for k, c in enumerate(s.columns, 1)}
    rows = [(s.name, n, [number[s.name, c] for c in cols], u, p) for s in specs for n, cols, u, p in s.indexes]
    raw = spark.createDataFrame(rows, "table_name string, index_name string, numbers array<long>, is_unique boolean, predicate string")
    names = columns(spark, specs).select("table_name", F.col("ordinal").alias("number"), "column_name")
    flat = raw.select("table_name", "index_name", "is_unique", "predicate", F.posexplode("numbers").alias("place", "number")).join(names, ["table_name", "number"])
    cols = F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda x: x["column_name"])
    return flat.groupBy("table_name", "index_name", "is_unique", "predicate").agg(cols.alias("columns"))


def foreign_key_indexes(spark: SparkSession, specs=SHOP) -> DataFrame:
    """(index_name, table_name, column_name): what a lookup by foreign key would want; bucketing columns here."""
    return foreign_keys(spark, specs).select(index_name(F.col("table_name"), F.col("column_name")).alias("index_name"), "table_name", "column_name")


def catalogue_tables(spark: SparkSession, specs=SHOP) -> DataFrame:
    """Column counts by table, first columns by ordinal: (table_name, n_columns, first_column)."""
    w = Window.partitionBy("table_name").orderBy("ordinal")
    return columns(spark, specs).withColumn("first_column", F.first("column_name").over(w)).groupBy("table_name").agg(F.count("*").alias("n_columns"), F.min("first_column").alias("first_column"))
