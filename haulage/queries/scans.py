"""Scans and catalog questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.queries.derived import (
    CATALOG_TABLES_SQL,
    COLUMNS_SQL,
    INVENTORY_SQL,
    KEYS_SQL,
    SMALL,
    TABLE_NAMES,
    catalog_columns,
    catalog_tables,
    cents,
    key_columns,
    key_constraints,
    with_ctes,
)
from haulage.queries.registry import query
from haulage.session import new_dir
from haulage.sinks.export import export_capped, export_ranges
from haulage.sinks.manifest import read_export, read_files
from haulage.operators.profile import best_range_column, profile_columns
from haulage.plans.ranges import range_plan
from haulage.sources import catalog, tables
from haulage.sources.tables import load


@query("scan_table", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
FROM orders""")
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    declared = {
        "o_orderkey": "bigint", "o_custkey": "string", "o_orderstatus": "string",
        "o_totalprice": "double", "o_orderdate": "date",
    }
    typed = tables.scan_table(load(spark, sf, "orders"), declared)
    return typed.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("scan_range", """
SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) AS ordered_at
FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'""")
def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    part = tables.scan_range(load(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1998-07-01")
    from haulage.functions.scale import micros

    return part.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        micros("o_orderdate", "timestamp_ntz").alias("ordered_at"),
    )


# The lines have no key, so all columns together make the order that SQL can follow.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("scan_page", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, position FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
  FROM lineitem)
WHERE position >= 4000 AND position < 5500""")
def scan_page(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    page = tables.scan_page(lines, LINE_ORDER, offset=4000, size=1500)
    return page.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position")


@query("scan_partition_column", """
WITH b AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders)
SELECT CAST(greatest(0, least(7, floor(8.0::DOUBLE * (o_custkey - lo) / (hi - lo)))) AS INTEGER) AS stride,
  count(*) AS row_count, min(o_custkey) AS first_key, max(o_custkey) AS last_key,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders, b GROUP BY 1""")
def scan_partition_column(spark: SparkSession, sf: str) -> DataFrame:
    """What parts of equal width would hold; a database's own are read by ``jdbc.read_strides``."""
    orders = load(spark, sf, "orders")
    lo, hi = orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    return orders.groupBy(tables.equal_width(F.col("o_custkey"), lo, hi, 8).alias("stride")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("o_custkey").alias("first_key"),
        F.max("o_custkey").alias("last_key"),
        F.sum(cents("o_totalprice")).alias("total_cents"),
    )


@query("scan_query", """
SELECT c_mktsegment, o_orderstatus, count(*) AS orders,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def scan_query(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scan_query(
        spark,
        """SELECT c_mktsegment, o_orderstatus, count(*) AS orders,
             sum(cast(round(o_totalprice * 100) AS bigint)) AS total_cents
           FROM {o} JOIN {c} ON o_custkey = c_custkey
           GROUP BY c_mktsegment, o_orderstatus""",
        o=load(spark, sf, "orders"),
        c=load(spark, sf, "customer"),
    )


@query("scan_where", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderdate >= '1998-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def scan_where(spark: SparkSession, sf: str) -> DataFrame:
    clause = "o_orderdate >= '1998-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"
    found = tables.scan_where(load(spark, sf, "orders"), clause)
    return found.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("scan_fetchsize", """
SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS files_above_limit FROM lineitem""")
def scan_fetchsize(spark: SparkSession, sf: str) -> DataFrame:
    """New file after 25,000 rows, without a shuffle."""
    path = new_dir(spark, "fetchsize")
    export_capped(load(spark, sf, "lineitem"), path, "lineitem", 25_000)
    return read_files(spark, path).agg(
        F.sum("row_count").alias("total_rows"),
        F.count_if(F.col("row_count") > 25_000).alias("files_above_limit"),
    )


@query("read_export", """
SELECT o_orderstatus, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents,
  min(epoch_us(o_orderdate)) AS first_order
FROM orders GROUP BY o_orderstatus""")
def read_back(spark: SparkSession, sf: str) -> DataFrame:
    from haulage.functions.scale import micros

    orders, path = load(spark, sf, "orders"), new_dir(spark, "read-export")
    best = best_range_column(profile_columns(orders, "orders"), SMALL)
    export_ranges(orders, range_plan(orders, best, SMALL, "orders"), path)
    return read_export(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("o_orderkey").alias("key_sum"),
        F.sum(cents("o_totalprice")).alias("total_cents"),
        F.min(micros("o_orderdate", "timestamp_ntz")).alias("first_order"),
    )


_USER_TABLES = """
user_tables AS (
  SELECT table_schema, table_name, table_schema || '.' || table_name AS full_name
  FROM catalog_tables
  WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('information_schema', 'pg_catalog')
    AND NOT starts_with(table_schema, 'pg_') AND NOT starts_with(table_schema, 'gp_'))"""


@query("catalog_tables", with_ctes(CATALOG_TABLES_SQL, _USER_TABLES) + "SELECT * FROM user_tables")
def user_tables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_tables(catalog_tables(spark, sf))


@query("catalog_schemas", with_ctes(CATALOG_TABLES_SQL, _USER_TABLES) + """
SELECT table_schema, coalesce(table_count, 0) AS table_count, first_table, last_table,
  coalesce(table_names, '') AS table_names
FROM (
  SELECT replace(lower(n_name), ' ', '_') AS table_schema FROM nation WHERE n_nationkey > 2
  UNION SELECT lower(r_name) FROM region)
FULL JOIN (
  SELECT table_schema, count(*) AS table_count, min(table_name) AS first_table,
    max(table_name) AS last_table, string_agg(table_name, ',' ORDER BY table_name) AS table_names
  FROM user_tables GROUP BY 1) USING (table_schema)""")
def user_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Nations are schemas with tables, regions are schemas without."""
    schemas = load(spark, sf, "nation").where("n_nationkey > 2").selectExpr(
        "replace(lower(n_name), ' ', '_') AS table_schema"
    ).unionByName(load(spark, sf, "region").selectExpr("lower(r_name) AS table_schema"))
    found = catalog.catalog_schemas(catalog_tables(spark, sf), schemas=schemas)
    return found.withColumn("table_names", F.array_join("table_names", ","))


@query("catalog_columns", with_ctes(COLUMNS_SQL) + """
SELECT table_schema, table_name, column_name, data_type, character_maximum_length, is_nullable,
  ordinal_position
FROM catalog_columns
WHERE (lower(table_schema), lower(table_name)) IN (
  SELECT 'sales', 'order_' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def columns_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    wanted = load(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.lit("sales").alias("table_schema"),
        F.concat(F.lit("ORDER_"), "o_orderkey").alias("table_name"),
    )
    return catalog.catalog_columns(catalog_columns(spark, sf), wanted)


@query("catalog_existing", with_ctes(COLUMNS_SQL) + """
SELECT 'sales' AS table_schema, 'ORDER_' || o_orderkey AS table_name FROM orders
WHERE ('sales', 'order_' || o_orderkey) IN (
  SELECT lower(table_schema), lower(table_name) FROM catalog_columns)""")
def existing(spark: SparkSession, sf: str) -> DataFrame:
    wanted = load(spark, sf, "orders").select(
        F.lit("sales").alias("table_schema"),
        F.concat(F.lit("ORDER_"), "o_orderkey").alias("table_name"),
    )
    return catalog.existing_tables(wanted, catalog_columns(spark, sf))


@query("catalog_attributes", """
SELECT lower(c_name) AS table_schema, 'rel_' || o_orderkey AS table_name,
  'att_' || l_partkey AS column_name, l_returnflag AS data_type,
  CASE WHEN CAST(l_quantity AS INTEGER) > 4 THEN CAST(l_quantity AS INTEGER) - 4 END
    AS character_maximum_length,
  CASE WHEN l_tax >= 0.04 THEN 'NO' ELSE 'YES' END AS is_nullable,
  l_linenumber - 1 AS ordinal_position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_linenumber - 1 > 0 AND NOT (l_linestatus = 'F' AND l_discount < 0.02)""")
def columns_by_attribute(spark: SparkSession, sf: str) -> DataFrame:
    classes = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("oid"),
        F.concat(F.lit("rel_"), "o_orderkey").alias("relname"),
        F.col("o_custkey").alias("relnamespace"),
    )
    namespaces = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("oid"), F.lower("c_name").alias("nspname")
    )
    attributes = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("attrelid"),
        (F.col("l_linenumber") - 1).alias("attnum"),
        F.concat(F.lit("att_"), "l_partkey").alias("attname"),
        F.col("l_returnflag").alias("format_type"),
        F.col("l_quantity").cast("int").alias("atttypmod"),
        (F.col("l_tax") >= 0.04).alias("attnotnull"),
        ((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.02)).alias("attisdropped"),
    )
    return catalog.columns_from_attributes(classes, namespaces, attributes)


@query("catalog_keys", with_ctes(KEYS_SQL) + """
SELECT table_schema, table_name, constraint_name, constraint_type, column_name, key_position
FROM key_constraints JOIN key_columns USING (constraint_schema, constraint_name)
WHERE constraint_type IN ('PRIMARY KEY', 'UNIQUE')""")
def keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_keys(key_constraints(spark, sf), key_columns(spark, sf))


@query("catalog_primary_keys", with_ctes(INVENTORY_SQL, KEYS_SQL) + """
SELECT 'Sales' AS table_schema, replace(table_name, 'sales.o', 'O') AS table_name, row_count
FROM inventory WHERE replace(table_name, 'sales.o', 'O') IN (
  SELECT table_name FROM key_constraints WHERE constraint_type = 'PRIMARY KEY')""")
def with_primary_key(spark: SparkSession, sf: str) -> DataFrame:
    from haulage.queries.derived import inventory

    named = inventory(spark, sf).select(
        F.lit("Sales").alias("table_schema"),
        F.replace("table_name", F.lit("sales.o"), F.lit("O")).alias("table_name"),
        "row_count",
    )
    found = catalog.tables_with_primary_key(named, key_constraints(spark, sf))
    return found.select("table_schema", "table_name", "row_count")


@query("catalog_partitioned", """
SELECT 'Sales' AS table_schema, 'Order_' || o_orderkey AS table_name FROM orders
WHERE 'Order_' || o_orderkey IN (
  SELECT CASE WHEN l_quantity >= 48 THEN 'Order_' ELSE 'Draft_' END || l_orderkey FROM lineitem)""")
def partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is a partition, of its order's table if it is of 48 or more, else of a draft."""
    def named(kind, key: str):
        return F.lit("Sales").alias("table_schema"), F.concat(kind, key).alias("table_name")

    large = F.when(F.col("l_quantity") >= 48, "Order_").otherwise("Draft_")
    parts = load(spark, sf, "lineitem").select(*named(large, "l_orderkey"))
    return catalog.partitioned_tables(load(spark, sf, "orders").select(*named(F.lit("Order_"), "o_orderkey")), parts)


@query("table_info", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, row_count, column_count, row_count > 2000 AS will_be_partitioned,
  CASE WHEN row_count > 2000 THEN (row_count + 1999) // 2000 ELSE 1 END AS estimated_chunks,
  2000 AS chunk_size,
  round(greatest(1.0, row_count * column_count * 10 / 1048576.0::DOUBLE), 2) AS estimated_size_mb
FROM (SELECT count(*) AS row_count FROM {t}),
  (SELECT count(*) AS column_count FROM (DESCRIBE {t}))""" for t in TABLE_NAMES))
def table_info(spark: SparkSession, sf: str) -> DataFrame:
    opened = {name: load(spark, sf, name) for name in TABLE_NAMES}
    return tables.table_info(
        tables.row_counts(opened), catalog.columns_of(spark, "main", opened), chunk_rows=2000
    )


@query("row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLE_NAMES))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.row_counts({name: load(spark, sf, name) for name in TABLE_NAMES})
