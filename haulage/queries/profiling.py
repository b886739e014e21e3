"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators import profile
from haulage.operators.verify import chunk_histogram
from haulage.plans.ranges import range_plan
from haulage.queries.derived import (
    COLUMNS_SQL,
    INVENTORY_SQL,
    KEYS_SQL,
    SMALL,
    catalog_columns,
    inventory,
    key_columns,
    key_constraints,
    with_ctes,
)
from haulage.queries.registry import query
from haulage.session import written
from haulage.sources import catalog
from haulage.sources.tables import load

# The rangeable columns of the profiled tables (ordinal, name, type).
PROFILED = {
    "orders": [(1, "o_orderkey", "bigint"), (2, "o_custkey", "bigint"),
               (4, "o_totalprice", "double precision"), (5, "o_orderdate", "timestamp")],
    "lineitem": [(1, "l_orderkey", "bigint"), (2, "l_partkey", "bigint"), (3, "l_suppkey", "bigint"),
                 (4, "l_linenumber", "integer"), (5, "l_quantity", "double precision"),
                 (6, "l_extendedprice", "double precision"), (7, "l_discount", "double precision"),
                 (8, "l_tax", "double precision"), (11, "l_shipdate", "timestamp")],
    "events": [(1, "event_id", "bigint"), (2, "ts", "timestamp"), (3, "user_id", "bigint"),
               (5, "value", "double precision")],
    "customer": [(1, "c_custkey", "bigint"), (3, "c_nationkey", "integer"),
                 (4, "c_acctbal", "double precision")],
    "part": [(1, "p_partkey", "bigint"), (5, "p_size", "integer"),
             (6, "p_retailprice", "double precision")],
}
# Columns derived so that one has many NULLs and one has nothing else.
SPARSE_SQL = """(SELECT *, CASE WHEN value > 20 THEN event_id END AS mostly_null,
  CASE WHEN value < 0 THEN event_id END AS all_null FROM events)"""


def sparse_events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumns(
        {
            "mostly_null": F.when(F.col("value") > 20, F.col("event_id")),
            "all_null": F.when(F.col("value") < 0, F.col("event_id")),
        }
    )


def _profile_sql(table: str, ordinal: int, column: str, kind: str, source: str | None = None) -> str:
    if kind == "timestamp":
        low, high, reals = f"epoch_us(min({column}))", f"epoch_us(max({column}))", "CAST(NULL AS DOUBLE)"
    elif kind == "double precision":
        return (f"SELECT '{table}' AS table_name, {ordinal} AS ordinal, '{column}' AS column_name, "
                f"'{kind}' AS data_type, CAST(NULL AS BIGINT) AS min_key, CAST(NULL AS BIGINT) AS max_key, "
                f"min({column}) + 0.0::DOUBLE AS min_real, max({column}) + 0.0::DOUBLE AS max_real, "
                f"count(*) - count({column}) AS null_count, count(*) AS total_count FROM {source or table}")
    else:
        low, high, reals = f"CAST(min({column}) AS BIGINT)", f"CAST(max({column}) AS BIGINT)", "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{table}' AS table_name, {ordinal} AS ordinal, '{column}' AS column_name, "
            f"'{kind}' AS data_type, {low} AS min_key, {high} AS max_key, {reals} AS min_real, "
            f"{reals} AS max_real, count(*) - count({column}) AS null_count, "
            f"count(*) AS total_count FROM {source or table}")


PROFILE_SQL = "profile AS (\n" + "\nUNION ALL\n".join(
    [_profile_sql(t, *c) for t, columns in PROFILED.items() for c in columns]
    + [_profile_sql("sparse_events", *c, source=SPARSE_SQL) for c in [
        *PROFILED["events"], (7, "mostly_null", "bigint"), (8, "all_null", "bigint")]]
) + ")"

DENSITY_SQL = """
dense AS (
  SELECT *, CASE WHEN data_type IN ('smallint', 'integer', 'bigint')
      THEN CAST(total_count AS DOUBLE) / CAST(max_key - min_key + 1 AS DOUBLE) END AS density
  FROM profile)"""

BEST_SQL = """
suitable AS (
  SELECT *, coalesce(density > 0.5, false) AS is_sequential,
    CASE WHEN coalesce(density > 0.5, false) AND data_type IN ('integer', 'bigint') THEN 1
      WHEN data_type IN ('date', 'timestamp', 'timestamptz') THEN 2 ELSE 3 END AS priority
  FROM dense
  WHERE (min_key IS NOT NULL OR min_real IS NOT NULL) AND null_count <= 0.2 * total_count),
best AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY table_name ORDER BY priority, ordinal) AS rn FROM suitable) WHERE rn = 1)"""


def table_profiles(spark: SparkSession, sf: str) -> DataFrame:
    opened = {name: load(spark, sf, name) for name in PROFILED}
    return profile.profile_tables({**opened, "sparse_events": sparse_events(spark, sf)})


@query("profile_columns", with_ctes(PROFILE_SQL) + "SELECT * FROM profile")
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table_profiles(spark, sf)


@query("density", with_ctes(PROFILE_SQL, DENSITY_SQL) + """
SELECT table_name, column_name, total_count, density, coalesce(density > 0.5, false) AS is_sequential
FROM dense""")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return profile.with_density(table_profiles(spark, sf)).select(
        "table_name", "column_name", "total_count", "density", "is_sequential"
    )


@query("suitable_columns", with_ctes(PROFILE_SQL, DENSITY_SQL, BEST_SQL) + """
SELECT table_name, column_name, null_count, total_count FROM suitable""")
def suitable_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.suitable_columns(table_profiles(spark, sf)).select(
        "table_name", "column_name", "null_count", "total_count"
    )


@query("best_range_column", with_ctes(PROFILE_SQL, DENSITY_SQL, BEST_SQL) + """
SELECT table_name, column_name, data_type, is_sequential, min_key, max_key, null_count FROM best""")
def best_range_column(spark: SparkSession, sf: str) -> DataFrame:
    return profile.best_range_column(table_profiles(spark, sf)).select(
        "table_name", "column_name", "data_type", "is_sequential", "min_key", "max_key",
        "null_count",
    )


@query("partition_column", with_ctes(COLUMNS_SQL, KEYS_SQL, """
numeric_columns AS (SELECT * FROM catalog_columns
  WHERE data_type IN ('integer', 'bigint', 'serial', 'bigserial', 'numeric')),
all_keys AS (
  SELECT table_schema, table_name, column_name, min(key_position) AS key_position
  FROM key_constraints JOIN key_columns USING (constraint_schema, constraint_name)
  WHERE constraint_type IN ('PRIMARY KEY', 'UNIQUE') GROUP BY ALL),
ranked AS (
  SELECT n.table_schema, n.table_name, n.column_name, n.data_type, k.key_position IS NOT NULL AS is_key,
    row_number() OVER (PARTITION BY n.table_schema, n.table_name ORDER BY k.key_position IS NULL,
      coalesce(k.key_position, n.ordinal_position), n.ordinal_position, n.column_name) AS rn
  FROM numeric_columns n LEFT JOIN all_keys k USING (table_schema, table_name, column_name))""") + """
SELECT table_schema, table_name, column_name, is_key FROM ranked WHERE rn = 1""")
def partition_column(spark: SparkSession, sf: str) -> DataFrame:
    keys = catalog.catalog_keys(key_constraints(spark, sf), key_columns(spark, sf))
    chosen = profile.partition_column(catalog_columns(spark, sf), keys)
    return chosen.select("table_schema", "table_name", "column_name", "is_key")


@query("size_estimate", with_ctes(INVENTORY_SQL, """
known AS (
  SELECT *, CASE WHEN row_count % 3 = 0 THEN row_count * 120 WHEN row_count % 3 = 1 THEN 0 END AS relation_bytes
  FROM inventory),
sized AS (
  SELECT *, coalesce(nullif(relation_bytes, 0), row_count * 500) / 1024.0::DOUBLE / 1024.0::DOUBLE AS mb FROM known)""") + """
SELECT table_name, row_count, relation_bytes, mb AS estimated_size_mb,
  least(mb * 0.1::DOUBLE, 2048.0::DOUBLE) AS memory_requirements_mb FROM sized""")
def size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the tables has a known size, a third one of zero, a third none."""
    tables = inventory(spark, sf).selectExpr(
        "table_name", "row_count",
        "CASE WHEN row_count % 3 = 0 THEN row_count * 120 WHEN row_count % 3 = 1 THEN 0L END AS relation_bytes",
    )
    return profile.size_estimate(tables)


@query("table_profile", with_ctes(PROFILE_SQL, DENSITY_SQL, BEST_SQL) + """
SELECT p.table_name, p.row_count,
  p.row_count * 500 / 1024.0::DOUBLE / 1024.0::DOUBLE AS estimated_size_mb,
  b.table_name IS NOT NULL AS has_suitable_range_column,
  b.column_name || ' (' || b.data_type || ')' AS range_column_info,
  coalesce(b.is_sequential, false) AS has_primary_key, p.row_count >= 10000 AS is_partitioned,
  'greenplum' AS db_type, true AS supports_cursors, (p.row_count + 1999) // 2000 AS offset_chunk_count,
  CASE WHEN p.row_count < 1000000 THEN 'minimal (small table - direct export recommended)'
    WHEN p.row_count < 10000000 THEN 'moderate (medium table - single file streaming)'
    WHEN p.row_count < 100000000 THEN 'high (large table - chunked streaming recommended)'
    ELSE 'extreme (very large table - chunked streaming highly recommended)' END
    AS estimated_offset_penalty,
  least(p.row_count * 500 / 1024.0::DOUBLE / 1024.0::DOUBLE * 0.1::DOUBLE, 2048.0::DOUBLE)
    AS memory_requirements_mb
FROM (SELECT table_name, max(total_count) AS row_count FROM profile GROUP BY 1) p
LEFT JOIN best b USING (table_name)""")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences stand in for primary keys, 10,000 rows for partitioned tables."""
    columns = written(table_profiles(spark, sf), "profiles")
    best = profile.best_range_column(columns, SMALL)
    return profile.table_profile(
        columns,
        primary_keys=best.where("is_sequential"),
        partitioned=columns.where(F.col("total_count") >= 10_000),
        db_type="greenplum",
        policy=SMALL,
    )


_CHUNKS = """
bounds AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS r FROM lineitem),
counted AS (
  SELECT *, greatest(1, least((r + 1999) // 2000, CASE WHEN r > 2000000 THEN least(200, r // 10000)
    WHEN r > 1000000 THEN least(150, r // 6000) WHEN r > 200000 THEN least(100, r // 4000)
    WHEN r > 20000 THEN least(80, r // 2000) ELSE least(50, r // 1000) END)) AS n0,
    CASE WHEN r > 2000000 THEN 10000 WHEN r > 1000000 THEN 6000 WHEN r > 200000 THEN 4000
      WHEN r > 20000 THEN 2000 ELSE 1000 END AS f FROM bounds),
sized AS (SELECT *, CASE WHEN r // n0 < f THEN greatest(1, r // f) ELSE n0 END AS n FROM counted),
planned AS (SELECT *, greatest(1, (hi - lo) // n) AS width FROM sized)"""


@query("chunk_histogram", with_ctes(_CHUNKS) + """
SELECT CAST(i AS INTEGER) AS chunk_id, count(l_orderkey) AS rows, count(l_orderkey) = 0 AS is_empty,
  any_value(CAST(r AS DOUBLE) / m) AS average_rows
FROM (SELECT *, least(n, (hi - lo) // (width + 1) + 1) AS m FROM planned), range(0, m) t(i)
LEFT JOIN lineitem ON least(n - 1, (l_orderkey - lo) // (width + 1)) = i GROUP BY i""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    best = profile.best_range_column(profile.profile_columns(lines, "lineitem"), SMALL)
    return chunk_histogram(lines, range_plan(lines, best, SMALL, "lineitem"))


@query("range_chunk_report", """
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS r FROM orders),
p AS (SELECT *, greatest(1, least((r + 1999) // 2000, CASE WHEN r > 2000000 THEN least(200, r // 10000)
    WHEN r > 1000000 THEN least(150, r // 6000) WHEN r > 200000 THEN least(100, r // 4000)
    WHEN r > 20000 THEN least(80, r // 2000) ELSE least(50, r // 1000) END)) AS n0,
    CASE WHEN r > 2000000 THEN 10000 WHEN r > 1000000 THEN 6000 WHEN r > 200000 THEN 4000
      WHEN r > 20000 THEN 2000 ELSE 1000 END AS f FROM b),
q AS (SELECT *, CASE WHEN r // n0 < f THEN greatest(1, r // f) ELSE n0 END AS n FROM p),
w AS (SELECT *, greatest(1, (hi - lo) // n) AS width FROM q)
SELECT CAST(least(n - 1, (o_orderkey - lo) // (width + 1)) AS INTEGER) AS chunk_id, count(*) AS rows,
  min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders, w GROUP BY 1""")
def range_chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """Profile a table, pick its split column, plan the ranges, and report each chunk."""
    from haulage.queries.derived import cents

    orders = load(spark, sf, "orders")
    best = profile.best_range_column(profile.profile_columns(orders, "orders"), SMALL)
    plan = range_plan(orders, best, SMALL, "orders")
    return orders.groupBy(plan.chunk_id().alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.sum(cents("o_totalprice")).alias("total_cents"),
    )
