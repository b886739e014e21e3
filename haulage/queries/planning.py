"""Ranges, pages and method choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.plans import layout, methods, ranges
from haulage.queries.derived import INVENTORY_SQL, SMALL, inventory, with_ctes
from haulage.queries.profiling import PROFILE_SQL, table_profiles
from haulage.queries.registry import query
from haulage.sources.tables import load


def _tier_sql(caps: str, floors: str) -> str:
    return f"""
counted AS (
  SELECT *, total_count AS r, greatest(1, least((total_count + 1999) // 2000, {caps})) AS n0,
    {floors} AS f FROM profile)"""


_NUMERIC_CAPS = """CASE WHEN total_count > 2000000 THEN least(200, total_count // 10000)
    WHEN total_count > 1000000 THEN least(150, total_count // 6000)
    WHEN total_count > 200000 THEN least(100, total_count // 4000)
    WHEN total_count > 20000 THEN least(80, total_count // 2000)
    ELSE least(50, total_count // 1000) END"""
_NUMERIC_FLOORS = """CASE WHEN total_count > 2000000 THEN 10000 WHEN total_count > 1000000 THEN 6000
    WHEN total_count > 200000 THEN 4000 WHEN total_count > 20000 THEN 2000 ELSE 1000 END"""
_NUMERIC_N = "CASE WHEN r // n0 < f THEN greatest(1, r // f) ELSE n0 END"
NUMERIC_SQL = _tier_sql(_NUMERIC_CAPS, _NUMERIC_FLOORS)
TIME_SQL = _tier_sql(
    """CASE WHEN total_count > 2000000 THEN least(200, total_count // 4000)
    WHEN total_count > 200000 THEN least(75, total_count // 2000)
    ELSE least(50, total_count // 200) END""",
    "0",
)
_OUT = "table_name, column_name, data_type, CAST(i AS INTEGER) AS chunk_id"
_NULLS = "i = 0 AND null_count > 0 AS has_nulls"
_WHOLE = "data_type IN ('smallint', 'integer', 'bigint')"


@query("numeric_ranges", with_ctes(PROFILE_SQL, NUMERIC_SQL) + f"""
SELECT {_OUT}, min_key + i * (width + 1) AS lo,
  CASE WHEN i = n - 1 THEN max_key ELSE least(min_key + i * (width + 1) + width, max_key) END AS hi,
  true AS hi_inclusive, i = m - 1 AS is_last, {_NULLS}
FROM (
  SELECT *, least(n, (max_key - min_key) // (width + 1) + 1) AS m FROM (
    SELECT *, greatest(1, (max_key - min_key) // n) AS width FROM (
      SELECT *, {_NUMERIC_N} AS n FROM counted WHERE {_WHOLE} AND min_key IS NOT NULL))),
  range(0, m) t(i)
UNION ALL
SELECT table_name, column_name, data_type, 0, NULL, NULL, true, true, null_count > 0
FROM profile WHERE {_WHOLE} AND min_key IS NULL AND total_count > 0""")
def numeric_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.numeric_ranges(table_profiles(spark, sf), SMALL)


@query("time_ranges", with_ctes(PROFILE_SQL, TIME_SQL) + f"""
SELECT {_OUT}, min_key + i * step AS lo,
  CASE WHEN i = m - 1 THEN max_key ELSE min_key + (i + 1) * step END AS hi,
  i = m - 1 AS hi_inclusive, i = m - 1 AS is_last, {_NULLS}
FROM (
  SELECT *, least(n0, (max_key - min_key) // step + 1) AS m FROM (
    SELECT *, greatest(1, (max_key - min_key) // n0) AS step FROM counted
    WHERE data_type = 'timestamp' AND min_key IS NOT NULL)), range(0, m) t(i)""")
def time_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.time_ranges(table_profiles(spark, sf), SMALL)


@query("real_ranges", with_ctes(PROFILE_SQL, NUMERIC_SQL) + f"""
SELECT {_OUT}, CASE WHEN i = 0 THEN min_real ELSE min_real + i * step END AS lo,
  CASE WHEN i = n - 1 THEN max_real ELSE min_real + (i + 1) * step END AS hi,
  i = n - 1 AS hi_inclusive, i = n - 1 AS is_last, {_NULLS}
FROM (
  SELECT *, (max_real - min_real) / n AS step FROM (
    SELECT *, {_NUMERIC_N} AS n FROM counted WHERE data_type = 'double precision')),
  range(0, n) t(i)""")
def real_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.real_ranges(table_profiles(spark, sf), SMALL)


@query("simple_ranges", with_ctes(PROFILE_SQL) + f"""
SELECT * FROM (
  SELECT {_OUT}, CASE WHEN i = 0 THEN min_key ELSE min_key + i * width + 1 END AS lo,
    CASE WHEN i = k - 1 THEN max_key ELSE min_key + (i + 1) * width END AS hi,
    true AS hi_inclusive, i = k - 1 AS is_last, {_NULLS}
  FROM (
    SELECT *, (max_key - min_key) // k AS width FROM (
      SELECT *, greatest(1, least(50, (max_key - min_key) // 2000)) AS k
      FROM profile WHERE {_WHOLE} AND min_key IS NOT NULL)), range(0, k) t(i))
WHERE lo <= hi""")
def simple_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The fallback: chunk count from the key span, without a row count."""
    count = ranges.fallback_chunk_count(target_rows=2000, least_keys=2000)
    return ranges.simple_ranges(table_profiles(spark, sf), count)


@query("pk_between_ranges", with_ctes(PROFILE_SQL) + f"""
SELECT {_OUT}, min_key + i * step AS lo,
  CASE WHEN i = m - 1 THEN max_key ELSE min_key + (i + 1) * step - 1 END AS hi,
  true AS hi_inclusive, i = m - 1 AS is_last, {_NULLS}
FROM (
  SELECT *, least((total_count + 3999) // 4000, (max_key - min_key) // step + 1) AS m FROM (
    SELECT *, greatest(1, (max_key - min_key + 1) // (total_count // 4000 + 1)) AS step
    FROM profile WHERE {_WHOLE} AND min_key IS NOT NULL)), range(0, m) t(i)""")
def pk_between_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.key_between_ranges(table_profiles(spark, sf), chunk_rows=4000)


@query("quantile_ranges", """
WITH q AS (SELECT quantile_disc(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS starts
  FROM lineitem)
SELECT CAST(len([s for s in starts if s <= l_extendedprice]) AS INTEGER) AS chunk_id,
  count(*) AS rows, min(l_extendedprice) AS first_value, max(l_extendedprice) AS last_value
FROM lineitem, q GROUP BY 1""")
def quantile_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly balanced chunks, from a distributed sort of the column."""
    return _balanced(load(spark, sf, "lineitem"), exact=True)


@query("quantile_ranges_approx", """
SELECT count(*) AS rows, CAST(8 AS BIGINT) AS chunks, true AS balanced FROM lineitem""")
def quantile_ranges_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks from a sketch; balanced: none is off by more than 1 % of all rows."""
    chunks = _balanced(load(spark, sf, "lineitem"), exact=False)
    return chunks.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("chunks"),
        ((F.max("rows") - F.min("rows")) <= F.sum("rows") * 0.01).alias("balanced"),
    )


def _balanced(lines: DataFrame, exact: bool) -> DataFrame:
    plan = ranges.quantile_plan(lines, "l_extendedprice", 8, exact=exact)
    return lines.groupBy(plan.chunk_id().alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("l_extendedprice").alias("first_value"),
        F.max("l_extendedprice").alias("last_value"),
    )


@query("offset_chunks", with_ctes(INVENTORY_SQL) + """
SELECT table_name, CAST(i AS INTEGER) AS chunk_id, i * 20000000 AS row_offset,
  least(20000000, row_count - i * 20000000) AS row_limit
FROM inventory, range(0, (row_count + 19999999) // 20000000) t(i)""")
def offset_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.offset_chunks(inventory(spark, sf), page_rows=20_000_000)


_SIZE = """CAST(CASE WHEN row_count <= 0 THEN 2000000 ELSE greatest(2000000, least(20000000,
  (greatest(CASE WHEN row_count > 1000000000 THEN 5000000 WHEN row_count > 100000000 THEN 2000000
    ELSE 1000000 END, row_count // CASE WHEN row_count > 1000000000 THEN least({w} * 4, 200)
    WHEN row_count > 100000000 THEN least({w} * 3, 100) ELSE least({w} * 2, 50) END) + 99999)
  // 100000 * 100000)) END AS BIGINT)"""


@query("optimal_chunk_size", with_ctes(INVENTORY_SQL)
       + f"SELECT table_name, row_count, {_SIZE.format(w=8)} AS chunk_rows FROM inventory")
def optimal_chunk_size(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select(
        "table_name", "row_count", methods.optimal_chunk_size(F.col("row_count")).alias("chunk_rows")
    )


_WORKERS = """least(16, CASE WHEN row_count > 500000000 THEN 16 WHEN row_count > 100000000 THEN 12
  WHEN row_count > 10000000 THEN 8 ELSE 6 END)"""


@query("optimal_parallelism", with_ctes(INVENTORY_SQL)
       + f"SELECT table_name, row_count, {_WORKERS} AS workers FROM inventory")
def optimal_parallelism(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select(
        "table_name", "row_count", methods.optimal_parallelism(F.col("row_count")).alias("workers")
    )


METHOD_SQL = """
chosen AS (
  SELECT *, db_type IN ('postgresql', 'greenplum') AS supports_cursors,
    CASE WHEN row_count < 500000 THEN 'direct_duckdb'
      WHEN row_count >= 10000000 AND has_suitable_range_column THEN 'range_chunking'
      WHEN row_count >= 50000000 THEN CASE WHEN db_type <> 'vertica' THEN 'cursor_streaming'
        ELSE 'parallel_duckdb' END
      WHEN row_count >= 5000000 AND db_type <> 'vertica' THEN 'cursor_streaming'
      ELSE 'parallel_duckdb' END AS method
  FROM inventory)"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).withColumn(
        "supports_cursors", methods.supports_cursors(F.col("db_type"))
    )


@query("select_method", with_ctes(INVENTORY_SQL, METHOD_SQL) + """
SELECT table_name, row_count, db_type, has_suitable_range_column, supports_cursors, method
FROM chosen""")
def select_method(spark: SparkSession, sf: str) -> DataFrame:
    return methods.plan_methods(_sources(spark, sf)).select(
        "table_name", "row_count", "db_type", "has_suitable_range_column", "supports_cursors",
        "method",
    )


@query("method_params", with_ctes(INVENTORY_SQL, METHOD_SQL, f"""
sized AS (SELECT *, {_SIZE.format(w=16)} AS s, {_WORKERS} AS w FROM chosen)""") + """
SELECT table_name, method,
  CAST(CASE method WHEN 'range_chunking' THEN s
    WHEN 'cursor_streaming' THEN CASE WHEN row_count < 50000000 THEN 2000000 ELSE 5000000 END
    WHEN 'parallel_duckdb' THEN least(1000000, greatest(100000, row_count // 50)) END AS BIGINT)
    AS chunk_rows,
  CASE method WHEN 'range_chunking' THEN w WHEN 'parallel_duckdb' THEN 8 END AS max_workers,
  CASE WHEN method = 'range_chunking' THEN (row_count + s - 1) // s END AS estimated_chunks,
  CASE WHEN method = 'range_chunking' THEN least((row_count + s - 1) // s, 200) END AS max_chunks,
  CASE WHEN method = 'range_chunking' THEN CASE WHEN row_count > 1000000000 THEN 'ultra-massive'
    WHEN row_count > 500000000 THEN 'massive' WHEN row_count > 100000000 THEN 'large'
    WHEN row_count > 10000000 THEN 'medium-large' ELSE 'medium' END END AS table_category,
  CASE WHEN method = 'range_chunking' THEN 400 END AS target_file_size_mb,
  CAST(CASE WHEN method = 'cursor_streaming' THEN 20000000 END AS BIGINT) AS single_file_below_rows,
  method = 'range_chunking' AND db_type = 'greenplum' AS segment_aligned
FROM sized""")
def method_params(spark: SparkSession, sf: str) -> DataFrame:
    return methods.plan_methods(_sources(spark, sf)).select(
        "table_name", "method", "chunk_rows", "max_workers", "estimated_chunks", "max_chunks",
        "table_category", "target_file_size_mb", "single_file_below_rows", "segment_aligned",
    )


@query("single_or_chunked", with_ctes(INVENTORY_SQL) + """
SELECT table_name, row_count, row_count > 20000000 AND row_count < 100000000
  AND row_count < 50000000 AS chunked FROM inventory""")
def single_or_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select(
        "table_name", "row_count", methods.streams_in_chunks(F.col("row_count")).alias("chunked")
    )


@query("benefit_label", with_ctes(INVENTORY_SQL) + """
SELECT table_name,
  CASE WHEN row_count < 1000000 THEN 'minimal (small table - direct export recommended)'
    WHEN row_count < 10000000 THEN 'moderate (medium table - single file streaming)'
    WHEN row_count < 100000000 THEN 'high (large table - chunked streaming recommended)'
    ELSE 'extreme (very large table - chunked streaming highly recommended)' END AS by_rows,
  CASE WHEN row_count < 1000000 THEN 'minimal (small table)'
    WHEN (row_count + 999999) // 1000000 < 50 THEN 'low (< 50 chunks)'
    WHEN (row_count + 999999) // 1000000 < 200 THEN 'moderate (50-200 chunks)'
    WHEN (row_count + 999999) // 1000000 < 1000 THEN 'high (200-1000 chunks)'
    ELSE 'extreme (> 1000 chunks - OFFSET would be unusable)' END AS by_chunks
FROM inventory""")
def benefit_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("row_count")
    return inventory(spark, sf).select(
        "table_name",
        methods.benefit_label(rows).alias("by_rows"),
        methods.benefit_label_by_chunks(rows, 1_000_000).alias("by_chunks"),
    )


@query("plan_warning", with_ctes(INVENTORY_SQL, METHOD_SQL) + """
SELECT table_name, method,
  CASE WHEN method = 'parallel_duckdb' AND row_count >= 100000000
      THEN '🚨 CRITICAL: ' || method || ' may take 8+ hours for ' || format('{:,}', row_count)
        || ' rows. Use range chunking!'
    WHEN method = 'parallel_duckdb' AND row_count >= 50000000
      THEN '⚠️  WARNING: ' || method || ' may be slow for ' || format('{:,}', row_count)
        || ' rows. Consider range chunking.'
    ELSE '' END AS warning
FROM chosen""")
def plan_warning(spark: SparkSession, sf: str) -> DataFrame:
    return methods.plan_methods(_sources(spark, sf)).select("table_name", "method", "warning")


_SAFE = "replace(replace(table_name, '.', '_'), '/', '_')"
_SCHEMA, _BARE = "split_part(table_name, '.', 1)", "split_part(table_name, '.', 2)"


@query("export_layout", with_ctes(INVENTORY_SQL) + f"""
SELECT table_name, 'clean_with_archive' AS strategy,
  '/stage/.temp/' || job_id || '/' || {_SAFE} AS temp_path, '/out/' || {_SAFE} AS final_path,
  '/out/.archive/jobs' AS archive_path FROM inventory
UNION ALL SELECT table_name, 'direct', '/out/' || {_SAFE}, '/out/' || {_SAFE}, '/out/.jobs'
FROM inventory
UNION ALL SELECT table_name, 'schema_first', '/stage/.temp/' || job_id || '/' || {_SCHEMA} || '/'
  || {_BARE}, '/out/' || {_SCHEMA} || '/' || {_BARE}, '/out/.archive/jobs' FROM inventory
UNION ALL SELECT table_name, 'legacy', '/stage/' || job_id || '/' || {_SAFE},
  '/out/' || job_id || '/' || {_SAFE}, '/out/.archive' FROM inventory""")
def export_layout(spark: SparkSession, sf: str) -> DataFrame:
    tables = inventory(spark, sf).select("table_name", "job_id")
    out = None
    for strategy in layout.STRATEGIES:
        part = layout.export_layout(tables, "/out", strategy, "/stage").drop("job_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("publish_version", """
WITH existing AS (
  SELECT DISTINCT base || CASE WHEN l_linenumber = 1 THEN '' ELSE '_v' || l_linenumber END AS path
  FROM (SELECT *, CASE WHEN l_quantity < 8 THEN '/out/s_' ELSE '/out/t_' END || l_suppkey AS base FROM lineitem)),
wanted AS (SELECT '/out/s_' || s_suppkey AS final_path FROM supplier
  UNION ALL SELECT '/out/t_' || s_suppkey FROM supplier UNION ALL SELECT '/out/p_' || p_partkey FROM part),
free AS (
  SELECT final_path, min(v) AS version FROM wanted, range(2, 9) t(v)
  WHERE final_path || '_v' || v NOT IN (SELECT path FROM existing) GROUP BY 1)
SELECT final_path,
  CASE WHEN final_path IN (SELECT path FROM existing) THEN final_path || '_v' || version
    ELSE final_path END AS actual_path,
  final_path IN (SELECT path FROM existing) AS was_renamed
FROM wanted JOIN free USING (final_path)""")
def publish_version(spark: SparkSession, sf: str) -> DataFrame:
    """Every line stands for a published export: few of the `s_` tables, many of the `t_` tables."""
    number = F.col("l_linenumber")
    plain = F.concat(F.when(F.col("l_quantity") < 8, "/out/s_").otherwise("/out/t_"), "l_suppkey")
    existing = load(spark, sf, "lineitem").select(
        F.when(number == 1, plain).otherwise(F.concat(plain, F.lit("_v"), number)).alias("path")
    )
    kinds = F.explode(F.array(F.lit("/out/s_"), F.lit("/out/t_"))).alias("kind")
    wanted = load(spark, sf, "supplier").select("s_suppkey", kinds).select(
        F.concat("kind", "s_suppkey").alias("final_path")
    ).unionByName(
        load(spark, sf, "part").select(F.concat(F.lit("/out/p_"), "p_partkey").alias("final_path"))
    )
    return layout.next_versions(wanted, existing)
