"""Exports, read back from what was written."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators.ledger import fold_jobs, fold_tables
from haulage.operators.profile import best_range_column, profile_columns
from haulage.operators.verify import footer_audit
from haulage.plans.ranges import range_plan
from haulage.policy import EXPORT_PROFILES, ExportOptions
from haulage.queries.derived import INVENTORY_SQL, SMALL, cents, inventory, with_ctes
from haulage.queries.planning import METHOD_SQL
from haulage.queries.registry import query
from haulage.queries.scans import LINE_ORDER
from haulage.session import filesystem, new_dir, written
from haulage.sinks import export, resumable
from haulage.sinks.job import Ledger, export_job, export_table
from haulage.sinks.manifest import list_data_files, read_export, read_files, read_metadata
from haulage.sinks.publish import archive_summary, publish
from haulage.sources.tables import load

_CENTS = "CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS BIGINT) AS total_cents"


def plan_for(df: DataFrame, table: str):
    best = best_range_column(profile_columns(df, table), SMALL)
    return range_plan(df, best, SMALL, table)


@query("export_single", f"""
SELECT c_mktsegment, count(*) AS row_count, CAST(sum(c_custkey) AS BIGINT) AS key_sum,
  {_CENTS.format(c='c_acctbal')} FROM customer GROUP BY 1""")
def export_single(spark: SparkSession, sf: str) -> DataFrame:
    customers, path = load(spark, sf, "customer"), new_dir(spark, "single")
    export.export_single(customers, path, "customer", customers.count())
    return read_export(spark, path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("c_custkey").alias("key_sum"),
        F.sum(cents("c_acctbal")).alias("total_cents"),
    )


@query("export_paged", f"""
SELECT CAST(position // 7000 AS INTEGER) AS chunk_id, count(*) AS row_count,
  CAST(sum(l_orderkey) AS BIGINT) AS key_sum, {_CENTS.format(c='l_extendedprice')}
FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
  FROM lineitem) GROUP BY 1""")
def export_paged(spark: SparkSession, sf: str) -> DataFrame:
    lines, path = load(spark, sf, "lineitem"), new_dir(spark, "paged")
    export.export_paged(lines, LINE_ORDER, 7000, path, "lineitem")
    return read_export(spark, path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("l_orderkey").alias("key_sum"),
        F.sum(cents("l_extendedprice")).alias("total_cents"),
    )


_TIERS = """greatest(1, least((r + 1999) // 2000, CASE WHEN r > 2000000 THEN least(200, r // 10000)
    WHEN r > 1000000 THEN least(150, r // 6000) WHEN r > 200000 THEN least(100, r // 4000)
    WHEN r > 20000 THEN least(80, r // 2000) ELSE least(50, r // 1000) END))"""
_FLOOR = """CASE WHEN r > 2000000 THEN 10000 WHEN r > 1000000 THEN 6000 WHEN r > 200000 THEN 4000
    WHEN r > 20000 THEN 2000 ELSE 1000 END"""


def ranges_sql(table: str, key: str) -> str:
    """CTE ``ranged``: the table with the chunk of each row."""
    return f"""
ranged AS (
  SELECT t.*, CAST(least(n - 1, ({key} - lo) // (greatest(1, (hi - lo) // n) + 1)) AS INTEGER)
    AS chunk_id
  FROM {table} t, (
    SELECT *, CASE WHEN r // n0 < f THEN greatest(1, r // f) ELSE n0 END AS n FROM (
      SELECT *, {_TIERS} AS n0, {_FLOOR} AS f FROM (
        SELECT min({key}) AS lo, max({key}) AS hi, count(*) AS r FROM {table}))))"""


@query("export_ranges", with_ctes(ranges_sql("lineitem", "l_orderkey")) + f"""
SELECT chunk_id, count(*) AS row_count, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
  {_CENTS.format(c='l_extendedprice')} FROM ranged GROUP BY 1""")
def export_ranges(spark: SparkSession, sf: str) -> DataFrame:
    lines, path = load(spark, sf, "lineitem"), new_dir(spark, "ranges")
    export.export_ranges(lines, plan_for(lines, "lineitem"), path)
    return read_export(spark, path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
        F.sum(cents("l_extendedprice")).alias("total_cents"),
    )


@query("resume_export", with_ctes(ranges_sql("orders", "o_orderkey")) + f"""
SELECT chunk_id, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
  {_CENTS.format(c='o_totalprice')} FROM ranged GROUP BY 1""")
def resume_export(spark: SparkSession, sf: str) -> DataFrame:
    """Two waves; then a chunk is lost, and the second run writes that one again."""
    orders, path = load(spark, sf, "orders"), new_dir(spark, "resume")
    plan = plan_for(orders, "orders")
    resumable.resume_export(orders, plan, path, waves=2)
    fs, lost = filesystem(spark, f"{path}/chunk_id={plan.chunks - 1}")
    fs.delete(lost, True)
    resumable.resume_export(orders, plan, path)
    return read_export(spark, path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("o_orderkey").alias("key_sum"),
        F.sum(cents("o_totalprice")).alias("total_cents"),
    )


@query("export_options", """
SELECT profile, codec, (SELECT count(*) FROM orders) AS row_count, true AS packs_better,
  true AS groups_fit
FROM (VALUES ('default', 'SNAPPY'), ('speed_optimized', 'SNAPPY'), ('balanced', 'ZSTD'),
  ('space_optimized', 'ZSTD'), ('resumable', 'ZSTD'), ('throughput', 'ZSTD'), ('small_groups', 'ZSTD'))
  t(profile, codec)""")
def export_options(spark: SparkSession, sf: str) -> DataFrame:
    """Each writer profile once, and one of small row groups; read from the files' footers.

    ``packs_better``: zstd stores fewer bytes than the default, and its level 9 not more than
    its level 1. ``groups_fit``: no row group is larger than its limit allows.
    """
    orders, out = load(spark, sf, "orders"), None
    profiles = {**EXPORT_PROFILES, "small_groups": ExportOptions("zstd", 3, row_group_mb=1)}
    for name, options in profiles.items():
        path = new_dir(spark, "options")
        export.export_capped(orders.coalesce(1), path, "orders", 1_000_000_000, options)
        limit = (options.row_group_mb or 128) * 1024 * 1024
        found = footer_audit(list_data_files(spark, path)).groupBy(F.col("codecs").alias("codec")).agg(
            F.sum("row_count").alias("row_count"), F.sum("stored_bytes").alias("stored"),
            # Sizes are checked while rows are buffered, so a group may end somewhat late.
            F.every(F.col("largest_group_bytes") <= 1.5 * limit).alias("groups_fit"),
        )
        found = found.withColumn("profile", F.lit(name))
        out = found if out is None else out.unionByName(found)
    out = written(out, "options-found")
    stored = {r["profile"]: r["stored"] for r in out.collect()}  # a row per profile
    better = F.lit(stored["space_optimized"] <= stored["throughput"])
    zstd = better & (F.col("stored") < stored["default"])
    return out.select(
        "profile", "codec", "row_count", F.when(F.col("codec") == "ZSTD", zstd).otherwise(better).alias("packs_better"),
        "groups_fit",
    )


@query("export_sized", """
SELECT count(*) AS total_rows, (count(*) + 4999) // 5000 AS file_count, true AS even FROM orders""")
def export_sized(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 5,000 rows; even: no file is more than one row per input task larger."""
    orders, path = load(spark, sf, "orders"), new_dir(spark, "sized")
    export.export_sized(orders, path, "orders", orders.count(), rows_in_file=5000)
    return read_files(spark, path).agg(
        F.sum("row_count").alias("total_rows"),
        F.count(F.lit(1)).alias("file_count"),
        (F.max("row_count") - F.min("row_count") < 5000).alias("even"),
    )


@query("export_manifest", with_ctes(ranges_sql("orders", "o_orderkey")) + """
SELECT 'orders' AS table_name, count(*) AS total_rows, 'complete' AS status, true AS partitioned,
  CAST(max(chunk_id) + 1 AS INTEGER) AS chunk_count, count(DISTINCT chunk_id) AS chunks_listed,
  count(*) AS rows_listed, true AS files_match
FROM ranged""")
def export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    orders, path = load(spark, sf, "orders"), new_dir(spark, "manifest")
    export.export_ranges(orders, plan_for(orders, "orders"), path)
    listed = read_files(spark, path)
    on_disk = list_data_files(spark, path).select("file_path", F.col("file_size").alias("_size"))
    compared = listed.withColumn(
        "file_path", F.regexp_replace("file_path", "^file:/+", "file:/")
    ).join(
        on_disk.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "file:/")),
        "file_path", "full_outer",
    )
    files = compared.agg(
        F.countDistinct("chunk_id").alias("chunks_listed"),
        F.sum("row_count").alias("rows_listed"),
        F.every(F.col("file_size").eqNullSafe(F.col("_size"))).alias("files_match"),
    ).withColumn("table_name", F.lit("orders"))
    stated = read_metadata(spark, path).select(
        "table_name", "total_rows", "status", "partitioned", "chunk_count"
    )
    return stated.join(files, "table_name")


@query("archive_job", with_ctes(INVENTORY_SQL, METHOD_SQL) + """
SELECT job_id, count(*) FILTER (WHERE method <> 'parallel_duckdb') AS moved_tables,
  count(*) FILTER (WHERE method = 'parallel_duckdb') AS failed_tables,
  count(*) FILTER (WHERE method = 'range_chunking') AS renamed_tables, count(*) AS total_tables
FROM chosen GROUP BY 1""")
def archive_job(spark: SparkSession, sf: str) -> DataFrame:
    """Summary written as JSON and read back."""
    from haulage.plans import methods

    chosen = methods.plan_methods(
        inventory(spark, sf).withColumn("supports_cursors", methods.supports_cursors(F.col("db_type")))
    )
    moved = chosen.select(
        "job_id",
        F.when(F.col("method") == methods.PAGED, "not moved").alias("error"),
        (F.col("method") == methods.RANGES).alias("was_renamed"),
    )
    path, summary = new_dir(spark, "archive"), archive_summary(moved)
    summary.write.json(path)
    return spark.read.schema(summary.schema).json(path)


@query("publish_export", """
SELECT name, was_renamed, rows_read FROM (VALUES ('orders', false), ('orders_v2', true),
  ('orders_v3', true)) t(name, was_renamed), (SELECT count(*) AS rows_read FROM orders)""")
def publish_export(spark: SparkSession, sf: str) -> DataFrame:
    """Three exports of one table, published under the same name."""
    orders, base, out = load(spark, sf, "orders"), new_dir(spark, "publish"), None
    plan = plan_for(orders, "orders")
    for attempt in range(3):
        staged = f"{base}/.temp/job{attempt}/orders"
        export.export_ranges(orders, plan, staged)
        done = publish(spark, staged, f"{base}/orders")
        rows = read_export(spark, done["final_path"]).agg(F.count(F.lit(1)).alias("rows_read"))
        part = rows.select(
            F.lit(done["final_path"].rsplit("/", 1)[1]).alias("name"),
            F.lit(done["was_renamed"]).alias("was_renamed"),
            "rows_read",
        )
        out = part if out is None else out.unionByName(part)
    return out


def _run_job(spark: SparkSession, sf: str) -> Ledger:
    names = ["orders", "customer", "part", "events", "missing_table"]
    base = new_dir(spark, "job")
    ledger = Ledger(spark, f"{base}/ledger")
    opened = {f"public.{n}": (lambda n=n: load(spark, sf, n)) for n in names}
    export_job(
        spark, opened, f"{base}/out", ledger, job_id="job-1", username="tester", policy=SMALL
    )
    return ledger


@query("export_job", """
SELECT 'public.orders' AS table_name, 'completed' AS status, count(*) AS rows_processed FROM orders
UNION ALL SELECT 'public.customer', 'completed', count(*) FROM customer
UNION ALL SELECT 'public.part', 'completed', count(*) FROM part
UNION ALL SELECT 'public.events', 'completed', count(*) FROM events
UNION ALL SELECT 'public.missing_table', 'failed', 0
UNION ALL SELECT '(job)', 'completed_with_errors', (SELECT count(*) FROM orders)
  + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM events)""")
def run_export_job(spark: SparkSession, sf: str) -> DataFrame:
    """Five tables, one of which does not exist; states from the ledger."""
    events = _run_job(spark, sf).events()
    tables = fold_tables(events).select("table_name", "status", "rows_processed")
    job = fold_jobs(events).select(
        F.lit("(job)").alias("table_name"), F.col("overall_status").alias("status"), "rows_processed"
    )
    return tables.unionByName(job)


# Range exports whatever the size of the table.
_RANGED = replace(SMALL, small_table_rows=0, range_preferred_rows=0)
_PLANNED_ROWS = """CAST(greatest(4000, least(40000, (greatest(CASE WHEN r > 2000000 THEN 10000
    WHEN r > 200000 THEN 4000 ELSE 2000 END, r // CASE WHEN r > 2000000 THEN 64 WHEN r > 200000 THEN 48
    ELSE 32 END) + 199) // 200 * 200)) AS BIGINT)"""


@query("export_planned", f"""
WITH sized AS (
  SELECT lo, hi, (r + s - 1) // s AS n FROM (
    SELECT *, {_PLANNED_ROWS} AS s FROM (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS r FROM lineitem))),
planned AS (
  SELECT l.*, CAST(least(n - 1, (l_orderkey - lo) // (greatest(1, (hi - lo) // n) + 1)) AS INTEGER) AS chunk_id
  FROM lineitem l, sized)
SELECT chunk_id, count(*) AS row_count, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
  {_CENTS.format(c='l_extendedprice')} FROM planned GROUP BY 1""")
def export_planned(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per chunk come from the method choice and decide how many chunks there are."""
    lines, path = load(spark, sf, "lineitem"), new_dir(spark, "planned")
    export_table(lines, "lineitem", path, policy=_RANGED, steered=True)
    return read_export(spark, path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
        F.sum(cents("l_extendedprice")).alias("total_cents"),
    )


class _Interrupted(Exception):
    pass


@query("rerun_job", with_ctes(ranges_sql("orders", "o_orderkey")) + """
SELECT 'public.orders' AS table_name, 'failed' AS first_status, 'completed' AS status,
  count(*) AS rows_processed, CAST(max(chunk_id) + 1 AS INTEGER) AS chunk_count,
  count(DISTINCT chunk_id) FILTER (WHERE chunk_id < (last + 2) // 2) AS chunks_kept
FROM ranged, (SELECT max(chunk_id) AS last FROM ranged)
UNION ALL
SELECT 'public.part', 'completed', 'completed', count(*), NULL, NULL FROM part""")
def rerun_job(spark: SparkSession, sf: str) -> DataFrame:
    """A job that is cut inside the range export of one table, after the first of two waves,
    and run again. ``chunks_kept``: chunks whose files the second run has left as they were."""
    base = new_dir(spark, "rerun")
    ledger = Ledger(spark, f"{base}/ledger")
    opened = {f"public.{n}": (lambda n=n: load(spark, sf, n)) for n in ("orders", "part")}

    def cut(table: str, fields: dict) -> None:
        if table == "public.orders" and "rows_processed" in fields:
            raise _Interrupted("cut after the first wave")

    options = dict(job_id="job-2", policy=_RANGED, waves=2, final=f"{base}/final")
    export_job(spark, opened, f"{base}/out", ledger, on_event=cut, **options)
    first = written(fold_tables(ledger.events()).select("table_name", F.col("status").alias("first_status")), "first-run")
    before = written(
        list_data_files(spark, f"{base}/out/job-2/public.orders").select("chunk_id", F.element_at(F.split("file_path", "/"), -1).alias("file_name")),
        "first-files",
    )
    export_job(spark, opened, f"{base}/out", ledger, **options)
    kept = read_files(spark, f"{base}/final/public_orders").join(before, ["chunk_id", "file_name"], "left_semi")
    kept = kept.agg(F.countDistinct("chunk_id").alias("chunks_kept")).withColumn("table_name", F.lit("public.orders"))
    tables = fold_tables(ledger.events()).select("table_name", "status", "rows_processed", "chunk_count")
    ranged = F.when(F.col("table_name") == "public.orders", F.col("chunk_count"))
    return tables.join(first, "table_name").join(kept, "table_name", "left").select(
        "table_name", "first_status", "status", "rows_processed", ranged.alias("chunk_count"), "chunks_kept"
    )
