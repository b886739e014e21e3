"""Verification and resume. The "export" is the source with known damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators import resume, verify
from haulage.queries.derived import INVENTORY_SQL, inventory, with_ctes
from haulage.queries.exports import plan_for, ranges_sql
from haulage.queries.registry import query
from haulage.session import new_dir
from haulage.sinks import export
from haulage.sinks.manifest import export_details as details_of
from haulage.sinks.manifest import list_data_files, read_export, read_metadata
from haulage.sources.tables import load

# The damage: urgent open orders are lost, some prices change, some rows are new.
DAMAGED_SQL = """
damaged AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_totalprice > 450000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority
  FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
  UNION ALL
  SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_totalprice < 5000)"""


def damaged(orders: DataFrame) -> DataFrame:
    lost = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    price = F.col("o_totalprice")
    kept = orders.where(~lost).withColumn("o_totalprice", F.when(price > 450000, price + 1).otherwise(price))
    new = orders.where(price < 5000).withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return kept.unionByName(new)


@query("verify_counts", with_ctes(ranges_sql("orders", "o_orderkey")) + """
SELECT chunk_id, count(*) AS source_rows,
  count(*) FILTER (WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')) AS export_rows,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') = 0 AS passed
FROM ranged GROUP BY 1""")
def verify_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk by chunk, against an export that lost rows."""
    orders, path = load(spark, sf, "orders"), new_dir(spark, "counts")
    plan = plan_for(orders, "orders")
    lost = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    export.gathered_by_chunk(
        orders.where(~lost).withColumn("chunk_id", plan.chunk_id())
    ).write.partitionBy("chunk_id").parquet(path)
    exported = spark.read.parquet(path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))
    return verify.verify_counts(verify.chunk_histogram(orders, plan), exported)


@query("verify_totals", """
SELECT count(*) AS source_rows, count(*) AS export_rows, CAST(0 AS BIGINT) AS failed_chunks,
  true AS passed FROM lineitem""")
def verify_totals(spark: SparkSession, sf: str) -> DataFrame:
    """An undamaged export passes as a whole."""
    lines, path = load(spark, sf, "lineitem"), new_dir(spark, "totals")
    plan = plan_for(lines, "lineitem")
    export.export_ranges(lines, plan, path)
    exported = read_export(spark, path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))
    return verify.verify_totals(
        verify.verify_counts(verify.chunk_histogram(lines, plan), exported)
    )


@query("verify_tolerance", with_ctes(INVENTORY_SQL) + """
SELECT table_name, abs(actual - row_count) <= greatest(100.0::DOUBLE, row_count * 0.001::DOUBLE) AS loose,
  abs(actual - row_count) <= row_count * 0.01::DOUBLE AS fresh,
  abs(actual - row_count) <= row_count * 0.001::DOUBLE AS resumed
FROM (SELECT *, row_count - CASE db_type WHEN 'vertica' THEN 99 WHEN 'greenplum' THEN row_count // 200
  ELSE 5000 END AS actual FROM inventory)""")
def verify_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    rows, kind = F.col("row_count"), F.col("db_type")
    lost = F.when(kind == "vertica", 99).when(
        kind == "greenplum", F.call_function("div", rows, F.lit(200))
    ).otherwise(5000)
    actual = rows - lost
    return inventory(spark, sf).select(
        "table_name",
        verify.within_tolerance(rows, actual).alias("loose"),
        verify.within_share(rows, actual, F.lit(False)).alias("fresh"),
        verify.within_share(rows, actual, F.lit(True)).alias("resumed"),
    )


@query("verify_gaps", """
WITH files AS (
  SELECT 's_' || l_suppkey || '_' || l_returnflag AS table_name, CAST(l_quantity AS INTEGER) AS chunk_number
  FROM lineitem),
tables AS (SELECT 's_' || s_suppkey || '_' || unnest(['A', 'N', 'R']) AS table_name FROM supplier),
planned AS (SELECT table_name, unnest(range(1, 46))::INTEGER AS chunk_number FROM tables)
SELECT *, 'missing' AS problem FROM (SELECT * FROM planned EXCEPT SELECT * FROM files)
UNION ALL SELECT *, 'extra' FROM (SELECT * FROM files EXCEPT SELECT * FROM planned)""")
def verify_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """45 chunks are planned per supplier and flag; the files are named by quantity (1 to 50)."""
    number = F.format_string("part_%04d.parquet", F.col("l_quantity").cast("int"))
    files = load(spark, sf, "lineitem").select(
        F.concat(F.lit("s_"), "l_suppkey", F.lit("_"), "l_returnflag").alias("table_name"), number.alias("file_name")
    )
    flags = F.explode(F.array(*map(F.lit, "ANR"))).alias("flag")
    planned = load(spark, sf, "supplier").select("s_suppkey", flags).select(
        F.concat(F.lit("s_"), "s_suppkey", F.lit("_"), "flag").alias("table_name"), F.lit(45).alias("chunk_count")
    )
    return verify.verify_gaps(files, planned)


@query("verify_readable", with_ctes(ranges_sql("lineitem", "l_orderkey")) + """
SELECT chunk_id, true AS readable, 'SNAPPY' AS codec, count(*) AS row_count FROM ranged GROUP BY 1""")
def verify_readable(spark: SparkSession, sf: str) -> DataFrame:
    """Footers of all files of an export, summed up per chunk."""
    lines, path = load(spark, sf, "lineitem"), new_dir(spark, "readable")
    export.export_ranges(lines, plan_for(lines, "lineitem"), path)
    files = list_data_files(spark, path)
    return (
        verify.verify_readable(files)
        .join(files, "file_path")
        .groupBy("chunk_id", "readable", "codec")
        .agg(F.sum("row_count").alias("row_count"))
    )


@query("file_checksums", with_ctes(ranges_sql("orders", "o_orderkey")) + """
SELECT DISTINCT chunk_id, true AS same_as_whole_file, true AS sizes_match FROM ranged""")
def file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Digests read in blocks against Spark's own over the whole file."""
    orders, path = load(spark, sf, "orders"), new_dir(spark, "checksums")
    export.export_ranges(orders, plan_for(orders, "orders"), path)
    blocks = verify.file_checksums(list_data_files(spark, path))
    whole = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("_whole"),
                F.length("content").alias("_bytes"))
    )
    return blocks.join(whole, "file_path").groupBy("chunk_id").agg(
        F.every(F.col("checksum") == F.col("_whole")).alias("same_as_whole_file"),
        F.every(F.col("file_size") == F.col("_bytes")).alias("sizes_match"),
    )


@query("combined_checksum", """
SELECT 'orders' AS table_name, true AS repeatable, true AS well_formed""")
def combined_checksum(spark: SparkSession, sf: str) -> DataFrame:
    """One digest over all files; a second reading gives the same one."""
    orders, path = load(spark, sf, "orders"), new_dir(spark, "combined")
    export.export_ranges(orders, plan_for(orders, "orders"), path)

    def digest(name: str) -> DataFrame:
        files = list_data_files(spark, path).withColumn("table_name", F.lit("orders"))
        found = verify.combined_checksum(verify.file_checksums(files))
        return found.select("table_name", F.col("combined_checksum").alias(name))

    return digest("first").join(digest("second"), "table_name").select(
        "table_name",
        (F.col("first") == F.col("second")).alias("repeatable"),
        F.col("first").rlike("^[0-9a-f]{64}$").alias("well_formed"),
    )


@query("verify_sample", with_ctes(DAMAGED_SQL) + """
SELECT count(*) AS sample_size, count(*) FILTER (WHERE o.o_totalprice = d.o_totalprice) AS same_rows,
  count(*) FILTER (WHERE d.o_orderkey IS NULL) AS missing_rows, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS extra_rows,
  count(*) FILTER (WHERE o.o_totalprice <> d.o_totalprice) AS changed_rows, false AS passed
FROM orders o FULL JOIN damaged d ON o.o_orderkey = d.o_orderkey
WHERE ('0x' || substr(md5(CAST(coalesce(o.o_orderkey, d.o_orderkey) AS VARCHAR)), 1, 6))::BIGINT % 4 = 0""")
def verify_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling verdict; sampling by a hash of the key is the feature."""
    orders = load(spark, sf, "orders")
    return verify.verify_sample(orders, damaged(orders), ["o_orderkey"], one_in=4)


@query("reconcile", with_ctes(DAMAGED_SQL) + """
SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey,
  CASE WHEN d.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra'
    WHEN o.o_totalprice = d.o_totalprice THEN 'same' ELSE 'changed' END AS outcome
FROM orders o FULL JOIN damaged d ON o.o_orderkey = d.o_orderkey""")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    return verify.reconcile(orders, damaged(orders), ["o_orderkey"])


# Prices are rounded up to tens by the export, partial orders lose their status.
_EXPORTED = """
export AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
    CAST(ceil(o_totalprice / 10) * 10 AS FLOAT) AS o_totalprice, o_orderdate, 'x' AS loaded_by FROM orders),
typed AS (
  SELECT *, CASE typeof(o_orderdate) WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    ELSE 'timestamp' END AS date_type FROM orders)"""


def _column_sql(name: str, kinds: str, match: str, outcome: str) -> str:
    return f"""SELECT '{name}' AS column_name, {kinds}, (SELECT count({name}) FROM orders) AS source_values,
  (SELECT count({name}) FROM export) AS export_values, {match} AS values_match, {outcome} AS outcome"""


def _same_sql(name: str, source: str) -> str:
    return f"NOT EXISTS (SELECT {source} FROM orders EXCEPT ALL SELECT {name} FROM export)"


_STATUS = _same_sql("o_orderstatus", "o_orderstatus")


@query("reconcile_columns", with_ctes(_EXPORTED) + " UNION ALL ".join([
    _column_sql("o_orderkey", "'bigint' AS source_type, 'bigint' AS export_type",
                _same_sql("o_orderkey", "o_orderkey"), "'same'"),
    _column_sql("o_custkey", "'bigint', 'string'", _same_sql("o_custkey", "CAST(o_custkey AS VARCHAR)"), "'type_changed'"),
    _column_sql("o_orderstatus", "'string', 'string'", _STATUS, f"CASE WHEN {_STATUS} THEN 'same' ELSE 'changed' END"),
    _column_sql("o_totalprice", "'double', 'float'", _same_sql("o_totalprice", "CAST(o_totalprice AS FLOAT)"), "'type_changed'"),
    _column_sql("o_orderdate", "(SELECT max(date_type) FROM typed), (SELECT max(date_type) FROM typed)",
                _same_sql("o_orderdate", "o_orderdate"), "'same'"),
    """SELECT 'o_orderpriority', 'string', NULL, count(o_orderpriority), NULL, NULL, 'missing' FROM orders""",
    """SELECT 'loaded_by', NULL, 'string', NULL, count(loaded_by), NULL, 'extra' FROM export""",
]))
def reconcile_columns(spark: SparkSession, sf: str) -> DataFrame:
    """An export that lost a column and some values, changed two types and one's values, and added a column."""
    orders = load(spark, sf, "orders")
    exported = orders.drop("o_orderpriority").withColumns(
        {
            "o_custkey": F.col("o_custkey").cast("string"),
            "o_orderstatus": F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END"),
            "o_totalprice": (F.ceil(F.col("o_totalprice") / 10) * 10).cast("float"),
            "loaded_by": F.lit("x"),
        }
    )
    return verify.reconcile_columns(orders, exported)


@query("reconcile_null_keys", """
WITH keyed AS (
  SELECT CASE WHEN o_orderkey > 0 THEN o_orderkey END AS k, o_totalprice AS price,
    CAST(o_totalprice AS FLOAT) AS exported FROM orders)
SELECT k, CASE WHEN k % 7 = 3 THEN 'missing' WHEN k % 7 = 4 OR k IS NULL AND price < 0 THEN 'changed' ELSE 'same' END AS outcome
FROM keyed""")
def reconcile_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A NULL key meets a NULL key; a float export of doubles is the same where it rounds alike."""
    source = load(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey > 0 THEN o_orderkey END AS k", "o_totalprice AS price",
        "map('status', o_orderstatus) AS marks",
    )
    export = source.where("k IS NULL OR k % 7 <> 3").selectExpr(
        "k", "cast(CASE WHEN k % 7 = 4 THEN price + 1000 ELSE price END AS float) AS price", "marks"
    )
    return verify.reconcile(source, export, ["k"])


_LINE = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate"""


@query("reconcile_rows", f"""
WITH source AS (SELECT {_LINE} FROM lineitem UNION ALL SELECT {_LINE} FROM lineitem WHERE l_linenumber = 2),
export AS (
  SELECT * REPLACE (CASE WHEN l_quantity = 50 THEN 'X' ELSE l_returnflag END AS l_returnflag)
  FROM source WHERE NOT (l_quantity = 1 AND l_returnflag = 'R')),
s AS (SELECT *, count(*) AS source_count FROM source GROUP BY ALL),
e AS (SELECT *, count(*) AS export_count FROM export GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity,
  coalesce(source_count, 0) AS source_count, coalesce(export_count, 0) AS export_count
FROM s FULL JOIN e USING ({_LINE})
WHERE coalesce(source_count, 0) <> coalesce(export_count, 0)""")
def reconcile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All lines, the second one of each order twice; some are lost and some changed."""
    lines = load(spark, sf, "lineitem")
    source = lines.unionByName(lines.where("l_linenumber = 2"))
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    exported = source.where(~((quantity == 1) & (flag == "R"))).withColumn(
        "l_returnflag", F.when(quantity == 50, "X").otherwise(flag)
    )
    return verify.reconcile_rows(source, exported).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity",
        "source_count", "export_count",
    )


@query("export_details", with_ctes(ranges_sql("orders", "o_orderkey")) + """
SELECT 'orders' AS table_name, max(chunk_id) + 1 AS chunk_count, true AS partitioned,
  'manifest' AS metadata_source, true AS has_size FROM ranged
UNION ALL SELECT 'customer', 1, false, 'inferred_from_files', true""")
def export_details(spark: SparkSession, sf: str) -> DataFrame:
    """One export with a manifest and one whose manifest is not looked at."""
    orders, base = load(spark, sf, "orders"), new_dir(spark, "details")
    export.export_ranges(orders, plan_for(orders, "orders"), f"{base}/orders")
    customers = load(spark, sf, "customer")
    export.export_single(customers, f"{base}/customer", "customer", customers.count())
    files = list_data_files(spark, f"{base}/orders").withColumn("table_name", F.lit("orders"))
    files = files.unionByName(
        list_data_files(spark, f"{base}/customer").withColumn("table_name", F.lit("customer"))
    )
    found = details_of(files, read_metadata(spark, f"{base}/orders"))
    return found.select(
        "table_name", F.col("chunk_count").cast("int").alias("chunk_count"), "partitioned",
        "metadata_source", (F.col("total_size_bytes") > 0).alias("has_size"),
    )


MANIFESTS_SQL = """
manifests AS (
  SELECT table_name, CASE WHEN db_type = 'vertica' THEN row_count + 1 ELSE row_count END AS total_rows,
    CASE WHEN has_suitable_range_column THEN 'complete' ELSE 'running' END AS status FROM inventory
  UNION ALL
  SELECT table_name, row_count, 'complete' FROM inventory WHERE row_count > 1000000000)"""


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of earlier exports: some outdated, some unfinished, some in two versions."""
    tables, rows = inventory(spark, sf), F.col("row_count")
    first = tables.select(
        "table_name",
        F.when(F.col("db_type") == "vertica", rows + 1).otherwise(rows).alias("total_rows"),
        F.when(F.col("has_suitable_range_column"), "complete").otherwise("running").alias("status"),
    )
    second = tables.where(rows > 1_000_000_000).select(
        "table_name", rows.alias("total_rows"), F.lit("complete").alias("status")
    )
    return first.unionByName(second)


@query("existing_export", with_ctes(INVENTORY_SQL, MANIFESTS_SQL) + """
SELECT table_name, row_count, (table_name, row_count) IN (
  SELECT table_name, total_rows FROM manifests WHERE status = 'complete') AS exists_already
FROM inventory""")
def existing_export(spark: SparkSession, sf: str) -> DataFrame:
    wanted, found = inventory(spark, sf).select("table_name", "row_count"), manifests(spark, sf)
    return resume.mark_existing(wanted, found)


RECORDS_SQL = """
records AS (
  SELECT 's_' || l_suppkey AS table_name, l_linenumber AS chunk_id, l_orderkey AS written,
    l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS row_count,
    CASE WHEN l_tax > 0.01 THEN md5(CAST(l_partkey AS VARCHAR)) END AS checksum
  FROM lineitem),
ledger AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, chunk_id
      ORDER BY written DESC, part DESC, row_count DESC, checksum DESC NULLS LAST) AS rn
    FROM records) WHERE rn = 1)"""


def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    """Completion records; each order line reports a chunk of its supplier's table."""
    return load(spark, sf, "lineitem").select(
        F.concat(F.lit("s_"), "l_suppkey").alias("table_name"),
        F.col("l_linenumber").alias("chunk_id"),
        F.col("l_orderkey").alias("written"),
        F.col("l_partkey").alias("part"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("row_count"),
        F.when(F.col("l_tax") > 0.01, F.md5(F.col("l_partkey").cast("string"))).alias("checksum"),
    )


ORDER = ["written", "part", "row_count", "checksum"]


@query("chunk_ledger", with_ctes(RECORDS_SQL) + "SELECT * FROM ledger")
def chunk_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return resume.chunk_ledger(chunk_records(spark, sf), ORDER)


@query("resume_plan", with_ctes(RECORDS_SQL) + """
SELECT table_name, chunk_id FROM (
  SELECT 's_' || s_suppkey AS table_name, unnest(range(0, 10))::INTEGER AS chunk_id FROM supplier)
WHERE (table_name, chunk_id) NOT IN (
  SELECT table_name, chunk_id FROM ledger
  WHERE chunk_id <> 3 AND (checksum IS NULL OR part >= 500))""")
def resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Ten chunks per supplier. Chunk 3 lost its file, small part numbers changed theirs."""
    ledger = resume.chunk_ledger(chunk_records(spark, sf), ORDER)
    current = ledger.where(F.col("chunk_id") != 3).select(
        "table_name", "chunk_id",
        F.when(F.col("part") < 500, F.lit("edited")).otherwise(F.col("checksum")).alias("checksum"),
    )
    plan = load(spark, sf, "supplier").select(
        F.concat(F.lit("s_"), "s_suppkey").alias("table_name"),
        F.explode(F.sequence(F.lit(0), F.lit(9))).alias("chunk_id"),
    )
    return resume.resume_plan(plan, ledger, current)
