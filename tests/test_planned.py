"""Chunks by size, checked options, footers, and Spark's own catalog."""

import pytest

from haulage.operators import verify
from haulage.plans.ranges import RangePlan, range_plan
from haulage.policy import ExportOptions, Policy
from haulage.sinks import export, manifest
from haulage.sources import catalog

PROFILE = (
    "table_name string, column_name string, data_type string, min_key bigint, max_key bigint, min_real double, "
    "max_real double, null_count bigint, total_count bigint"
)
ROWS = 2 * 10**11


def plan_of(spark, kind, spark_type, policy, rows=ROWS):
    df = spark.createDataFrame([], f"k {spark_type}")
    best = spark.createDataFrame([("t", "k", kind, 1, 3 * rows, 0.0, 1e9, 0, rows)], PROFILE)
    return range_plan(df, best, policy, "t")


def test_plans_of_huge_tables(spark):
    assert plan_of(spark, "bigint", "bigint", Policy()).chunks == 200  # the compatible default
    for policy in (Policy(chunk_rows=20_000_000), Policy(chunk_mb=10_000), Policy(chunk_rows=10**9, chunk_mb=10_000)):
        plan = plan_of(spark, "bigint", "bigint", policy)
        most = policy.rows_in_chunk()
        assert most <= 21_000_000 and plan.chunks == -(-ROWS // most)
        # The chunk of a row is arithmetic, whatever the number of chunks.
        assert len(plan.chunk_sql()) < 500
        got = spark.createDataFrame([(1,), (3 * ROWS // 2,), (3 * ROWS,), (None,)], "k bigint").select(plan.chunk_id().alias("c"))
        first, middle, last, null = (r["c"] for r in got.collect())
        assert (first, last, null) == (0, plan.chunks - 1, 0) and abs(middle - plan.chunks / 2) <= 1


def test_many_starts_are_searched_in_a_list(spark):
    starts = tuple(float(i) / 3 for i in range(1, 1200))
    plan = RangePlan("t", "k", "double", starts)
    values = [None, -1.0, 0.0, 1 / 3, 0.34, 100.1, 399.0, 1199 / 3, 500.0]
    got = spark.createDataFrame([(v,) for v in values], "k double").select("k", plan.chunk_id().alias("c")).collect()
    for r in got:
        assert r["c"] == (0 if r["k"] is None else sum(s <= r["k"] for s in starts))


def test_options_are_checked():
    for bad in (dict(codec="zip"), dict(codec="zstd", level=0), dict(codec="zstd", level=23), dict(row_group_mb=0),
                dict(max_records_per_file=0)):
        with pytest.raises(ValueError):
            ExportOptions(**bad)
    ExportOptions("zstd", 22, 1, 1)


def test_footer_audit(spark, tmp_path):
    df = spark.range(200_000).selectExpr("id", "sha2(cast(id AS string), 256) AS v")
    found = {}
    for name, options in {"one": ExportOptions("zstd", 1), "many": ExportOptions("zstd", 1, row_group_mb=2)}.items():
        path = str(tmp_path / name)
        export.export_single(df, path, "t", 200_000, options)
        found[name] = verify.footer_audit(manifest.list_data_files(spark, path)).first()
    assert found["one"]["row_groups"] == 1 and found["many"]["row_groups"] > 3
    assert found["many"]["largest_group_bytes"] < found["one"]["largest_group_bytes"]
    assert all(r["row_count"] == 200_000 and r["codecs"] == "ZSTD" and "PLAIN" in r["encodings"] for r in found.values())
    assert all(0 < r["stored_bytes"] <= r["plain_bytes"] * 1.01 for r in found.values())


@pytest.fixture
def databases(spark, tmp_path):
    for name in ("shop", "bare"):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    spark.sql("CREATE TABLE shop.sales (id BIGINT, day DATE, place STRING) USING parquet PARTITIONED BY (place)")
    spark.sql("INSERT INTO shop.sales VALUES (1, DATE'2024-01-01', 'a'), (2, NULL, 'b'), (3, NULL, 'b')")
    spark.sql("CREATE TABLE shop.odd_one (x INT) USING parquet")
    spark.sql("CREATE VIEW shop.few AS SELECT 1 AS one")
    yield
    for name in ("shop", "bare"):
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_the_catalog_of_spark(spark, databases):
    wanted = [("shop", "sales"), ("shop", "odd_one")]
    tables = catalog.spark_tables(spark)
    user = {(r["table_schema"], r["table_name"]) for r in catalog.catalog_tables(tables).collect()}
    assert user >= set(wanted) and ("shop", "few") not in user
    schemas = {r["table_schema"]: r for r in catalog.catalog_schemas(tables, schemas=catalog.spark_schemas(spark)).collect()}
    assert schemas["shop"]["table_names"] == ["odd_one", "sales"] and schemas["shop"]["table_count"] == 2
    assert (schemas["bare"]["table_names"], schemas["bare"]["table_count"]) == ([], 0)
    columns = catalog.spark_columns(spark, wanted)
    names = spark.createDataFrame([("SHOP", "Sales")], "table_schema string, table_name string")
    found = catalog.catalog_columns(columns, names).orderBy("ordinal_position").collect()
    assert [(r["column_name"], r["data_type"]) for r in found] == [("id", "bigint"), ("day", "date"), ("place", "text")]
    parts = catalog.spark_partitions(spark, wanted)
    assert sorted(r["partition"] for r in parts.collect()) == ["place=a", "place=b"]
    kept = catalog.partitioned_tables(tables, parts).collect()
    assert [r["table_name"] for r in kept] == ["sales"]


def test_sizes_from_analyzed_tables(spark, databases):
    from haulage.operators.profile import size_estimate

    wanted = [("shop", "sales"), ("shop", "odd_one")]
    sizes = {r["table_name"]: r for r in catalog.spark_sizes(spark, wanted).collect()}
    assert sizes["odd_one"]["row_count"] is None
    spark.sql("ANALYZE TABLE shop.sales COMPUTE STATISTICS")
    spark.sql("ANALYZE TABLE shop.odd_one COMPUTE STATISTICS")
    found = catalog.spark_sizes(spark, wanted)
    sizes = {r["table_name"]: r for r in found.collect()}
    assert sizes["sales"]["relation_bytes"] > 0 and sizes["sales"]["row_count"] == 3
    assert (sizes["odd_one"]["relation_bytes"], sizes["odd_one"]["row_count"]) == (0, 0)
    guessed = {r["table_name"]: r["estimated_size_mb"] for r in size_estimate(found).collect()}
    assert guessed["sales"] == sizes["sales"]["relation_bytes"] / 1024 / 1024 and guessed["odd_one"] == 0
