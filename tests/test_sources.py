"""Readers, catalogs, layout and logs. The JDBC reads themselves need a database."""

from pyspark.sql import functions as F

from haulage.operators import logs
from haulage.plans import layout
from haulage.sources import catalog, jdbc, tables


def test_database_options():
    db = jdbc.Database("greenplum", "h", "u", "secret", extra={"ssl": True})
    assert db.url == "jdbc:postgresql://h:5432/postgres"
    assert jdbc.Database("Vertica", "h", "u", port=1).url == "jdbc:vertica://h:1/defaultdb"
    assert "secret" not in repr(db) and db.options()["ssl"] == "True"
    assert jdbc.stride_options("id", 1, 9, 4)["numPartitions"] == "4"
    assert [jdbc.fetch_size(n) for n in (None, 999_999, 1_000_000, 10_000_000)] == [25_000, 25_000, 50_000, 100_000]


def test_unknown_database_is_refused():
    import pytest

    with pytest.raises(ValueError, match="unsupported"):
        jdbc.Database("oracle", "h", "u")


def test_profile_runs_in_the_database(spark):
    df = spark.createDataFrame([], "id bigint, name string, at timestamp_ntz")
    assert jdbc.profile_query(df, "s.t") == (
        'SELECT count(*) AS row_total, min("id") AS lo_1, max("id") AS hi_1, count("id") AS n_1, '
        'min("at") AS lo_3, max("at") AS hi_3, count("at") AS n_3 FROM s.t'
    )


def test_catalog_queries_name_the_schema():
    assert "v_catalog.tables" in jdbc.catalog_query("vertica", "tables")
    assert "information_schema.columns" in jdbc.catalog_query("greenplum", "columns")


def test_user_tables(spark):
    frame = spark.createDataFrame(
        [("public", "b", "BASE TABLE"), ("public", "a", "BASE TABLE"), ("public", "v", "VIEW"),
         ("pg_x", "t", "BASE TABLE"), ("v_catalog", "t", "BASE TABLE")],
        "table_schema string, table_name string, table_type string",
    )
    assert [r["full_name"] for r in catalog.catalog_tables(frame).collect()] == ["public.a", "public.b", "v_catalog.t"]
    assert [r["full_name"] for r in catalog.catalog_tables(frame, "vertica").collect()] == ["pg_x.t", "public.a", "public.b"]
    schemas = {r["table_schema"]: r["table_count"] for r in catalog.catalog_schemas(frame).collect()}
    assert schemas == {"public": 2, "v_catalog": 1}


def test_range_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "timestamp_ntz'2024-01-01' AS at", "'x' AS v").write.parquet(path)
    part = tables.scan_range(spark.read.parquet(path), "id", "10", 20).select("id")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert part.count() == 10
    assert tables.scan_range(spark.read.parquet(path), "id", 10, 20, hi_inclusive=True).count() == 11


def test_equal_width_keeps_every_row(spark):
    frame = spark.createDataFrame([(None,), (-5,), (0,), (49,), (50,), (99,), (100,), (500,)], "k int")
    parts = frame.select(tables.equal_width(F.col("k"), 0, 100, 4).alias("s")).collect()
    assert [r["s"] for r in parts] == [0, 0, 0, 1, 2, 3, 3, 3]
    assert {r["s"] for r in frame.select(tables.equal_width(F.col("k"), 5, 5, 4).alias("s")).collect()} == {0}


def test_layouts(spark):
    frame = spark.createDataFrame([("sales.order_items", "j"), ("plain", "j")], "table_name string, job_id string")
    rows = layout.export_layout(frame, "/o", "schema_first").collect()
    assert rows[0]["final_path"] == "/o/sales/order_items" and rows[1]["final_path"] == "/o/public/plain"
    assert rows[0]["temp_path"] == "/o/.temp/j/sales/order_items"
    odd = layout.export_layout(frame, "/o", "whatever").first()
    assert (odd["strategy"], odd["final_path"]) == ("legacy", "/o/j/sales_order_items")


def test_first_free_version(spark):
    existing = spark.createDataFrame([(p,) for p in ("/a", "/a_v2", "/a_v4", "/b_v2", "/c")], "path string")
    wanted = spark.createDataFrame([(p,) for p in ("/a", "/b", "/c", "/d")], "final_path string")
    found = {r["final_path"]: (r["actual_path"], r["was_renamed"]) for r in layout.next_versions(wanted, existing).collect()}
    assert found == {"/a": ("/a_v3", True), "/b": ("/b", False), "/c": ("/c_v2", True), "/d": ("/d", False)}


LINES = [
    "[2024-01-01 10:00:00] [INFO] [JOB:j1] [TABLES:1/2] [JOB-PROGRESS:50.0%] [TABLE:public.users] "
    "[PROGRESS:10.0%] [ROWS:1.0K/9.5M] [MEM:12.5MB] Processing chunk [7]",
    "[2024-01-01 10:00:01] [ERROR] something failed",
    "Traceback (most recent call last):",
]


def test_log_lines(spark, tmp_path):
    (tmp_path / "w.log").write_text("\n".join(LINES) + "\n")
    lines = logs.read_log_lines(spark, str(tmp_path))
    first, second, third = logs.parse_logs(lines).orderBy("line_no").collect()
    assert (first["job_id"], first["table_name"], first["progress_percent"]) == ("j1", "public.users", 10.0)
    assert (first["tables"], first["job_progress"], first["rows"]) == ("1/2", "50.0%", "1.0K/9.5M")
    assert first["message"] == "Processing chunk [7]" and str(first["logged_at"]) == "2024-01-01 10:00:00"
    assert (second["level"], second["job_id"], second["message"]) == ("ERROR", None, "something failed")
    assert third["logged_at"] is None and third["message"] == LINES[2]
    assert [r["value"] for r in logs.tail_logs(lines, 2).collect()] == [LINES[2], LINES[1]]
    assert [r["value"] for r in logs.tail_logs(lines, 5, job_id="j1").collect()] == [LINES[0]]
    severity = [r[0] for r in lines.orderBy("line_no").select(logs.log_severity(F.col("value"))).collect()]
    assert severity == ["none", "error", "none"]
