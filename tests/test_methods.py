"""Method choice at the bounds, by hand."""

from pyspark.sql import functions as F

from haulage.plans import methods
from haulage.policy import Policy

SIZES = [100_000, 1_000_000, 10_000_000, 100_000_000, 500_000_000, 1_000_000_000]


def test_sizes_and_workers(spark):
    rows = spark.createDataFrame([(n,) for n in [0, *SIZES, 2_000_000_000]], "r bigint").select(
        methods.optimal_chunk_size(F.col("r")).alias("size"),
        methods.optimal_parallelism(F.col("r")).alias("workers"),
        methods.optimal_parallelism(F.col("r"), 4).alias("few"),
    ).collect()
    assert [r["size"] for r in rows] == [
        2_000_000, 2_000_000, 2_000_000, 2_000_000, 6_300_000, 20_000_000, 20_000_000, 20_000_000,
    ]
    assert [r["workers"] for r in rows] == [6, 6, 6, 6, 8, 12, 16, 16]
    assert {r["few"] for r in rows} == {4}


def test_methods(spark):
    cases = [  # rows, has range, cursors, expected
        (499_999, True, True, "direct_duckdb"), (500_000, True, True, "parallel_duckdb"),
        (4_999_999, False, True, "parallel_duckdb"), (5_000_000, False, True, "cursor_streaming"),
        (9_999_999, True, False, "parallel_duckdb"), (10_000_000, True, False, "range_chunking"),
        (49_999_999, False, False, "parallel_duckdb"), (50_000_000, False, True, "cursor_streaming"),
        (50_000_000, False, False, "parallel_duckdb"), (200_000_000, True, True, "range_chunking"),
    ]
    frame = spark.createDataFrame(cases, "r bigint, ranged boolean, cursors boolean, expected string")
    chosen = methods.select_method(F.col("r"), F.col("ranged"), F.col("cursors"))
    for row in frame.withColumn("m", chosen).collect():
        assert row["m"] == row["expected"], row


def test_warnings_and_labels(spark):
    frame = spark.createDataFrame([(49_999_999,), (50_000_000,), (100_000_000,)], "r bigint")
    rows = frame.select(
        methods.plan_warning(F.col("r"), F.lit("parallel_duckdb")).alias("w"),
        methods.plan_warning(F.col("r"), F.lit("range_chunking")).alias("none"),
        methods.streams_in_chunks(F.col("r")).alias("chunked"),
        methods.benefit_label_by_chunks(F.col("r"), 1_000_000).alias("label"),
    ).collect()
    assert rows[0]["w"] == "" and "WARNING" in rows[1]["w"] and "50,000,000" in rows[1]["w"]
    assert "CRITICAL" in rows[2]["w"] and {r["none"] for r in rows} == {""}
    assert [r["chunked"] for r in rows] == [True, False, False]
    assert rows[0]["label"].startswith("moderate") and rows[2]["label"].startswith("moderate")


def test_scaled_policy_keeps_counts():
    small = Policy().scaled(500)
    assert small.numeric_tiers[-1].floor_rows == 1000 and small.numeric_tiers[-1].max_chunks == 50
    assert small.small_table_rows == 1000 and small.max_files_per_table == 200
