"""Ranges lose no row and share none, whatever the column holds."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from haulage.operators.profile import best_range_column, profile_columns
from haulage.operators.verify import chunk_histogram
from haulage.plans import ranges
from haulage.policy import Policy

TINY = Policy().scaled(100_000)  # 10 rows per chunk, at least 5


def walked(low, high, count):
    """Chunks of a closed whole-number interval, walked one after the other."""
    width, start, out = max(1, (high - low) // count), low, []
    while len(out) < count and start <= high:
        end = high if len(out) == count - 1 else min(high, start + width)
        out.append((start, end))
        start = end + 1
    return out


def profile_rows(spark, rows):
    """rows: (table, min, max, rows, nulls) of a bigint column."""
    return spark.createDataFrame(
        [(t, 1, "c", "bigint", lo, hi, None, None, nulls, n) for t, lo, hi, n, nulls in rows],
        "table_name string, ordinal int, column_name string, data_type string, min_key bigint, "
        "max_key bigint, min_real double, max_real double, null_count bigint, total_count bigint",
    )


def test_numeric_ranges_match_a_walk(spark):
    rng, cases = random.Random(7), {}
    for i in range(400):
        low = rng.randint(-10**6, 10**6)
        cases[f"t{i}"] = (low, low + rng.choice([0, 1, 2, 7, rng.randint(0, 10**7)]), rng.randint(1, 60))
    edge = {"wide": (-(2**63), 2**63 - 1, 7), "top": (2**63 - 3, 2**63 - 1, 2),
            "bottom": (-(2**63), -(2**63) + 10, 4)}
    cases |= edge
    frame = profile_rows(spark, [(t, lo, hi, 100, 0) for t, (lo, hi, _) in cases.items()])
    counts = spark.createDataFrame([(t, n) for t, (_, _, n) in cases.items()], "table_name string, n int")
    found = ranges.numeric_ranges(frame.join(counts, "table_name"), chunks=F.col("n"))
    got = {}
    for row in found.collect():
        got.setdefault(row["table_name"], {})[row["chunk_id"]] = (row["lo"], row["hi"])
    for table, (low, high, count) in cases.items():
        chunks = [got[table][i] for i in range(len(got[table]))]
        assert chunks == walked(low, high, count), table


@pytest.mark.parametrize("make", [
    lambda p: ranges.simple_ranges(p, F.lit(7)),
    lambda p: ranges.key_between_ranges(p, 30),
    lambda p: ranges.numeric_ranges(p, TINY),
])
def test_closed_ranges_cover_every_key_once(spark, make):
    cases = [("a", 0, 999, 300, 0), ("b", -50, -50, 40, 3), ("c", 5, 9, 500, 0), ("d", -7, 1000, 90, 0),
             ("e", 1, 90, 90, 0)]
    rows = make(profile_rows(spark, cases)).orderBy("table_name", "chunk_id").collect()
    for table, low, high, _, _ in cases:
        mine = [(r["lo"], r["hi"]) for r in rows if r["table_name"] == table]
        assert mine[0][0] == low and mine[-1][1] == high
        assert all(b[0] == a[1] + 1 for a, b in zip(mine, mine[1:])), table


def test_chunk_counts_at_the_tier_bounds(spark):
    counted = spark.createDataFrame(
        [(0,), (1,), (499_999,), (1_000_000,), (10_000_000,), (10_000_001,), (100_000_001,),
         (500_000_001,), (1_000_000_001,)], "r bigint",
    ).select(
        ranges.chunk_count("r", 1_000_000, Policy().numeric_tiers, True).alias("numeric"),
        ranges.chunk_count("r", 1_000_000, Policy().time_tiers, False).alias("time"),
    ).collect()
    assert [r["numeric"] for r in counted] == [0, 1, 1, 1, 10, 10, 50, 150, 200]
    assert [r["time"] for r in counted] == [0, 1, 1, 1, 10, 11, 75, 75, 200]


def moments(n):
    return [datetime(2024, 3, 31, 0, 0, 0, i * 37 % 10**6) for i in range(n)]


COLUMNS = {
    "dense": ("bigint", list(range(100))),
    "negative": ("int", [i * 7 - 300 for i in range(100)]),
    "small": ("smallint", [i % 50 for i in range(100)]),
    "one_value": ("bigint", [5] * 100),
    "some_nulls": ("bigint", [None if i % 7 == 0 else i for i in range(100)]),
    "huge": ("bigint", [-(2**63), 2**63 - 1, *range(98)]),
    "skewed": ("bigint", [0] * 60 + [10**12 + i for i in range(40)]),
    "fraction": ("double", [i / 7 - 3 for i in range(100)]),
    "not_a_number": ("double", [float("nan"), float("inf"), None, *[i / 3 for i in range(97)]]),
    "moment": ("timestamp_ntz", moments(100)),
    "instant": ("timestamp", moments(100)),
    "day": ("date", [date(2024, 1, 1 + i % 28) for i in range(100)]),
    "old_day": ("date", [date(1950 + i, 2, 3) for i in range(100)]),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_row_is_in_exactly_one_chunk(spark, name):
    dtype, values = COLUMNS[name]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} {dtype}")
    best = best_range_column(profile_columns(df, "t", [name]), TINY)
    plan = ranges.range_plan(df, best, TINY, "t")
    placed = df.withColumn("chunk", plan.chunk_id())
    matches = sum((F.when(plan.predicate(i), 1).otherwise(0) for i in range(plan.chunks)), F.lit(0))
    own = F.coalesce(*[F.when(plan.predicate(i), i) for i in range(plan.chunks)])
    rows = placed.select("chunk", matches.alias("n"), own.alias("own")).collect()
    assert len(rows) == 100
    assert all(r["n"] == 1 and r["own"] == r["chunk"] for r in rows)
    histogram = chunk_histogram(df, plan).collect()
    assert sum(r["rows"] for r in histogram) == 100 and len(histogram) == plan.chunks


def test_quantile_plan_balances_skew(spark):
    df = spark.createDataFrame([(i**4,) for i in range(1000)], "k bigint")
    for exact in (True, False):
        plan = ranges.quantile_plan(df, "k", 4, accuracy=100_000, exact=exact)
        counts = [r["rows"] for r in chunk_histogram(df, plan).orderBy("chunk_id").collect()]
        assert sum(counts) == 1000 and max(counts) - min(counts) <= 2


def test_all_null_column_gets_one_chunk_and_empty_table_none(spark):
    rows = [("nulls", None, None, 10, 10), ("empty", None, None, 0, 0)]
    found = ranges.numeric_ranges(profile_rows(spark, rows)).collect()
    assert [(r["table_name"], r["chunk_id"], r["lo"], r["has_nulls"]) for r in found] == [
        ("nulls", 0, None, True)
    ]


def test_best_column_prefers_sequences_then_times(spark):
    df = spark.createDataFrame(
        [(i * 100, i, datetime(2024, 1, 1), i / 2) for i in range(50)],
        "sparse bigint, seq bigint, at timestamp_ntz, part double",
    )
    profile = profile_columns(df, "t")

    def best(frame):
        return best_range_column(frame).first()["column_name"]

    assert best(profile) == "seq"
    assert best(profile.where("column_name <> 'seq'")) == "at"
    assert best(profile.where("column_name NOT IN ('seq', 'at')")) == "sparse"


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS at").write.parquet(path)
    df = spark.read.parquet(path)
    for name in ("id", "at"):
        best = best_range_column(profile_columns(df, "t", [name]), TINY)
        plan = ranges.range_plan(df, best, TINY, "t")
        text = df.where(plan.predicate(1))._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({name}" in text and f"LessThan({name}" in text


def test_sql_predicates():
    plan = ranges.RangePlan("t", 'o"id', "bigint", starts=(10, 20), low=0, step=10, rows=5)
    assert plan.sql_predicates() == [
        '("o""id" < 10) OR "o""id" IS NULL', '"o""id" >= 10 AND "o""id" < 20', '"o""id" >= 20',
    ]
    times = ranges.RangePlan("t", "at", "timestamp_ntz", starts=(1_500_000,), low=0, step=1, rows=5)
    assert times.sql_predicates()[1] == "\"at\" >= TIMESTAMP '1970-01-01 00:00:01.500000'"
    days = ranges.RangePlan("t", "d", "date", starts=(ranges.DAY_MICROS + 1,), rows=5)
    assert days.sql_predicates()[1] == "\"d\" >= DATE '1970-01-03'"
