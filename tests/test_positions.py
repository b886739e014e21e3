"""Global positions and running totals, also when one key holds most rows."""

import random

from pyspark.sql import functions as F

from haulage.operators import accounting
from haulage.operators.positions import running_totals, with_positions
from haulage.sources.tables import scan_page


def test_positions_with_copies(spark):
    rng = random.Random(3)
    rows = [(1, "same")] * 400 + [(rng.randint(0, 5), rng.choice("ab")) for _ in range(600)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    placed = with_positions(df, ["k", "v"]).collect()
    assert sorted(r["position"] for r in placed) == list(range(1000))
    assert [(r["k"], r["v"]) for r in sorted(placed, key=lambda r: r["position"])] == sorted(rows)


def test_pages_are_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "k int, v int")
    pages = [scan_page(df, ["k"], start, 30).collect() for start in (0, 30, 60, 90)]
    assert [len(p) for p in pages] == [30, 30, 30, 10]
    assert len({r["v"] for p in pages for r in p}) == 100


def test_running_totals_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 11}", i, rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at int, n int").repartition(5)
    got = running_totals(df, ["k"], ["at"], {"done": F.col("n"), "seen": F.lit(1)}).collect()
    expected, sums = {}, {}
    for key, at, n in rows:
        done, seen = sums.get(key, (0, 0))
        sums[key] = expected[(key, at)] = (done + n, seen + 1)
    assert len(got) == 2000
    for r in got:
        assert (r["done"], r["seen"]) == expected[(r["k"], r["at"])]
        assert (r["done_all"], r["seen_all"]) == sums[r["k"]]


def test_milestones(spark):
    rows = [("one", 0)] + [("four", i) for i in range(4)] + [("ten", i) for i in range(10)]
    df = spark.createDataFrame(rows, "t string, at int")
    marks = accounting.progress_milestones(df, ["t"], ["at"]).collect()
    found = sorted((r["t"], r["at"], r["milestone"]) for r in marks)
    assert found == [
        ("four", 0, 25), ("four", 1, 50), ("four", 2, 75), ("one", 0, 75),
        ("ten", 2, 25), ("ten", 4, 50), ("ten", 7, 75),
    ]


def test_page_of_wide_rows_with_nulls_copies_and_all_types(spark):
    from datetime import date, datetime
    from decimal import Decimal

    rng = random.Random(9)
    rows = [
        (
            rng.choice([None, 1, 1, 1, 2]), rng.choice([None, 0.1, -0.5, float("nan")]),
            datetime(2024, 10, 27, rng.randint(0, 3), 30), date(2024, 1, rng.randint(1, 3)),
            Decimal("1.50") * rng.randint(1, 2), rng.choice(["it's", "b", None]), bytes([rng.randint(0, 2)]),
        )
        for _ in range(300)
    ] + [(1, 0.1, datetime(2024, 1, 1), date(2024, 1, 1), Decimal("1.50"), "copy", b"c")] * 150
    df = spark.createDataFrame(
        rows, "a int, b double, c timestamp, d date, e decimal(9,2), f string, g binary"
    )
    from haulage.session import written

    df = written(df.repartition(4), "wide")
    order = ["a", "b", "c", "d", "e", "f", "g"]
    whole = with_positions(df, order).selectExpr("position", "to_json(struct(*)) AS j")
    expected = {r["position"]: r["j"] for r in whole.collect()}
    for offset, size in [(0, 50), (40, 200), (440, 100), (449, 1), (450, 10), (200, 1)]:
        rows = scan_page(df, order, offset, size).selectExpr("position", "to_json(struct(*)) AS j").collect()
        assert {r["position"]: r["j"] for r in rows} == {
            p: j for p, j in expected.items() if offset <= p < offset + size
        }
        assert len(rows) == len({r["position"] for r in rows})


def test_rows_without_a_key_are_a_group(spark):
    from haulage.operators.accounting import running_progress

    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("j", 1, 7)], "job string, seq int, n long")
    got = running_progress(rows, ["job"], ["seq"], "n", "n").collect()
    assert sorted((str(r["job"]), r["rows_done"], r["chunks_done_all"]) for r in got) == [
        ("None", 5, 2), ("None", 11, 2), ("j", 7, 1),
    ]
