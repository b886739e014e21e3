"""Cells with literal splitters: pages by selection, positions and totals with one shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haulage.operators import cells as c
from haulage.operators import positions as p
from haulage.session import written
from haulage.sinks import export
from haulage.sinks.manifest import read_export


@pytest.fixture
def small(monkeypatch):
    """Many cells on small tables."""
    monkeypatch.setattr(c, "LEAST_ROWS", 40)
    monkeypatch.setattr(p, "BLOCK", 7)


def table(spark, seed=1, rows=3000):
    """One key and one row hold a third each; NULLs, texts with one beginning, and copies."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        kind = i % 3
        if kind == 0:
            out.append(("hot", 7, 7, 0.5))
        elif kind == 1:
            out.append(("hot", rng.randint(0, 9), rng.randint(0, 10**6), -0.5))
        else:
            key = rng.choice([None, "", "a", "é", "x" * 300 + rng.choice("ab"), f"k{rng.randint(0, 400)}"])
            out.append((key, rng.choice([None, 1, 2]), rng.randint(0, 50), float(i)))
    return spark.createDataFrame(out, "k string, a int, n long, d double").repartition(5)


def listed(df, *columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_cells_follow_the_order(spark, small):
    tied = c.with_ties(table(spark))
    cut = c.cells(tied, ["k", "a"])
    assert len(cut.counts) > 20 and sum(cut.counts) == 3000 and cut.copies
    rows = tied.withColumn("cell", cut.cell()).collect()
    key = lambda r: ((r.k is not None, (r.k or "").encode()), (r.a is not None, r.a or 0), r._tie_a, r._tie_b)
    cells = [r["cell"] for r in sorted(rows, key=key)]
    assert cells == sorted(cells)
    assert [cells.count(i) for i in range(len(cut.counts))] == cut.counts


def test_positions_are_gapless_and_ordered(spark, small):
    df = table(spark)
    got = p.with_positions(df, ["k", "a"]).collect()
    assert sorted(r["position"] for r in got) == list(range(3000))
    assert listed(p.with_positions(df, ["k", "a"]), "k", "a", "n", "d") == listed(df, "k", "a", "n", "d")
    key = lambda r: ((r.k is not None, (r.k or "").encode()), (r.a is not None, r.a or 0))
    keys = [key(r) for r in sorted(got, key=lambda r: r["position"])]
    assert keys == sorted(keys)


@pytest.mark.parametrize("order", [["k", "a"], ["a"], ["n", "k"], ["d"]])
def test_pages_equal_positions(spark, small, order):
    df = table(spark)
    whole = {r["position"]: tuple(r) for r in p.with_positions(df, order).collect()}
    for offset, size in [(0, 10), (990, 25), (1500, 1), (2990, 50), (300, 1800), (5000, 5)]:
        got = {r["position"]: tuple(r) for r in p.page(df, order, offset, size, sort_rows=60).collect()}
        assert got == {i: r for i, r in whole.items() if offset <= i < offset + size}


def test_running_totals_beyond_cells(spark, small):
    df = written(table(spark).withColumn("at", F.monotonically_increasing_id()), "numbered")
    copies = df.drop("at").where("n = 7 AND a = 7")
    assert copies.count() > 900
    got = p.running_totals(df, ["k"], ["at"], {"sum": F.col("n"), "seen": F.lit(1).cast("long")}).collect()
    sums, expected = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        done, seen = sums.get(r["k"], (0, 0))
        sums[r["k"]] = expected[r["at"]] = (done + r["n"], seen + 1)
    assert {r["at"]: (r["sum"], r["seen"]) for r in got} == expected
    assert all((r["sum_all"], r["seen_all"]) == sums[r["k"]] for r in got)


def test_running_totals_of_copies(spark, small):
    df = table(spark)
    got = p.running_totals(df, ["k"], ["a", "n", "d"], {"sum": F.col("n"), "seen": F.lit(1).cast("long")}).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(r)
    for rows in by.values():
        assert sorted(r["seen"] for r in rows) == list(range(1, len(rows) + 1))
        done = 0
        for r in sorted(rows, key=lambda r: r["seen"]):
            done += r["n"]
            assert r["sum"] == done
        assert {r["sum_all"] for r in rows} == {done} and {r["seen_all"] for r in rows} == {len(rows)}


def exchanges(df):
    """Shuffles of rows in the plan, told by what they are dealt by."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+\([^,]*|\w+)", text), text


def big(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(400_000).selectExpr("id % 1000 AS k", "id AS v", "repeat('x', 20) AS wide").write.parquet(path)
    return spark.read.parquet(path)


def test_page_plan_has_no_exchange_of_the_table(spark, tmp_path):
    df = big(spark, tmp_path)
    # Everything that the search runs, not only the last plan.
    page = p.page(df, ["k", "v"], 200_000, 100, sort_rows=5_000)
    found, text = exchanges(page)
    assert found == ["SinglePartition"]  # of the rows around the page
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(k", text)
    rows = page.collect()
    assert [r["position"] for r in sorted(rows, key=lambda r: r["position"])] == list(range(200_000, 200_100))
    assert {r["k"] for r in rows} == {500}


def test_paged_export_shuffles_once_and_writes_once(spark, tmp_path, monkeypatch):
    df = big(spark, tmp_path)
    plans, writes = [], []
    monkeypatch.setattr("haulage.session.written", lambda *a: writes.append(a))
    original = export._write
    monkeypatch.setattr(export, "_write", lambda frame, *a, **k: (plans.append(exchanges(frame)[0]), original(frame, *a, **k)))
    path = str(tmp_path / "out")
    metadata = export.export_paged(df, ["k", "v"], 30_000, path, "big")
    assert not writes and len(plans) == 1 and len(plans[0]) == 1
    assert metadata["total_rows"] == 400_000 and metadata["chunk_count"] == 14
    back = read_export(spark, path).groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")
    ).orderBy("chunk_id").collect()
    assert [r["n"] for r in back] == [30_000] * 13 + [10_000]
    assert all(a["high"] <= b["low"] for a, b in zip(back, back[1:]))


def test_a_task_holds_one_cell(spark, tmp_path):
    """Whatever the number of shuffle partitions, which do not grow with the table."""
    tied = c.with_ties(big(spark, tmp_path))
    cut = c.cells(tied, ["v"], target_rows=10_000)
    joined = cut.joined()
    assert sum(joined.counts) == 400_000 and len(joined.counts) < len(cut.counts)
    placed = p.with_positions(tied.select("k", "v", "wide"), ["v"], cut=cut)
    held = {r["part"]: r["count"] for r in placed.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    assert sorted(held.values()) == sorted(joined.counts)
    assert placed.where("position <> v").count() == 0


def test_paged_export_of_copies(spark, small, tmp_path):
    df = table(spark)
    metadata = export.export_paged(df, ["k", "a"], 250, str(tmp_path / "out"), "t")
    back = read_export(spark, str(tmp_path / "out"))
    assert metadata["total_rows"] == 3000
    assert sorted(r["count"] for r in back.groupBy("chunk_id").count().collect()) == [250] * 12
    assert listed(back, "k", "a", "n", "d") == listed(df, "k", "a", "n", "d")


def test_running_totals_plan(spark, tmp_path):
    df = big(spark, tmp_path)
    totals = p.running_totals(df, ["k"], ["v"], {"done": F.lit(1).cast("long")})
    found, text = exchanges(totals)
    wide = [x for x in found if "_cell" in x]
    assert len(wide) == 1, found
    # The others gather sums of the few keys that a splitter lies in.
    assert totals.where("k = 3").agg(F.max("done"), F.max("done_all")).first()[:] == (400, 400)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert p.with_positions(empty, ["k"]).count() == 0
    assert p.page(empty, ["k"], 0, 10).count() == 0
    assert p.running_totals(empty, ["k"], ["v"], {"s": F.col("v")}).count() == 0
    one = spark.createDataFrame([(None, 1)], "k int, v int")
    assert [r["position"] for r in p.page(one, ["k"], 0, 10).collect()] == [0]
