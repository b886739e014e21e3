"""Streams over several micro-batches, with events out of order, repeated and late."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from haulage.operators.ledger import fold_tables
from haulage.streaming import feeds
from test_ledger import START, events


def in_batches(spark, frames, folder):
    """One file per frame, read one per micro-batch, oldest first."""
    import os

    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        fresh = [p for p in folder.iterdir() if p.name.startswith("part-")]
        for p in fresh:
            target = folder / f"b{i}.parquet"
            p.rename(target)
            os.utime(target, (1_700_000_000 + i * 60,) * 2)
    return feeds.read_feed(spark, str(folder), frames[0].schema, files_per_batch=1)


def test_state_ignores_the_order_of_arrival(spark, tmp_path):
    log = events(
        spark,
        ("table_start", "j", "t", {"status": "processing", "row_count": 100}),
        ("table_update", "j", "t", {"rows_processed": 40}),
        ("table_complete", "j", "t", {"rows_processed": 100}),
        ("table_start", "j", "u", {"status": "processing"}),
        ("table_update", "j", "u", {"rows_processed": 7}),
    )
    frames = [log.where(f"seq IN ({ids})") for ids in ("2, 3", "1, 4", "0", "1, 2")]  # last: repeats
    feed = in_batches(spark, frames, tmp_path / "in")
    feeds.finish(feeds.stream_job_state(feed, str(tmp_path / "out"), str(tmp_path / "cp")))
    live = feeds.latest_rows(spark, str(tmp_path / "out"), ["job_id", "table_name"])
    batch = fold_tables(log)
    assert sorted(live.select(batch.columns).collect()) == sorted(batch.collect())
    assert {r["table_name"]: r["status"] for r in live.collect()} == {"t": "completed", "u": "processing"}


def test_rollup_follows_the_states(spark, tmp_path):
    log = events(
        spark,
        ("table_start", "j", "t", {"status": "processing", "row_count": 100}),
        ("table_start", "j", "u", {"status": "processing", "row_count": 300}),
        ("table_complete", "j", "t", {"rows_processed": 100}),
        ("table_fail", "j", "u", {"error_message": "x"}),
    )
    feed = in_batches(spark, [log.where("seq < 2"), log.where("seq >= 2")], tmp_path / "in")
    feeds.finish(
        feeds.stream_job_rollup(
            feed, str(tmp_path / "t"), str(tmp_path / "j"), str(tmp_path / "cp"), elapsed=F.lit(10.0)
        )
    )
    row = feeds.latest_rows(spark, str(tmp_path / "j"), ["job_id"]).first()
    assert (row["tables_total"], row["tables_completed"], row["tables_failed"]) == (2, 1, 1)
    assert (row["rows_processed"], row["progress_percent"], row["throughput_rows_per_sec"]) == (100, 25.0, 10)


def ticks(spark, *rows):
    out = [(START + timedelta(seconds=s), key, n) for s, key, n in rows]
    return spark.createDataFrame(out, "ts timestamp_ntz, job_id string, rows bigint")


def test_windows_and_late_rows(spark, tmp_path):
    frames = [
        ticks(spark, (0, "a", 10), (59, "a", 20), (60, "a", 5)),
        ticks(spark, (30, "a", 1), (3600, "a", 7)),       # 30 s: late but within the delay
        ticks(spark, (3700, "a", 2)),                     # moves the watermark past the first hour
        ticks(spark, (10, "a", 1000), (3710, "a", 3)),    # 10 s: too late
    ]
    feed = in_batches(spark, frames, tmp_path / "in")
    told = feeds.finish(
        feeds.stream_throughput(
            feed, str(tmp_path / "out"), str(tmp_path / "cp"), ["job_id"], delay="10 minutes"
        )
    )
    found = feeds.latest_rows(spark, str(tmp_path / "out"), ["window_start", "job_id"])
    got = {
        (r["at"] - int((START - datetime(1970, 1, 1)).total_seconds())): r["rows"]
        for r in found.selectExpr("unix_seconds(window_start) AS at", "rows").collect()
    }
    assert got == {0: 31, 60: 5, 3600: 7, 3660: 5}
    assert told == {"rows": 8, "late_rows": 1}


def test_each_table_is_taken_once(spark, tmp_path):
    frames = [ticks(spark, (0, "a", 1), (1, "b", 1), (2, "a", 1)), ticks(spark, (9000, "a", 1), (9001, "c", 1))]
    feed = in_batches(spark, frames, tmp_path / "in")
    feeds.finish(feeds.stream_dedupe(feed, ["job_id"], str(tmp_path / "o"), str(tmp_path / "cp")))
    assert sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b", "c"]
    feeds.finish(
        feeds.stream_dedupe(feed, ["job_id"], str(tmp_path / "o2"), str(tmp_path / "cp2"), delay="1 minute")
    )
    assert spark.read.parquet(str(tmp_path / "o2")).count() >= 3


def test_export_continues_where_it_stopped(spark, tmp_path):
    first = ticks(spark, (0, "a", 1), (1, "b", 2))
    feed = in_batches(spark, [first], tmp_path / "in")
    paths = str(tmp_path / "out"), str(tmp_path / "cp")
    assert feeds.finish(feeds.stream_export(feed, *paths))["rows"] == 2
    ticks(spark, (2, "c", 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = feeds.read_feed(spark, str(tmp_path / "in"), first.schema)
    feeds.finish(feeds.stream_export(again, *paths))
    assert sorted(r["job_id"] for r in spark.read.parquet(paths[0]).collect()) == ["a", "b", "c"]


def test_totals_cover_more_batches_than_a_query_remembers(spark, tmp_path):
    folder = tmp_path / "many"
    for i in range(110):
        spark.range(3).coalesce(1).write.mode("append").parquet(str(folder))
    feed = feeds.read_feed(spark, str(folder), "id long", files_per_batch=1)
    told = feeds.finish(feeds.stream_export(feed, str(tmp_path / "to"), str(tmp_path / "at")))
    assert told["rows"] == 330
