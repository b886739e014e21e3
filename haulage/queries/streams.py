"""Structured Streaming over the events, which arrive in three portions in order of time.

After each portion the stream is started anew on its checkpoint and runs until the input is
used up, so states, windows and claims are carried over batches and restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.scale import micros
from haulage.queries.accounting import at
from haulage.queries.derived import (
    FEED_SQL,
    TABLE_STATE_SQL,
    as_table_events,
    cents,
    shape_feed,
    with_ctes,
)
from haulage.queries.registry import query
from haulage.session import new_dir
from haulage.sources.tables import load
from haulage.streaming import feeds


def in_portions(spark: SparkSession, sf: str, start: Callable[[DataFrame], object], portions: int = 3) -> None:
    """All events, a portion at a time; ``start`` gives a running query over the stream of them."""
    events, folder = load(spark, sf, "events"), new_dir(spark, "stream-events")
    at_us = micros("ts", dict(events.dtypes)["ts"])
    shares = [i / portions for i in range(1, portions)]
    edges = events.agg(F.percentile_approx(at_us, shares)).first()[0] or []
    place = F.lit(0)
    for edge in edges:
        place = place + F.coalesce(at_us > edge, F.lit(False)).cast("int")
    for portion in range(len(edges) + 1):
        events.where(place == portion).write.mode("append").parquet(folder)
        feeds.finish(start(feeds.read_feed(spark, folder, events.schema)))


@query("stream_export", """
SELECT event_type, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS key_sum,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents,
  max(epoch_us(ts)) AS last_at FROM events GROUP BY 1""")
def stream_export(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "stream-export")
    in_portions(spark, sf, lambda events: feeds.stream_export(events, f"{base}/out", f"{base}/state"))
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("event_id").alias("key_sum"),
        F.sum(cents("value")).alias("total_cents"),
        F.max(micros("ts", "timestamp_ntz")).alias("last_at"),
    )


@query("stream_job_state", with_ctes(TABLE_STATE_SQL) + """
SELECT job_id, table_name, status, row_count, rows_processed, chunk_count, started_at, ended_at
FROM table_state""")
def stream_job_state(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "stream-state")
    in_portions(
        spark, sf,
        lambda events: feeds.stream_job_state(
            as_table_events(shape_feed(events)), f"{base}/out", f"{base}/state"
        ),
    )
    return feeds.latest_rows(spark, f"{base}/out", ["job_id", "table_name"]).select(
        "job_id", "table_name", "status", "row_count", "rows_processed", "chunk_count",
        at("start_time").alias("started_at"), at("end_time").alias("ended_at"),
    )


@query("stream_throughput", with_ctes(FEED_SQL) + """
SELECT at_us // 60000000 * 60000000 AS window_start, event_type, CAST(sum(amount) AS BIGINT) AS rows,
  count(*) AS events, CAST(sum(amount) AS BIGINT) / 60 AS rows_per_sec
FROM feed GROUP BY ALL""")
def stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "stream-throughput")
    in_portions(
        spark, sf,
        lambda events: feeds.stream_throughput(
            shape_feed(events), f"{base}/out", f"{base}/state", ["event_type"], rows="amount"
        ),
    )
    latest = feeds.latest_rows(spark, f"{base}/out", ["window_start", "event_type"])
    return latest.withColumn("window_start", F.unix_micros("window_start"))


@query("stream_dedupe", with_ctes(FEED_SQL) + "SELECT DISTINCT job_id, table_name FROM feed")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "stream-dedupe")
    in_portions(
        spark, sf,
        lambda events: feeds.stream_dedupe(
            shape_feed(events).select("job_id", "table_name", "ts"), ["job_id", "table_name"],
            f"{base}/out", f"{base}/state",
        ),
    )
    return spark.read.parquet(f"{base}/out").select("job_id", "table_name")


@query("stream_job_rollup", with_ctes(TABLE_STATE_SQL, """
figures AS (
  SELECT job_id, count(*) AS tables_total, count(*) FILTER (WHERE status = 'completed') AS tables_completed,
    count(*) FILTER (WHERE status = 'failed') AS tables_failed,
    CAST(sum(row_count) AS BIGINT) AS rows_total, CAST(sum(rows_processed) AS BIGINT) AS rows_processed,
    (coalesce(max(ended_at), min(started_at) + 3600000000) - min(started_at)) / 1000000.0::DOUBLE AS seconds
  FROM table_state GROUP BY 1),
rated AS (SELECT *, CASE WHEN seconds > 0 THEN CAST(floor(rows_processed / seconds) AS BIGINT) ELSE 0 END
  AS throughput_rows_per_sec FROM figures)""") + """
SELECT job_id, tables_total, tables_completed, tables_failed, rows_total, rows_processed,
  throughput_rows_per_sec, rows_processed / greatest(rows_total, 1) * 100 AS progress_percent,
  (rows_total - rows_processed) / nullif(throughput_rows_per_sec, 0) AS eta_seconds
FROM rated""")
def stream_job_rollup(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "stream-rollup")
    ended = F.coalesce(at("ended_at"), at("started_at") + F.lit(3_600_000_000))
    seconds = (ended - at("started_at")) / F.lit(1_000_000.0)
    in_portions(
        spark, sf,
        lambda events: feeds.stream_job_rollup(
            as_table_events(shape_feed(events)), f"{base}/tables", f"{base}/jobs", f"{base}/state",
            elapsed=seconds,
        ),
    )
    return feeds.latest_rows(spark, f"{base}/jobs", ["job_id"]).select(
        "job_id", "tables_total", "tables_completed", "tables_failed", "rows_total",
        "rows_processed", "throughput_rows_per_sec", "progress_percent", "eta_seconds",
    )
