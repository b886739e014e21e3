"""The progress feed and continuous export as Structured Streaming queries.

All queries run with ``availableNow`` (finish what is there) unless a processing
interval is given. State is one row per job, table or window, never per event.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from haulage.functions.scale import micros
from haulage.operators.accounting import throughput_eta
from haulage.operators.ledger import table_aggregates, table_state
from haulage.policy import ExportOptions, Policy
from haulage.session import scratch, written
from haulage.streaming.state import StateTable


def read_feed(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    """A Parquet folder as a stream; ``path`` may also be a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def table_glob(folder: str, name: str) -> str:
    """Glob for one table of a folder. A plain path to a single file is not accepted by the
    streaming file source, a glob is, and it also matches a directory of that name."""
    return f"{folder}/{name}.parque[t]"


def _with_instant(df: DataFrame) -> DataFrame:
    """Watermarks need an instant; a time without zone is taken as UTC."""
    if dict(df.dtypes)["ts"] != "timestamp_ntz":
        return df
    return df.withColumn("ts", F.timestamp_micros(micros("ts", "timestamp_ntz")))


class Totals(StreamingQueryListener):
    """Adds up every batch of every run; a query itself remembers the last hundred only."""

    def __init__(self):
        self.rows, self.late, self.ended = Counter(), Counter(), {}

    def end_of(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        run, progress = str(event.progress.runId), event.progress
        self.rows[run] += max(0, progress.numInputRows)
        self.late[run] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryTerminated(self, event):
        self.end_of(str(event.runId)).set()


_totals: dict[str, Totals] = {}  # one per application


def _listening(spark: SparkSession) -> Totals:
    application = spark.sparkContext.applicationId
    if application not in _totals:
        _totals[application] = Totals()
        spark.streams.addListener(_totals[application])
    return _totals[application]


def _start(writer, interval: str | None):
    _listening(SparkSession.active())
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def finish(query) -> dict:
    """Wait for the end; returns rows read and rows dropped as too late, over all batches."""
    query.awaitTermination()
    totals, run = _listening(SparkSession.active()), str(query.runId)
    if not totals.end_of(run).wait(60):  # events come in order, the end after all progress
        raise TimeoutError("the query's last events did not arrive")
    return {"rows": totals.rows[run], "late_rows": totals.late[run]}


def stream_export(
    feed: DataFrame, path: str, checkpoint: str,
    options: ExportOptions = ExportOptions(), interval: str | None = None,
):
    """Continuous export into Parquet files; each row is written exactly once."""
    writer = feed.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return _start(writer.options(**options.as_writer_options()), interval)


def _upserts(path: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Keep the changed rows of a micro-batch in a :class:`StateTable`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        StateTable(batch.sparkSession, path, keys).upsert(rows, batch_id)

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each row written by the update queries below."""
    return StateTable(spark, path, keys).read()


def stream_job_state(events: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Live state per (job, table). The fold depends on event order only, so late and
    repeated deliveries of updates cannot reopen a finished table."""
    tables = events.where(F.col("op").startswith("table_"))
    state = tables.groupBy("job_id", "table_name").agg(*table_aggregates())
    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    keys = ["job_id", "table_name"]
    return _start(writer.foreachBatch(_upserts(path, keys, table_state)), interval)


def stream_throughput(
    progress: DataFrame, path: str, checkpoint: str, keys: list[str], rows: str = "rows",
    delay: str = "10 minutes", policy: Policy = Policy(), interval: str | None = None,
):
    """Rows per window of 60 seconds. Rows later than the watermark are dropped and show up
    in :func:`finish`; open windows are written too, and replaced when they grow."""
    seconds = policy.throughput_window_seconds
    window = F.window("ts", f"{seconds} seconds")
    summed = (
        _with_instant(progress).withWatermark("ts", delay)
        .groupBy(window.alias("w"), *keys)
        .agg(F.sum(rows).alias("rows"), F.count(F.lit(1)).alias("events"))
    )
    shaped = summed.select(
        F.col("w.start").alias("window_start"), *keys, "rows", "events",
        (F.col("rows") / seconds).alias("rows_per_sec"),
    )
    writer = shaped.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return _start(writer.foreachBatch(_upserts(path, ["window_start", *keys])), interval)


def stream_dedupe(
    claims: DataFrame, keys: list[str], path: str, checkpoint: str,
    delay: str | None = None, interval: str | None = None,
):
    """Let each table through once. Without ``delay`` a claim is remembered for good (one
    state row per table); with it, for that time after the claim."""
    if delay:
        once = _with_instant(claims).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    else:
        once = claims.dropDuplicates(keys)
    writer = once.writeStream.format("parquet").option("path", path)
    return _start(writer.option("checkpointLocation", checkpoint), interval)


def job_rollup(tables: DataFrame, elapsed) -> DataFrame:
    """Job figures from table states: percent, tables done and failed, rows, ETA."""
    summed = tables.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("tables_total"),
        F.count_if(F.col("status") == "completed").alias("tables_completed"),
        F.count_if(F.col("status") == "failed").alias("tables_failed"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("rows_processed"),
        F.min("start_time").alias("started_at"),
        F.max("end_time").alias("ended_at"),
    )
    timed = summed.withColumn("elapsed_seconds", elapsed)
    figures = throughput_eta(
        F.col("rows_processed"), F.col("rows_total"), F.col("elapsed_seconds"),
        F.col("tables_completed"), F.col("tables_total"),
    )
    return timed.withColumns(
        {n: figures[n] for n in ("throughput_rows_per_sec", "progress_percent", "eta_seconds")}
    )


def stream_job_rollup(
    events: DataFrame, state_path: str, rollup_path: str, checkpoint: str, elapsed,
    interval: str | None = None,
):
    """Table states plus, per tick, the figures of the jobs that changed in it.

    States lie in buckets by job, so a tick reads the buckets of its jobs only, one version
    of each table and a few deltas.
    """
    tables = events.where(F.col("op").startswith("table_"))
    state = tables.groupBy("job_id", "table_name").agg(*table_aggregates())

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = StateTable(spark, state_path, ["job_id", "table_name"], by=["job_id"])
        with scratch(spark):
            changed = written(table_state(batch), "tick")
            touched = states.upsert(changed, batch_id)
            jobs = changed.select("job_id").distinct()
            affected = states.read(touched).join(jobs, "job_id", "left_semi")
            StateTable(spark, rollup_path, ["job_id"]).upsert(job_rollup(affected, elapsed), batch_id)

    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return _start(writer.foreachBatch(write), interval)
