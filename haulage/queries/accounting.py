"""Job accounting over the folded ledger and the chunk feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.scale import human_rows, human_seconds, micros
from haulage.operators import accounting, ledger
from haulage.queries.derived import (
    FEED_SQL,
    INVENTORY_SQL,
    TABLE_STATE_SQL,
    as_job_events,
    as_table_events,
    feed,
    inventory,
    with_ctes,
)
from haulage.queries.registry import query
from haulage.sources.tables import load

# Events before the first start count for nothing; starts after the first completion
# that follows it are ignored.
JOB_STATE_SQL = (
    FEED_SQL
    + """,
first AS (SELECT job_id, min(ord) AS s FROM feed WHERE event_type = 'signup' GROUP BY 1),
finished AS (
  SELECT job_id, min(ord) AS e FROM feed JOIN first USING (job_id)
  WHERE event_type = 'purchase' AND ord > s GROUP BY 1),
effective AS (
  SELECT feed.*, s FROM feed JOIN first USING (job_id) LEFT JOIN finished USING (job_id)
  WHERE ord >= s AND NOT (event_type = 'signup' AND ord > coalesce(e, 9223372036854775807))),
job_state AS (
  SELECT job_id,
    coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END, ord)
      FILTER (WHERE event_type IN ('purchase', 'error')), 'running') AS overall_status,
    arg_max('user_' || k, ord) FILTER (WHERE event_type = 'signup') AS db_username,
    max(at_us) FILTER (WHERE event_type = 'signup') AS started_at,
    max(at_us) FILTER (WHERE event_type IN ('purchase', 'error')) AS ended_at,
    arg_max('failed at ' || k, ord) FILTER (WHERE event_type = 'error') AS error_message,
    coalesce(arg_max(k, ord) FILTER (WHERE event_type = 'view'), 0) AS progress_percent,
    coalesce(arg_max(k, ord) FILTER (WHERE event_type = 'signup'), 0) AS tables_total,
    coalesce(arg_max(k // 10, ord) FILTER (WHERE event_type = 'click'), 0) AS tables_completed,
    coalesce(arg_max(amount, ord) FILTER (WHERE event_type = 'view'), 0) AS rows_processed,
    coalesce(arg_max(amount, ord) FILTER (WHERE event_type = 'click'), 0)
      AS throughput_rows_per_sec
  FROM effective GROUP BY 1)"""
)
JOB_COLUMNS = [
    "job_id", "overall_status", "db_username", "started_at", "ended_at", "error_message",
    "progress_percent", "tables_total", "tables_completed", "rows_processed",
    "throughput_rows_per_sec",
]


def at(column: str):
    return micros(column, "timestamp_ntz")


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fold_jobs(as_job_events(feed(spark, sf)))


def table_states(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fold_tables(as_table_events(feed(spark, sf)))


def shown(jobs: DataFrame) -> DataFrame:
    """Times as microseconds."""
    return jobs.withColumns({"started_at": at("start_time"), "ended_at": at("end_time")}).select(
        *JOB_COLUMNS
    )


@query("fold_ledger", with_ctes(JOB_STATE_SQL) + "SELECT * FROM job_state")
def fold_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return shown(job_states(spark, sf))


@query("fold_table_ledger", with_ctes(TABLE_STATE_SQL) + "SELECT * FROM table_state")
def fold_table_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table_states(spark, sf).select(
        "job_id", "table_name", "status", "row_count", "rows_processed", "chunk_count",
        "file_size_mb", at("start_time").alias("started_at"), at("end_time").alias("ended_at"),
        "error_message",
    )


@query("job_history", with_ctes(JOB_STATE_SQL) + """
SELECT * FROM job_state ORDER BY started_at DESC, job_id LIMIT 20""")
def job_history(spark: SparkSession, sf: str) -> DataFrame:
    """The recent 20."""
    return shown(ledger.job_history(job_states(spark, sf), limit=20))


@query("job_history_all", with_ctes(JOB_STATE_SQL) + "SELECT * FROM job_state")
def job_history_all(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ledger.job_history(job_states(spark, sf)))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of suppliers and of event users; not all have a job."""
    suppliers = load(spark, sf, "supplier").select(F.concat(F.lit("job_"), "s_suppkey").alias("job_id"))
    users = load(spark, sf, "customer").select(F.concat(F.lit("job_"), "c_custkey").alias("job_id"))
    return suppliers.unionByName(users)


_WANTED_SQL = """
wanted AS (SELECT 'job_' || s_suppkey AS job_id FROM supplier
  UNION SELECT 'job_' || c_custkey FROM customer)"""


@query("job_lookup", with_ctes(JOB_STATE_SQL, _WANTED_SQL) + """
SELECT job_id, coalesce(overall_status, 'not_found') AS status, started_at, error_message,
  progress_percent FROM wanted LEFT JOIN job_state USING (job_id)""")
def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = ledger.job_lookup(job_states(spark, sf), _wanted(spark, sf))
    return found.select(
        "job_id", "status", at("start_time").alias("started_at"), "error_message",
        "progress_percent",
    )


@query("job_tables", with_ctes(TABLE_STATE_SQL) + """
SELECT job_id, table_name, status, rows_processed FROM table_state
WHERE job_id IN (SELECT 'job_' || s_suppkey FROM supplier)""")
def job_tables(spark: SparkSession, sf: str) -> DataFrame:
    wanted = load(spark, sf, "supplier").select(F.concat(F.lit("job_"), "s_suppkey").alias("job_id"))
    found = ledger.tables_of(table_states(spark, sf), wanted)
    return found.select("job_id", "table_name", "status", "rows_processed")


@query("job_errors", with_ctes(FEED_SQL) + """
SELECT seq, job_id, at_us AS logged_at, 'failed at ' || k AS error_message FROM feed
WHERE event_type = 'error' AND job_id IN (SELECT 'job_' || s_suppkey FROM supplier)""")
def job_errors(spark: SparkSession, sf: str) -> DataFrame:
    events = as_job_events(feed(spark, sf)).withColumn(
        "op", F.when(F.col("op") == "job_fail", "error_log").otherwise(F.col("op"))
    )
    wanted = load(spark, sf, "supplier").select(F.concat(F.lit("job_"), "s_suppkey").alias("job_id"))
    found = ledger.errors_newest_first(ledger.errors_of(events), wanted)
    return found.select("seq", "job_id", at("timestamp").alias("logged_at"), "error_message")


_SUMS = """count(*) AS tables, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'processing') AS processing,
  CAST(sum(row_count) AS BIGINT) AS total_rows, sum(file_size_mb) AS total_size_mb,
  count(*) FILTER (WHERE chunk_count > 1) AS partitioned_tables"""


@query("job_summary", with_ctes(TABLE_STATE_SQL) + f"""
SELECT *, completed / tables * 100 AS completed_percent, failed / tables * 100 AS failed_percent,
  processing / tables * 100 AS processing_percent
FROM (SELECT job_id, {_SUMS} FROM table_state GROUP BY ROLLUP (job_id))""")
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes are quarters of a MB, so their sums are exact."""
    states = table_states(spark, sf).select(
        "job_id", "status", "row_count", F.col("file_size_mb").alias("total_size_mb"),
        (F.col("chunk_count") > 1).alias("partitioned"),
    )
    return accounting.job_summary(states)


@query("chunk_summary", with_ctes(TABLE_STATE_SQL) + """
SELECT job_id, count(*) AS total_tables, CAST(sum(chunk_count) AS BIGINT) AS total_chunks,
  CAST(sum(CASE WHEN status = 'completed' THEN chunk_count ELSE 0 END) AS BIGINT) AS completed_chunks,
  CAST(sum(CASE WHEN status = 'processing' THEN chunk_count ELSE 0 END) AS BIGINT) AS processing_chunks
FROM table_state GROUP BY ROLLUP (job_id)""")
def chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.chunk_summary(table_states(spark, sf))


_TIMED = """
timed AS (SELECT *, (coalesce(ended_at, started_at + 3600000000) - started_at) / 1000000.0::DOUBLE
  AS seconds, chunk_count * 2 AS chunks_planned FROM table_state)"""


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    ended = F.coalesce(at("end_time"), at("start_time") + F.lit(3_600_000_000))
    return table_states(spark, sf).withColumns(
        {
            "seconds": (ended - at("start_time")) / F.lit(1_000_000.0),
            "chunks_planned": F.col("chunk_count") * 2,
        }
    )


@query("throughput_eta", with_ctes(TABLE_STATE_SQL, _TIMED, """
rated AS (SELECT *, CASE WHEN seconds > 0 THEN CAST(floor(rows_processed / seconds) AS BIGINT)
  ELSE 0 END AS rate FROM timed)""") + """
SELECT job_id, table_name, rate AS throughput_rows_per_sec,
  rows_processed / greatest(row_count, 1) * 100 AS progress_percent,
  row_count - rows_processed AS remaining_rows,
  (row_count - rows_processed) / nullif(rate, 0) AS eta_seconds,
  (chunks_planned - chunk_count) * (seconds / nullif(chunk_count, 0)) AS eta_seconds_by_chunks
FROM rated""")
def throughput_eta(spark: SparkSession, sf: str) -> DataFrame:
    figures = accounting.throughput_eta(
        F.col("rows_processed"), F.col("row_count"), F.col("seconds"), F.col("chunk_count"),
        F.col("chunks_planned"),
    )
    return _timed(spark, sf).withColumns(figures).select("job_id", "table_name", *figures)


@query("performance_rating", with_ctes(TABLE_STATE_SQL, _TIMED, """
rated AS (SELECT *, rows_processed * 1000000 AS many,
  coalesce(rows_processed * 1000000 / nullif(seconds, 0), 0.0) AS rate FROM timed)""") + """
SELECT job_id, table_name, rate AS rows_per_sec,
  coalesce(chunk_count / nullif(seconds, 0), 0.0) AS chunks_per_sec,
  coalesce(many / nullif(chunk_count, 0), 0.0) AS rows_per_chunk,
  CASE WHEN rate > 20000 THEN 'excellent' WHEN rate > 10000 THEN 'good' WHEN rate > 5000 THEN 'fair'
    WHEN rate > 1000 THEN 'slow' ELSE 'very slow' END AS rating FROM rated""")
def performance_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in millions, so that all classes occur."""
    figures = accounting.performance_rating(
        F.col("rows_processed") * 1_000_000, F.col("seconds"), F.col("chunk_count")
    )
    return _timed(spark, sf).withColumns(figures).select("job_id", "table_name", *figures)


@query("throughput_hint", with_ctes(TABLE_STATE_SQL, _TIMED, """
rated AS (SELECT *, coalesce(rows_processed * 1000000 / nullif(seconds, 0), 0.0) AS rate,
  CASE WHEN chunk_count > 1 THEN 'DuckDB-Chunked' ELSE 'Polars' END AS method FROM timed)""") + """
SELECT job_id, table_name, method, CASE
  WHEN method = 'Polars' AND rate < 500 THEN 'very slow'
  WHEN method = 'Polars' AND rate < 1000 THEN 'slow'
  WHEN method = 'Polars' AND rate < 2000 THEN 'consider a faster method'
  WHEN method <> 'Polars' AND rate < 2000 THEN 'slower than expected'
  WHEN method <> 'Polars' AND rate > 10000 THEN 'excellent' ELSE '' END AS hint
FROM rated""")
def throughput_hint(spark: SparkSession, sf: str) -> DataFrame:
    """Hints while tables are being exported; rows in millions again."""
    rate = F.coalesce(
        F.col("rows_processed") * 1_000_000 / F.nullif(F.col("seconds"), F.lit(0)), F.lit(0.0)
    )
    method = F.when(F.col("chunk_count") > 1, "DuckDB-Chunked").otherwise("Polars")
    return _timed(spark, sf).withColumn("method", method).select(
        "job_id", "table_name", "method",
        accounting.throughput_hint(rate, F.col("method")).alias("hint"),
    )


@query("final_status", with_ctes(TABLE_STATE_SQL) + """
SELECT job_id, count(*) FILTER (WHERE status = 'completed') AS tables_completed,
  count(*) FILTER (WHERE status = 'failed') AS tables_failed,
  CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'completed'
    ELSE 'completed_with_errors' END AS overall_status
FROM table_state GROUP BY 1""")
def final_status(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.final_status(table_states(spark, sf))


# Some chunks belong to no job; they form a group of their own.
KEYLESS_SQL = """
keyless AS (
  SELECT * REPLACE (CASE WHEN seq % 10 = 3 THEN NULL ELSE job_id END AS job_id) FROM feed)"""


def some_without_job(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("job_id", F.when(F.col("seq") % 10 == 3, None).otherwise(F.col("job_id")))


@query("progress_milestones", with_ctes(FEED_SQL, KEYLESS_SQL) + """
SELECT job_id, seq, done, total, CAST(milestone AS BIGINT) AS milestone FROM (
  SELECT *, least(done * 4 // total, 3) * 25 AS milestone, (done - 1) * 4 // total AS before FROM (
    SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS done,
      count(*) OVER (PARTITION BY job_id) AS total FROM keyless))
WHERE done * 4 // total > before AND before < 3 AND milestone > 0""")
def progress_milestones(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a finished chunk of its job."""
    marks = accounting.progress_milestones(some_without_job(feed(spark, sf)), ["job_id"], ["ts", "seq"])
    return marks.select("job_id", "seq", "done", "total", "milestone")


@query("running_progress", with_ctes(FEED_SQL, KEYLESS_SQL) + """
SELECT job_id, seq, rows_done, chunks_done, rows_done // seconds_done AS throughput,
  chunks_done / total * 100 AS progress_percent FROM (
  SELECT job_id, seq, CAST(sum(amount) OVER w AS BIGINT) AS rows_done, count(*) OVER w AS chunks_done,
    CAST(sum(k + 1) OVER w AS BIGINT) AS seconds_done, count(*) OVER (PARTITION BY job_id) AS total
  FROM keyless WINDOW w AS (PARTITION BY job_id ORDER BY ord ROWS UNBOUNDED PRECEDING))""")
def running_progress(spark: SparkSession, sf: str) -> DataFrame:
    chunks = some_without_job(feed(spark, sf)).withColumn("seconds", (F.col("k") + 1).cast("bigint"))
    done = accounting.running_progress(chunks, ["job_id"], ["ts", "seq"], "amount", "seconds")
    return done.select(
        "job_id", "seq", "rows_done", "chunks_done", "throughput", "progress_percent"
    )


@query("classify_errors", with_ctes(TABLE_STATE_SQL) + """
SELECT 'document ' || doc_id AS source,
  regexp_matches(lower(text), 'connection|timeout|segment|network|temporary') AS retryable,
  regexp_matches(lower(text), 'connection|timeout|segment|network|temporary|ldap|authentication|login|attach|failed to attach|unable to connect|authentication failed') AS retryable_extended
FROM documents
UNION ALL
SELECT job_id || ' ' || table_name, contains(error_message, 'connection'), true FROM table_state
WHERE error_message IS NOT NULL""")
def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents").select(
        F.concat(F.lit("document "), "doc_id").alias("source"), F.col("text").alias("error_message")
    )
    failed = table_states(spark, sf).where(F.col("error_message").isNotNull()).select(
        F.concat_ws(" ", "job_id", "table_name").alias("source"), "error_message"
    )
    return accounting.classify_errors(documents.unionByName(failed)).drop("error_message")


def _human_sql(value: str, steps: list, last: str, first: str) -> str:
    cases = " ".join(
        f"WHEN {value} < {bound} THEN {text}" for bound, text in [(steps[0][0], first)] + [
            (bound, f"format('{{:.1f}}', {value} / {unit}::DOUBLE) || '{mark}'")
            for bound, unit, mark in steps[1:]]
    )
    return f"CASE {cases} ELSE {last} END"


_ROWS = _human_sql(
    "row_count", [(1000, 1, ""), (1000000, 1000, "K"), (1000000000, 1000000, "M")],
    "format('{:.1f}', row_count / 1000000000::DOUBLE) || 'B'", "CAST(row_count AS VARCHAR)")
_SECONDS = _human_sql(
    "s", [(60, 1, ""), (3600, 60, "m")], "format('{:.1f}', s / 3600::DOUBLE) || 'h'",
    "format('{:.1f}', s) || 's'")


@query("humanize", with_ctes(INVENTORY_SQL) + f"""
SELECT table_name, row_count, {_ROWS} AS rows_text, {_SECONDS} AS time_text
FROM (SELECT *, row_count / 70000.0::DOUBLE AS s FROM inventory)""")
def humanize(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("row_count")
    return inventory(spark, sf).select(
        "table_name", "row_count", human_rows(rows).alias("rows_text"),
        human_seconds(rows / F.lit(70_000.0)).alias("time_text"),
    )


@query("slow_chunks", with_ctes(FEED_SQL) + """
SELECT job_id, seq, table_name, k AS seconds FROM feed WHERE k > 30""")
def slow_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = feed(spark, sf).withColumnRenamed("k", "seconds")
    return accounting.slow_chunks(chunks, "seconds").select("job_id", "seq", "table_name", "seconds")


@query("dedupe_status", with_ctes(FEED_SQL) + """
SELECT job_id, table_name, status, CASE status WHEN 'processing' THEN 'processing'
  WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'retry' ELSE 'new' END AS decision
FROM (
  SELECT job_id, table_name, arg_max(CASE event_type WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'processing' END, ord) AS status
  FROM feed GROUP BY ALL)""")
def dedupe_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "completed").when(kind == "error", "failed")
        .when(kind == "view", "queued").otherwise("processing")
    )
    exports = feed(spark, sf).select(
        "job_id", "table_name", status.alias("status"), F.col("ts").alias("start_time"), "seq"
    )
    return ledger.latest_status(exports)
