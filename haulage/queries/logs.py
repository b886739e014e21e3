"""Log questions over lines rendered from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.scale import micros
from haulage.operators import logs
from haulage.queries.derived import LOG_SQL, log_lines, with_ctes
from haulage.queries.registry import query
from haulage.session import new_dir


@query("parse_logs", with_ctes(LOG_SQL) + """
SELECT line_no, epoch_us(date_trunc('second', ts)) AS logged_at,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  job_id, CASE WHEN event_type <> 'signup' THEN table_name END AS table_name,
  CASE WHEN event_type <> 'signup' THEN CAST(k AS DOUBLE) END AS progress_percent,
  CASE WHEN event_type <> 'signup' THEN k || '/100' END AS chunks,
  CASE WHEN event_type <> 'signup' THEN 'range_chunking' END AS method, '1/16' AS connections,
  amount || '.5MB' AS memory, CAST(NULL AS VARCHAR) AS circuit,
  regexp_extract(value, 'MB\\] (.*)$', 1) AS message
FROM feed JOIN log_lines ON seq = line_no""")
def parse_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_logs(log_lines(spark, sf)).select(
        "line_no", micros("logged_at", "timestamp_ntz").alias("logged_at"), "level", "job_id",
        "table_name", "progress_percent", "chunks", "method", "connections", "memory", "circuit",
        "message",
    )


@query("read_logs", with_ctes(LOG_SQL) + """
SELECT value AS line, count(*) AS lines FROM log_lines GROUP BY 1""")
def read_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines as text files, read line by line."""
    path = new_dir(spark, "logs")
    log_lines(spark, sf).select("value").write.text(path)
    return logs.read_log_lines(spark, path).groupBy(F.col("value").alias("line")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("tail_logs", with_ctes(LOG_SQL) + """
SELECT * FROM log_lines ORDER BY line_no DESC LIMIT 100""")
def tail_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tail_logs(log_lines(spark, sf), 100)


@query("tail_job_logs", with_ctes(LOG_SQL) + """
SELECT * FROM log_lines WHERE contains(value, 'job_7') ORDER BY line_no DESC LIMIT 50""")
def tail_job_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The job filter is a plain text search, so job_7 also finds job_71."""
    return logs.tail_logs(log_lines(spark, sf), 50, job_id="job_7")


@query("tail_totals", with_ctes(LOG_SQL) + """
SELECT count(*) AS total_lines, count(*) FILTER (WHERE contains(value, 'job_7')) AS matching_lines,
  least(count(*) FILTER (WHERE contains(value, 'job_7')), 50) AS showing FROM log_lines""")
def tail_totals(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tail_totals(log_lines(spark, sf), 50, job_id="job_7")


_PATTERNS = {
    "chunk": "chunk|partition|split|part_\\d+|chunks_|processing chunk",
    "processing": "processing|export|write|read|starting|completed|finished",
    "export": "export|parquet|file|save|table.*rows|successfully exported",
    "error": "error|exception|failed|traceback|critical|warning",
    "polars": "polars|dataframe|lazy|read_database|write_parquet",
}


@query("filter_logs", with_ctes(LOG_SQL) + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS category, line_no, value FROM log_lines "
    f"WHERE regexp_matches(value, '{pattern}', 'i')" for name, pattern in _PATTERNS.items()))
def filter_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.categorized_logs(log_lines(spark, sf)).select("category", "line_no", "value")


@query("log_severity", with_ctes(LOG_SQL) + """
SELECT severity, job_id, count(*) AS lines FROM (
  SELECT CASE WHEN regexp_matches(value, 'ERROR|CRITICAL|Failed|Exception', 'i') THEN 'error'
    WHEN regexp_matches(value, 'WARNING|Warning', 'i') THEN 'warning'
    WHEN regexp_matches(value, 'SUCCESS|completed|successfully|finished', 'i') THEN 'info'
    ELSE 'none' END AS severity, regexp_extract(value, '\\[JOB:([^\\]]*)\\]', 1) AS job_id
  FROM log_lines) GROUP BY ALL""")
def log_severity(spark: SparkSession, sf: str) -> DataFrame:
    parsed = logs.parse_logs(log_lines(spark, sf))
    return parsed.groupBy(logs.log_severity(F.col("value")).alias("severity"), "job_id").agg(
        F.count(F.lit(1)).alias("lines")
    )
