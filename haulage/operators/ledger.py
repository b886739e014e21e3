"""The job ledger as an append-only event log, folded into the current state.

Every fold is a set of ``max_by``/``min_by`` aggregates, which combine map-side. A job
that owns a third of all events therefore shuffles one row per task, and the order in
which events arrive does not matter: only ``(ts, seq)`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event kinds and final states.
EVENT_KINDS = (
    "job_start", "job_update", "job_complete", "job_fail",
    "table_start", "table_update", "table_complete", "table_fail",
    "error_log", "progress_update", "query", "batch",
)
FINISHED = ("completed", "completed_with_errors")
JOB_FIELDS = {
    "db_username": "string", "status": "string", "overall_status": "string",
    "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "error_message": "string",
    "progress_percent": "int", "tables_total": "int", "tables_completed": "int",
    "tables_failed": "int", "rows_total": "bigint", "rows_processed": "bigint",
    "throughput_rows_per_sec": "bigint",
}
TABLE_FIELDS = {
    "status": "string", "row_count": "bigint", "rows_processed": "bigint",
    "chunk_count": "int", "file_path": "string", "file_size_mb": "double",
    "throughput_rows_per_sec": "bigint", "start_time": "timestamp_ntz",
    "end_time": "timestamp_ntz", "error_message": "string",
}
# What a job or table starts with; everything else starts as NULL.
JOB_DEFAULTS = {
    "progress_percent": 0, "tables_total": 0, "tables_completed": 0, "tables_failed": 0,
    "rows_total": 0, "rows_processed": 0, "throughput_rows_per_sec": 0,
}
TABLE_DEFAULTS = {
    "row_count": 0, "rows_processed": 0, "chunk_count": 1, "file_size_mb": 0.0,
    "throughput_rows_per_sec": 0,
}
# A start on a job that exists but has not finished changes only these.
RESTART_FIELDS = ("db_username", "start_time", "tables_total")
# End of fixed values.

EVENT_SCHEMA = (
    "seq bigint, ts timestamp_ntz, op string, job_id string, table_name string, fields struct<"
    + ", ".join(f"{n}: {t}" for n, t in {**JOB_FIELDS, **TABLE_FIELDS}.items())
    + ">"
)


_ORDER = "struct(ts, seq)"


def _effects(fields: dict[str, str], scope: str) -> dict[str, str]:
    """SQL: what an event sets in each field, with the states its kind implies."""
    out = {}
    for name in fields:
        value = f"fields.{name}"
        if name in ("status", "overall_status"):
            value = (
                f"CASE op WHEN '{scope}_complete' THEN 'completed' "
                f"WHEN '{scope}_fail' THEN 'failed' ELSE {value} END"
            )
        elif name == "end_time":
            value = f"CASE WHEN op IN ('{scope}_complete', '{scope}_fail') THEN coalesce({value}, ts) ELSE {value} END"
        out[name] = value
    return out


def _latest(name: str, value: str, when: str = "true") -> list[Column]:
    """Aggregate: last non-NULL value in event order, with its place in that order.

    One ordered struct instead of a value and a place halves the work.
    """
    pair = f"max(CASE WHEN {when} AND {value} IS NOT NULL THEN struct(ts, seq, {value} AS v) END)"
    return [F.expr(f"{pair} AS {name}")]


def fold_jobs(events: DataFrame) -> DataFrame:
    """Current row of every started job.

    - updates are sparse: each field keeps its last value that was set;
    - events before the first start of a job have nothing to change;
    - a start on an unfinished job refreshes who runs it and since when;
    - a job that has finished is never restarted.
    """
    jobs = events.where("startswith(op, 'job_')")
    effects = _effects(JOB_FIELDS, "job")

    # Pass 1: first start and the latest value of each field over all other events.
    aggregates = [F.expr(f"min(CASE WHEN op = 'job_start' THEN {_ORDER} END) AS _first")]
    for name, value in effects.items():
        aggregates += _latest(f"_u_{name}", value, "op <> 'job_start'")
    summary = jobs.groupBy("job_id").agg(*aggregates).where("_first IS NOT NULL")

    # Pass 2: only starts and finishing events, a small part of the log.
    states = ", ".join(repr(s) for s in FINISHED)
    starts = jobs.where("op = 'job_start'")
    first_start = starts.groupBy("job_id").agg(F.expr(f"min({_ORDER}) AS _first"))
    first_end = (
        jobs.where(f"op <> 'job_start' AND {effects['overall_status']} IN ({states})")
        .selectExpr("job_id", f"{_ORDER} AS _at")
        .join(first_start, "job_id")
        .where("_at > _first")
        .groupBy("job_id")
        .agg(F.expr("min(_at) AS _finished"))
    )
    restarts = [c for n in RESTART_FIELDS for c in _latest(f"_s_{n}", f"fields.{n}")]
    started = (
        starts.join(first_end, "job_id", "left")
        .where(f"_finished IS NULL OR {_ORDER} < _finished")
        .groupBy("job_id")
        .agg(F.expr(f"min_by(fields.status, {_ORDER}) AS _initial"), *restarts)
    )

    columns = []
    for name, dtype in JOB_FIELDS.items():
        # Named structs compare field by field, so (ts, seq) decides.
        in_force = f"CASE WHEN struct(_u_{name}.ts, _u_{name}.seq) > _first THEN _u_{name} END"
        if name in RESTART_FIELDS:
            value = f"greatest({in_force}, _s_{name}).v"
        elif name in ("status", "overall_status"):
            value = f"coalesce(({in_force}).v, _initial, 'queued')"
        else:
            value = f"({in_force}).v"
        if name in JOB_DEFAULTS:
            value = f"coalesce({value}, {JOB_DEFAULTS[name]})"
        columns.append(f"cast({value} AS {dtype}) AS {name}")
    return summary.join(started, "job_id").selectExpr(
        "job_id", *columns, "_first.ts AS created_at"
    )


def table_aggregates() -> list[Column]:
    """The aggregates of :func:`fold_tables`; also usable on a stream."""
    out = [F.expr(f"max(CASE WHEN op = 'table_start' THEN {_ORDER} END) AS _start")]
    for name, value in _effects(TABLE_FIELDS, "table").items():
        out += _latest(f"_u_{name}", value)
    return out


def table_state(aggregated: DataFrame) -> DataFrame:
    """Rows of :func:`table_aggregates` as table states; a start resets the table."""
    columns = []
    for name, dtype in TABLE_FIELDS.items():
        value = f"CASE WHEN struct(_u_{name}.ts, _u_{name}.seq) >= _start THEN _u_{name}.v END"
        if name in TABLE_DEFAULTS:
            value = f"coalesce({value}, {TABLE_DEFAULTS[name]})"
        columns.append(f"cast({value} AS {dtype}) AS {name}")
    return aggregated.where("_start IS NOT NULL").selectExpr(
        "job_id", "table_name", *columns, "_start.ts AS last_start"
    )


def fold_tables(events: DataFrame) -> DataFrame:
    """Current row per (job, table) since its latest start, in one pass over the log."""
    tables = events.where("startswith(op, 'table_')")
    return table_state(tables.groupBy("job_id", "table_name").agg(*table_aggregates()))


def errors_of(events: DataFrame) -> DataFrame:
    """The error list: one row per logged error."""
    return events.where(F.col("op") == "error_log").select(
        "seq", "job_id", F.col("ts").alias("timestamp"), "fields.error_message"
    )


# --- reports over the folded state ---------------------------------------------------


def job_history(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs, newest first; ``limit`` gives the recent ones (a top-k, not a full sort)."""
    ordered = jobs.orderBy(F.desc_nulls_last("start_time"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def job_lookup(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status rows of the wanted jobs; ids without a job come back as ``not_found``."""
    ids = wanted.select("job_id").distinct()
    return ids.join(jobs, "job_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("not_found"))
    )


def tables_of(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    return tables.join(wanted.select("job_id"), "job_id", "left_semi").orderBy(
        "job_id", "table_name"
    )


def errors_newest_first(errors: DataFrame, wanted: DataFrame) -> DataFrame:
    return errors.join(wanted.select("job_id"), "job_id", "left_semi").orderBy(
        "job_id", F.desc("timestamp"), F.desc("seq")
    )


def latest_status(exports: DataFrame) -> DataFrame:
    """Latest status per (job, table) and what it means for taking the table now.

    ``exports(job_id, table_name, status, start_time, seq)``.
    """
    latest = exports.groupBy("job_id", "table_name").agg(
        F.max_by("status", F.struct("start_time", "seq")).alias("status")
    )
    decision = (
        F.when(F.col("status") == "processing", "processing")
        .when(F.col("status") == "completed", "completed")
        .when(F.col("status") == "failed", "retry")
        .otherwise("new")
    )
    return latest.withColumn("decision", decision)
