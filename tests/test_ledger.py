"""Ledger folds: order of events decides, not order of arrival."""

import random
from datetime import datetime, timedelta

from haulage.operators import ledger
from haulage.operators.accounting import final_status, job_summary
from haulage.operators.ledger import EVENT_SCHEMA, JOB_FIELDS, TABLE_FIELDS

START = datetime(2024, 1, 1, 10)
NAMES = list({**JOB_FIELDS, **TABLE_FIELDS})


def events(spark, *rows, shuffle=False):
    """rows: (op, job, table, fields) in event order."""
    out = [
        (i, START + timedelta(minutes=i), op, job, table, tuple(fields.get(n) for n in NAMES))
        for i, (op, job, table, fields) in enumerate(rows)
    ]
    if shuffle:
        random.Random(1).shuffle(out)
    return spark.createDataFrame(out, EVENT_SCHEMA).repartition(3)


def test_table_round_trip(spark):
    log = events(
        spark,
        ("table_start", "test-job-1", "users", {"status": "processing", "row_count": 1000}),
        ("table_complete", "test-job-1", "users", {"rows_processed": 1000}),
    )
    row = ledger.fold_tables(log).first()
    assert (row["status"], row["rows_processed"], row["end_time"]) == (
        "completed", 1000, START + timedelta(minutes=1),
    )


def test_sparse_updates_and_restart(spark):
    log = events(
        spark,
        ("job_update", "a", None, {"rows_processed": 5}),              # before the start: nothing
        ("job_start", "a", None, {"status": "queued", "db_username": "u1", "tables_total": 3}),
        ("job_update", "a", None, {"rows_processed": 10, "status": "running"}),
        ("job_start", "a", None, {"status": "queued", "db_username": "u2"}),
        ("job_update", "a", None, {"progress_percent": 40}),
        shuffle=True,
    )
    row = ledger.fold_jobs(log).first()
    assert (row["status"], row["db_username"], row["tables_total"]) == ("running", "u2", 3)
    assert (row["rows_processed"], row["progress_percent"]) == (10, 40)


def test_finished_jobs_are_not_restarted(spark):
    log = events(
        spark,
        ("job_start", "a", None, {"status": "running", "db_username": "first"}),
        ("job_complete", "a", None, {}),
        ("job_start", "a", None, {"status": "running", "db_username": "second"}),
        ("job_update", "b", None, {"status": "running"}),              # unknown job
        ("job_start", "c", None, {"status": "running"}),
        ("job_fail", "c", None, {"error_message": "lost"}),
        ("job_start", "c", None, {"status": "running", "db_username": "again"}),
        ("job_start", "d", None, {"status": "running"}),
        ("job_update", "d", None, {"status": "completed_with_errors", "overall_status": "completed_with_errors"}),
        ("job_start", "d", None, {"db_username": "late"}),
        shuffle=True,
    )
    rows = {r["job_id"]: r for r in ledger.fold_jobs(log).collect()}
    assert set(rows) == {"a", "c", "d"}
    assert (rows["a"]["overall_status"], rows["a"]["db_username"]) == ("completed", "first")
    assert (rows["c"]["overall_status"], rows["c"]["db_username"]) == ("failed", "again")
    assert rows["d"]["overall_status"] == "completed_with_errors" and rows["d"]["db_username"] is None


def test_failed_then_retried_table(spark):
    log = events(
        spark,
        ("table_start", "j", "t", {"status": "processing", "row_count": 9}),
        ("table_fail", "j", "t", {"error_message": "lost"}),
        ("table_start", "j", "t", {"status": "processing", "row_count": 8}),
        ("table_update", "j", "other", {"rows_processed": 1}),         # never started
    )
    rows = ledger.fold_tables(log).collect()
    assert len(rows) == 1
    assert (rows[0]["status"], rows[0]["error_message"], rows[0]["row_count"]) == ("processing", None, 8)


def test_lookups_on_empty_and_missing(spark):
    log = events(spark, ("job_start", "a", None, {"status": "running"}))
    jobs = ledger.fold_jobs(log)
    wanted = spark.createDataFrame([("a",), ("zzz",), ("a",)], "job_id string")
    found = {r["job_id"]: r["status"] for r in ledger.job_lookup(jobs, wanted).collect()}
    assert found == {"a": "running", "zzz": "not_found"}
    assert ledger.job_history(jobs.limit(0)).collect() == []
    assert ledger.errors_newest_first(ledger.errors_of(log), wanted).collect() == []


def test_summary_and_final_status(spark):
    tables = spark.createDataFrame(
        [("a", "completed", 10, 1.5, True), ("a", "failed", 5, None, False), ("b", "completed", None, 2.0, False)],
        "job_id string, status string, row_count bigint, total_size_mb double, partitioned boolean",
    )
    rows = {r["job_id"]: r for r in job_summary(tables).collect()}
    assert (rows["a"]["completed_percent"], rows["a"]["total_rows"]) == (50.0, 15)
    assert (rows[None]["tables"], rows[None]["total_size_mb"], rows[None]["partitioned_tables"]) == (3, 3.5, 1)
    states = {r["job_id"]: r["overall_status"] for r in final_status(tables).collect()}
    assert states == {"a": "completed_with_errors", "b": "completed"}


def test_latest_status(spark):
    exports = spark.createDataFrame(
        [("j", "a", "failed", 1, 1), ("j", "a", "processing", 2, 2), ("j", "b", "failed", 3, 3), ("j", "c", "odd", 1, 1)],
        "job_id string, table_name string, status string, start_time int, seq int",
    )
    found = {r["table_name"]: r["decision"] for r in ledger.latest_status(exports).collect()}
    assert found == {"a": "processing", "b": "retry", "c": "new"}
