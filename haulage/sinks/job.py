"""A whole export job: profile, choose, export, verify, publish, account; table by table.

A table goes through the states planned, staged, verified, published and archived, which the
ledger keeps as its status until it is completed. What a state stands for lies on disk as
well, so a job that was cut short is taken up where it stopped.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators.ledger import EVENT_SCHEMA, JOB_FIELDS, TABLE_FIELDS, fold_tables, latest_status
from haulage.operators.profile import best_range_column, profile_columns, rangeable_columns
from haulage.operators.resume import existing_exports
from haulage.operators.verify import verify_export
from haulage.plans.layout import FIRST_VERSION, export_layout
from haulage.plans.methods import CURSOR, DIRECT, RANGES, plan_methods
from haulage.plans.ranges import range_plan
from haulage.policy import ExportOptions, Policy
from haulage.session import path_exists, remove, write_text, written
from haulage.sinks.export import export_paged, export_ranges, export_single, export_sized
from haulage.sinks.manifest import load_metadata
from haulage.sinks.publish import archive_summary, publish
from haulage.sinks.resumable import resume_export, stored_plan


class Ledger:
    """Appends events as small JSON files; reads them back as the event log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._seq, self._lock = 0, threading.Lock()

    def record(self, op: str, job_id: str, table: str | None = None, **fields) -> None:
        known = {**JOB_FIELDS, **TABLE_FIELDS}
        unknown = set(fields) - set(known)
        if unknown:
            raise ValueError(f"unknown ledger fields: {sorted(unknown)}")
        with self._lock:
            self._seq += 1
            seq, now = self._seq, _now()
        event = {
            "seq": seq, "ts": now, "op": op, "job_id": job_id, "table_name": table,
            "fields": fields,
        }
        name = f"{job_id}-{seq:08d}-{uuid.uuid4().hex[:8]}.json"
        write_text(self.spark, f"{self.path}/{name}", json.dumps(event, default=str))

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).json(self.path)


def export_table(
    df: DataFrame, table: str, path: str, *, db_type: str = "postgresql",
    policy: Policy = Policy(), options: ExportOptions = ExportOptions(),
    order: list[str] | None = None, job_id: str | None = None, waves: int | None = None,
    told: Callable[..., None] | None = None, steered: bool = False,
) -> dict:
    """Choose the method from the table's profile and export it. Returns the metadata.

    ``steered`` builds range plans from the parameters that the method choice gives, rows per
    chunk above all; limits that the policy states itself come first. Without it the
    policy's tiers decide.

    With ``waves`` a range export keeps a chunk ledger, and one that was cut short under the
    same plan is taken up; anything else that lies at ``path`` unsealed is removed first.
    ``told(**fields)`` hears of the plan and of finished waves.
    """
    spark = df.sparkSession
    best = None
    if rangeable_columns(df):
        best = written(best_range_column(profile_columns(df, table), policy), "best-column")  # one row
    plan = range_plan(df, best, policy, table) if best is not None else None
    rows = plan.rows if plan else df.count()
    decision = plan_methods(
        spark.createDataFrame(
            [(table, rows, plan is not None, db_type.lower() in ("postgresql", "greenplum"), db_type)],
            "table_name string, row_count bigint, has_suitable_range_column boolean, "
            "supports_cursors boolean, db_type string",
        ),
        policy,
    ).first()
    method = decision["method"]
    if steered and method == RANGES and policy.rows_in_chunk() is None:
        plan = range_plan(df, best, replace(policy, chunk_rows=decision["chunk_rows"]), table)
    if waves:
        ranged = method == RANGES
        if not (ranged and stored_plan(spark, path) == json.loads(json.dumps(plan.as_dict()))):
            remove(spark, path)
    if told:
        told(status="planned", row_count=rows, chunk_count=plan.chunks if method == RANGES else 1)
    if method == DIRECT and rows <= policy.single_file_rows:
        return export_single(df, path, table, rows, options, policy, job_id)
    if method == RANGES and waves:
        done = [0]

        def on_wave(_: list[int], written: int) -> None:
            done[0] += written
            if told:
                told(rows_processed=done[0])

        return resume_export(df, plan, path, options, policy, waves, job_id, on_wave)
    if method == RANGES:
        return export_ranges(df, plan, path, options, job_id=job_id, policy=policy)
    if method in (CURSOR, DIRECT):
        return export_sized(df, path, table, rows, options=options, policy=policy, job_id=job_id)
    return export_paged(
        df, order or df.columns[:1], decision["chunk_rows"], path, table, options, job_id
    )


class Damaged(Exception):
    """An export that failed its check."""


def _checked(spark: SparkSession, path: str, metadata: dict) -> None:
    """Every listed file must be there, readable, and hold the listed rows."""
    bad = verify_export(spark, path).where("outcome NOT IN ('ok', 'empty')")
    found = bad.select("file_path", "outcome").limit(5).collect()
    if found:
        named = ", ".join(f"{r['file_path']} ({r['outcome']})" for r in found)
        raise Damaged(f"{metadata['table_name']}: {named}")


def _versions(spark: SparkSession, final: str):
    """Sealed exports under a final name: the name itself, then its versions."""
    path, version = final, FIRST_VERSION
    while path_exists(spark, path):
        metadata = load_metadata(spark, path)
        if metadata is not None:
            yield path, metadata
        path, version = f"{final}_v{version}", version + 1


def _existing(spark: SparkSession, final: str, table: str, rows: int) -> str | None:
    """A complete export of as many rows under any version of the name."""
    found = list(_versions(spark, final))
    if not found:
        return None
    kinds = "table_name string, total_rows bigint, status string"
    manifests = spark.createDataFrame([(m["table_name"], m["total_rows"], m["status"]) for _, m in found], kinds)
    wanted = spark.createDataFrame([(table, rows)], "table_name string, row_count bigint")
    if not existing_exports(wanted, manifests).count():
        return None
    return next(p for p, m in found if m["table_name"] == table and m["total_rows"] == rows)


def export_job(
    spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], base: str, ledger: Ledger, *,
    job_id: str | None = None, username: str | None = None, policy: Policy = Policy(),
    options: ExportOptions = ExportOptions(), db_type: str = "postgresql", concurrent: int = 4,
    exporter: Callable[[str, str, str], dict] | None = None, waves: int = 4,
    final: str | None = None, strategy: str = "clean_with_archive", conflict: str = "version",
    skip_existing: bool = False, on_event: Callable[[str, dict], None] | None = None,
    steered: bool = False,
) -> str:
    """Export many tables; one that fails is recorded and the others go on.

    Each table is staged below ``base/job_id``, checked file by file, and, if ``final`` names
    a folder, published under the name that ``strategy`` gives it, by the ``conflict`` rule,
    with one line in the job's archive. ``skip_existing`` passes over tables of which a
    complete export with as many rows is published already.

    A second run under the same ``job_id`` takes every table up where it stopped: completed
    ones are left alone, sealed ones are checked and published, of a range export only the
    missing chunks are written, and anything else is started again. An export that fails
    its check is removed, so that the next run makes it anew.

    ``tables`` maps a name to a function that opens it. A few tables run at a time, so that
    the planning and the last tasks of one leave no executors idle. ``exporter(name, path,
    job_id)`` replaces the default way to export one table. ``on_event(table, fields)`` hears
    of every change of a table; an error that it raises ends the table.
    """
    job_id = job_id or uuid.uuid4().hex
    staged = {name: f"{base}/{job_id}/{table_folder(name)}" for name in tables}
    finals, archive = _final_paths(spark, list(tables), final, job_id, strategy)

    def told(name: str, **fields) -> None:
        ledger.record("table_update", job_id, name, **fields)
        if on_event:
            on_event(name, fields)

    def stage(name: str) -> dict:
        path = staged[name]
        metadata = load_metadata(spark, path)
        if metadata is None and exporter:
            remove(spark, path)
            metadata = exporter(name, path, job_id)
        elif metadata is None:
            metadata = export_table(
                tables[name](), name, path, db_type=db_type, policy=policy, options=options,
                job_id=job_id, waves=waves, steered=steered, told=lambda **fields: told(name, **fields),
            )
        told(name, status="staged", rows_processed=metadata["total_rows"], file_path=path)
        return metadata

    def finish(name: str) -> tuple[dict, str]:
        """From wherever the table stands to its last state."""
        ended = published(name)
        if ended is None and skip_existing and final:
            path = _existing(spark, finals[name], name, tables[name]().count())
            ended = None if path is None else (load_metadata(spark, path), path)
        if ended is None:
            metadata, path = stage(name), staged[name]
            try:
                _checked(spark, path, metadata)
            except Damaged:
                remove(spark, path)
                raise
            told(name, status="verified")
            if final is None:
                return metadata, path
            ended = metadata, publish(spark, path, finals[name], conflict)["final_path"]
        if final is not None:
            told(name, status="published", file_path=ended[1])
            line = {"job_id": job_id, "table_name": name, "final_path": ended[1], "was_renamed": ended[1] != finals[name], "error": None}
            write_text(spark, f"{archive}/{job_id}/tables/{table_folder(name)}.json", json.dumps(line))
            told(name, status="archived")
        return ended

    def published(name: str) -> tuple[dict, str] | None:
        """What an earlier run of this job has published of the table."""
        if final is None:
            return None
        for path, metadata in _versions(spark, finals[name]):
            if metadata["job_id"] == job_id and metadata["table_name"] == name:
                return metadata, path
        return None

    completed = _completed(ledger, job_id, tables)
    if tables and len(completed) == len(tables):
        return job_id
    ledger.record(
        "job_start", job_id, db_username=username, status="running", overall_status="running",
        tables_total=len(tables), start_time=_now(),
    )
    lock, figures = threading.Lock(), {
        "done": len(completed), "failed": 0, "rows": sum(completed.values()),
    }

    def run(name: str) -> None:
        ledger.record("table_start", job_id, name, status="processing", start_time=_now())
        try:
            metadata, path = finish(name)
        except Exception as error:
            message = str(error)
            ledger.record("table_fail", job_id, name, error_message=message)
            ledger.record("error_log", job_id, name, error_message=message)
            with lock:
                figures["failed"] += 1
            return
        ledger.record(
            "table_complete", job_id, name, rows_processed=metadata["total_rows"],
            row_count=metadata["total_rows"], chunk_count=metadata["chunk_count"], file_path=path,
            file_size_mb=metadata["total_bytes"] / 1024 / 1024,
        )
        with lock:
            figures["done"] += 1
            figures["rows"] += metadata["total_rows"]
            ledger.record(
                "job_update", job_id, tables_completed=figures["done"],
                rows_processed=figures["rows"],
                progress_percent=int(figures["done"] / len(tables) * 100),
            )

    with ThreadPoolExecutor(max_workers=max(1, concurrent)) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), [name for name in tables if name not in completed]))

    if final is not None and path_exists(spark, f"{archive}/{job_id}/tables"):
        lines = spark.read.schema(_LINE).json(f"{archive}/{job_id}/tables")
        summary = archive_summary(lines).withColumns(
            {"strategy": F.lit(strategy), "conflict_resolution": F.lit(conflict)}
        )
        summary.coalesce(1).write.mode("overwrite").json(f"{archive}/{job_id}/summary")  # one row
    state = "completed" if figures["failed"] == 0 else "completed_with_errors"
    ledger.record(
        "job_update", job_id, status=state, overall_status=state, progress_percent=100,
        tables_completed=figures["done"], tables_failed=figures["failed"], end_time=_now(),
    )
    return job_id


_LINE = "job_id string, table_name string, final_path string, was_renamed boolean, error string"


def _final_paths(
    spark: SparkSession, names: list[str], final: str | None, job_id: str, strategy: str
) -> tuple[dict[str, str], str | None]:
    if final is None or not names:
        return {}, None
    listed = spark.createDataFrame([(n, job_id) for n in names], "table_name string, job_id string")
    rows = export_layout(listed, final, strategy).collect()  # one per table
    return {r["table_name"]: r["final_path"] for r in rows}, rows[0]["archive_path"]


def _completed(ledger: Ledger, job_id: str, tables: dict) -> dict[str, int]:
    """Rows of the tables that an earlier run has completed and whose export is still there."""
    if not path_exists(ledger.spark, ledger.path):
        return {}
    events = ledger.events().where(F.col("job_id") == job_id)
    states = latest_status(fold_tables(events).withColumn("seq", F.lit(0)))
    rows = fold_tables(events).select("job_id", "table_name", "file_path").join(
        states.where("decision = 'completed'"), ["job_id", "table_name"]
    ).collect()  # one per table of the job
    found = {r["table_name"]: load_metadata(ledger.spark, r["file_path"]) for r in rows if r["table_name"] in tables}
    return {name: m["total_rows"] for name, m in found.items() if m is not None}


def table_folder(name: str) -> str:
    """A folder name that stands for one table only; ``unquote`` gives the table back.

    It is always the name of one visible folder: a leading dot or underscore is escaped, and
    a table without a name is refused.
    """
    if not name:
        raise ValueError("a table needs a name")
    folder = quote(name, safe="")
    if folder[0] in "._":
        folder = f"%{ord(folder[0]):02X}{folder[1:]}"
    return folder


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
