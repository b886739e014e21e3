"""Export jobs straight from a database, described by a job configuration."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from haulage.operators.profile import best_range_column
from haulage.plans.methods import CURSOR_DIALECTS, RANGES, plan_methods
from haulage.plans.ranges import RangePlan, range_plan
from haulage.policy import ExportOptions, Policy
from haulage.session import child_names, filesystem, remove, rename, written
from haulage.sinks.export import export_capped, export_single, rows_per_file
from haulage.sinks.job import Ledger, export_job
from haulage.sinks.manifest import CHUNK, write_manifest
from haulage.sources import catalog, jdbc

# Fields a configuration must have.
REQUIRED_FIELDS = ("db_type", "db_host", "db_port", "db_username", "db_password")


@dataclass(frozen=True)
class TableRequest:
    """One table of a configuration."""

    name: str
    where_clause: str | None = None
    chunk_rows: int | None = None
    connections: int | None = None

    @property
    def source(self) -> str:
        """What stands after FROM."""
        if not self.where_clause:
            return self.name
        return f"(SELECT * FROM {self.name} WHERE {self.where_clause}) filtered"

    @classmethod
    def parse(cls, entry: str | dict) -> "TableRequest":
        """From a plain name, or an entry with schema, table, condition and chunk settings."""
        if isinstance(entry, str):
            return cls(entry)
        override = entry.get("chunk_override") or {}
        return cls(
            f"{entry.get('schema', 'public')}.{entry['table']}",
            entry.get("where_clause"),
            override.get("chunk_size"),
            override.get("chunk_workers"),
        )


def database_from(config: dict) -> jdbc.Database:
    missing = [name for name in REQUIRED_FIELDS if not config.get(name)]
    if missing:
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    return jdbc.Database(
        config["db_type"], config["db_host"], config["db_username"], config["db_password"],
        int(config["db_port"]), config.get("db_name"),
    )


def discover(spark: SparkSession, db: jdbc.Database) -> DataFrame:
    """All user tables, sorted."""
    tables = jdbc.read_query(spark, db, jdbc.catalog_query(db.db_type, "tables"))
    return catalog.catalog_tables(tables, db.db_type)


@dataclass(frozen=True)
class Unit:
    """What one task reads over one connection: a chunk, or a part of one."""

    chunk: int
    predicate: str


def planned_units(
    spark: SparkSession, db: jdbc.Database, source: str, plan: RangePlan, second: list[str], limit: int
) -> list[Unit]:
    """The chunks of a plan; one with more than twice ``limit`` rows is split further.

    A value that fills a chunk cannot be split by its own column, so the next columns of
    ``second`` are tried inside the chunk, in equal steps between their extremes there. The
    database counts; no rows are read. A chunk that no column splits stays whole.
    """
    counted = jdbc.read_query(spark, db, jdbc.chunk_counts_query(source, plan))
    rows = {r["chunk_id"]: r["row_count"] for r in counted.collect()}  # a row per chunk
    units = []
    for chunk, predicate in enumerate(plan.sql_predicates()):
        parts = [predicate]
        if rows.get(chunk, 0) > 2 * limit:
            wanted = -(-rows[chunk] // limit)
            for column in second:
                low, high, _ = jdbc.read_query(spark, db, jdbc.bounds_query(source, column, predicate)).first()
                inner = _steps(column, low, high, wanted)
                if len(inner) > 1:
                    parts = [f"({predicate}) AND ({p})" for p in inner]
                    break
        units.extend(Unit(chunk, p) for p in parts)
    return units


def _steps(column: str, low: int | None, high: int | None, wanted: int) -> list[str]:
    """Conditions that part a whole-number column into equal steps; NULLs go to the first."""
    if low is None or high == low:
        return []
    step = max(1, -(-(high - low + 1) // wanted))
    starts = tuple(range(low + step, high + 1, step))
    return RangePlan("part", column, "bigint", starts, low, step).sql_predicates()


def export_units(
    spark: SparkSession, db: jdbc.Database, source: str, units: list[Unit], path: str,
    options: ExportOptions, connections: int, rows: int | None = None,
) -> None:
    """Read and write each unit as a job of its own, ``connections`` of them at a time.

    Rows are written as they come: no shuffle, and no sort, since a unit belongs to one chunk.
    A finished unit's files are moved into its chunk's folder; after a failure the others
    finish, and the first error is raised.
    """

    def run(numbered: tuple[int, Unit]) -> None:
        number, unit = numbered
        draft, chunk = f"{path}/_units/{number}", f"{path}/{CHUNK}={unit.chunk}"
        read = jdbc.read_unit(spark, db, source, unit.predicate, rows)
        read.write.options(**options.as_writer_options()).mode("overwrite").parquet(draft)
        fs, folder = filesystem(spark, chunk)
        fs.mkdirs(folder)
        for name in child_names(spark, draft):
            if name.endswith(".parquet"):
                rename(spark, f"{draft}/{name}", f"{chunk}/unit-{number:06d}-{name}")
        remove(spark, draft)

    with ThreadPoolExecutor(max_workers=max(1, connections)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(run), x) for x in enumerate(units)]
    for future in done:
        future.result()
    remove(spark, f"{path}/_units")


def export_database_table(
    spark: SparkSession,
    db: jdbc.Database,
    request: TableRequest,
    path: str,
    policy: Policy = Policy(),
    options: ExportOptions = ExportOptions(),
    connections: int | None = None,
    job_id: str | None = None,
) -> dict:
    """Profile in the database, then read one query per chunk, each written as it comes.

    Rows per chunk and connections come from the request, else from the method choice; limits
    of the policy come first. A chunk that one value fills is read by several tasks, and
    files hold a bounded number of rows. Without a range column the table is read through
    one cursor into files of target size.
    """
    table = request.name
    if request.chunk_rows:
        policy = replace(policy, target_chunk_rows=request.chunk_rows)
    whole = jdbc.read_table(spark, db, request.source)
    try:
        profile = jdbc.read_profile(spark, db, request.source)
    except ValueError:  # no rangeable column
        profile = None
    best = written(best_range_column(profile, policy), "best-column") if profile is not None else None
    plan = range_plan(whole, best, policy, table) if best is not None else None
    rows = plan.rows if plan else jdbc.read_count(spark, db, request.source).first()["row_count"]
    if rows < policy.small_table_rows:
        return export_single(whole, path, table, rows, options, policy, job_id)
    in_file = rows_per_file(rows, policy.bytes_per_row, policy)
    if plan is None:
        read = jdbc.read_table(spark, db, request.source, rows)
        return export_capped(read, path, table, in_file, options, job_id, rows)
    decision = plan_methods(
        spark.createDataFrame(
            [(table, rows, True, db.db_type.lower() in CURSOR_DIALECTS, db.db_type)],
            "table_name string, row_count bigint, has_suitable_range_column boolean, "
            "supports_cursors boolean, db_type string",
        ),
        policy,
    ).first()
    if not request.chunk_rows and policy.rows_in_chunk() is None and decision["method"] == RANGES:
        policy = replace(policy, chunk_rows=decision["chunk_rows"])
        plan = range_plan(whole, best, policy, table)
    others = [c for c, t in whole.dtypes if t in ("smallint", "int", "bigint") and c != plan.column]
    limit = request.chunk_rows or policy.rows_in_chunk() or max(1, -(-rows // plan.chunks))
    units = planned_units(spark, db, request.source, plan, others, limit)
    bounded = replace(options, max_records_per_file=options.max_records_per_file or in_file)
    export_units(
        spark, db, request.source, units, path, bounded,
        request.connections or connections or decision["max_workers"] or 16, rows,
    )
    return write_manifest(
        spark, path, table, whole.schema, method="ranges", chunked=True, planned_chunks=plan.chunks,
        plan=plan.as_dict(), job_id=job_id, expected_rows=rows,
    )


def export_database(
    spark: SparkSession, config: dict, base: str, ledger: Ledger, *, job_id: str | None = None,
    policy: Policy = Policy(), options: ExportOptions = ExportOptions(), concurrent: int = 4,
) -> str:
    """Run the job a configuration describes; without a list of tables, all user tables."""
    db = database_from(config)
    entries = config.get("tables") or [r["full_name"] for r in discover(spark, db).collect()]
    requests = {r.name: r for r in map(TableRequest.parse, entries)}

    def export_one(name: str, path: str, job: str) -> dict:
        return export_database_table(
            spark, db, requests[name], path, policy, options, job_id=job
        )

    return export_job(
        spark, dict.fromkeys(requests), base, ledger, job_id=job_id or str(uuid.uuid4()),
        username=config["db_username"], db_type=db.db_type, concurrent=concurrent,
        exporter=export_one,
    )
