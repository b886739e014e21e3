"""Range exports that can be taken up again after an interruption or damage.

Next to the data lie the plan (``_export_plan``) and the chunk ledger (``_chunk_ledger``,
one Parquet row per finished chunk, only ever appended to).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators.resume import LEDGER_SCHEMA, chunk_ledger, resume_plan, same_plan
from haulage.operators.verify import chunk_checksums, file_checksums
from haulage.plans.ranges import RangePlan
from haulage.policy import ExportOptions, Policy
from haulage.session import path_exists, remove, target_partition_size, write_text
from haulage.sinks.export import gathered_by_chunk
from haulage.sinks.manifest import (
    CHUNK, FILES, chunk_folders, list_data_files, scan_files, write_manifest,
)

PLAN, LEDGER = "_export_plan/plan.json", "_chunk_ledger"


def stored_plan(spark: SparkSession, path: str) -> dict | None:
    """The plan that an export was started with."""
    if not path_exists(spark, f"{path}/{PLAN}"):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/_export_plan").collect()))


def _check_plan(spark: SparkSession, path: str, plan: RangePlan) -> None:
    """Store the plan, or refuse to go on with a different one."""
    current, stored = json.loads(json.dumps(plan.as_dict())), stored_plan(spark, path)
    if stored is None:
        write_text(spark, f"{path}/{PLAN}", json.dumps(current))
    elif not same_plan(stored, current):
        raise ValueError(f"{path} was started with another plan; export to a new path")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    records = spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/{LEDGER}")
    return chunk_ledger(records, ["completed_at", "checksum"])


def current_chunks(spark: SparkSession, path: str, table: str, chunks: list[int]) -> DataFrame | None:
    """These chunks as their files are now: only their folders are listed and hashed. None
    where no chunk has a folder."""
    folders = chunk_folders(spark, path, chunks)
    if not folders:
        return None
    files = list_data_files(spark, path, folders).withColumn("table_name", F.lit(table))
    return chunk_checksums(file_checksums(files))


def pending_chunks(spark: SparkSession, path: str, plan: RangePlan) -> list[int]:
    """Chunks that are not recorded, or whose files are no longer what was recorded. Only
    recorded chunks are hashed; of a wave that was cut short nothing else counts."""
    if not path_exists(spark, f"{path}/{LEDGER}"):
        return list(range(plan.chunks))
    planned = spark.range(plan.chunks).select(
        F.lit(plan.table).alias("table_name"), F.col("id").cast("int").alias(CHUNK)
    )
    ledger = read_ledger(spark, path)
    recorded = sorted(r[CHUNK] for r in ledger.where("row_count > 0").select(CHUNK).collect())  # one per chunk
    now = current_chunks(spark, path, plan.table, recorded)
    if now is None:
        now = spark.createDataFrame([], f"table_name string, {CHUNK} int, checksum string")
    left = resume_plan(planned, ledger, now)
    # Empty chunks have no file; their record alone is enough.
    empty = ledger.where("row_count = 0").select("table_name", CHUNK)
    left = left.join(empty, ["table_name", CHUNK], "left_anti")
    return sorted(r[CHUNK] for r in left.select(CHUNK).collect())


def _record(spark: SparkSession, path: str, df: DataFrame, plan: RangePlan, chunks: list[int]) -> int:
    """Append the records of freshly written chunks, from their own files alone; returns their
    rows."""
    wanted = spark.createDataFrame([(c,) for c in chunks], f"{CHUNK} int")
    folders = chunk_folders(spark, path, chunks)
    if folders:
        rows = scan_files(spark, path, df.schema, True, folders).groupBy(CHUNK).agg(
            F.sum("row_count").alias("row_count"), F.min("file_name").alias("file_name")
        )
        now = current_chunks(spark, path, plan.table, chunks).select(CHUNK, "checksum", "file_size")
        found = wanted.join(rows, CHUNK, "left").join(now, CHUNK, "left")
    else:
        found = wanted.selectExpr(
            CHUNK, "cast(NULL AS bigint) AS row_count", "cast(NULL AS string) AS file_name",
            "cast(NULL AS string) AS checksum", "cast(NULL AS bigint) AS file_size",
        )
    records = found.select(
        F.lit(plan.table).alias("table_name"), CHUNK, "file_name",
        F.coalesce("row_count", F.lit(0)).alias("row_count"), "checksum",
        F.coalesce("file_size", F.lit(0)).alias("file_size"),
        F.current_timestamp().alias("completed_at"),
    )
    records.coalesce(1).write.mode("append").parquet(f"{path}/{LEDGER}")
    latest = read_ledger(spark, path).join(wanted, CHUNK)
    return latest.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows")).first()["rows"]


def resume_export(
    df: DataFrame,
    plan: RangePlan,
    path: str,
    options: ExportOptions = ExportOptions(),
    policy: Policy = Policy(),
    waves: int = 1,
    job_id: str | None = None,
    on_wave: Callable[[list[int], int], None] | None = None,
) -> dict:
    """Write what is missing of a range export and seal it. Also starts a new one.

    A wave is one Spark job over consecutive pending chunks, filtered at the scan; what a
    finished wave has written is not written again, and a wave lists and hashes its own
    chunks only. ``on_wave(chunks, rows)`` is told of each finished wave. Returns the metadata.
    """
    spark = df.sparkSession
    _check_plan(spark, path, plan)
    todo = pending_chunks(spark, path, plan)
    size = max(1, -(-len(todo) // max(1, waves)))
    for first in range(0, len(todo), size):
        wave = todo[first : first + size]
        for stray in chunk_folders(spark, path, wave):  # of a wave that was cut short
            remove(spark, stray)
        chunked = df.where(plan.span(wave[0], wave[-1])).withColumn(CHUNK, plan.chunk_id())
        chunked = chunked.where(F.col(CHUNK).isin(wave))
        with target_partition_size(spark, policy.target_file_mb):
            (
                gathered_by_chunk(chunked)
                .write.options(**options.as_writer_options())
                .mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")  # replaces these chunks only
                .partitionBy(CHUNK)
                .parquet(path)
            )
        rows = _record(spark, path, df, plan, wave)
        if on_wave:
            on_wave(wave, rows)
    remove(spark, f"{path}/{FILES}")  # the list of an earlier seal
    return write_manifest(
        spark, path, plan.table, df.schema, method="ranges", chunked=True,
        planned_chunks=plan.chunks, plan=plan.as_dict(), job_id=job_id,
        expected_rows=df.count() if plan.rows is None else plan.rows,
    )
