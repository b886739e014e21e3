"""Taking up an interrupted export: what is done and still intact, what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "table_name string, chunk_id int, file_name string, row_count bigint, checksum string, "
    "file_size bigint, completed_at timestamp"
)


def chunk_ledger(records: DataFrame, order: list[str]) -> DataFrame:
    """Latest record per (table, chunk) of the append-only chunk ledger."""
    rest = [c for c in records.columns if c not in ("table_name", "chunk_id")]
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return (
        records.groupBy("table_name", "chunk_id").agg(latest.alias("r")).select(
            "table_name", "chunk_id", "r.*"
        )
    )


def intact_chunks(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks whose file is still there with the checksum that was recorded.

    A record without checksum only needs its file. ``current(table_name, chunk_id,
    checksum)`` describes the files as they are now.
    """
    now = current.select("table_name", "chunk_id", F.col("checksum").alias("_now"))
    joined = ledger.join(now, ["table_name", "chunk_id"])
    matches = F.col("checksum").isNull() | (F.col("checksum") == F.col("_now"))
    return joined.where(matches).drop("_now")


def resume_plan(plan: DataFrame, ledger: DataFrame, current: DataFrame) -> DataFrame:
    """Planned chunks that still have to be written."""
    done = intact_chunks(ledger, current).select("table_name", "chunk_id")
    return plan.join(done, ["table_name", "chunk_id"], "left_anti")


def existing_exports(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """Wanted tables that are already exported completely, under any version.

    ``wanted(table_name, row_count)``; ``manifests(table_name, total_rows, status)``.
    """
    return wanted.join(_complete(manifests), ["table_name", "row_count"], "left_semi")


def tables_to_export(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    return wanted.join(_complete(manifests), ["table_name", "row_count"], "left_anti")


def mark_existing(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """``wanted`` plus ``exists_already``, in one join."""
    done = _complete(manifests).distinct().withColumn("_done", F.lit(True))
    marked = wanted.join(done, ["table_name", "row_count"], "left")
    return marked.select(*wanted.columns, F.coalesce("_done", F.lit(False)).alias("exists_already"))


def _complete(manifests: DataFrame) -> DataFrame:
    complete = manifests.where(F.col("status") == "complete")
    return complete.select("table_name", F.col("total_rows").alias("row_count"))


def same_plan(stored: dict | None, current: dict) -> bool:
    """A resumed export must use the very same chunks."""
    return stored == current
