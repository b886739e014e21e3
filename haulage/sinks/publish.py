"""Moving finished exports from staging to their final names, and archiving the job."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.plans.layout import FIRST_VERSION
from haulage.session import filesystem, path_exists, rename
from haulage.sinks.manifest import load_metadata, save_metadata

CONFLICTS = ("version", "timestamp", "overwrite")


def free_path(spark: SparkSession, path: str, conflict: str = "version") -> str:
    """The path itself if it is free, else a renamed one by the conflict rule."""
    if conflict not in CONFLICTS:
        raise ValueError(f"unknown conflict rule: {conflict}")
    if not path_exists(spark, path):
        return path
    if conflict == "overwrite":
        return path
    if conflict == "timestamp":
        return f"{path}_{datetime.now(timezone.utc):%Y-%m-%d_%H-%M-%S}"
    version = FIRST_VERSION
    while path_exists(spark, f"{path}_v{version}"):
        version += 1
    return f"{path}_v{version}"


def publish(spark: SparkSession, staged: str, final: str, conflict: str = "version") -> dict:
    """Move one sealed export to its final name; unsealed ones are refused.

    With ``overwrite`` the old export is first moved aside and removed once the new one
    is in place, so that a failure in between loses nothing.
    """
    metadata = load_metadata(spark, staged)
    if metadata is None:
        raise ValueError(f"{staged} is not a complete export")
    target, aside = free_path(spark, final, conflict), None
    if conflict == "overwrite" and path_exists(spark, target):
        aside = f"{target}.replaced-{uuid.uuid4().hex}"  # never in the way of a later one
        rename(spark, target, aside)
    rename(spark, staged, target)
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    metadata.pop("path", None)
    save_metadata(spark, target, {**metadata, "final_path": target, "organized_timestamp": now})
    if aside:
        fs, old = filesystem(spark, aside)
        fs.delete(old, True)
    return {"table": metadata["table_name"], "final_path": target, "was_renamed": target != final}


def publish_job(
    spark: SparkSession, job_id: str, staged: dict[str, tuple[str, str]], archive: str,
    conflict: str = "version", strategy: str = "clean_with_archive",
) -> DataFrame:
    """Publish all tables of a job; a failing table does not stop the others.

    ``staged`` maps table -> (staging path, final path). Returns one row per table and
    writes the job's summary below ``archive``.
    """
    rows = []
    for table, (source, final) in staged.items():
        try:
            done = publish(spark, source, final, conflict)
            rows.append((job_id, table, done["final_path"], done["was_renamed"], None))
        except Exception as error:
            rows.append((job_id, table, None, False, str(error)))
    moved = spark.createDataFrame(
        rows,
        "job_id string, table_name string, final_path string, was_renamed boolean, error string",
    )
    summary = archive_summary(moved).withColumns(
        {"strategy": F.lit(strategy), "conflict_resolution": F.lit(conflict)}
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{archive}/{job_id}")
    return moved


def archive_summary(moved: DataFrame) -> DataFrame:
    """Moved, failed and renamed tables per job."""
    return moved.groupBy("job_id").agg(
        F.count_if(F.col("error").isNull()).alias("moved_tables"),
        F.count_if(F.col("error").isNotNull()).alias("failed_tables"),
        F.count_if("was_renamed").alias("renamed_tables"),
        F.count(F.lit(1)).alias("total_tables"),
    )
