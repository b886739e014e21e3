"""Where exports go: staging, final and archive paths, and versioned names, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The organisation strategies and their folders.
STRATEGIES = ("clean_with_archive", "direct", "schema_first", "legacy")
ARCHIVES = {
    "clean_with_archive": "/.archive/jobs", "direct": "/.jobs",
    "schema_first": "/.archive/jobs", "legacy": "/.archive",
}
FIRST_VERSION = 2
# End of fixed values.


def safe_name(table: Column) -> Column:
    return F.translate(table, "./\\", "___")


def schema_part(table: Column) -> Column:
    return F.when(F.contains(table, F.lit(".")), F.split_part(table, F.lit("."), F.lit(1))).otherwise(
        F.lit("public")
    )


def table_part(table: Column) -> Column:
    return F.when(F.contains(table, F.lit(".")), F.split_part(table, F.lit("."), F.lit(2))).otherwise(
        table
    )


def export_layout(
    tables: DataFrame, base: str, strategy: str = "clean_with_archive", staging: str | None = None
) -> DataFrame:
    """Staging, final and archive path of each row of ``tables(table_name, job_id)``.

    An unknown strategy is treated as ``legacy``. ``staging`` may lie elsewhere.
    """
    staging = base if staging is None else staging
    table, job = F.col("table_name"), F.col("job_id")
    safe, schema, bare = safe_name(table), schema_part(table), table_part(table)

    def path(root: str, *parts) -> Column:
        return F.concat_ws("/", F.lit(root), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    if strategy == "clean_with_archive":
        temp, final = path(staging, ".temp", job, safe), path(base, safe)
    elif strategy == "direct":
        temp = final = path(base, safe)
    elif strategy == "schema_first":
        temp, final = path(staging, ".temp", job, schema, bare), path(base, schema, bare)
    else:
        strategy = "legacy"
        temp, final = path(staging, job, safe), path(base, job, safe)
    return tables.withColumns(
        {
            "strategy": F.lit(strategy),
            "temp_path": temp,
            "final_path": final,
            "archive_path": F.lit(base + ARCHIVES[strategy]),
        }
    )


def next_versions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """A free name for each wanted path.

    ``wanted(final_path)``, ``existing(path)``. The plain name if it is free, else the
    first free ``_vN`` from 2 upwards, found with anti-joins: a free version is 2 or the
    successor of a taken one.
    """
    paths = wanted.select("final_path").distinct()
    taken = existing.select("path").distinct()
    plain_taken = paths.join(taken, F.col("final_path") == F.col("path"), "left_semi")

    versions = taken.select(
        F.regexp_extract("path", r"^(.*)_v(\d+)$", 1).alias("final_path"),
        F.regexp_extract("path", r"^(.*)_v(\d+)$", 2).try_cast("int").alias("version"),
    ).where(F.col("version") >= FIRST_VERSION)
    candidates = plain_taken.withColumn("version", F.lit(FIRST_VERSION)).unionByName(
        versions.select("final_path", (F.col("version") + 1).alias("version"))
    )
    free = (
        candidates.join(versions, ["final_path", "version"], "left_anti")
        .groupBy("final_path")
        .agg(F.min("version").alias("version"))
    )
    joined = paths.join(plain_taken.withColumn("_taken", F.lit(True)), "final_path", "left").join(
        free, "final_path", "left"
    )
    renamed = F.coalesce("_taken", F.lit(False))
    versioned = F.concat("final_path", F.lit("_v"), F.col("version").cast("string"))
    return joined.select(
        "final_path",
        F.when(renamed, versioned).otherwise(F.col("final_path")).alias("actual_path"),
        renamed.alias("was_renamed"),
    )


def timestamped_name(path: Column, at: Column) -> Column:
    return F.concat(path, F.lit("_"), F.date_format(at, "yyyy-MM-dd_HH-mm-ss"))
