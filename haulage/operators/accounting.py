"""Figures about jobs: summaries, throughput, progress, ratings, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.scale import tiered
from haulage.operators.positions import running_totals
from haulage.policy import RATING_TIERS, Policy

# Words that mark an error as worth a retry.
RETRYABLE = ("connection", "timeout", "segment", "network", "temporary")
RETRYABLE_EXTENDED = RETRYABLE + (
    "ldap", "authentication", "login", "attach", "failed to attach", "unable to connect",
    "authentication failed",
)
SLOWEST_RATING = "very slow"
# End of fixed values.


def _with_total(per_job: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Rows per key plus one grand total with a NULL key. The input is already one row per
    key, so the rollup does not double the events."""
    return per_job.rollup(key).agg(*[F.sum(c).alias(c) for c in sums])


def job_summary(tables: DataFrame) -> DataFrame:
    """Tables by status, shares, rows and size per job, with a grand total row.

    ``tables(job_id, status, row_count, total_size_mb, partitioned)``.
    """
    status = F.col("status")
    per_job = tables.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "processing").alias("processing"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("total_size_mb"), F.lit(0)).alias("total_size_mb"),
        F.count_if("partitioned").alias("partitioned_tables"),
    )
    sums = [c for c in per_job.columns if c != "job_id"]

    def share(name: str) -> Column:
        return (F.col(name) / F.col("tables") * 100).alias(f"{name}_percent")

    return _with_total(per_job, "job_id", sums).select(
        "job_id", *sums, share("completed"), share("failed"), share("processing")
    )


def chunk_summary(tables: DataFrame) -> DataFrame:
    """Total, completed and processing chunks per job and over all jobs.

    A completed table has completed all its chunks, any other none.
    """
    chunks, status = F.coalesce("chunk_count", F.lit(1)), F.col("status")
    per_job = tables.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum(chunks).alias("total_chunks"),
        F.sum(F.when(status == "completed", chunks).otherwise(0)).alias("completed_chunks"),
        F.sum(F.when(status == "processing", chunks).otherwise(0)).alias("processing_chunks"),
    )
    return _with_total(per_job, "job_id", [c for c in per_job.columns if c != "job_id"])


def throughput_eta(
    done_rows: Column, total_rows: Column, elapsed: Column, done_chunks: Column, total_chunks: Column
) -> dict[str, Column]:
    """Rate, percent and remaining time, by rows and by the average chunk."""
    rate = F.when(elapsed > 0, F.floor(done_rows / elapsed)).otherwise(0).cast("bigint")
    chunk_time = elapsed / F.nullif(done_chunks, F.lit(0))
    return {
        "throughput_rows_per_sec": rate,
        "progress_percent": done_rows / F.greatest(total_rows, F.lit(1)) * 100,
        "remaining_rows": total_rows - done_rows,
        "eta_seconds": (total_rows - done_rows) / F.nullif(rate, F.lit(0)),
        "eta_seconds_by_chunks": (total_chunks - done_chunks) * chunk_time,
    }


def performance_rating(rows: Column, seconds: Column, chunks: Column) -> dict[str, Column]:
    """Class by average rate, with the rates behind it."""
    rate = F.coalesce(rows / F.nullif(seconds, F.lit(0)), F.lit(0.0))
    return {
        "rows_per_sec": rate,
        "chunks_per_sec": F.coalesce(chunks / F.nullif(seconds, F.lit(0)), F.lit(0.0)),
        "rows_per_chunk": F.coalesce(rows / F.nullif(chunks, F.lit(0)), F.lit(0.0)),
        "rating": tiered(rate, RATING_TIERS, SLOWEST_RATING),
    }


def throughput_hint(rate: Column, method: Column) -> Column:
    """Hint while a table is being exported, depending on the method family."""
    return (
        F.when(method.startswith("Polars") & (rate < 500), "very slow")
        .when(method.startswith("Polars") & (rate < 1_000), "slow")
        .when(method.startswith("Polars") & (rate < 2_000), "consider a faster method")
        .when(method.startswith("DuckDB") & (rate < 2_000), "slower than expected")
        .when(method.startswith("DuckDB") & (rate > 10_000), "excellent")
        .otherwise("")
    )


def final_status(tables: DataFrame) -> DataFrame:
    """Final state of each job from its tables' states."""
    counted = tables.groupBy("job_id").agg(
        F.count_if(F.col("status") == "completed").alias("tables_completed"),
        F.count_if(F.col("status") == "failed").alias("tables_failed"),
    )
    state = F.when(F.col("tables_failed") == 0, "completed").otherwise("completed_with_errors")
    return counted.withColumn("overall_status", state)


def running_progress(
    chunks: DataFrame, keys: list[str], order: list[str], rows: str, seconds: str
) -> DataFrame:
    """Cumulative rows, chunks, rate and percent after each chunk, hot keys included."""
    summed = running_totals(
        chunks, keys, order,
        {"rows_done": F.col(rows), "chunks_done": F.lit(1).cast("bigint"),
         "seconds_done": F.col(seconds)},
    )
    rate = F.floor(F.col("rows_done") / F.nullif(F.col("seconds_done"), F.lit(0)))
    return summed.withColumns(
        {
            "throughput": F.coalesce(rate, F.lit(0)).cast("bigint"),
            "progress_percent": F.col("chunks_done") / F.col("chunks_done_all") * 100,
        }
    )


def progress_milestones(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The chunks at which a table passes 25, 50 and 75 percent.

    One chunk can pass several marks; it is listed with the highest one.
    """
    summed = running_totals(chunks, keys, order, {"done": F.lit(1).cast("bigint")})

    def quarter(done: Column) -> Column:
        return F.call_function("div", done * 4, F.col("done_all"))

    now, before = quarter(F.col("done")), quarter(F.col("done") - 1)
    return (
        summed.withColumn("milestone", F.least(now, F.lit(3)) * 25)
        .where((now > before) & (before < 3) & (F.col("milestone") > 0))
        .withColumnRenamed("done_all", "total")
    )


def is_retryable(message: Column, words=RETRYABLE) -> Column:
    """Whether an error text has one of the words, in any case."""
    return F.lower(message).rlike("|".join(words))


def classify_errors(errors: DataFrame, message: str = "error_message") -> DataFrame:
    return errors.withColumns(
        {
            "retryable": is_retryable(F.col(message)),
            "retryable_extended": is_retryable(F.col(message), RETRYABLE_EXTENDED),
        }
    )


def slow_chunks(chunks: DataFrame, seconds: str, policy: Policy = Policy()) -> DataFrame:
    return chunks.where(F.col(seconds) > policy.slow_chunk_seconds)
