"""Per-table export decisions as column expressions over a table profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.scale import ceil_div, div, tiered
from haulage.policy import CATEGORY_TIERS, WORKER_TIERS, Policy

# Method names and the texts shown to users.
DIRECT, RANGES, CURSOR, PAGED = "direct_duckdb", "range_chunking", "cursor_streaming", "parallel_duckdb"
CURSOR_DIALECTS = ["postgresql", "greenplum"]
BENEFIT_BY_ROWS = (
    (1_000_000, "minimal (small table - direct export recommended)"),
    (10_000_000, "moderate (medium table - single file streaming)"),
    (100_000_000, "high (large table - chunked streaming recommended)"),
    (None, "extreme (very large table - chunked streaming highly recommended)"),
)
BENEFIT_BY_CHUNKS = (
    (50, "low (< 50 chunks)"),
    (200, "moderate (50-200 chunks)"),
    (1000, "high (200-1000 chunks)"),
    (None, "extreme (> 1000 chunks - OFFSET would be unusable)"),
)
SMALL_TABLE_BENEFIT = "minimal (small table)"
CRITICAL_WARNING = "🚨 CRITICAL: %s may take 8+ hours for %,d rows. Use range chunking!"
SLOW_WARNING = "⚠️  WARNING: %s may be slow for %,d rows. Consider range chunking."
# End of fixed values.


def _below(value: Column, steps) -> Column:
    """First label whose bound lies above ``value``; the last step has no bound."""
    chain = F
    for bound, label in steps[:-1]:
        chain = chain.when(value < bound, label)
    return chain.otherwise(steps[-1][1])


def optimal_chunk_size(rows: Column, policy: Policy = Policy(), workers: int | None = None) -> Column:
    """Rows per chunk: a few chunks per worker, aligned, within the policy's bounds."""
    workers = policy.workers if workers is None else workers
    *upper, lowest = policy.size_tiers

    def by_tier(value):
        return tiered(rows, [(t.above, value(t)) for t in upper], value(lowest))

    target_chunks = by_tier(lambda t: min(workers * t.chunks_per_worker, t.max_chunks))
    size = F.greatest(by_tier(lambda t: t.min_rows), div(rows, target_chunks))
    aligned = ceil_div(size, policy.chunk_alignment) * F.lit(policy.chunk_alignment)
    bounded = F.greatest(
        F.lit(policy.min_chunk_rows), F.least(aligned, F.lit(policy.max_chunk_rows))
    )
    return F.when(rows <= 0, F.lit(policy.min_chunk_rows)).otherwise(bounded).cast("bigint")


def optimal_parallelism(rows: Column, max_available: int = 16) -> Column:
    *upper, (_, lowest) = WORKER_TIERS
    return F.least(tiered(rows, upper, lowest), F.lit(max_available))


def supports_cursors(db_type: Column) -> Column:
    return F.lower(db_type).isin(CURSOR_DIALECTS)


def prefers_ranges(rows: Column, has_range: Column, policy: Policy = Policy()) -> Column:
    return (rows >= policy.range_preferred_rows) & has_range


def avoids_offset(rows: Column, policy: Policy = Policy()) -> Column:
    return rows >= policy.offset_slow_rows


def select_method(
    rows: Column, has_range: Column, cursors: Column, policy: Policy = Policy()
) -> Column:
    """Direct, ranges, cursor or pages. Cursors stand in from ``cursor_rows`` upwards,
    which also covers every table too large for pages."""
    return (
        F.when(rows < policy.small_table_rows, DIRECT)
        .when(prefers_ranges(rows, has_range, policy), RANGES)
        .when((rows >= policy.cursor_rows) & cursors, CURSOR)
        .otherwise(PAGED)
    )


def table_category(rows: Column) -> Column:
    *upper, (_, lowest) = CATEGORY_TIERS
    return tiered(rows, upper, lowest)


def method_params(
    rows: Column, method: Column, db_type: Column, policy: Policy = Policy()
) -> dict[str, Column]:
    """Parameters of the chosen method; a parameter of another method is NULL."""
    chunk_rows = optimal_chunk_size(rows, policy, policy.cpu_count)
    chunks = ceil_div(rows, chunk_rows)
    cursor_rows = F.when(rows < policy.offset_slow_rows, 2_000_000).otherwise(5_000_000)
    page_rows = F.least(F.lit(1_000_000), F.greatest(F.lit(100_000), div(rows, 50)))
    page_workers = min(8, max(4, policy.cpu_count // 2))
    ranges = method == RANGES
    return {
        "chunk_rows": F.when(ranges, chunk_rows)
        .when(method == CURSOR, cursor_rows)
        .when(method == PAGED, page_rows)
        .cast("bigint"),
        "max_workers": F.when(ranges, optimal_parallelism(rows, min(16, policy.cpu_count)))
        .when(method == PAGED, page_workers)
        .cast("int"),
        "estimated_chunks": F.when(ranges, chunks).cast("bigint"),
        "max_chunks": F.when(
            ranges, F.least(chunks, F.lit(policy.max_files_per_table).cast("bigint"))
        ),
        "table_category": F.when(ranges, table_category(rows)),
        "target_file_size_mb": F.when(ranges, policy.target_file_mb).cast("int"),
        "single_file_below_rows": F.when(method == CURSOR, policy.single_file_rows).cast("bigint"),
        "segment_aligned": ranges & (F.lower(db_type) == "greenplum"),
    }


def plan_methods(tables: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Method, parameters and warning for each row of a table profile."""
    rows = F.col("row_count")
    chosen = tables.withColumn(
        "method",
        select_method(rows, F.col("has_suitable_range_column"), F.col("supports_cursors"), policy),
    )
    chosen = chosen.withColumns(method_params(rows, F.col("method"), F.col("db_type"), policy))
    return chosen.withColumn("warning", plan_warning(rows, F.col("method"), policy))


def streams_in_chunks(rows: Column, policy: Policy = Policy()) -> Column:
    """A streamed export is split only between the single-file and the offset limits."""
    return (
        (rows > policy.stream_chunk_above_rows)
        & (rows < policy.stream_chunk_below_rows)
        & (rows < policy.offset_slow_rows)
    )


def benefit_label(rows: Column) -> Column:
    return _below(rows, BENEFIT_BY_ROWS)


def benefit_label_by_chunks(rows: Column, chunk_rows: int) -> Column:
    """The older label, which counts pages instead of rows."""
    return F.when(rows < 1_000_000, SMALL_TABLE_BENEFIT).otherwise(
        _below(ceil_div(rows, chunk_rows), BENEFIT_BY_CHUNKS)
    )


def plan_warning(rows: Column, method: Column, policy: Policy = Policy()) -> Column:
    """Warning for paged methods on large tables; empty text when there is none."""
    paged = F.lower(method).rlike("offset|parallel")
    return (
        F.when(paged & (rows >= policy.offset_very_slow_rows),
               F.format_string(CRITICAL_WARNING, method, rows))
        .when(paged & (rows >= policy.offset_slow_rows),
              F.format_string(SLOW_WARNING, method, rows))
        .otherwise("")
    )
