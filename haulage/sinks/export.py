"""Writing tables as Parquet: whole, sized, by range or by page. One Spark job each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.operators.cells import cells, with_ties
from haulage.operators.positions import with_positions
from haulage.plans.ranges import RangePlan
from haulage.policy import ExportOptions, Policy
from haulage.session import target_partition_size
from haulage.sinks.manifest import CHUNK, write_manifest


def _check_free(df: DataFrame) -> None:
    if CHUNK in df.columns:
        raise ValueError(f"the table has a column named {CHUNK}; rename it first")


def _write(df: DataFrame, path: str, options: ExportOptions, chunked: bool) -> None:
    writer = df.write.options(**options.as_writer_options())
    (writer.partitionBy(CHUNK) if chunked else writer).parquet(path)


def gathered_by_chunk(df: DataFrame) -> DataFrame:
    """Bring the rows of a chunk together for writing.

    A rebalance, not a plain repartition: adaptive execution splits a chunk that is larger
    than :func:`target_partition_size` over several tasks, and joins small ones.
    """
    return df.hint("rebalance", F.col(CHUNK))


def export_single(
    df: DataFrame,
    path: str,
    table: str,
    rows: int,
    options: ExportOptions = ExportOptions(),
    policy: Policy = Policy(),
    job_id: str | None = None,
) -> dict:
    """One file, written by one task, as asked; tables beyond the policy's limit are refused, and
    :func:`export_sized` is the choice for them. Fails unless ``rows`` rows were written."""
    if rows > policy.single_file_rows:
        raise ValueError(f"{table}: {rows} rows are too many for one file; use export_sized")
    _write(df.coalesce(1), path, options, chunked=False)
    return write_manifest(
        df.sparkSession, path, table, df.schema, method="single", chunked=False, job_id=job_id,
        expected_rows=rows,
    )


def rows_per_file(rows: int, bytes_per_row: float, policy: Policy = Policy()) -> int:
    """Rows that make a file of the target size, raised to keep the number of files low
    unless files would then get too large."""
    per_mb = 1024 * 1024 / max(bytes_per_row, 1.0)
    by_size = max(1, int(policy.target_file_mb * per_mb))
    by_count = -(-rows // policy.max_files_per_table)
    return max(by_size, min(by_count, max(1, int(policy.hard_max_file_mb * per_mb))))


def export_sized(
    df: DataFrame,
    path: str,
    table: str,
    rows: int,
    bytes_per_row: float | None = None,
    options: ExportOptions = ExportOptions(),
    policy: Policy = Policy(),
    job_id: str | None = None,
    rows_in_file: int | None = None,
) -> dict:
    """Files of about the target size, spread evenly over as many tasks as files."""
    limit = rows_in_file or rows_per_file(rows, bytes_per_row or policy.bytes_per_row, policy)
    files = max(1, -(-rows // limit))
    _write(df.repartition(files), path, options, chunked=False)
    return write_manifest(
        df.sparkSession, path, table, df.schema, method="sized", chunked=False,
        chunk_size=limit, job_id=job_id, expected_rows=rows,
    )


def export_capped(
    df: DataFrame, path: str, table: str, max_records: int,
    options: ExportOptions = ExportOptions(), job_id: str | None = None, rows: int | None = None,
) -> dict:
    """As read, without a shuffle; a new file starts after ``max_records`` rows. The total is
    checked against ``rows``, or else against a count of the source."""
    capped = ExportOptions(**{**options.__dict__, "max_records_per_file": max_records})
    _write(df, path, capped, chunked=False)
    return write_manifest(
        df.sparkSession, path, table, df.schema, method="capped", chunked=False,
        chunk_size=max_records, job_id=job_id,
        expected_rows=df.count() if rows is None else rows,
    )


def export_ranges(
    df: DataFrame,
    plan: RangePlan,
    path: str,
    options: ExportOptions = ExportOptions(),
    gather: bool = True,
    job_id: str | None = None,
    only: DataFrame | None = None,
    policy: Policy = Policy(),
) -> dict:
    """All ranges in one job, one directory per chunk.

    ``gather=False`` skips the shuffle; use it when the input already comes chunk by chunk
    (a JDBC read of the same plan). ``only(chunk_id)`` restricts a resumed export.
    """
    _check_free(df)
    chunked = df.withColumn(CHUNK, plan.chunk_id())
    if only is not None:
        chunked = chunked.join(only.select(CHUNK).distinct(), CHUNK, "left_semi")
    with target_partition_size(df.sparkSession, policy.target_file_mb):
        _write(gathered_by_chunk(chunked) if gather else chunked, path, options, chunked=True)
    expected = None
    if only is None:  # a plan by quantiles knows no total, so the source is counted
        expected = df.count() if plan.rows is None else plan.rows
    return write_manifest(
        df.sparkSession, path, plan.table, df.schema, method="ranges", chunked=True,
        planned_chunks=plan.chunks, plan=plan.as_dict(), job_id=job_id, expected_rows=expected,
    )


def export_paged(
    df: DataFrame,
    order: list[str],
    page_rows: int,
    path: str,
    table: str,
    options: ExportOptions = ExportOptions(),
    job_id: str | None = None,
) -> dict:
    """Pages of equal size in a total order.

    Positions come from cells with literal splitters, so the table is shuffled once and
    written once, and a task that runs again gives its rows the same pages. Each task holds
    consecutive rows and writes into few pages.
    """
    _check_free(df)
    cut = cells(with_ties(df), order)
    rows = sum(cut.counts)
    page = F.expr(f"cast(_position div {page_rows} AS int)")
    placed = with_positions(df, order, "_position", cut=cut).withColumn(CHUNK, page)
    _write(placed.drop("_position"), path, options, chunked=True)
    return write_manifest(
        df.sparkSession, path, table, df.schema, method="pages", chunked=True,
        planned_chunks=-(-rows // page_rows), chunk_size=page_rows, job_id=job_id,
        expected_rows=rows,
    )
