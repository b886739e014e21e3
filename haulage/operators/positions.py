"""Global order without a single-task window and without a second copy of the table.

Rows fall into cells of a total order by literal splitters (:mod:`haulage.operators.cells`).
Cells are counted in one pass; the counts give each cell's offset, so that after one shuffle
by cell a row's place within its cell gives its place in the table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.functions.rows import quoted
from haulage.operators.cells import (
    CELL, TARGET_ROWS, TIES, Cells, Splitters, cells, numbers, splitters, with_ties,
)

COPIES, START = "_copies", "_start"
PAGE_ROWS = 200_000  # rows that are sorted for a page besides its own
PAGE_SPLITTERS = 255
BLOCK = 100_000  # copies of a row that one task makes at a time


def _names(columns: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in columns]


def _in_cells(tied: DataFrame, cut: Cells) -> DataFrame:
    return tied.withColumn(CELL, cut.cell())


def _collapsed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of cells in which copies pile up, one row for all copies, with their number.

    Counted before the shuffle, so that a row that fills a third of the table is one entry
    per task. Rows are told apart by their 128-bit hash, since maps cannot be grouped by.
    """
    kept = [F.first(quoted(c)).alias(c) for c in columns]
    return df.groupBy(CELL, *TIES).agg(*kept, F.count(F.lit(1)).alias(COPIES))


def _shuffled(df: DataFrame, cut: Cells) -> DataFrame:
    """One task for each cell, so that a task holds no more rows however large the table is."""
    if len(cut.counts) == 1:
        return df.repartition(1, CELL)
    return df.repartitionById(len(cut.counts), CELL)


def _expanded(df: DataFrame, name: str, low: int | None, high: int | None) -> DataFrame:
    """``COPIES`` rows from each row that begins at position ``START``, as far as they lie in
    ``[low, high)``; blocks of copies are spread over tasks before they are made."""
    begin = F.col(START) if low is None else F.greatest(F.col(START), F.lit(low))
    end = F.col(START) + F.col(COPIES)
    end = end if high is None else F.least(end, F.lit(high))
    rest = [c for c in df.columns if c not in (START, COPIES)]
    blocks = (
        df.withColumns({"_begin": begin, "_end": end}).where("_begin < _end")
        .withColumn("_block", F.explode(F.sequence(F.col("_begin"), F.col("_end") - 1, F.lit(BLOCK))))
        .repartition("_block")
    )
    last = F.least(F.col("_block") + BLOCK, F.col("_end")) - 1
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_block"), last))).select(*_names(rest), name)


def _placed(
    tied: DataFrame, order: list[str], name: str, cut: Cells, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Rows with ties plus their position, by ``order`` and then the row's hash."""
    cut = cut.joined()
    offset = F.get(numbers(cut.offsets()), F.col(CELL))
    sort = [*_names(order), *TIES]
    full = _in_cells(tied, cut)
    piled = F.col(CELL).isin(cut.copies)
    place = F.row_number().over(W.partitionBy(CELL).orderBy(*sort))
    placed = (
        _shuffled(full.where(~piled) if cut.copies else full, cut)
        .withColumn(name, offset + place - 1)
        .select(*_names(tied.columns), name)
    )
    if low is not None:
        placed = placed.where((F.col(name) >= low) & (F.col(name) < high))
    if not cut.copies:
        return placed
    once = _collapsed(full.where(piled), [c for c in tied.columns if c not in TIES])
    before = W.partitionBy(CELL).orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
    start = offset + F.coalesce(F.sum(COPIES).over(before), F.lit(0))
    copies = _expanded(once.withColumn(START, start).drop(CELL), name, low, high)
    return placed.unionByName(copies.select(*_names(tied.columns), name))


def with_positions(
    df: DataFrame, order: list[str], name: str = "position", target_rows: int = TARGET_ROWS,
    cut: Cells | None = None,
) -> DataFrame:
    """``df`` plus a 0-based global position in ``order``, ties broken by the row's hash.

    One shuffle; nothing is written. ``df`` is read once more for the counts (``cut``), so
    input that gives other rows when read again must be written first.
    """
    tied = with_ties(df)
    cut = cut or cells(tied, order, target_rows)
    return _placed(tied, order, name, cut).select(*_names(df.columns), name)


# Positions in a given order; what it leaves open, the row's hash decides.
placed = with_positions


def page(
    df: DataFrame, order: list[str], offset: int, size: int, sort_rows: int = PAGE_ROWS
) -> DataFrame:
    """Rows ``offset .. offset + size`` of that order, with their ``position``.

    By selection: rows are counted between splitters, and the search goes on among those
    around the page until few others are left; only these are sorted. A round reads the
    columns of the order once for a sample and once for the counts. The row's hash joins
    them where they leave too many rows equal.
    """
    offset, rows = max(offset, 0), df.count()
    size = max(0, min(size, rows - offset))
    if size == 0:
        return df.limit(0).withColumn("position", F.lit(0).cast("bigint"))
    reach, tied, before = F.lit(True), False, 0
    while rows - size > max(sort_rows, size):
        region = (with_ties(df) if tied else df).where(reach)
        cut = splitters(region, [*order, *TIES] if tied else order, PAGE_SPLITTERS, rows)
        counted = region.select(cut.bucket().alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        sizes = {r["b"]: r["n"] for r in counted.collect()}  # at most 511 rows
        ends = list(accumulate(sizes.get(b, 0) for b in range(2 * len(cut.keys) + 1)))
        first = next(b for b, end in enumerate(ends) if end > offset - before)
        last = next(b for b, end in enumerate(ends) if end >= offset + size - before)
        skipped = ends[first - 1] if first else 0
        stuck = ends[last] - skipped > rows / 2
        if stuck and tied:
            break  # copies that nothing tells apart
        reach, tied = reach & cut.within(first, last), tied or stuck
        before, rows = before + skipped, ends[last] - skipped
    found = with_ties(df).where(reach)
    if rows <= 2 * sort_rows:
        cut = Cells(Splitters(tuple(order), (), ()), [0], {}, [rows])
    else:
        cut = cells(found, order, rows=rows)
    inside = _placed(found, order, "position", cut, offset - before, offset - before + size)
    return inside.withColumn("position", F.col("position") + F.lit(before)).select(
        *_names(df.columns), "position"
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Running sums per key, plus ``<name>_all`` with the total of the key.

    One shuffle by cells of (key, order), in which sums run locally. Only a key that a
    splitter lies in reaches beyond its cell; the sums of these keys, at most as many as
    splitters, are gathered per cell beforehand and carried on. A NULL key is a key like
    others. Rows that agree in all columns are summed one after the other.
    """
    values = {f"_v_{name}": value for name, value in totals.items()}
    tied = with_ties(df.withColumns(values))
    cut = cells(tied, [*keys, *order]).joined()
    full = _in_cells(tied, cut)
    piled = F.col(CELL).isin(cut.copies)
    group = W.partitionBy(CELL, *_names(keys))
    until = group.orderBy(*_names(order), *TIES).rowsBetween(W.unboundedPreceding, W.currentRow)

    def summed(part: DataFrame, times: Column) -> DataFrame:
        return part.withColumns(
            {
                **{f"_r_{n}": F.sum(F.col(f"_v_{n}") * times).over(until) for n in totals},
                **{f"_t_{n}": F.sum(F.col(f"_v_{n}") * times).over(group) for n in totals},
            }
        )

    sums = summed(_shuffled(full.where(~piled) if cut.copies else full, cut), F.lit(1))
    if cut.copies:
        once = _collapsed(full.where(piled), [c for c in tied.columns if c not in TIES])
        spread = _expanded(
            summed(once, F.col(COPIES)).withColumn(START, F.lit(0).cast("bigint")).withColumn("_n", F.col(COPIES)),
            "_copy", None, None,
        )
        later = F.col("_n") - F.col("_copy") - 1  # copies that follow this one
        spread = spread.withColumns({f"_r_{n}": F.col(f"_r_{n}") - F.col(f"_v_{n}") * later for n in totals})
        sums = sums.unionByName(spread.select(*sums.columns))
    if cut.splitters.keys:
        carried = _carried(full, cut, keys, totals)
        same = F.col(CELL) == F.col("_j_cell")
        for i, key in enumerate(keys):
            same = same & F.col(quoted(key)).eqNullSafe(F.col(f"_j_{i}"))
        sums = sums.join(F.broadcast(carried), same, "left")
        out = {}
        for n in totals:
            out[n] = F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_r_{n}")
            out[f"{n}_all"] = F.coalesce(F.col(f"_a_{n}"), F.col(f"_t_{n}"))
    else:
        out = {n: F.col(f"_r_{n}") for n in totals} | {f"{n}_all": F.col(f"_t_{n}") for n in totals}
    return sums.select(*_names(df.columns), *[c.alias(n) for n, c in out.items()])


def _carried(full: DataFrame, cut: Cells, keys: list[str], totals: dict) -> DataFrame:
    """Per cell and key, for keys that a splitter lies in: sums of earlier cells and of all."""
    spark, found = full.sparkSession, [f"_j_{i}" for i in range(len(keys))]
    texts = spark.createDataFrame([(k,) for k in cut.splitters.keys], "k string")
    split = texts.select(cut.splitters.parsed(F.col("k")).alias("k")).select(
        *[F.col(f"k.k{i}").alias(name) for i, name in enumerate(found)]
    ).distinct()
    same = F.lit(True)
    for name, key in zip(found, keys):
        same = same & F.col(quoted(key)).eqNullSafe(F.col(name))
    sums = (
        full.join(F.broadcast(split), same).groupBy(*found, F.col(CELL).alias("_j_cell"))
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    )
    whole = W.partitionBy(*found)
    earlier = whole.orderBy("_j_cell").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *found, "_j_cell", *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in totals],
        *[F.sum(f"_s_{n}").over(whole).alias(f"_a_{n}") for n in totals],
    )
