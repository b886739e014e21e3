"""Lossless value ranges: every row falls into exactly one chunk, NULLs into the first.

Ranges are computed as DataFrames (one row per chunk), so many tables are planned in one
job. :class:`RangePlan` holds the few rows of one table's plan for building predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.rows import quoted
from haulage.functions.scale import micros_sql
from haulage.operators.positions import with_positions
from haulage.operators.profile import TIME_TYPES, WHOLE_TYPES
from haulage.policy import Policy

DAY_MICROS = 86_400_000_000
_WIDE = "decimal(21,0)"  # a span of 64-bit keys does not fit into 64 bits


def _by_tier(rows: str, tiers, value) -> str:
    """SQL: ``value`` of the first tier whose bound lies below ``rows``."""
    *upper, lowest = tiers
    cases = " ".join(f"WHEN {rows} > {t.above} THEN {value(t)}" for t in upper)
    return f"CASE {cases} ELSE {value(lowest)} END"


def chunk_count(rows: str, target_rows: int, tiers, strict_floor: bool) -> Column:
    """Number of chunks for a row count under a tier table; 0 for an empty table.

    ``strict_floor`` also lowers the count until every chunk has its minimum of rows.
    """
    floor_rows = _by_tier(rows, tiers, lambda t: t.floor_rows)
    most = _by_tier(rows, tiers, lambda t: f"least({t.max_chunks}, {rows} div {t.floor_rows})")
    wanted = f"({rows} + {target_rows - 1}) div {target_rows}"
    count = f"greatest(1, least({wanted}, {most}))"
    if strict_floor:
        count = (
            f"CASE WHEN {rows} div {count} < {floor_rows} "
            f"THEN greatest(1, {rows} div {floor_rows}) ELSE {count} END"
        )
    return F.expr(f"cast(CASE WHEN {rows} <= 0 THEN 0 ELSE {count} END AS int)")


def _wanted_chunks(policy: Policy, tiers, strict_floor: bool) -> Column:
    """Chunks of the stated size, however many that makes; else what the tiers give."""
    most = policy.rows_in_chunk()
    if most is None:
        return chunk_count("total_count", policy.target_chunk_rows, tiers, strict_floor)
    return F.expr(f"cast(CASE WHEN total_count <= 0 THEN 0 ELSE (total_count + {most - 1}) div {most} END AS int)")


def _explode_chunks(planned: DataFrame, count: str) -> DataFrame:
    """One row per chunk; tables without chunks yield none."""
    return planned.where(f"{count} > 0").selectExpr(
        "*", f"explode(sequence(0, {count} - 1)) AS chunk_id"
    )


_LAST = "(chunk_id = _m - 1)"


def _finish(chunks: DataFrame, lo: str, hi: str, hi_inclusive: str) -> DataFrame:
    return chunks.selectExpr(
        "table_name", "column_name", "data_type", "chunk_id",
        f"{lo} AS lo", f"{hi} AS hi", f"{hi_inclusive} AS hi_inclusive", f"{_LAST} AS is_last",
        "(chunk_id = 0 AND null_count > 0) AS has_nulls",
    )


def _of_types(profile: DataFrame, types) -> DataFrame:
    return profile.where(f"data_type IN ({', '.join(repr(t) for t in types)})")


# A column without values still needs one chunk, for its NULLs.
_ONLY_NULLS = "(min_key IS NULL AND total_count > 0)"


def numeric_ranges(
    profile: DataFrame, policy: Policy = Policy(), chunks: Column | None = None
) -> DataFrame:
    """Closed whole-number ranges ``[lo, hi]`` of nearly equal width.

    Input: column profile rows. The chunk count comes from the policy's tiers unless
    ``chunks`` gives it.
    """
    if chunks is None:
        chunks = _wanted_chunks(policy, policy.numeric_tiers, True)
    planned = (
        _of_types(profile, WHOLE_TYPES)
        .withColumn("_n", chunks)
        .selectExpr("*", f"cast(max_key AS {_WIDE}) - cast(min_key AS {_WIDE}) AS _span")
        .selectExpr(
            "*",
            # One chunk spans everything; from two on, the quotient fits into 64 bits.
            f"cast(CASE WHEN _n <= 1 THEN greatest(1, _span) "
            f"ELSE greatest(1L, _span div _n) END AS {_WIDE}) AS _width",
        )
        .selectExpr(
            "*",
            f"cast(CASE WHEN {_ONLY_NULLS} THEN 1 "
            "ELSE least(_n, _span div (_width + 1) + 1) END AS int) AS _m",
        )
    )
    start = f"(cast(min_key AS {_WIDE}) + chunk_id * (_width + 1))"
    hi = (
        f"CASE WHEN min_key IS NULL OR chunk_id = _n - 1 THEN max_key "
        f"ELSE cast(least({start} + _width, cast(max_key AS {_WIDE})) AS bigint) END"
    )
    return _finish(_explode_chunks(planned, "_m"), f"cast({start} AS bigint)", hi, "true")


def time_ranges(
    profile: DataFrame, policy: Policy = Policy(), chunks: Column | None = None
) -> DataFrame:
    """Half-open ranges ``[lo, hi)`` in microseconds; the last one is closed."""
    if chunks is None:
        chunks = _wanted_chunks(policy, policy.time_tiers, False)
    planned = (
        _of_types(profile, TIME_TYPES)
        .withColumn("_n", chunks)
        .selectExpr("*", "max_key - min_key AS _span")
        .selectExpr("*", "greatest(1L, _span div greatest(_n, 1)) AS _step")
        .selectExpr(
            "*",
            f"cast(CASE WHEN {_ONLY_NULLS} THEN 1 "
            "ELSE least(_n, _span div _step + 1) END AS int) AS _m",
        )
    )
    hi = f"CASE WHEN {_LAST} THEN max_key ELSE min_key + (chunk_id + 1) * _step END"
    return _finish(_explode_chunks(planned, "_m"), "min_key + chunk_id * _step", hi, _LAST)


def real_ranges(
    profile: DataFrame, policy: Policy = Policy(), chunks: Column | None = None
) -> DataFrame:
    """Half-open ranges for fractional columns; the last one is closed."""
    if chunks is None:
        chunks = _wanted_chunks(policy, policy.numeric_tiers, True)
    not_real = ", ".join(repr(t) for t in (*WHOLE_TYPES, *TIME_TYPES))
    planned = (
        profile.where(f"data_type NOT IN ({not_real}) AND total_count > 0")
        .withColumn("_n", chunks)
        .selectExpr("*", "(max_real - min_real) / greatest(_n, 1) AS _step")
        # One chunk when all values are equal, or the bounds are infinite or not numbers.
        .selectExpr(
            "*",
            "CASE WHEN _step > 0 AND _step < double('Infinity') THEN _n ELSE least(_n, 1) END AS _m",
        )
    )
    lo = "CASE WHEN chunk_id = 0 THEN min_real ELSE min_real + chunk_id * _step END"
    hi = f"CASE WHEN {_LAST} THEN max_real ELSE min_real + (chunk_id + 1) * _step END"
    return _finish(_explode_chunks(planned, "_m"), lo, hi, _LAST)


def simple_ranges(profile: DataFrame, count: Column) -> DataFrame:
    """Plain division into ``count`` closed ranges, first one a key wider than the rest."""
    planned = (
        _of_types(profile, WHOLE_TYPES)
        .where("min_key IS NOT NULL")
        .withColumn("_m", count.cast("int"))
        .selectExpr(
            "*",
            f"cast(floor((cast(max_key AS {_WIDE}) - cast(min_key AS {_WIDE})) / _m) AS {_WIDE}) AS _width",
        )
    )
    first, end = "cast(min_key AS {w}) + chunk_id * _width", "cast(min_key AS {w}) + (chunk_id + 1) * _width"
    lo = f"CASE WHEN chunk_id = 0 THEN min_key ELSE cast({first.format(w=_WIDE)} + 1 AS bigint) END"
    hi = f"CASE WHEN {_LAST} THEN max_key ELSE cast({end.format(w=_WIDE)} AS bigint) END"
    return _finish(_explode_chunks(planned, "_m"), lo, hi, "true").where("lo <= hi")


def fallback_chunk_count(target_rows: int, least_keys: int = 1_000_000) -> Column:
    """Chunk count from the key span alone, when the row count is unknown."""
    span = f"(cast(max_key AS {_WIDE}) - cast(min_key AS {_WIDE}))"
    return F.expr(
        f"cast(greatest(1, least(50, floor({span} / {max(least_keys, target_rows)}))) AS int)"
    )


def key_between_ranges(profile: DataFrame, chunk_rows: int) -> DataFrame:
    """Equal key steps for BETWEEN clauses. The last chunk reaches the largest key."""
    span = f"(cast(max_key AS {_WIDE}) - cast(min_key AS {_WIDE}))"
    planned = (
        _of_types(profile, WHOLE_TYPES)
        .where("min_key IS NOT NULL")
        .selectExpr(
            "*",
            f"cast(greatest(1, floor(({span} + 1) / (total_count div {chunk_rows} + 1))) AS {_WIDE}) AS _step",
        )
        .selectExpr(
            "*",
            f"cast(least((total_count + {chunk_rows - 1}) div {chunk_rows}, "
            f"{span} div _step + 1) AS int) AS _m",
        )
    )
    start = f"cast(min_key AS {_WIDE}) + chunk_id * _step"
    hi = f"CASE WHEN {_LAST} THEN max_key ELSE cast({start} + _step - 1 AS bigint) END"
    return _finish(_explode_chunks(planned, "_m"), f"cast({start} AS bigint)", hi, "true")


def offset_chunks(tables: DataFrame, page_rows: int) -> DataFrame:
    """Pages of ``page_rows`` rows; the last one is short. Input: table_name, row_count."""
    planned = tables.selectExpr(
        "*", f"cast((row_count + {page_rows - 1}) div {page_rows} AS int) AS _m"
    )
    first = f"chunk_id * {page_rows}L"
    return _explode_chunks(planned, "_m").selectExpr(
        "table_name", "chunk_id", f"{first} AS row_offset",
        f"least({page_rows}L, row_count - {first}) AS row_limit",
    )


def quantile_starts(
    df: DataFrame, column: str, chunks: int, accuracy: int = 10_000, exact: bool = False
) -> list:
    """Inner boundaries that balance the rows (``chunks - 1`` values or fewer).

    The sketch takes one pass and is off by ``rows / accuracy``; ``exact`` sorts the one
    column over all executors instead and picks the values at their positions.
    """
    if chunks < 2:
        return []
    filled = df.select(column).where(f"`{column}` IS NOT NULL")
    if not exact:
        shares = ", ".join(f"{i / chunks}D" for i in range(1, chunks))
        sketch = f"approx_percentile(`{column}`, array({shares}), {accuracy}) AS q"
        return sorted(set(filled.selectExpr(sketch).first()["q"] or []))
    rows, placed = filled.count(), with_positions(filled, [column])
    wanted = sorted({max(0, -(-rows * i // chunks) - 1) for i in range(1, chunks)}) if rows else []
    found = placed.where(F.col("position").isin(wanted)).select(column).distinct().collect()
    return sorted(r[0] for r in found)


@dataclass(frozen=True)
class RangePlan:
    """One table's chunks. ``starts`` holds the first key of chunks 1, 2, ...;
    a row belongs to the last chunk whose start is not above it."""

    table: str
    column: str
    spark_type: str
    starts: tuple
    low: object = None
    step: int | None = None
    rows: int | None = None
    nulls: int | None = None

    @property
    def chunks(self) -> int:
        return 0 if self.rows == 0 else len(self.starts) + 1

    @property
    def is_time(self) -> bool:
        return self.spark_type in ("date", "timestamp", "timestamp_ntz")

    @property
    def _name(self) -> str:
        return quoted(self.column)

    def key(self) -> Column:
        """The column as the number the plan was made with."""
        return F.expr(self._key_sql())

    def _key_sql(self) -> str:
        return f"({micros_sql(self._name, self.spark_type)})" if self.is_time else self._name

    def chunk_id(self) -> Column:
        """Chunk of a row: closed form for equal steps, binary search otherwise."""
        return F.expr(self.chunk_sql())

    def chunk_sql(self) -> str:
        if not self.starts:
            return "0"
        if self.step is None:
            found = self._search(0, len(self.starts)) if len(self.starts) < 256 else self._search_list()
            return f"CASE WHEN {self._name} IS NULL THEN 0 ELSE {found} END"
        # Rows beyond the profiled bounds stay in the outer chunks, so the difference
        # below never overflows.
        if self.starts[-1] - self.low < 2**63:
            place = f"({self._key_sql()} - {self._number(self.low)}) div {self._number(self.step)}"
        else:
            wide = f"cast({self._key_sql()} AS {_WIDE}) - {self.low}BD"
            place = f"({wide}) div {self.step}BD"
        return (
            f"CASE WHEN {self._name} IS NULL OR {self._name} < {self._literal_sql(self.starts[0])} THEN 0 "
            f"WHEN {self._name} >= {self._literal_sql(self.starts[-1])} THEN {len(self.starts)} "
            f"ELSE cast({place} AS int) END"
        )

    def _search(self, first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        return (
            f"CASE WHEN {self._name} < {self._literal_sql(self.starts[middle])} "
            f"THEN {self._search(first, middle)} ELSE {self._search(middle + 1, last)} END"
        )

    def _search_list(self) -> str:
        """SQL: binary search over one literal list, whatever its length. Starts of a chunk plan
        stand in the list as texts that are cast once."""
        values = ", ".join(self._literal_sql(s) for s in self.starts)
        halves = ", ".join(str(1 << b) for b in range(len(self.starts).bit_length() - 1, -1, -1))
        step = f"CASE WHEN get(array({values}), p + h - 1) <= {self._name} THEN p + h ELSE p END"
        return f"aggregate(array({halves}), 0, (p, h) -> {step})"

    @staticmethod
    def _number(key: int) -> str:
        # The smallest 64-bit number has no literal of its own.
        return f"{key}L" if key > -(2**63) else f"({key + 1}L - 1L)"

    def _literal_sql(self, key) -> str:
        if self.is_time:
            return f"cast('{self.text(key)}' AS {self.spark_type})"
        if isinstance(key, int):
            return f"cast({self._number(key)} AS {self.spark_type})"
        return f"cast('{key!r}' AS {self.spark_type})"

    def literal(self, key) -> Column:
        """A key as a literal of the column's own type, so that filters reach the scan."""
        return F.expr(self._literal_sql(key))

    def text(self, key) -> str:
        """ISO text of a key (dates: the first day that is not below the key)."""
        if self.spark_type == "date":
            return str(date(1970, 1, 1) + timedelta(days=-(-key // DAY_MICROS)))
        moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=key)
        zone = "+00:00" if self.spark_type == "timestamp" else ""
        return moment.strftime("%Y-%m-%d %H:%M:%S.%f") + zone

    def predicate(self, chunk: int) -> Column:
        """Filter of one chunk; outer chunks are open, the first one takes the NULLs."""
        return self.span(chunk, chunk)

    def span(self, first: int, last: int) -> Column:
        """Filter of consecutive chunks, as one range."""
        parts = []
        if first > 0:
            parts.append(f"{self._name} >= {self._literal_sql(self.starts[first - 1])}")
        if last < len(self.starts):
            parts.append(f"{self._name} < {self._literal_sql(self.starts[last])}")
        text = " AND ".join(parts) or "true"
        return F.expr(f"({text}) OR {self._name} IS NULL" if first == 0 and parts else text)

    def sql_predicates(self) -> list[str]:
        """The same filters as SQL text for a database, one per chunk."""
        name = '"' + self.column.replace('"', '""') + '"'

        def value(key):
            if not self.is_time:
                return str(key)
            word = "DATE" if self.spark_type == "date" else "TIMESTAMP"
            if self.spark_type == "timestamp":
                word = "TIMESTAMP WITH TIME ZONE"
            return f"{word} '{self.text(key)}'"

        out = []
        for chunk in range(self.chunks):
            parts = []
            if chunk > 0:
                parts.append(f"{name} >= {value(self.starts[chunk - 1])}")
            if chunk < len(self.starts):
                parts.append(f"{name} < {value(self.starts[chunk])}")
            text = " AND ".join(parts) or "1 = 1"
            out.append(f"({text}) OR {name} IS NULL" if chunk == 0 and parts else text)
        return out

    def as_dict(self) -> dict:
        """What a resumed export compares to make sure that the plan is the same."""
        return {
            "table": self.table, "column": self.column, "spark_type": self.spark_type,
            "starts": [str(s) for s in self.starts],
        }


def range_plan(
    df: DataFrame, best: DataFrame, policy: Policy = Policy(), table: str = "table"
) -> RangePlan | None:
    """Plan for ``df`` from its best range column, or None when it has none.

    Collects one profile row and the plan itself: a number per chunk.
    """
    row = best.first()
    if row is None:
        return None
    types = dict(df.dtypes)
    spark_type = types[row["column_name"]]
    one = df.sparkSession.createDataFrame([row], best.schema)  # no second scan
    if row["data_type"] in WHOLE_TYPES:
        ranges = numeric_ranges(one, policy)
    elif row["data_type"] in TIME_TYPES:
        ranges = time_ranges(one, policy)
    else:
        ranges = real_ranges(one, policy)
    found = ranges.orderBy("chunk_id").select("lo").collect()
    starts = tuple(r["lo"] for r in found[1:])
    equal_steps = row["data_type"] in WHOLE_TYPES + TIME_TYPES and len(found) > 1
    return RangePlan(
        table=table,
        column=row["column_name"],
        spark_type=spark_type,
        starts=starts,
        low=found[0]["lo"] if found else None,
        step=starts[0] - found[0]["lo"] if equal_steps else None,
        rows=row["total_count"],
        nulls=row["null_count"],
    )


def quantile_plan(
    df: DataFrame, column: str, chunks: int, accuracy: int = 10_000, table: str = "table",
    exact: bool = False,
) -> RangePlan:
    """A plan with balanced chunks instead of equal widths, against skewed values."""
    spark_type = dict(df.dtypes)[column]
    plan = RangePlan(table=table, column=column, spark_type=spark_type, starts=())
    keys = df.select(plan.key().alias("k"))
    starts = quantile_starts(keys, "k", chunks, accuracy, exact)
    return RangePlan(table=table, column=column, spark_type=spark_type, starts=tuple(starts))
