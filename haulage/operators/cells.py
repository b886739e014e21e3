"""A total order cut into cells by literals.

A sample of the keys gives splitters, which become literals of the query. Which cell a row
falls into then depends on the row alone: tasks that run again place it alike, and cells can
be counted in one pass and shuffled in another, without a written copy in between.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.rows import quoted, row_hash

TARGET_ROWS = 1_000_000  # rows of a cell, as long as there are fewer than MAX_SPLITTERS
LEAST_ROWS = 10_000  # rows of a cell that are worth a task of their own
MAX_SPLITTERS = 4_095
SAMPLED = 32  # keys that are sampled for one splitter, so at most 131,040 reach the driver
PREFIX = 256  # characters of a sampled text; any value can be a splitter
MAX_BITS = 12
CELL = "_cell"
TIES = ["_tie_a", "_tie_b"]
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def with_ties(df: DataFrame) -> DataFrame:
    """``df`` plus a 128-bit hash of the row, which tells rows with equal keys apart."""
    return df.withColumn("_tie", row_hash(df.columns, dict(df.dtypes))).selectExpr(
        *[quoted(c) for c in df.columns], "_tie.a AS _tie_a", "_tie.b AS _tie_b"
    )


def numbers(values: list[int]) -> Column:
    """An array literal, cheap to build whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


@dataclass(frozen=True)
class Splitters:
    """Ascending keys as JSON texts, for rows ordered by the columns ``order``."""

    order: tuple[str, ...]
    kinds: tuple[str, ...]
    keys: tuple[str, ...]

    def key(self) -> Column:
        return F.struct(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(self.order)])

    @property
    def _schema(self) -> str:
        return "struct<" + ", ".join(f"k{i}: {kind}" for i, kind in enumerate(self.kinds)) + ">"

    def parsed(self, text: Column) -> Column:
        return F.from_json(text, self._schema, _JSON)

    def literal(self, index: int) -> Column:
        return self.parsed(F.lit(self.keys[index]))

    def bucket(self) -> Column:
        """``2 i`` for rows between splitters ``i`` and ``i + 1``, ``2 i - 1`` for rows equal to
        splitter ``i`` (the first is 1), found by a binary search over one literal."""
        if not self.keys:
            return F.lit(0)
        listed = F.from_json(F.lit("[" + ",".join(self.keys) + "]"), f"array<{self._schema}>", _JSON)
        halves = [1 << b for b in range(len(self.keys).bit_length() - 1, -1, -1)]

        def search(key: Column) -> Column:
            def step(found: Column, half: Column) -> Column:
                return F.when(F.get(listed, found + half - 1) <= key, found + half).otherwise(found)

            place = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)
            return F.transform(
                F.array(place),
                lambda p: 2 * p - F.when((p > 0) & F.get(listed, p - 1).eqNullSafe(key), 1).otherwise(0),
            )[0]

        return F.transform(F.array(self.key()), search)[0]  # the key is built once

    def within(self, first: int, last: int) -> Column:
        """Rows of consecutive buckets. The leading column is compared on its own as well, so
        that the filter reaches the scan."""
        lead, found = F.col(quoted(self.order[0])), F.lit(True)
        if first > 0:
            low = self.literal((first - 1) // 2)
            found = found & (self.key() >= low if first % 2 else self.key() > low)
            if json.loads(self.keys[(first - 1) // 2]).get("k0") is not None:
                found = found & (lead >= low["k0"])
        if last < 2 * len(self.keys):
            high = self.literal(last // 2)
            found = found & (self.key() <= high if last % 2 else self.key() < high)
            null = json.loads(self.keys[last // 2]).get("k0") is None
            found = found & (lead.isNull() if null else lead.isNull() | (lead <= high["k0"]))
        return found


def splitters(df: DataFrame, order: list[str], count: int, rows: int) -> Splitters:
    """About ``count`` splitters that cut ``rows`` rows into like parts, fewer where keys repeat."""
    kinds = dict(df.dtypes)
    count = min(count, MAX_SPLITTERS)
    plain = Splitters(tuple(order), tuple(kinds[c] for c in order), ())
    if count < 1 or rows < 2:
        return plain
    short = [
        F.substring(F.col(quoted(c)), 1, PREFIX).alias(f"k{i}")
        if kinds[c] in ("string", "binary") else F.col(quoted(c)).alias(f"k{i}")
        for i, c in enumerate(order)
    ]
    keys, share = df.select(*short), SAMPLED * count / rows
    if share < 1:
        keys = keys.sample(fraction=share, seed=7)
    key = F.struct(*keys.columns).alias("key")
    found = [r["key"] for r in keys.select(key).orderBy("key").select(F.to_json("key", _JSON).alias("key")).collect()]
    picked = [found[len(found) * i // (count + 1)] for i in range(1, count + 1)] if found else []
    return Splitters(plain.order, plain.kinds, tuple(dict.fromkeys(picked)))


@dataclass(frozen=True)
class Cells:
    """Cells in order with their rows. Buckets of one repeated key are cut by the row's hash."""

    splitters: Splitters
    first: list[int]  # first cell of each bucket
    bits: dict[int, int]  # bits of the hash that cut a bucket
    counts: list[int]  # rows of each cell
    copies: list[int] = field(default_factory=list)  # cells in which copies of rows pile up

    def cell(self) -> Column:
        """The cell of a row with ties, as a number that follows the order."""
        bucket = self.splitters.bucket()
        if not self.bits:
            return F.get(numbers(self.first), bucket).cast("int")

        def placed(b: Column) -> Column:
            part = F.lit(0).cast("bigint")
            for bits in sorted(set(self.bits.values())):
                cut = F.shiftright(F.col(TIES[0]), 64 - bits) + F.lit(1 << (bits - 1))
                part = F.when(b.isin([k for k, v in self.bits.items() if v == bits]), cut).otherwise(part)
            return F.get(numbers(self.first), b) + part

        return F.transform(F.array(bucket), placed)[0].cast("int")

    def offsets(self) -> list[int]:
        return [0, *accumulate(self.counts)][:-1]

    def joined(self) -> Cells:
        """Cells that are worth a task each: rows equal to a splitter join those that follow it,
        unless both are many."""
        limit = 2 * max(sum(self.counts) // (len(self.splitters.keys) + 1), 1)
        first, counts, copies = [], [], []
        for b, cell in enumerate(self.first):
            rows = self.counts[cell]
            if b and b % 2 == 0 and b - 1 not in self.bits and counts[-1] + rows <= limit:
                first.append(len(counts) - 1)
                counts[-1] += rows
                continue
            first.append(len(counts))
            parts = range(cell, cell + (1 << self.bits.get(b, 0)))
            copies.extend(len(counts) + p - cell for p in parts if p in self.copies)
            counts.extend(self.counts[p] for p in parts)
        return Cells(self.splitters, first, self.bits, counts, copies)


def cells(
    tied: DataFrame, order: list[str], target_rows: int = TARGET_ROWS, rows: int | None = None
) -> Cells:
    """Cells of about ``target_rows`` rows in ``order``, told apart further by the row's hash.

    ``tied`` comes from :func:`with_ties`. One count, one sample of the keys, one count per
    bucket; and where a key holds more than two cells, one count of the hashes of its rows.
    Rows with equal hashes cannot be told apart; cells in which they pile up are in ``copies``.
    """
    spark = tied.sparkSession
    rows = tied.count() if rows is None else rows
    wanted = max(-(-rows // target_rows), min(4 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), 1)
    cut = splitters(tied, order, wanted - 1, rows)
    if not cut.keys:
        return Cells(cut, [0], {}, [rows])
    limit = 2 * max(rows // (len(cut.keys) + 1), 1)

    def counted(frame: DataFrame, **by: Column) -> dict:
        found = frame.select(*[c.alias(n) for n, c in by.items()]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return {tuple(r)[:-1]: r["n"] for r in found.collect()}

    buckets = {b: n for (b,), n in counted(tied, b=cut.bucket()).items()}
    hot = [b for b, n in buckets.items() if b % 2 and n > limit]
    bits = {b: min(MAX_BITS, (-(-buckets[b] // limit)).bit_length()) for b in hot}
    parts: dict[tuple[int, int], int] = {}
    if hot:
        most = max(bits.values())
        high = F.shiftright(F.col(TIES[0]), 64 - most) + F.lit(1 << (most - 1))
        for (b, part), n in counted(tied.where(cut.bucket().isin(hot)), b=cut.bucket(), part=high).items():
            place = (b, part >> (most - bits[b]))
            parts[place] = parts.get(place, 0) + n
    first, counts = [], []
    for b in range(2 * len(cut.keys) + 1):
        first.append(len(counts))
        counts.extend([parts.get((b, p), 0) for p in range(1 << bits[b])] if b in bits else [buckets.get(b, 0)])
    piled = [c for b in hot for c in range(first[b], first[b] + (1 << bits[b])) if counts[c] > limit]
    return Cells(cut, first, bits, counts, piled)
