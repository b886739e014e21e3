"""Hashes over whole rows, and names and texts put into SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str, mark: str = "`") -> str:
    """A column name as SQL, whatever it contains."""
    return mark + name.replace(mark, mark * 2) + mark


def literal(text: str) -> str:
    """A text as SQL."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def row_hash(columns: list[str], types: dict[str, str] | None = None) -> Column:
    """128 bits over a row. The NULL pattern is hashed too, because the hash functions
    skip NULLs and would not see a value that moved to the neighbouring column. Maps are
    hashed as their sorted entries; ``types`` tells which columns are maps."""
    names = [quoted(name) for name in columns]
    kinds = [(types or {}).get(name, "") for name in columns]
    values = [
        f"array_sort(map_entries({n}))" if kind.startswith("map<") else n
        for n, kind in zip(names, kinds)
    ]
    nulls = "concat(" + ", ".join(f"if({n} IS NULL, '1', '0')" for n in names) + ")"
    forward, backward = ", ".join([nulls, *values]), ", ".join([*reversed(values), nulls, "1"])
    return F.expr(f"struct(xxhash64({forward}) AS a, xxhash64({backward}) AS b)")
