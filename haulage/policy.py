"""Every threshold in one place, so that a test can scale all of them together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Tier:
    """Limits that hold for tables with more than ``above`` rows."""

    above: int
    max_chunks: int
    floor_rows: int


@dataclass(frozen=True)
class SizeTier:
    """Chunk sizing for tables with more than ``above`` rows."""

    above: int
    chunks_per_worker: int
    max_chunks: int
    min_rows: int


# Results depend on these numbers, so they are stated as they are.
NUMERIC_TIERS = (
    Tier(1_000_000_000, 200, 5_000_000),
    Tier(500_000_000, 150, 3_000_000),
    Tier(100_000_000, 100, 2_000_000),
    Tier(10_000_000, 80, 1_000_000),
    Tier(0, 50, 500_000),
)
TIME_TIERS = (
    Tier(1_000_000_000, 200, 2_000_000),
    Tier(100_000_000, 75, 1_000_000),
    Tier(0, 50, 100_000),
)
SIZE_TIERS = (
    SizeTier(1_000_000_000, 4, 200, 5_000_000),
    SizeTier(100_000_000, 3, 100, 2_000_000),
    SizeTier(0, 2, 50, 1_000_000),
)
WORKER_TIERS = ((500_000_000, 16), (100_000_000, 12), (10_000_000, 8), (0, 6))
CATEGORY_TIERS = (
    (1_000_000_000, "ultra-massive"),
    (500_000_000, "massive"),
    (100_000_000, "large"),
    (10_000_000, "medium-large"),
    (0, "medium"),
)
RATING_TIERS = ((20_000, "excellent"), (10_000, "good"), (5_000, "fair"), (1_000, "slow"))
# End of fixed values.


def _tiers_scaled(tiers, factor):
    """Divide the row thresholds of a tier table, leaving the counts alone."""
    out = []
    for tier in tiers:
        changes = {"above": tier.above // factor}
        for name in ("floor_rows", "min_rows"):
            if hasattr(tier, name):
                changes[name] = max(1, getattr(tier, name) // factor)
        out.append(replace(tier, **changes))
    return tuple(out)


@dataclass(frozen=True)
class Policy:
    target_chunk_rows: int = 1_000_000
    numeric_tiers: tuple[Tier, ...] = NUMERIC_TIERS
    time_tiers: tuple[Tier, ...] = TIME_TIERS
    # Most rows and megabytes of a chunk. Where one is given, it decides, and a large table gets as
    # many chunks as that takes; the tiers with their caps are the compatible default.
    chunk_rows: int | None = None
    chunk_mb: int | None = None

    # Chunk sizing (rows)
    size_tiers: tuple[SizeTier, ...] = SIZE_TIERS
    chunk_alignment: int = 100_000
    min_chunk_rows: int = 2_000_000
    max_chunk_rows: int = 20_000_000
    workers: int = 8
    cpu_count: int = 16

    # Method choice (rows)
    small_table_rows: int = 500_000
    range_preferred_rows: int = 10_000_000
    offset_slow_rows: int = 50_000_000
    offset_very_slow_rows: int = 100_000_000
    cursor_rows: int = 5_000_000
    stream_chunk_above_rows: int = 20_000_000
    stream_chunk_below_rows: int = 100_000_000
    stream_chunk_rows: int = 10_000_000
    single_file_rows: int = 20_000_000

    # Output
    bytes_per_row: int = 500
    target_file_mb: int = 400
    hard_max_file_mb: int = 2_048
    max_files_per_table: int = 200
    memory_cap_mb: int = 2_048

    # Profiling
    dense_above: float = 0.5
    max_null_share: float = 0.2

    # Cleaning and monitoring
    max_text_chars: int = 5_000
    slow_chunk_seconds: int = 30
    throughput_window_seconds: int = 60

    def rows_in_chunk(self, bytes_per_row: float | None = None) -> int | None:
        """Most rows of a chunk by the stated limits; None if the tiers decide."""
        limits = []
        if self.chunk_rows:
            limits.append(self.chunk_rows)
        if self.chunk_mb:
            limits.append(int(self.chunk_mb * 1024 * 1024 / max(bytes_per_row or self.bytes_per_row, 1.0)))
        return max(1, min(limits)) if limits else None

    def scaled(self, factor: int) -> "Policy":
        """The same policy for tables ``factor`` times smaller."""
        rows = (
            "target_chunk_rows", "chunk_alignment", "min_chunk_rows", "max_chunk_rows",
            "small_table_rows", "range_preferred_rows", "offset_slow_rows",
            "offset_very_slow_rows", "cursor_rows", "stream_chunk_above_rows",
            "stream_chunk_below_rows", "stream_chunk_rows", "single_file_rows",
        )
        changes = {name: max(1, getattr(self, name) // factor) for name in rows}
        return replace(
            self,
            numeric_tiers=_tiers_scaled(self.numeric_tiers, factor),
            time_tiers=_tiers_scaled(self.time_tiers, factor),
            size_tiers=_tiers_scaled(self.size_tiers, factor),
            **changes,
        )


CODECS = ("snappy", "zstd", "gzip", "lz4", "lz4_raw", "brotli", "none", "uncompressed")


@dataclass(frozen=True)
class ExportOptions:
    """Parquet writer settings. Row groups are sized in bytes, as Parquet does."""

    codec: str = "snappy"
    level: int | None = None
    row_group_mb: int | None = None
    max_records_per_file: int | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec!r}; one of {', '.join(CODECS)}")
        if self.codec == "zstd" and self.level is not None and not 1 <= self.level <= 22:
            raise ValueError(f"zstd has levels 1 to 22, not {self.level}")
        for name in ("row_group_mb", "max_records_per_file"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be at least 1, not {value}")

    def as_writer_options(self) -> dict[str, str]:
        opts = {"compression": self.codec}
        if self.level is not None and self.codec == "zstd":
            opts["parquet.compression.codec.zstd.level"] = str(self.level)
        if self.row_group_mb is not None:
            opts["parquet.block.size"] = str(self.row_group_mb * 1024 * 1024)
        if self.max_records_per_file is not None:
            opts["maxRecordsPerFile"] = str(self.max_records_per_file)
        return {**opts, **{k: str(v) for k, v in self.extra.items()}}


# The named writer profiles.
EXPORT_PROFILES = {
    "default": ExportOptions("snappy"),
    "speed_optimized": ExportOptions("snappy"),
    "balanced": ExportOptions("zstd", 3),
    "space_optimized": ExportOptions("zstd", 9),
    "resumable": ExportOptions("zstd", 3, row_group_mb=50),
    "throughput": ExportOptions("zstd", 1, row_group_mb=512),
}
