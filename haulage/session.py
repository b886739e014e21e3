"""Session defaults, the shared scratch area and the few file-system calls we need."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "haulage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        # State of long streams outside the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    import tempfile

    folder = tempfile.mkdtemp(prefix="haulage-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_made = threading.local()


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/haulage/{label}-{uuid.uuid4().hex}"
    for made in getattr(_made, "paths", []):
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Folders that :func:`new_dir` names inside, on this thread, are removed at the end. For
    steps whose result is written or collected inside."""
    stack = _made.paths = getattr(_made, "paths", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage, survives lost executors, and later passes can prune columns.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and Path of ``path`` (works for any configured scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = filesystem(spark, path)
    return bool(fs.exists(hpath))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a directory; the target's parent is created and the target must be new."""
    fs, src = filesystem(spark, source)
    _, dst = filesystem(spark, target)
    if fs.exists(dst):
        raise FileExistsError(target)
    parent = dst.getParent()
    if not fs.exists(parent):
        fs.mkdirs(parent)
    if not fs.rename(src, dst):
        raise OSError(f"could not move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a directory and what is in it, if it is there."""
    fs, hpath = filesystem(spark, path)
    if fs.exists(hpath):
        fs.delete(hpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Directory entries right below ``path``; empty when it does not exist."""
    fs, hpath = filesystem(spark, path)
    if not fs.exists(hpath):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hpath)]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, complete once it is visible under its name."""
    folder, _, name = path.rpartition("/")
    fs, draft = filesystem(spark, f"{folder}/.{name}.writing")  # hidden from readers
    _, target = filesystem(spark, path)
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"could not write {path}")


class _Setting:
    """A session setting held at a value while at least one of several concurrent users needs
    it; what it was before comes back with the last of them."""

    def __init__(self, name: str):
        self.name, self.lock, self.users, self.before = name, threading.Lock(), 0, None

    @contextmanager
    def held(self, spark: SparkSession, value: str):
        with self.lock:
            if self.users == 0:
                self.before = spark.conf.get(self.name, None)
                spark.conf.set(self.name, value)
            self.users += 1
        try:
            yield
        finally:
            with self.lock:
                self.users -= 1
                if self.users == 0 and self.before is None:
                    spark.conf.unset(self.name)
                elif self.users == 0:
                    spark.conf.set(self.name, self.before)


_cleanup = _Setting("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
_advisory = _Setting("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def shuffles_removed(spark: SparkSession):
    """Writes inside free their shuffle files when they end: what was written replaces them.

    The setting is read when a write is planned; other queries that start meanwhile free
    theirs as well, which costs them at most a recomputation.
    """
    return _cleanup.held(spark, "true")


def target_partition_size(spark: SparkSession, megabytes: int):
    """Size that adaptive execution aims at while files are written."""
    return _advisory.held(spark, f"{max(1, megabytes)}m")
