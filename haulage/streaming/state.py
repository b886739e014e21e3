"""Current state as a table that streams write to: keyed rows in buckets, compacted as it grows.

A micro-batch adds its changed rows as a delta. After every few batches the buckets that the
deltas touch are rewritten with the newest version of each row, so a read meets one version
per key and a few deltas, however long the stream has run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.rows import quoted
from haulage.session import child_names, path_exists, remove, write_text

BUCKETS, EVERY = 16, 10
_BUCKET, _VERSION = "_bucket", "_version"


class StateTable:
    """Rows by ``keys`` below ``path``; ``by`` (some of the keys) tells the bucket.

    ``base/v=N/_bucket=B`` holds bucket B as of batch N, ``delta/batch_id=N`` what batch N
    changed, and ``pointer/pointer.json`` which version of each bucket counts. It is replaced
    in one step after a compaction is complete. What it no longer names stays until the
    following compaction, for readers that have begun.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], by: list[str] | None = None,
        buckets: int = BUCKETS, every: int = EVERY,
    ):
        self.spark, self.path, self.keys = spark, path, keys
        self.by, self.buckets, self.every = by or keys, buckets, every

    def _pointer(self) -> dict:
        """``upto``: last batch that is compacted; ``base``: version by bucket; the schema."""
        if not path_exists(self.spark, f"{self.path}/pointer/pointer.json"):
            return {"upto": -1, "before": -1, "base": {}, "schema": None}
        rows = self.spark.read.text(f"{self.path}/pointer").collect()
        return json.loads("".join(r["value"] for r in rows))

    def _deltas(self, after: int) -> dict[int, str]:
        names = [n for n in child_names(self.spark, f"{self.path}/delta") if n.startswith("batch_id=")]
        found = {int(n.split("=")[1]): f"{self.path}/delta/{n}" for n in names}
        # A batch that was cut short has no success mark and is written again.
        return {n: p for n, p in sorted(found.items()) if n > after and path_exists(self.spark, f"{p}/_SUCCESS")}

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in self.by]), F.lit(self.buckets)).cast("int")

    def _folders(self, pointer: dict, only: set[int] | None = None) -> list[str]:
        """Folders that make up the buckets now."""
        wanted = lambda b: only is None or b in only
        out = [f"{self.path}/base/v={v}/{_BUCKET}={b}" for b, v in pointer["base"].items() if wanted(int(b))]
        for delta in self._deltas(pointer["upto"]).values():
            out.extend(f"{delta}/{_BUCKET}={b}" for b in sorted(self._touched([delta])) if wanted(b))
        return out

    def _touched(self, folders: list[str]) -> set[int]:
        names = [n for f in folders for n in child_names(self.spark, f)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")}

    def _newest(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        version = F.regexp_extract(F.col("_metadata.file_path"), "/(?:v|batch_id)=([0-9]+)/", 1).cast("bigint")
        rows = self.spark.read.schema(schema).parquet(*folders).withColumn(_VERSION, version)
        rest = [quoted(c) for c in schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*rest), _VERSION)
        keys = [quoted(k) for k in self.keys]
        return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*map(quoted, schema.names))

    def upsert(self, rows: DataFrame, batch_id: int) -> set[int]:
        """Add a batch's rows, one per key; a repeated batch replaces itself. Returns the
        buckets that it touches."""
        delta = f"{self.path}/delta/batch_id={batch_id}"
        pointer = self._pointer()
        if batch_id <= pointer["upto"]:  # compacted already: the stream repeats its last batch
            return self._touched([delta]) or set(range(self.buckets))
        rows.withColumn(_BUCKET, self._bucket()).write.mode("overwrite").partitionBy(_BUCKET).parquet(delta)
        if pointer["schema"] is None:
            self._point({**pointer, "schema": rows.schema.json()})
        if batch_id - pointer["upto"] >= self.every:
            self.compact(batch_id)
        return self._touched([delta])

    def compact(self, upto: int) -> None:
        """Rewrite the buckets that deltas have touched. Other buckets keep their version."""
        pointer = self._pointer()
        deltas = [p for n, p in self._deltas(pointer["upto"]).items() if n <= upto]
        touched = self._touched(deltas)
        if touched:
            schema = T.StructType.fromJson(json.loads(pointer["schema"]))
            rows = self._newest(self._folders(pointer, touched), schema).withColumn(_BUCKET, self._bucket())
            rows.repartition(len(touched), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(
                f"{self.path}/base/v={upto}"
            )
        base = {**pointer["base"], **{str(b): upto for b in touched}}
        self._point({**pointer, "upto": upto, "before": pointer["upto"], "base": base})
        self._forget(pointer, base)

    def _forget(self, before: dict, base: dict) -> None:
        """Remove what neither this nor the last pointer names."""
        kept = {*base.values(), *before["base"].values()}
        for name in child_names(self.spark, f"{self.path}/base"):
            if int(name.split("=")[1]) not in kept:
                remove(self.spark, f"{self.path}/base/{name}")
        for name in child_names(self.spark, f"{self.path}/delta"):
            if int(name.split("=")[1]) <= before["upto"]:
                remove(self.spark, f"{self.path}/delta/{name}")

    def _point(self, pointer: dict) -> None:
        write_text(self.spark, f"{self.path}/pointer/pointer.json", json.dumps(pointer))

    def read(self, only: set[int] | None = None) -> DataFrame:
        """Newest version of each row, of some buckets or of all."""
        pointer = self._pointer()
        if pointer["schema"] is None:
            raise ValueError(f"nothing was written to {self.path}")
        schema = T.StructType.fromJson(json.loads(pointer["schema"]))
        return self._newest(self._folders(pointer, only), schema)
