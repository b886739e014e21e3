"""The state table of streams: reads stay small, repeated and cut batches do no harm."""

import shutil

import pytest

from haulage.session import scratch, new_dir, path_exists
from haulage.streaming.state import StateTable


def rows(spark, batch, keys=40):
    """Each batch changes a fourth of the keys."""
    return spark.range(keys).where(f"id % 4 = {batch % 4}").selectExpr("id AS job", "id % 3 AS t", f"{batch} AS v")


def read_rows(spark, table):
    """Rows that a read goes through, whatever it keeps."""
    folders = table._folders(table._pointer())
    return spark.read.parquet(*folders).count()


def test_reads_do_not_grow(spark, tmp_path):
    table, seen = StateTable(spark, str(tmp_path / "s"), ["job", "t"], by=["job"], buckets=2, every=5), []
    for batch in range(45):
        table.upsert(rows(spark, batch), batch)
        if batch >= 5:
            seen.append(read_rows(spark, table))
    assert max(seen[20:]) <= max(seen[:20]) <= 40 + 5 * 10
    got = {r["job"]: r["v"] for r in table.read().collect()}
    assert got == {k: max(b for b in range(45) if b % 4 == k % 4) for k in range(40)}
    kept = [p for p in (tmp_path / "s" / "delta").iterdir() if p.name.startswith("batch_id=")]
    assert len(kept) <= 10 and len(list((tmp_path / "s" / "base").iterdir())) <= 3


def test_only_wanted_buckets_are_read(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), ["job", "t"], by=["job"], buckets=8, every=2)
    for batch in range(4):
        table.upsert(rows(spark, batch), batch)
    touched = table.upsert(spark.createDataFrame([(7, 1, 99)], "job long, t long, v int"), 4)
    assert len(touched) == 1
    found = {r["job"]: r["v"] for r in table.read(touched).collect()}
    assert found[7] == 99 and len(found) < 40


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), ["job", "t"], every=2)
    for batch in (0, 1, 1, 2, 2, 3, 3):
        table.upsert(rows(spark, batch), batch)
    assert {r["job"]: r["v"] for r in table.read().collect()} == {k: k % 4 for k in range(40)}


def test_a_cut_compaction_is_done_again(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "s"), ["job", "t"], every=3)
    for batch in range(2):
        table.upsert(rows(spark, batch), batch)
    with monkeypatch.context() as m:
        m.setattr(table, "_point", lambda pointer: (_ for _ in ()).throw(OSError("cut")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, 2), 2)
    assert {r["job"] for r in table.read().collect()} == {k for k in range(40) if k % 4 < 3}
    table.upsert(rows(spark, 2), 2)
    assert table._pointer()["upto"] == 2
    assert {r["job"]: r["v"] for r in table.read().collect()} == {k: k % 4 for k in range(40) if k % 4 < 3}


def test_a_cut_delta_does_not_count(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), ["job", "t"])
    table.upsert(rows(spark, 0), 0)
    shutil.copytree(tmp_path / "s" / "delta" / "batch_id=0", tmp_path / "s" / "delta" / "batch_id=1")
    (tmp_path / "s" / "delta" / "batch_id=1" / "_SUCCESS").unlink()
    assert len(table._deltas(-1)) == 1
    with pytest.raises(ValueError, match="nothing"):
        StateTable(spark, str(tmp_path / "none"), ["job"]).read()


def test_scratch_is_removed(spark):
    with scratch(spark):
        path = new_dir(spark, "x")
        spark.range(3).write.parquet(path)
        with scratch(spark):
            inner = new_dir(spark, "y")
            spark.range(3).write.parquet(inner)
        assert not path_exists(spark, inner) and path_exists(spark, path)
    assert not path_exists(spark, path)
