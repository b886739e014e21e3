"""Exports survive checking; damage is found and named."""

import dataclasses
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haulage.operators import resume, verify
from haulage.operators.ledger import fold_jobs, fold_tables
from haulage.operators.profile import best_range_column, profile_columns
from haulage.plans.ranges import range_plan
from haulage.policy import ExportOptions, Policy
from haulage.session import written
from haulage.sinks import export, manifest, publish, resumable
from haulage.sinks.job import Ledger, export_job

SMALL = Policy().scaled(50_000)  # 20 rows per chunk


@pytest.fixture
def source(spark):
    # Coalesced rows with NULL keys and a key that holds a third of all rows.
    return written(
        spark.range(300).selectExpr(
            "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 77 ELSE id END AS k",
            "concat('row ', id) AS v", "id",
        ),
        "source",
    )


def planned(df, column="k"):
    best = best_range_column(profile_columns(df, "t", [column]), SMALL)
    return range_plan(df, best, SMALL, "t")


def parts(path):
    return sorted(p for p in Path(path).rglob("*.parquet") if not p.parent.name.startswith("_"))


def test_range_export_is_lossless(spark, source, tmp_path):
    plan, path = planned(source), str(tmp_path / "t")
    metadata = export.export_ranges(source, plan, path)
    assert metadata["total_rows"] == 300 and metadata["chunk_count"] == plan.chunks > 5
    back = manifest.read_export(spark, path)
    assert back.drop("chunk_id").exceptAll(source).count() == 0
    assert source.exceptAll(back.drop("chunk_id")).count() == 0
    counts = back.groupBy("chunk_id").agg(F.count("*").alias("rows"))
    verdict = verify.verify_totals(verify.verify_counts(verify.chunk_histogram(source, plan), counts))
    assert verdict.first()["passed"]


def test_hot_chunk_is_written_by_several_tasks(spark, tmp_path):
    """Two thirds of the rows have one key; its chunk is still split at the target size."""
    rows = spark.range(150_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN id ELSE 77 END AS k", "sha2(cast(id AS string), 512) AS v"
    )
    df = written(rows, "hot")
    plan, path = planned(df), str(tmp_path / "t")
    export.export_ranges(df, plan, path, policy=Policy(target_file_mb=1))
    files = manifest.read_files(spark, path).groupBy("chunk_id").count().collect()
    sizes = {r["chunk_id"]: r["count"] for r in files}
    assert sizes[0] >= 4 and manifest.load_metadata(spark, path)["total_rows"] == 150_000


def test_paged_export_has_full_pages(spark, source, tmp_path):
    path = str(tmp_path / "t")
    metadata = export.export_paged(source, ["k"], 70, path, "t")
    sizes = {r["chunk_id"]: r["count"] for r in manifest.read_export(spark, path).groupBy("chunk_id").count().collect()}
    assert sizes == {0: 70, 1: 70, 2: 70, 3: 70, 4: 20} and metadata["chunk_count"] == 5


def test_single_sized_and_capped(spark, source, tmp_path):
    export.export_single(source, str(tmp_path / "a"), "t", 300)
    assert len(parts(tmp_path / "a")) == 1
    export.export_sized(source, str(tmp_path / "b"), "t", 300, rows_in_file=100)
    assert len(parts(tmp_path / "b")) == 3
    export.export_capped(source.coalesce(1), str(tmp_path / "c"), "t", 80)
    rows = [r["row_count"] for r in manifest.read_files(spark, str(tmp_path / "c")).collect()]
    assert sorted(rows) == [60, 80, 80, 80]


def test_single_export_of_a_large_table_is_refused(spark, source, tmp_path):
    with pytest.raises(ValueError, match="too many"):
        export.export_single(source, str(tmp_path / "t"), "t", 300, policy=Policy(single_file_rows=100))


def test_wrong_totals_are_not_sealed(spark, source, tmp_path):
    half = source.where("k % 2 = 0")
    plan = planned(source)
    unknown = dataclasses.replace(plan, rows=None)
    attempts = {
        "single": lambda p: export.export_single(half, p, "t", 300),
        "sized": lambda p: export.export_sized(half, p, "t", 300),
        "capped": lambda p: export.export_capped(half, p, "t", 80, rows=300),
        "ranges": lambda p: export.export_ranges(half, plan, p),
    }
    for name, attempt in attempts.items():
        path = str(tmp_path / name)
        with pytest.raises(ValueError, match="expected"):
            attempt(path)
        assert manifest.load_metadata(spark, path) is None
    assert export.export_ranges(half, unknown, str(tmp_path / "q"))["total_rows"] == half.count()


def test_file_size_rule():
    policy = Policy()
    assert export.rows_per_file(1_000, 500, policy) == 838_860  # 400 MB
    assert export.rows_per_file(1_000_000_000, 500, policy) == 4_294_967  # 2 GB, not 200 files
    assert export.rows_per_file(200_000_000, 500, policy) == 1_000_000  # 200 files


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "k bigint, v string")
    path = str(tmp_path / "t")
    export.export_ranges(empty, planned(empty) or _no_plan(), path)
    back = manifest.read_export(spark, path)
    assert back.count() == 0 and back.columns == ["k", "v", "chunk_id"]


def _no_plan():
    from haulage.plans.ranges import RangePlan

    return RangePlan("t", "k", "bigint", starts=(), rows=0)


def test_reserved_column_is_refused(spark, tmp_path):
    df = spark.range(5).withColumn("chunk_id", F.lit(1))
    with pytest.raises(ValueError, match="chunk_id"):
        export.export_paged(df, ["id"], 2, str(tmp_path / "t"), "t")


def checksums(spark, path):
    found = verify.file_checksums(manifest.list_data_files(spark, path))
    return written(
        found.select(F.lit("t").alias("table_name"), "chunk_id", "file_path", "file_size", "checksum"),
        "checksums",
    )


def test_damage_is_named_and_resumed(spark, source, tmp_path):
    plan, path = planned(source), str(tmp_path / "t")
    export.export_ranges(source, plan, path)
    before = checksums(spark, path)
    ledger = before.select(
        "table_name", "chunk_id", F.lit("f").alias("file_name"), F.lit(0).alias("row_count"),
        "checksum", "file_size", F.lit(1).alias("completed_at"),
    )
    files = {int(p.parent.name.split("=")[1]): p for p in parts(path)}
    files[0].unlink()                                             # missing
    files[1].write_bytes(files[1].read_bytes()[:40])              # truncated
    files[2].write_bytes(files[3].read_bytes())                   # edited, still readable
    for crc in Path(path).rglob(".*.crc"):
        crc.unlink()

    verdicts = verify.verify_readable(manifest.list_data_files(spark, path)).collect()
    broken = {r["file_path"].split("chunk_id=")[1].split("/")[0] for r in verdicts if not r["readable"]}
    assert broken == {"1"}

    chunks = spark.range(plan.chunks).selectExpr("'t' AS table_name", "cast(id AS int) AS chunk_id")
    todo = resume.resume_plan(chunks, resume.chunk_ledger(ledger, ["completed_at"]), checksums(spark, path))
    assert sorted(r["chunk_id"] for r in todo.collect()) == [0, 1, 2]

    again = str(tmp_path / "again")
    export.export_ranges(source, plan, again, only=todo)
    redone = {r["chunk_id"]: r["count"] for r in manifest.read_export(spark, again).groupBy("chunk_id").count().collect()}
    wanted = {r["chunk_id"]: r["rows"] for r in verify.chunk_histogram(source, plan).collect()}
    assert redone == {i: n for i, n in wanted.items() if i in (0, 1, 2) and n}


def test_resume_writes_only_what_is_missing(spark, source, tmp_path):
    plan, path = planned(source), str(tmp_path / "t")
    resumable.resume_export(source, plan, path, waves=3)
    assert resumable.pending_chunks(spark, path, plan) == []
    files = {int(p.parent.name.split("=")[1]): p for p in parts(path)}
    kept = {i: p.stat().st_mtime_ns for i, p in files.items()}
    files[0].unlink()
    files[2].write_bytes(files[3].read_bytes())
    for crc in Path(path).rglob(".*.crc"):
        crc.unlink()
    assert resumable.pending_chunks(spark, path, plan) == [0, 2]
    resumable.resume_export(source, plan, path)
    now = {int(p.parent.name.split("=")[1]): p.stat().st_mtime_ns for p in parts(path)}
    assert {i for i in now if now[i] != kept[i]} == {0, 2}
    back = manifest.read_export(spark, path).drop("chunk_id")
    assert verify.reconcile_rows(source, back).count() == 0 and back.count() == 300
    with pytest.raises(ValueError, match="another plan"):
        resumable.resume_export(source, planned(source, "id"), path)


def test_duplicated_file_changes_the_counts(spark, source, tmp_path):
    plan, path = planned(source), str(tmp_path / "t")
    export.export_ranges(source, plan, path)
    first = parts(path)[0]
    shutil.copy(first, first.with_name("copy.parquet"))
    counts = manifest.read_export(spark, path).groupBy("chunk_id").agg(F.count("*").alias("rows"))
    compared = verify.verify_counts(verify.chunk_histogram(source, plan), counts)
    assert [r["chunk_id"] for r in compared.where("NOT passed").collect()] == [
        int(first.parent.name.split("=")[1])
    ]
    assert not verify.verify_totals(compared).first()["passed"]


def test_checksums_match_hashlib(spark, source, tmp_path):
    import hashlib

    path = str(tmp_path / "t")
    export.export_ranges(source, planned(source), path)
    found = {r["file_path"].split(":")[1].replace("///", "/"): r["checksum"] for r in checksums(spark, path).collect()}
    expected = {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in parts(path)}
    assert found == expected
    combined = verify.combined_checksum(checksums(spark, path)).first()
    order = sorted(expected, key=lambda p: int(p.split("chunk_id=")[1].split("/")[0]))
    assert combined["combined_checksum"] == hashlib.sha256(
        "".join(expected[p] for p in order).encode()
    ).hexdigest()


def test_gaps(spark):
    files = spark.createDataFrame(
        [("a", f"part_{i:04d}.parquet") for i in (1, 2, 4, 9)] + [("a", "notes.txt"), ("b", "part_0001.parquet")],
        "table_name string, file_name string",
    )
    plan = spark.createDataFrame([("a", 5), ("b", 1), ("c", 0)], "table_name string, chunk_count int")
    found = sorted((r["table_name"], r["chunk_number"], r["problem"]) for r in verify.verify_gaps(files, plan).collect())
    assert found == [("a", 3, "missing"), ("a", 5, "missing"), ("a", 9, "extra")]


def test_gaps_of_odd_rows_and_plan(spark):
    """Rows that repeat, null names, blocks' edges; chunks that the plan implies are not broadcast."""
    numbers = [0, 1, 63, 64, 65, 127, 128, 130, 2147483647]
    seen = [("a", n) for n in numbers] * 2 + [(None, 1), (None, 1), ("x", 5)]
    plan = [("a", 129), ("a", 129), ("a", 70), (None, 2), ("b", 64), ("b", 63), ("c", None), ("d", -1)]
    files = spark.createDataFrame([(t, f"part_{n:04d}.parquet") for t, n in seen], "table_name string, file_name string")
    planned = spark.createDataFrame(plan, "table_name string, chunk_count int")
    gaps = verify.verify_gaps(files, planned)
    have, due = set(seen), {(t, n) for t, c in plan if t and c for n in range(1, c + 1)}
    missing = [(t, n, "missing") for t, c in plan for n in range(1, (c or 0) + 1) if not t or (t, n) not in have]
    extra = [(t, n, "extra") for t, n in have if not t or (t, n) not in due]
    found = [tuple(r) for r in gaps.collect()]
    assert sorted(found, key=str) == sorted(missing + extra, key=str)
    assert gaps.dtypes == [("table_name", "string"), ("chunk_number", "int"), ("problem", "string")]
    large = spark.range(1000).selectExpr("cast(id AS string) AS table_name", "2000 AS chunk_count")
    plan_text = verify.verify_gaps(files, large)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan_text


def test_row_hash_sees_moved_nulls(spark):
    left = spark.createDataFrame([(1, None, "x"), (2, "a", "b")], "k int, p string, q string")
    right = spark.createDataFrame([(1, "x", None), (2, "a", "b")], "k int, p string, q string")
    found = {r["k"]: r["outcome"] for r in verify.reconcile(left, right, ["k"]).collect()}
    assert found == {1: "changed", 2: "same"}
    assert verify.reconcile_rows(left, right).count() == 2
    assert verify.verify_sample(left, left, ["k"], one_in=1).first()["passed"]
    half = verify.verify_sample(left, right, ["k"], one_in=2).first()
    assert half["sample_size"] <= 2


def test_publish_versions_and_refuses_unsealed(spark, source, tmp_path):
    final = str(tmp_path / "out" / "t")
    names = []
    for i in range(3):
        staged = str(tmp_path / "stage" / str(i))
        export.export_single(source, staged, "t", 300)
        names.append(publish.publish(spark, staged, final)["final_path"])
    assert [n.rsplit("/", 1)[1] for n in names] == ["t", "t_v2", "t_v3"]
    assert manifest.load_metadata(spark, names[1])["final_path"] == names[1]
    staged = str(tmp_path / "stage" / "over")
    export.export_single(source.limit(10), staged, "t", 10)
    publish.publish(spark, staged, final, "overwrite")
    assert manifest.read_export(spark, final).count() == 10
    source.write.parquet(str(tmp_path / "unsealed"))
    moved = publish.publish_job(
        spark, "j", {"bad": (str(tmp_path / "unsealed"), final)}, str(tmp_path / "archive")
    )
    assert "not a complete export" in moved.first()["error"]
    summary = spark.read.json(str(tmp_path / "archive" / "j")).first()
    assert (summary["failed_tables"], summary["total_tables"]) == (1, 1)


def test_job_isolates_failing_tables(spark, source, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def broken():
        raise RuntimeError("connection timeout")

    export_job(
        spark, {"s.good": lambda: source, "s.bad": broken}, str(tmp_path / "out"), ledger,
        job_id="j1", policy=SMALL,
    )
    tables = {r["table_name"]: r for r in fold_tables(ledger.events()).collect()}
    assert tables["s.good"]["status"] == "completed" and tables["s.good"]["rows_processed"] == 300
    assert tables["s.bad"]["status"] == "failed" and "timeout" in tables["s.bad"]["error_message"]
    job = fold_jobs(ledger.events()).first()
    assert job["overall_status"] == "completed_with_errors" and job["tables_failed"] == 1


def test_writer_options():
    assert ExportOptions("zstd", 3, 50).as_writer_options() == {
        "compression": "zstd", "parquet.compression.codec.zstd.level": "3",
        "parquet.block.size": str(50 * 1024 * 1024),
    }
    assert ExportOptions("snappy", 3).as_writer_options() == {"compression": "snappy"}
    assert json.dumps(ExportOptions(max_records_per_file=5).as_writer_options())


def test_moved_exports_list_their_files(spark, source, tmp_path):
    staged, final = str(tmp_path / "staging" / "t"), str(tmp_path / "final" / "t")
    export.export_ranges(source, planned(source), staged)
    publish.publish(spark, staged, final)
    listed = [r["file_path"] for r in manifest.read_files(spark, final).collect()]
    assert listed and all("/final/t/" in path for path in listed)
    assert spark.read.parquet(*listed).count() == 300


def test_rerun_skips_sealed_tables_and_redoes_the_rest(spark, source, tmp_path):
    ledger, opened = Ledger(spark, str(tmp_path / "ledger")), []

    def broken():
        raise OSError("not now")

    def good(name):
        opened.append(name)
        return source

    tables = {"a.b_c": lambda: good("a.b_c"), "a_b.c": broken}
    job = export_job(spark, tables, str(tmp_path / "out"), ledger, policy=SMALL)
    assert fold_jobs(ledger.events()).first()["overall_status"] == "completed_with_errors"
    tables["a_b.c"] = lambda: good("a_b.c")
    export_job(spark, tables, str(tmp_path / "out"), ledger, policy=SMALL, job_id=job)
    states = {r["table_name"]: r["status"] for r in fold_tables(ledger.events()).collect()}
    assert states["a.b_c"] == "completed" and opened == ["a.b_c", "a_b.c"]
    for name in tables:
        assert manifest.load_metadata(spark, f"{tmp_path}/out/{job}/{name}")["total_rows"] == 300
    export_job(spark, tables, str(tmp_path / "out"), ledger, policy=SMALL, job_id=job)
    assert len(opened) == 2


def test_comparison_is_not_fooled(spark, source):
    with pytest.raises(ValueError, match="missing"):
        verify.reconcile_rows(source, source.drop("v"))
    with pytest.raises(ValueError, match="missing"):
        verify.reconcile(source, source.drop("v"), ["k"])
    keyed = spark.sql("SELECT * FROM VALUES (1, map('a', 1D)), (NULL, map('b', 2D)) t(k, m)")
    assert {r["outcome"] for r in verify.reconcile(keyed, keyed, ["k"]).collect()} == {"same"}
    lost = verify.reconcile_rows(keyed, keyed.where("k IS NOT NULL")).collect()
    assert [(r["k"], r["m"], r["export_count"]) for r in lost] == [(None, {"b": 2.0}, 0)]
    odd = spark.sql("SELECT 1 AS `a``b'c`")
    assert verify.reconcile(odd, odd, ["a`b'c"]).first()["outcome"] == "same"
