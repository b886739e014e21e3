"""Resumed exports, jobs that are taken up, and checks through Spark's own readers."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_export import SMALL, parts, planned, source  # noqa: F401

from haulage.operators import verify
from haulage.operators.ledger import fold_jobs, fold_tables
from haulage.plans.layout import ARCHIVES
from haulage.sinks import export, manifest, resumable
from haulage.sinks.job import Ledger, export_job, table_folder


@pytest.fixture
def hashed(monkeypatch):
    """Chunks of the files that are listed for hashing, call by call."""
    calls, original = [], resumable.file_checksums

    def spy(files):
        calls.append(sorted({r["chunk_id"] for r in files.select("chunk_id").collect()}))
        return original(files)

    monkeypatch.setattr(resumable, "file_checksums", spy)
    return calls


def test_waves_hash_exactly_their_own_files(spark, source, tmp_path, hashed):  # noqa: F811
    plan, path, waves = planned(source), str(tmp_path / "t"), []
    resumable.resume_export(source, plan, path, waves=4, on_wave=lambda chunks, rows: waves.append((chunks, rows)))
    filled = {int(p.parent.name.split("=")[1]) for p in parts(path)}
    assert len(waves) == 4 and sum(rows for _, rows in waves) == 300
    assert hashed == [[c for c in chunks if c in filled] for chunks, _ in waves if set(chunks) & filled]
    assert [c for chunks, _ in waves for c in chunks] == list(range(plan.chunks))


class Cut(Exception):
    pass


def test_a_partly_written_wave_is_taken_up(spark, source, tmp_path, hashed, monkeypatch):  # noqa: F811
    plan, path = planned(source), str(tmp_path / "t")
    original, calls = resumable._record, []

    def record(*args):
        calls.append(args[-1])
        if len(calls) == 3:  # the third wave has its files, but no records
            raise Cut
        return original(*args)

    monkeypatch.setattr(resumable, "_record", record)
    with pytest.raises(Cut):
        resumable.resume_export(source, plan, path, waves=4)
    done = [c for chunks in calls[:2] for c in chunks]
    kept = {p: p.stat().st_mtime_ns for p in parts(path) if int(p.parent.name.split("=")[1]) in done}
    (Path(path) / f"chunk_id={calls[2][0]}").mkdir(exist_ok=True)
    # A stray file of the cut wave must not stay beside the new ones.
    (Path(path) / f"chunk_id={calls[2][0]}" / "stray.parquet").write_bytes(b"half a file")
    monkeypatch.setattr(resumable, "_record", original)
    hashed.clear()
    assert resumable.pending_chunks(spark, path, plan) == [c for c in range(plan.chunks) if c not in done]
    assert set(hashed[0]) <= set(done)
    resumable.resume_export(source, plan, path, waves=2)
    assert all(p.stat().st_mtime_ns == at for p, at in kept.items())
    back = manifest.read_export(spark, path).drop("chunk_id")
    assert verify.reconcile_rows(source, back).count() == 0 and back.count() == 300


def test_table_folders():
    for name in ("", None):
        with pytest.raises(ValueError):
            table_folder(name)
    names = [".", "..", "a.b", ".a", "_a", "%2E", "a/b", "a\\b", "%5Fa", "...", "ä b"]
    folders = [table_folder(n) for n in names]
    assert len(set(folders)) == len(names)
    assert all(f not in (".", "..") and f[0] not in "._" and "/" not in f for f in folders)


def states(ledger):
    return {r["table_name"]: r["status"] for r in fold_tables(ledger.events()).collect()}


def seen_states(ledger, table):
    rows = ledger.events().where(F.col("table_name") == table).orderBy("ts", "seq").collect()
    return [r["fields"]["status"] or r["op"] for r in rows if r["fields"]["status"] or r["op"] == "table_complete"]


def test_a_job_goes_on_inside_a_range_export(spark, source, tmp_path):  # noqa: F811
    ledger, waves = Ledger(spark, str(tmp_path / "ledger")), []
    keep_ranges = SMALL.__class__(**{**SMALL.__dict__, "range_preferred_rows": 1, "small_table_rows": 1})

    def cut(table, fields):
        if "rows_processed" in fields and "status" not in fields:
            waves.append(fields["rows_processed"])
            if len(waves) == 2:
                raise Cut("out of luck")

    options = dict(policy=keep_ranges, job_id="j", final=str(tmp_path / "final"), waves=4)
    tables = {"s.t": lambda: source, "s.u": lambda: source.where("id < 100")}
    export_job(spark, {"s.t": tables["s.t"]}, str(tmp_path / "out"), ledger, on_event=cut, **options)
    assert states(ledger) == {"s.t": "failed"}
    staged = tmp_path / "out" / "j" / "s.t"
    kept = {p.name: p.stat().st_mtime_ns for p in parts(staged)}
    assert kept and manifest.load_metadata(spark, str(staged)) is None

    export_job(spark, tables, str(tmp_path / "out"), ledger, **options)
    assert states(ledger) == {"s.t": "completed", "s.u": "completed"}
    assert fold_jobs(ledger.events()).first()["overall_status"] == "completed"
    final = tmp_path / "final" / "s_t"
    now = {p.name: p.stat().st_mtime_ns for p in parts(final)}
    assert all(now.get(name) == at for name, at in kept.items()) and len(now) > len(kept)
    back = manifest.read_export(spark, str(final)).drop("chunk_id")
    assert verify.reconcile_rows(source, back).count() == 0
    assert seen_states(ledger, "s.u") == [
        "processing", "planned", "staged", "verified", "published", "archived", "table_complete",
    ]
    summary = spark.read.json(f"{tmp_path}/final{ARCHIVES['clean_with_archive']}/j/summary").first()
    assert (summary["moved_tables"], summary["failed_tables"], summary["total_tables"]) == (2, 0, 2)
    before = ledger.events().count()
    export_job(spark, tables, str(tmp_path / "out"), ledger, **options)
    assert ledger.events().count() == before  # nothing was left to do


def test_a_job_goes_on_after_each_state(spark, source, tmp_path):  # noqa: F811
    """Cut after a state, the next run ends with one published export of the table."""
    for state in ("planned", "staged", "published"):
        base, ledger, opened = tmp_path / state, Ledger(spark, str(tmp_path / state / "ledger")), []

        def cut(table, fields, state=state):
            if fields.get("status") == state:
                raise Cut(state)

        tables = {"t": lambda: opened.append(1) or source}
        options = dict(policy=SMALL, job_id="j", final=str(base / "final"))
        export_job(spark, tables, str(base / "out"), ledger, on_event=cut, **options)
        assert states(ledger) == {"t": "failed"}
        export_job(spark, tables, str(base / "out"), ledger, **options)
        assert states(ledger) == {"t": "completed"}
        # The table is read again only if it was not staged.
        assert len(opened) == (2 if state == "planned" else 1)
        assert [p.name for p in (base / "final").iterdir() if not p.name.startswith(".")] == ["t"]
        assert manifest.read_export(spark, str(base / "final" / "t")).count() == 300


def test_empty_tables_pass_the_check(spark, source, tmp_path):  # noqa: F811
    ledger, empty = Ledger(spark, str(tmp_path / "ledger")), source.limit(0)
    export_job(spark, {"t": lambda: empty}, str(tmp_path / "out"), ledger, job_id="j", final=str(tmp_path / "final"))
    assert states(ledger) == {"t": "completed"}
    assert manifest.read_export(spark, str(tmp_path / "final" / "t")).count() == 0


def test_damaged_staging_is_made_anew_and_existing_is_skipped(spark, source, tmp_path):  # noqa: F811
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def damage(table, fields):
        if fields.get("status") == "staged":
            victim = parts(fields["file_path"])[0]
            victim.write_bytes(victim.read_bytes()[:-20])
            for crc in Path(fields["file_path"]).rglob(".*.crc"):
                crc.unlink()

    options = dict(policy=SMALL, final=str(tmp_path / "final"))
    export_job(spark, {"t": lambda: source}, str(tmp_path / "out"), ledger, job_id="j", on_event=damage, **options)
    row = fold_tables(ledger.events()).first()
    assert row["status"] == "failed" and "size_changed" in row["error_message"]
    export_job(spark, {"t": lambda: source}, str(tmp_path / "out"), ledger, job_id="j", **options)
    assert states(ledger) == {"t": "completed"}
    # Another job finds the export by name and rows.
    export_job(spark, {"t": lambda: source}, str(tmp_path / "out"), ledger, job_id="k", skip_existing=True, **options)
    assert [p.name for p in (tmp_path / "final").iterdir() if not p.name.startswith(".")] == ["t"]
    export_job(spark, {"t": lambda: source.limit(5)}, str(tmp_path / "out"), ledger, job_id="l", skip_existing=True, **options)
    assert sorted(p.name for p in (tmp_path / "final").iterdir() if not p.name.startswith(".")) == ["t", "t_v2"]


@pytest.fixture
def only_spark(spark, tmp_path):
    """A path that Spark's readers open and Arrow does not."""
    mount = tmp_path.name.replace("_", "-")  # file systems are remembered by name
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{mount}.link./data", f"file://{tmp_path}")
    return f"viewfs://{mount}/data"


def test_checks_where_only_spark_reads(spark, source, tmp_path, only_spark):  # noqa: F811
    local = tmp_path / "t"
    export.export_ranges(source, planned(source), str(local))
    files = parts(local)
    files[0].write_bytes(files[0].read_bytes()[:40])
    files[1].write_bytes(files[2].read_bytes())
    for crc in local.rglob(".*.crc"):
        crc.unlink()
    path = f"{only_spark}/t"
    assert not verify.arrow_opens(path)
    name = lambda p: p.split("/t/", 1)[1]
    there = manifest.list_data_files(spark, path)
    verdicts = {name(r["file_path"]): r for r in verify.verify_readable(there).collect()}
    known = {name(r["file_path"]): r for r in verify.verify_readable(manifest.list_data_files(spark, str(local))).collect()}
    assert len(known) == len(files) and set(verdicts) == set(known)
    for key, r in known.items():
        assert (verdicts[key]["readable"], verdicts[key]["row_count"], verdicts[key]["codec"]) == (
            r["readable"], r["row_count"], r["codec"]
        )
    sums = {name(r["file_path"]): r["checksum"] for r in verify.file_checksums(there).collect()}
    assert sums == {name(str(p)): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    outcomes = {name(r["file_path"]): r["outcome"] for r in verify.verify_export(spark, path).collect()}
    assert {k for k, v in outcomes.items() if v != "ok"} == {name(str(files[i])) for i in (0, 1)}
    files[4].unlink()
    files[3].write_bytes(b"")  # Spark lists no empty files
    outcomes = {name(r["file_path"]): r["outcome"] for r in verify.verify_export(spark, path).collect()}
    assert outcomes[name(str(files[3]))] == outcomes[name(str(files[4]))] == "missing"


def test_what_cannot_be_opened_is_not_damaged(spark, source, tmp_path, only_spark, monkeypatch):  # noqa: F811
    export.export_single(source, str(tmp_path / "t"), "t", 300)
    monkeypatch.setattr(verify, "WHOLE_FILE_BYTES", 10)  # too large for Spark's reader
    found = verify.verify_readable(manifest.list_data_files(spark, f"{only_spark}/t")).collect()
    assert [r["readable"] for r in found] == [None] and "cannot open" in found[0]["error"]
    with pytest.raises(Exception, match="cannot open"):
        verify.file_checksums(manifest.list_data_files(spark, f"{only_spark}/t")).collect()
    assert [r["outcome"] for r in verify.verify_export(spark, f"{only_spark}/t").collect()] == ["not_opened"]


def tree(digests, group=1000):
    """The digest of ordered digests, in plain Python."""
    while len(digests) > group:
        digests = [one(digests[i : i + group]) for i in range(0, len(digests), group)]
    return one(digests)


def one(digests):
    return digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest()


def test_digest_tree(spark):
    sizes = {("t", 0): 1, ("t", 1): 1000, ("t", 2): 1001, ("u", 0): 100_000}
    rows = spark.createDataFrame([(t, c, n) for (t, c), n in sizes.items()], "table_name string, chunk_id int, n int")
    listed = rows.selectExpr("table_name", "chunk_id", "explode(sequence(1, n)) AS i").selectExpr(
        "table_name", "chunk_id", "concat('f/', lpad(i, 7, '0'), '.parquet') AS file_path", "cast(i AS bigint) AS file_size",
        "sha2(concat_ws('|', table_name, chunk_id, i), 256) AS checksum",
    ).repartition(7)
    got = {(r["table_name"], r["chunk_id"]): r for r in verify.chunk_checksums(listed).collect()}
    for (t, c), n in sizes.items():
        digests = [hashlib.sha256(f"{t}|{c}|{i}".encode()).hexdigest() for i in range(1, n + 1)]
        assert got[t, c]["checksum"] == tree(digests)
        assert (got[t, c]["file_count"], got[t, c]["file_size"]) == (n, n * (n + 1) // 2)
    many = spark.range(2500).selectExpr(
        "'v' AS table_name", "cast(id AS int) AS chunk_id", "concat('f', id) AS file_path", "id AS file_size",
        "sha2(cast(id AS string), 256) AS checksum",
    )
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2500)]
    whole = verify.combined_checksum(many).first()
    assert whole["combined_checksum"] == hashlib.sha256("".join(
        one(digests[i : i + 1000]) for i in range(0, 2500, 1000)
    ).encode()).hexdigest()
    assert whole["file_count"] == 2500
