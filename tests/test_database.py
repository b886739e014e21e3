"""Database jobs with the JDBC reads replaced by reads of Parquet files.

No database is started; what is tested is which reads are made and what becomes of them.
"""

import pytest

from haulage.operators.ledger import fold_jobs, fold_tables
from haulage.policy import Policy
from haulage.sinks import database, manifest
from haulage.sinks.job import Ledger
from haulage.sources import jdbc

SMALL = Policy().scaled(50_000)
CONFIG = {"db_type": "postgresql", "db_host": "h", "db_port": "5432", "db_username": "u", "db_password": "p"}


@pytest.fixture
def fake(spark, tmp_path, monkeypatch):
    """Tables as views; queries run on them, a chunked read is a union of filtered reads."""
    spark.range(500).selectExpr("id", "concat('v', id) AS v").createOrReplaceTempView("big")
    spark.range(5).selectExpr("concat('v', id) AS v").createOrReplaceTempView("words")
    asked = []

    def table(session, db, source, rows=None):
        asked.append(source)
        return session.sql(f"SELECT * FROM {source}".replace("public.", "").replace('"', "`"))

    def query(session, db, text):
        asked.append(text)
        if "information_schema.tables" in text:
            return session.sql(
                "SELECT 'public' AS table_schema, t AS table_name, 'BASE TABLE' AS table_type "
                "FROM VALUES ('big'), ('words') AS x(t)"
            )
        return session.sql(text.replace("public.", "").replace('"', "`"))

    monkeypatch.setattr(jdbc, "read_table", table)
    monkeypatch.setattr(jdbc, "read_query", query)
    return asked


def test_job_over_all_tables(spark, tmp_path, fake):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    job = database.export_database(spark, CONFIG, str(tmp_path / "out"), ledger, policy=SMALL)
    tables = {r["table_name"]: r for r in fold_tables(ledger.events()).collect()}
    assert [r["error_message"] for r in tables.values()] == [None, None]
    assert {n: (r["status"], r["rows_processed"]) for n, r in tables.items()} == {
        "public.big": ("completed", 500), "public.words": ("completed", 5),
    }
    assert tables["public.big"]["chunk_count"] > 5
    assert fold_jobs(ledger.events()).first()["overall_status"] == "completed"
    back = manifest.read_export(spark, f"{tmp_path}/out/{job}/public.big")
    assert back.select("id").distinct().count() == 500
    assert any(q.startswith("SELECT count(*) AS row_total") for q in fake)


def test_condition_and_chunk_size(spark, tmp_path, fake):
    request = database.TableRequest.parse(
        {"table": "big", "where_clause": "id >= 100", "chunk_override": {"chunk_size": 100, "chunk_workers": 2}}
    )
    done = database.export_database_table(
        spark, database.database_from(CONFIG), request, str(tmp_path / "t"), SMALL
    )
    assert (done["total_rows"], done["chunk_count"]) == (400, 4)
    assert "(SELECT * FROM public.big WHERE id >= 100) filtered" in fake


def test_a_chunk_that_one_value_fills(spark, tmp_path, fake, monkeypatch):
    """A third of the rows has one key: several tasks read it, files stay bounded, nothing is sorted."""
    spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1500 ELSE id END AS k", "CASE WHEN id % 50 = 0 THEN NULL ELSE id % 700 END AS n", "id"
    ).createOrReplaceTempView("hot")
    plans, original = [], jdbc.read_unit

    def unit(*args):
        read = original(*args)
        plans.append((args[3], read._jdf.queryExecution().executedPlan().toString(), read.count()))
        return read

    monkeypatch.setattr(jdbc, "read_unit", unit)
    monkeypatch.setattr(database, "rows_per_file", lambda *a: 40)
    request = database.TableRequest.parse({"table": "hot", "chunk_override": {"chunk_size": 100, "chunk_workers": 3}})
    path = str(tmp_path / "t")
    policy = Policy(small_table_rows=1, numeric_tiers=SMALL.numeric_tiers, target_chunk_rows=100)
    done = database.export_database_table(spark, database.database_from(CONFIG), request, path, policy)
    assert done["total_rows"] == 3000
    parts = [n for text, _, n in plans if '"n"' in text or '"id"' in text]
    assert len(parts) >= 5 and sum(parts) > 1000 and max(n for _, _, n in plans) <= 400
    assert not any("Sort" in plan or "Exchange" in plan for _, plan, _ in plans)
    assert max(r["row_count"] for r in manifest.read_files(spark, path).collect()) <= 40
    back = manifest.read_export(spark, path)
    assert sorted(r["id"] for r in back.select("id").collect()) == list(range(3000))
    assert back.where("k = 1500").select("chunk_id").distinct().count() == 1


def test_a_failing_unit_leaves_no_seal(spark, tmp_path, fake, monkeypatch):
    original, calls = jdbc.read_unit, []

    def unit(*args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("connection lost")
        return original(*args)

    monkeypatch.setattr(jdbc, "read_unit", unit)
    request = database.TableRequest.parse({"table": "big"})
    with pytest.raises(OSError, match="lost"):
        database.export_database_table(spark, database.database_from(CONFIG), request, str(tmp_path / "t"), SMALL)
    assert manifest.load_metadata(spark, str(tmp_path / "t")) is None and len(calls) > 3


def test_vertica_keys_come_from_its_own_catalog():
    for what in ("tables", "columns", "constraints", "key_columns"):
        assert "information_schema" not in jdbc.catalog_query("vertica", what)
        assert "v_catalog" in jdbc.catalog_query("vertica", what)


def test_missing_fields():
    with pytest.raises(ValueError, match="db_port, db_password"):
        database.database_from({"db_type": "postgresql", "db_host": "h", "db_username": "u"})
