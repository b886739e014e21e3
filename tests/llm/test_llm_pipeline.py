"""The pipeline's stages, one after the other."""

from collections import Counter

import corpus_pipeline
import llm_brute as brute
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the input and of each stage's output."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_names_and_columns(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for rows in stages[:-1]:
        assert rows[0].asDict().keys() == set(corpus_pipeline.COLUMNS)
    assert {"shard", "slot"} <= stages[-1][0].asDict().keys()


def test_near_duplicates_by_brute_force(stages):
    before, after = stages[1], stages[2]
    expected = {k for k, (_, c) in brute.near([(r["doc_id"], r["text"]) for r in before], 5).items() if k == c}
    assert {r["doc_id"] for r in after} == expected


def odd_docs(spark):
    """Copies with and without identifiers, nulls, empty and long texts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1)] * 4 + [(None, a, "en", "s", 1)] * 6 + [(None, b, None, None, None)] * 3
    rows += [(2, b + " x", "en", "s", 1), (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0)]
    rows += [(5, "word " * 50_000, "en", "t", 1), (6, "own text of few words", "en", "t", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS shard", "2 AS NAME", "3 AS hits", "4 AS score", "5 AS r"
    )


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS)
    assert sum((r["text"] or "").startswith("a0 ") for r in got) == 1
    assert sum((r["text"] or "").startswith("b0 ") for r in got) == 1
    others = sorted(str(r["doc_id"]) for r in got if not (r["text"] or "").startswith(("a0 ", "b0 ")))
    assert others == ["3", "4", "5", "6", "None"]


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"])
def test_stages_take_odd_and_empty_tables(spark, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    docs = odd_docs(spark)
    rows = function(spark, docs, SF).collect()
    assert len(rows) >= 5
    if stage != "sharding":
        assert set(rows[0].asDict()) == set(corpus_pipeline.COLUMNS)
    if stage in ("toxicity", "decontamination", "sharding"):
        assert len(rows) == docs.count()  # nothing here is toxic or of the benchmark
    assert function(spark, docs.limit(0), SF).count() == 0


def test_contaminated_documents_go(spark, stages):
    from haulage.llm.decontaminate import plain

    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in stages[2] if any(i in plain(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in stages[3]}
    assert held.isdisjoint(kept)
    assert len(kept) >= 0.98 * (len(stages[2]) - len(held))


def test_mixing_repeats_documents(stages):
    before = {r["doc_id"] for r in stages[3]}
    times = Counter(r["doc_id"] for r in stages[4])
    assert set(times) <= before and max(times.values()) <= 3


def test_shards_are_even(stages):
    assert len(stages[5]) == len(stages[4])
    sizes = Counter(r["shard"] for r in stages[5])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, stages[-1]))
