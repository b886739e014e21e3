"""Each query against its SQL, or against brute force over the whole table."""

import os
from collections import Counter, defaultdict

import llm_brute as brute
import pytest
from compare import compare, connect
from haulage.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLE_SQL[name]) is None


def test_op2_by_scanning_every_text(spark, texts):
    """Myers distance of every item against every whole text: nothing more and nothing less is found."""
    from haulage.llm import decontaminate as d

    items = [d.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    masks = [(d.masks(i), len(i), len(i) // d.CHARS_PER_ERROR if len(i) - 2 >= d.MIN_CHARS else 0) for i in items]
    got = {r["doc_id"]: r for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert set(got) == set(texts)
    small = [k for k in sorted(texts) if len(texts[k]) < 2500]  # the scan is slow
    for doc_id in small:
        text = d.plain(texts[doc_id])
        found = [x for x, (m, n, budget) in ((d.distance(m, n, text), (m, n, b)) for m, n, b in masks) if x <= budget]
        r = got[doc_id]
        assert (r["n_items"], r["least_distance"], r["kept"]) == (len(found), min(found, default=None), not found)
    assert len(small) > 50 and any(not r["kept"] for r in got.values())


def test_op3_by_brute_force(spark, texts):
    expected = brute.near(texts.items(), 4)
    for r in QUERIES["op3_near_dedup"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_op4_by_brute_force(spark, texts):
    expected = dict(zip(texts, brute.repeats(texts.values(), 35)))
    for r in QUERIES["op4_substring_dedup"](spark, SF).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]]


def test_op6_law_and_groups(spark, texts):
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    groups = [t for t, n in Counter(texts.values()).items() if n > 1]
    assert groups and sum(len(where[t]) > 1 for t in groups) <= len(groups) // 4


def test_op7_comes_near_the_targets(spark):
    rows = QUERIES["op7_mixing"](spark, SF).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[k] - target[k]) <= largest for k in target)


def test_op8_base_by_brute_force(spark, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        found = tuple(r[n] for n in names)
        assert found == brute.quality(texts[r["doc_id"]])
        assert r["base_failed"] == (found[0] < 20 or 100 * found[4] > 30 * found[0])
        assert not (r["kept"] and r["base_failed"])


def test_op9_as_the_library_counts(spark, texts):
    import sentencepiece
    from haulage.llm.tokens import model_path

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = QUERIES["op9_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_op10_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, other = [s for s, y in held if y], [s for s, y in held if not y]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in other)
    assert wins / (len(toxic) * len(other)) > 0.85
    assert sum(s >= 0.7 for s in other) <= 0.05 * len(other)
