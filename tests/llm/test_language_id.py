"""Language identification against plain sums over all segmentations, and on held-out rows."""

import math
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from haulage.llm import language_id as li
from haulage.llm.queries import QUERIES



def small_vocabulary():
    return ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bb", "aba"] + [f"<0x{b:02X}>" for b in range(256)]


def segmentations(word, names):
    """All ways to cut the word; a letter that is no piece is spelt by its bytes."""
    if not word:
        yield []
        return
    for size in range(1, len(word) + 1):
        head = word[:size]
        if head in names:
            cut = [head]
        elif size == 1:
            cut = [f"<0x{b:02X}>" for b in head.encode()]
        else:
            continue
        for rest in segmentations(word[size:], names):
            yield cut + rest


def test_forward_sums_all_segmentations():
    pieces = li.Pieces(small_vocabulary())
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(len(pieces)), 3).T)
    place = {n: i for i, n in enumerate(pieces.names)}
    words = ["a", "abab", "bbaabab", "cab", "éa", "b" * 12, "ca"]
    got = li.likelihoods(pieces, model, words)
    for word, row in zip(words, got):
        ways = list(segmentations("▁" + word, set(pieces.names)))
        expected = [
            math.log(sum(math.exp(sum(model[place[p], l] for p in way)) for way in ways)) for l in range(3)
        ]
        assert row == pytest.approx(expected)


def test_expected_counts_by_all_segmentations():
    pieces = li.Pieces(small_vocabulary())
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(len(pieces)), 2).T)
    place = {n: i for i, n in enumerate(pieces.names)}
    words, language, times = ["abab", "bab", "cé", "abab"], np.array([0, 1, 1, 1]), np.array([3.0, 1, 2, 5])
    expected = np.zeros(model.shape)
    for word, l, n in zip(words, language, times):
        ways = list(segmentations("▁" + word, set(pieces.names)))
        chances = [math.exp(sum(model[place[p], l] for p in way)) for way in ways]
        for way, chance in zip(ways, chances):
            for p in way:
                expected[place[p], l] += n * chance / sum(chances)
    got = li.expected(pieces, model, words, language, times)
    assert got == pytest.approx(expected)


def test_blocks_cover_all_words():
    words = ["x" * (i % 60 + 1) for i in range(5000)]
    seen = np.concatenate(list(li.blocks(words, 100)))
    assert sorted(seen) == list(range(5000))


TEXTS = {
    "xx": "kala mala sala kalamala sakala",
    "yy": "torun brun trun oruntor brontor",
}


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, t, l) for i, (l, t) in enumerate(list(TEXTS.items()) * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_edges(spark, taught):
    long = "kala " * 60_000
    rows = [
        (1, None, "xx"), (2, "", None), (3, " 12 ?! ²\n", "yy"), (4, long, None), (4, long, None),
        (None, "Brun torun", None), (None, None, None), (7, "日本 kala sala mala", None), (8, "x" * 5000, None),
        (9, "BRUN", "yy"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS SCORE", "2 AS lang_pred", "'x' AS Text", "3 AS c0", "4 AS word", "5 AS n", "6 AS key"
    )
    model = li.fit(taught)
    assert model[1] == ["xx", "yy"]
    got = li.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["lang_pred"])
    assert by[1] == by[2] == by[3] == ["und"]
    assert by[4] == ["xx", "xx"] and sorted(by[None]) == ["und", "yy"]
    assert by[7] == ["xx"] and by[9] == ["yy"] and by[8][0] in ("xx", "yy")
    assert li.language_id(docs.limit(0)).count() == 0
    nothing = li.predict(docs, li.fit(taught.limit(0))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    # Upper-case twins of the given columns are not read.
    assert li.language_id(docs).count() == len(rows)


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(0, "same words", "bb"), (0, "same words", "aa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.language_id(docs).collect()} == {"aa"}


def test_held_out_rows_teach_nothing(spark, taught):
    out = [i for i in range(200) if crc32(str(i).encode()) % 4 == 2][:5]
    extra = spark.createDataFrame([(i, "zzz", "zz") for i in out], taught.schema)
    assert li.fit(taught.unionByName(extra))[1] == ["xx", "yy"]


def test_too_many_languages_are_refused(spark):
    rows = [(0, "word", f"l{i}") for i in range(li.MAX_LANGUAGES + 1)]
    with pytest.raises(ValueError):
        li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_op11_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert len(held) > 100 and right >= 0.98 * len(held)
