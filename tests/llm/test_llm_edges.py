"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import llm_brute as brute
import pytest
from haulage.llm import (
    decontaminate, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, tokens,
    toxicity, warc,
)
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 4000}x{i // 4000}" for i in range(12_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, "one two three four five six seven", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \n\t ", "b"),
    (5, LONG, "b"),
    (5, LONG, "b"),  # the same row twice
    (6, f"start {PASSAGE} end of it", "c"),
    (7, f"{PASSAGE} other end", "d"),
    (None, f"none here {PASSAGE}", None),
    (None, None, None),
    (8, "x", "a"),
    (9, "ONE two three four five six seven", "c"),
    (10, "w " * 500, "c"),
    (11, "Ünïcödé ▁ mark  and   blanks\n\nfeeds\r\n", "é"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns of the same names as the operators' own must not get in their way.
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr(
        "*", "7 AS shard", "'x' AS hits", "1 AS n_words", "2.0 AS score", "3 AS repeats", "4 AS size"
    )


INNER = (
    "_k _c _t _t1 _t2 _a _b _all _places _words _lines _hashes _sorted _id _v _n _g1 _g2 _h _u _starts _counts _p row c0"
    " text_ key place lines site t1 t2 t3"
).split()
TWINS = "Text TEXT Doc_ID Source Shard Slot Score Kept KEPT N_Words N_Removed Clean_Text Kept_Text Failed Repeats".split()


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """The operators' own inner names, and their columns and results in another case."""
    names = [*docs.columns, *INNER, *TWINS]
    rows = [(*r[:3], 7, "x", 1, 2.0, 3, 4, *([f"v{i}"] * len(INNER + TWINS))) for i, r in enumerate(ROWS)]
    kinds = ["long", "string", "string", "int", "string", "int", "double", "int", "int"] + ["string"] * len(INNER + TWINS)
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds)])
    return spark.createDataFrame(rows, schema)


def results(frame, *names):
    """Rows by identifier and the named results, whatever else is there."""
    places = [frame.columns.index(n) for n in names]
    return sorted(str([r[i] for i in places]) for r in frame.collect())


OPERATORS = {
    "line_dedup": (lambda d: line_dedup.remove_boilerplate(d, 2), ["clean_text", "n_lines", "n_removed"]),
    "near_duplicates": (lambda d: near_dedup.near_duplicates(d, 4), []),
    "substring_dedup": (substring_dedup.remove_repeats, ["n_words", "n_removed", "kept_text", "repeats"]),
    "sharding": (lambda d: sharding.shard(d, 4), ["shard", "slot"]),
    "quality": (quality.judge, ["n_words", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"]),
    "tokens": (tokens.token_counts, []),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(docs, clashing, name):
    function, added = OPERATORS[name]
    mixed = function(clashing)
    if name == "sharding":  # rows of one text may change places
        assert mixed.count() == len(ROWS)
    else:
        plain = function(docs.select("doc_id", "text", "source"))
        assert results(mixed, *(added and ["doc_id", *added] or mixed.columns)) == results(
            plain, *(added and ["doc_id", *added] or plain.columns)
        )
    if not added:
        return
    gone = {a.lower() for a in added}
    measures = {"n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words"}
    kept = [c for c in clashing.columns if c.lower() not in gone | (measures if name == "quality" else set())]
    assert set(kept) <= set(mixed.columns)
    # The caller's values came along with their rows.
    inner, twin, text = (mixed.columns.index(n) for n in ("_k", "Text", "text"))
    for r in mixed.collect():
        assert r[inner] == r[twin] and ROWS[int(r[inner][1:])][1] == r[text]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_line_dedup(docs, empty):
    rows = line_dedup.remove_boilerplate(docs, min_sites=2).collect()
    assert len(rows) == len(ROWS)
    expected = brute.boilerplate([(t, s) for _, t, s in ROWS], 2)
    assert sorted(map(str, (r["clean_text"] for r in rows))) == sorted(map(str, expected))
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_line_dedup_near_the_threshold(spark):
    rows = [(i, f"often\nline {i}\nrare" if i < 9 else "often\nother", f"s{i % 12}") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for sites in (8, 9, 10, 12, 13):
        got = {r["doc_id"]: r["clean_text"] for r in line_dedup.remove_boilerplate(frame, sites).collect()}
        expected = brute.boilerplate([(t, s) for _, t, s in rows], sites)
        assert got == {r[0]: e for r, e in zip(rows, expected)}, sites


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, PASSAGE), (2, PASSAGE.replace("p7 ", "q7 ")), (3, None), (4, ""), (None, "p1 p2"), (5, LONG)],
        "item_id long, text string",
    )
    rows = decontaminate.find_items(docs, items).collect()
    found = {(r["doc_id"], h["item_id"]): h["distance"] for r in rows for h in r["hits"]}
    # The short item, of two words, is held where they stand side by side.
    assert found == {
        (d, i): i - 1 for d in (6, 7, None) for i in (1, 2)
    } | {(5, 5): 0} | {(d, None): 0 for d in (6, 7, None)}
    assert len(decontaminate.decontaminate(docs, items).collect()) == len(ROWS) - 5
    assert decontaminate.find_items(empty, items).count() == 0
    assert decontaminate.find_items(docs, items.limit(0)).where("size(hits) > 0").count() == 0
    # The same in several blocks.
    blocks = decontaminate.find_items(docs, items, block_chars=300).collect()
    assert {(r["doc_id"], h["item_id"]): h["distance"] for r in blocks for h in r["hits"]} == found


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "ab"), (2, "c de"), (3, "Ω"), (4, " !? ")], "item_id long, text string")
    texts = ["xab abx", "so ab.", "c, DE f", "c d e", "ω here", "cc de", "!?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "1 AS row", "2 AS HITS", "3 AS Text", "4 AS _t", "5 AS c0"
    )
    rows = decontaminate.find_items(docs, items).collect()
    assert {(r["doc_id"], h["item_id"]) for r in rows for h in r["hits"]} == {(1, 1), (2, 2), (4, 3)}
    assert rows[0].asDict().keys() == {"doc_id", "text", "row", "Text", "_t", "c0", "hits"}
    assert all((r["row"], r["Text"], r["_t"], r["c0"]) == (1, 3, 4, 5) for r in rows)


def test_edit_distance():
    for item, text in [("abcdef", "xxabxdefyy"), ("kitten", "sitting"), ("aaaa", "bbbb"), ("abc", "")]:
        got = decontaminate.distance(decontaminate.masks(item), len(item), text)
        assert got == brute.edit_distance_inside(item, text)


def test_pieces_cover_the_item():
    for budget in range(5):
        cut = decontaminate.pieces("abcdefghijk", budget)
        assert len(cut) == budget + 1 and "".join(p for _, p in cut) == "abcdefghijk"


def test_near_duplicates(docs, empty):
    rows = near_dedup.near_duplicates(docs, size=4).collect()
    assert len(rows) == len(ROWS)
    expected = brute.near([(i, t) for i, t, _ in ROWS if i is not None], 4)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert not r["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_copies_in_a_chain(spark):
    """Neighbours are alike, the ends are not; many copies share buckets."""
    words = [f"t{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[3 * i : 3 * i + 100]), "s") for i in range(60)]
    rows += [(2000 + i, " ".join(words[:90] + [f"u{i}"] + words[91:100]), "s") for i in range(60)]
    expected = brute.near([(i, t) for i, t, _ in rows], 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [base[:1], base[:3], base[:900], base[100:], base]
    found = near_dedup.sketches(sets, 288)
    assert (found < np.iinfo(np.uint64).max).all()
    assert abs((found[2] == found[3]).mean() - 0.8) < 0.1
    assert (near_dedup.sketches([base[:3][::-1]], 288)[0] == found[1]).all()


def test_substring_dedup(docs, empty):
    rows = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == sorted(
        x[:2] for x in brute.repeats([t for _, t, _ in ROWS], 35)
    )
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_spans_and_windows(spark):
    import random

    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(6)]
    texts = [" ".join(rng.choice(pool) for _ in range(4)) for _ in range(30)] + ["a " * 60, "a b " * 40]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for window, seed in ((35, 8), (12, 3)):
        got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame, window, seed).collect()}
        for i, expected in enumerate(brute.repeats(texts, window)):
            assert (got[i]["n_words"], got[i]["n_removed"]) == expected[:2]
            assert sum(s["end"] - s["begin"] for s in got[i]["repeats"]) == expected[1]


def test_warc(spark, empty, tmp_path):
    page = "<html lang=\"en\"><head><title>A\n t</title></head><body><script>x</script><p>Hi &amp; <b>you</b><br>there</p></body></html>"
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nb", page), (2, None, None), (None, "http://c", ""), (1, "http://a/\r\nb", page)],
        "page_id long, url string, html string",
    ).selectExpr("*", "1 AS payload", "2 AS text")
    records = warc.derivatives(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 8
    text = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    meta = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert text["block"] == "Hi & you\nthere"
    assert text["refers_to"] == meta["refers_to"] and meta["concurrent_to"] == text["record_id"]
    assert "title: A t\r\n" in meta["block"] and "http-status: HTTP/1.1 200 OK\r\n" in meta["block"]
    warc.write_records(records, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert sorted(r["block"] for r in back) == sorted(r["block"] for r in rows)
    assert {r["headers"]["WARC-Record-ID"] for r in back} == {r["record_id"] for r in rows}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    assert sorted(map(str, (r["text"] for r in rows))) == sorted(str(t) for _, t, _ in ROWS)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.shard(empty).count() == 0


def test_sharding_one_text_holds_a_third(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}", "s") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    # Two hundred equal rows need at least three shards of seventy-five.
    assert len({r["shard"] for r in got if r["text"] == "same"}) <= 5


def test_sharding_many_rows_without_identifier(spark):
    rows = [(None if i % 3 else i, "same" if i % 2 else f"text {i}", "s") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows))
    places = [(r["shard"], r["slot"]) for r in got]
    assert len(set(places)) == 400 and {s for s, _ in places} == set(range(8))
    assert all(sorted(n for s, n in places if s == shard) == list(range(50)) for shard in range(8))
    # Two hundred equal rows fill four shards of fifty; a piece is an eighth of what began in a shard.
    assert len({r["shard"] for r in got if r["text"] == "same"}) <= 6


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["source"]: r for r in rows}
    assert by[None]["source_size"] == 42 and by["b"]["target"] <= 3 * by["b"]["source_size"]
    total = sum(r["mix_size"] for r in rows)
    assert sum(r["target"] for r in by.values()) == pytest.approx(total)
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["repeats"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


@pytest.mark.parametrize("block", [100_000, 7])
def test_mixing_draws_repeated_rows_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "_BLOCK", block)
    ten = " ".join("w" * 10)
    rows = [(1, ten, "a")] * 300 + [(i, ten, "a") for i in range(2, 102)] + [(i, ten, "b") for i in range(500, 900)]
    rows += [(None, ten, None)] * 200 + [(i, ten, "c") for i in range(1000, 3000)] + [(7000, "once", "c")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS _whole", "2 AS _cut", "3 AS _source", "4 AS _one", "5 AS row", "6 AS REPEATS", "7 AS c1", "8 AS _r", "9 AS _place"
    ).repartition(9)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"_whole", "_cut", "_source", "_one", "row", "c1", "_r"}
    assert all((r["_whole"], r["_cut"], r["_source"], r["_one"], r["row"], r["_r"], r["_place"]) == (1, 2, 3, 4, 5, 8, 9) for r in got)
    taken, target = {}, {}
    for r in got:
        assert r["repeats"] in range(4)
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_size"] * r["repeats"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["repeats"])
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_water_filling_clamps_and_shares(spark):
    sources = spark.createDataFrame(
        [("a", 10, 5), ("b", 100, 2), ("c", 1000, 1), ("d", 0, 5)], "_source string, size long, weight int"
    )
    got = {r["_source"]: r["target"] for r in mixing.fill(sources).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0, "d": 0.0}


def test_quality(docs, empty):
    rows = quality.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = sorted((str(i), *brute.quality(t)) for i, t, _ in ROWS)
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == expected
    assert all(r["failed"] is not None and r["kept"] == (not r["failed"]) for r in rows)
    assert quality.judge(empty).count() == 0


def test_tokens(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    rows = tokens.token_counts(docs, limit=100).collect()
    expected = sorted((str(i), len(model.encode(t or "")), len((t or "").encode())) for i, t, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert tokens.token_counts(empty).count() == 0


def test_tokens_without_common_ones(spark, monkeypatch):
    """Every pre-token takes the way of the rare ones."""
    monkeypatch.setattr(tokens, "COMMON_CHARS", 0)
    frame = spark.createDataFrame(ROWS, SCHEMA)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    total = sum(r["n_tokens"] for r in tokens.token_counts(frame).collect())
    assert total == sum(len(model.encode(t or "")) for _, t, _ in ROWS)


def test_toxicity(spark, docs, empty):
    import random

    rng = random.Random(3)
    plain = ["river", "stone", "cloud", "paper", "green", "walk", "early", "music", "table", "north"]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(30)] + (["zorgblat", "vexnik"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(bad) if i % 7 else None))
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1.0 AS score")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = toxicity.score(frame, model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] < 0.7 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(0 <= r["score"] < 0.7 for r in nothing)
    assert toxicity.toxicity(empty, labels).count() == 0
