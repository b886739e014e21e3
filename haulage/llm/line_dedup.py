"""Lines that many sites share: counted by sketches, checked exactly near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import BLANKS, exact, inside, packed, unpacked, whole
from haulage.session import written

MIN_SITES = 10
EDGES = f"^{BLANKS}+|{BLANKS}+\\z"
LG_REGISTERS = 12  # of a sketch; its relative standard error is 1.04 / sqrt(2^12) = 1.6 %
DEVIATIONS = 6


def _lines(text: str):
    """The lines of a text without blanks around them."""
    return F.transform(F.split(whole(text), "\n"), lambda line: F.regexp_replace(line, EDGES, ""))


def _hashed(line):
    return F.xxhash64(line).alias("_a"), F.xxhash64(F.lit(5), line).alias("_b")


def boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source"
) -> DataFrame:
    """``(_a, _b)``: 128-bit hashes of the lines that at least ``min_sites`` sites hold.

    Sketches of the sites are merged per line hash, combined before the shuffle. A line whose
    estimate is clear of the threshold is decided by it; the rest get exact distinct counts.
    A null site is no site. Blank lines are left out.
    """
    sites = exact(docs, text=text, site=site).select(
        F.col("site").cast("string").alias("_site"), F.explode(F.array_distinct(_lines("text"))).alias("_line")
    ).where((F.col("_line") != "") & F.col("_site").isNotNull())
    hashed = sites.select(*_hashed(F.col("_line")), "_site")
    spread = written(
        hashed.groupBy("_a", "_b")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", LG_REGISTERS)).alias("_sites"))
        .where(F.col("_sites") >= _band(min_sites)[0]),
        "line-spread",
    )
    low, high = _band(min_sites)
    sure = spread.where(F.col("_sites") > high).select("_a", "_b")
    unsure = spread.where((F.col("_sites") >= low) & (F.col("_sites") <= high)).select("_a", "_b")
    counted = (
        hashed.distinct().join(unsure, ["_a", "_b"], "left_semi")
        .groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_sites).select("_a", "_b")
    )
    return written(sure.unionByName(counted), "boilerplate")


def _band(min_sites: int) -> tuple[int, int]:
    """Estimates from the first to the second are too near the threshold to trust."""
    error = DEVIATIONS * 1.04 / math.sqrt(1 << LG_REGISTERS)
    return math.floor(min_sites * (1 - error)) - 1, math.ceil(min_sites * (1 + error)) + 1


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", key: str = "doc_id"
) -> DataFrame:
    """``docs`` plus ``clean_text``, ``n_lines`` and ``n_removed``.

    Line hashes, not lines, meet the boilerplate; the positions found go back to the texts
    by a hash of the text, of the identifier (where there is a column ``key``) and of the
    site, so copies of a page do not meet in one task, and repeated rows and null
    identifiers need no care. A null text has a null ``clean_text`` and no lines; an empty
    one has one blank line. Other lines stay byte for byte. An empty table gives an empty
    one. Columns of ``docs`` named like a result give way to it, all others stay.
    """
    names = docs.columns
    bad = boilerplate(docs, min_sites, text, site)
    parts = {"site": site}
    if key.lower() in (n.lower() for n in names):
        parts["key"] = key
    keys = [
        F.xxhash64(whole("text")).alias("t1"), F.xxhash64(F.lit(5), whole("text")).alias("t2"),
        F.xxhash64(*parts).alias("t3"),
    ]
    rows = packed(docs, text=text, **parts)
    places = rows.select(*keys, F.posexplode(_lines("text")).alias("place", "line")).select(
        "t1", "t2", "t3", "place", *_hashed(F.col("line"))
    )
    found = (
        places.join(bad, ["_a", "_b"])
        .groupBy("t1", "t2", "t3").agg(F.collect_set("place").alias("places"))
    )
    kept = F.expr(
        "transform(array_except(sequence(0, size(lines) - 1), coalesce(places, array())),"
        " p -> element_at(lines, p + 1))"
    )
    joined = rows.select("row", *keys).join(found, ["t1", "t2", "t3"], "left").select(
        "row", "places", F.split(inside(names, text).cast("string"), "\n").alias("lines")
    )
    return unpacked(
        joined, names,
        clean_text=F.when(F.col("lines").isNotNull(), F.array_join(kept, "\n")),
        n_lines=F.coalesce(F.array_size("lines"), F.lit(0)).cast("long"),
        n_removed=F.coalesce(F.array_size("places"), F.lit(0)).cast("long"),
    )
