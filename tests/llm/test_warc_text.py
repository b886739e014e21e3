"""Plain text of pages against Python's HTML parser, which shares no pattern with the operator."""

import html
import itertools
import re
from html.entities import html5
from html.parser import HTMLParser

from haulage.llm import warc
from pyspark.sql import functions as F

BREAKING = set(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article nav section blockquote pre td th dd dt dl hr "
    "header footer main aside figure figcaption caption form address".split()
)


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.inside = [], "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.inside.append(tag)
        self.parts.append("\n" if tag in BREAKING else " " if tag == "head" else "")

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)
        self.parts.append("\n" if tag in BREAKING else " " if tag in ("head", "script", "style") else "")

    def handle_startendtag(self, tag, attrs):
        self.parts.append("\n" if tag in BREAKING else "")

    def handle_data(self, data):
        if self.inside == ["head", "title"]:
            self.title += data
        if not self.inside:
            self.parts.append(data)

    def handle_comment(self, data):
        self.parts.append(" ")


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    text = "".join(reader.parts).replace("\xa0", " ")
    text = re.sub(" ?\n ?", "\n", re.sub("[ \t\r]+", " ", text))
    return re.sub("^\n|\n\\Z", "", re.sub("\n+", "\n", text)), " ".join(reader.title.replace("\xa0", " ").split())


def decoded(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", warc.decode(F.col("t")).alias("d")).collect()
    return [r["d"] for r in sorted(rows, key=lambda r: r["i"])]


def test_all_names(spark):
    texts = [f"a &{name}b &amp;{name}" for name in html5] + ["".join(f"&{n}." for n in html5)]
    expected = [html.unescape(t).replace("\xa0", " ") for t in texts]
    assert decoded(spark, texts) == expected


def test_numbers_and_single_pass(spark):
    cases = {
        "&#8212;&#x2014;&#X2014;": "———", "&#0065;&#65": "AA", "&#x1F600;": "😀", "&#160;x&nbsp;y": " x y",
        "&#150;&#x80;": "–€", "&#0;&#xD800;&#x110000;&#99999999999999999999;": "�" * 4,
        "&amp;lt;": "&lt;", "&amp;#38;lt;": "&#38;lt;", "&#38;amp;": "&amp;", "&amp;amp;amp;": "&amp;amp;",
        "&notit; &notin; &copyright &ampx": "¬it; ∉ ©right &x", "AT&T & co &unknown; &; &# &#x;": "AT&T & co &unknown; &; &# &#x;",
        "&hellip;&eacute;&fjlig;": "…éfj", "": "", "&&amp;&": "&&&",
    }
    assert decoded(spark, list(cases)) == list(cases.values())


def test_tidied_is_what_the_patterns_give(spark):
    """All short texts of blanks and breaks, and long runs."""
    signs = [" ", "\n", "\t", "\r", "é"]
    texts = ["".join(t) for n in range(6) for t in itertools.product(signs, repeat=n)]
    texts += [f"{a * n}x{b * n}" for a in signs for b in [*signs, " \n", "\n ", "\r\n"] for n in (7, 8, 9, 17, 100)] + [None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = F.col("t")
    for pattern, to in warc.TIDY:
        patterns = F.regexp_replace(patterns, pattern, to)
    assert frame.where(~warc.tidied(F.col("t")).eqNullSafe(patterns)).count() == 0


def test_pages_by_parser(spark):
    pages = [
        "<html><head><title>Caf&eacute; &amp;amp; T&#10;b &ndash; x</title></head><body><header>Top</header>"
        "<table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1</td><td class='x'>2 &lt;b&gt;</td></tr></table>"
        "<dl><dt>k</dt><dd>v</dd></dl>x<hr/>y<main>m</main>n<footer>&copy; 2024 &middot; me</footer></body></html>",
        "<body>a<b>b</b>c <header>no head</header>d&#8217;s</body>",
    ]
    frame = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(frame)).collect()
    for i, page in enumerate(pages):
        text, title = read(page)
        block = {r["warc_type"]: r["block"] for r in rows if r["page_id"] == i}
        assert block["conversion"] == text
        assert f"\r\ntitle: {title}\r\n" in block["metadata"]
    first = next(r["block"] for r in rows if r["page_id"] == 0 and r["warc_type"] == "conversion")
    assert first == "Top\na\nb\n1\n2 <b>\nk\nv\nx\ny\nm\nn\n© 2024 · me"


def test_given_pages_by_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    given = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert given
    for r in rows:
        text, title = read(given[r["page_id"]])
        if r["warc_type"] == "conversion":
            assert r["block"] == text
        else:
            assert f"\r\ntitle: {title}\r\n" in r["block"]
