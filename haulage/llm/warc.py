"""Derived archive records: linked metadata and plain-text conversion of responses.

Records follow the public WARC 1.1 format. Everything is an expression over one row, so
there is no shuffle, and records are written by Spark's text sink.
"""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import exact, whole

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"  # two line breaks end every record
SOFTWARE = "haulage derivative builder"
# Elements that stand on lines of their own, table cells among them.
BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|"
    "figcaption|figure|footer|form|frameset|h[1-6]|header|hgroup|hr|legend|li|listing|main|menu|nav|"
    "noframes|ol|optgroup|option|p|plaintext|pre|search|section|select|summary|table|tbody|td|tfoot|th|"
    "thead|title|tr|ul|xmp"
)
STRIP = (
    ("(?is)<!--.*?-->", " "),
    ("(?is)<script[^>]*>.*?</script>", " "),
    ("(?is)<style[^>]*>.*?</style>", " "),
    ("(?is)<head(?:[ \\t\\r\\n][^>]*)?>.*?</head>", " "),  # not a header
    (f"(?i)</?(?:{BLOCKS})(?:[ \\t\\r\\n][^>]*)?/?>", "\n"),
    ("<[^>]*>", ""),
)
# Patterns are read alike by Java and RE2, so the SQL counterpart uses them too.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
# The public HTML5 names; those without a semicolon are also read in front of other letters.
NAMES = {**html5, "nbsp": " ", "nbsp;": " ", "NonBreakingSpace;": " "}
SHORT = sorted({len(name) for name in NAMES if name[-1] != ";"}, reverse=True)
BUCKETS = 64  # the names are dealt over so many small maps, as a map is searched from its start
# What numbers 128 to 159 stand for in HTML: the characters of Windows-1252, where it has one.
C1 = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
TITLE = "(?is)<title[^>]*>(.*?)</title>"
LANGUAGE = "(?i)<html[^>]*[ \\t\\r\\n]lang=\"([a-zA-Z-]+)\""
BREAKS = "[ \\t\\r\\n]+"
TIDY = (("[ \\t\\r]+", " "), (" ?\\n ?", "\n"), ("\\n+", "\n"), ("^\\n|\\n\\z", ""))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(value, "UTF-8"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based identifier: the same record gets the same one on every run."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _named(name: Column) -> Column:
    """What a name stands for, or null."""
    dealt: list[list[str]] = [[] for _ in range(BUCKETS)]
    for known, value in NAMES.items():
        dealt[zlib.crc32(known.encode()) % BUCKETS].append(f"{known}\x02{value}")
    maps = F.array(*(F.str_to_map(F.lit("\x01".join(d)), F.lit("\x01"), F.lit("\x02")) for d in dealt))
    bucket = (F.crc32(F.encode(name, "UTF-8")) % BUCKETS + 1).cast("int")
    return F.try_element_at(F.element_at(maps, bucket), name)


def _numbered(number: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
        .when(number.between(128, 159), F.element_at(F.array(*map(F.lit, C1)), (number - 127).cast("int")))
        .when(number == 160, " ")
        .otherwise(wide)
    )


def _decoded(reference: Column) -> Column:
    """A match of REFERENCE decoded; it stays as it is where HTML5 knows no such name."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base_16 = F.lower(F.substring(reference, 3, 1)) == "x"
    number = F.when(base_16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    name = F.substring(reference, 2, 1 << 20)
    # An unknown name may begin with a known one that needs no semicolon, the longest one counts.
    begins = [
        F.concat(_named(F.substring(name, 1, n)), F.substring(name, n + 1, 1 << 20)) for n in SHORT
    ]
    return (
        F.when(~F.startswith(reference, F.lit("&#")), F.coalesce(_named(name), *begins, reference))
        .when(digits == "", "\ufffd")  # zeros only
        .when(F.char_length(digits) > 7, "\ufffd")
        .otherwise(_numbered(number))
    )


def decode(text: Column) -> Column:
    """Character references decoded from left to right, each once: what one gives is not read
    again. A no-break space is read as a blank."""

    def run(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        between = F.split(t, REFERENCE, -1)
        pairs = F.zip_with(between, found, lambda a, r: F.concat(a, F.coalesce(_decoded(r), F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pairs, "")).otherwise(t)

    # As a variable, so that what makes the text runs once.
    return F.transform(F.array(text), run).getItem(0)


def tidied(text: Column) -> Column:
    """What the patterns of TIDY do one after the other, in fewer matches: a single blank, which
    every word ends with, is left as it is instead of being replaced by itself."""
    for sign in "\t\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    text = F.regexp_replace(text, " {2,}", " ")
    return F.btrim(F.regexp_replace(text, "[ \\n]*\\n[ \\n]*", "\n"), F.lit("\n"))


def plain_text(html: Column) -> Column:
    for pattern, to in STRIP:
        html = F.regexp_replace(html, pattern, to)
    return tidied(decode(html))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages: ``page_id, target_uri, date, record_id, http_headers,
    payload``. Null addresses and bodies are read as empty."""
    pages = exact(pages, page_id="page_id", url="url", html="html")
    url, html = whole("url"), whole("html")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # A line break would end the header line it is written to.
        F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("target_uri"),
        F.lit(date).alias("date"),
        record_id(F.lit("response"), page, url, F.md5(html)).alias("record_id"),
        headers.alias("http_headers"),
        html.alias("payload"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records per response: ``page_id, record_id, warc_type, refers_to, concurrent_to,
    target_uri, date, content_type, payload_digest, block_digest, content_length, block``.

    Both refer to the response. The metadata record keeps the response's HTTP headers and
    digests as fields and names the conversion; the conversion holds the page as plain text.
    Repeated responses give repeated records with the same identifiers. An empty page has
    an empty conversion. Character references are decoded in the conversion and in the title.
    """
    own = ("page_id", "target_uri", "date", "record_id", "http_headers", "payload")
    source = exact(source, **dict(zip(own, own)))
    title = F.regexp_extract("payload", TITLE, 1)
    language = F.regexp_extract("payload", LANGUAGE, 1)
    base = source.withColumns(
        {
            "text": plain_text(F.col("payload")),
            "payload_digest": digest(F.col("payload")),
            "source_digest": digest(F.concat("http_headers", "payload")),
            "conversion_id": record_id(F.lit("conversion"), F.col("record_id")),
            "metadata_id": record_id(F.lit("metadata"), F.col("record_id")),
            # One field a line: breaks inside a title would end the field.
            "title": F.trim(F.regexp_replace(decode(title), BREAKS, " ")),
            "language": language,
        }
    )
    header_fields = F.regexp_replace(
        F.regexp_replace("http_headers", "\r\n\r\n$", ""), "\r\n", "\r\nhttp-header: "
    )
    fields = F.concat(
        F.lit("http-status: "), header_fields,
        F.lit("\r\nsource-block-digest: "), F.col("source_digest"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nconversion: "), F.col("conversion_id"),
        F.lit("\r\ntitle: "), F.col("title"),
        F.lit("\r\nlanguage: "), F.col("language"),
        F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"),
        F.lit("\r\n"),
    )

    def record(kind: str, rid: str, other: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.col(rid).alias("record_id"), F.lit(kind).alias("warc_type"),
            F.col("record_id").alias("refers_to"), F.col(other).alias("concurrent_to"),
            F.lit(content_type).alias("content_type"), block.alias("block"),
        )

    pair = F.array(
        record("metadata", "metadata_id", "conversion_id", "application/warc-fields", fields),
        record("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("text")),
    )
    return base.select("page_id", "target_uri", "date", "payload_digest", F.explode(pair).alias("r")).select(
        "page_id", "r.record_id", "r.warc_type", "r.refers_to", "r.concurrent_to", "target_uri", "date",
        "r.content_type", "payload_digest", digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def record_text(records: DataFrame) -> DataFrame:
    """``value``: the record as it stands in an archive, without the two final line breaks."""
    lines = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Source-Payload-Digest", "payload_digest"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
    ]
    head = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in lines]
    length = F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"))
    return records.select(
        F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *head, length), F.lit(END), F.col("block")).alias("value")
    )


def write_records(records: DataFrame, path: str) -> None:
    """One compressed archive per task; Spark's text sink puts the final line breaks."""
    record_text(records).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that `write_records` wrote: ``headers`` (map) and ``block``.

    A file is split where a record begins, so tasks share large archives; the length in the
    header then tells where the block ends.
    """
    pieces = spark.read.option("lineSep", "\r\nWARC/1.1\r\n").text(path)
    body = F.regexp_replace("value", "^WARC/1.1\r\n", "")
    head = F.substring_index("_body", END, 1)
    rest = F.expr("encode(substring(_body, char_length(_head) + 5), 'UTF-8')")
    size = F.col("headers").getItem("Content-Length").cast("int")
    return (
        pieces.withColumn("_body", body)
        .withColumn("_head", head)
        .withColumn("headers", F.str_to_map("_head", F.lit("\r\n"), F.lit(": ")))
        .select("headers", F.decode(F.substring(rest, F.lit(1), size), "UTF-8").alias("block"))
    )
