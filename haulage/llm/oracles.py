"""The same results in SQL, for the operators that SQL can express.

Label propagation, edit distance in substrings, tokenizers and language models are beyond it;
their queries are tested against brute force instead.
"""

from __future__ import annotations

from haulage.llm import lexical_search, line_dedup, mixing, quality, warc
from haulage.llm.common import WORD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(text: str, patterns) -> str:
    for pattern, to in patterns:
        text = f"regexp_replace({text}, '{pattern}', {_literal(to)}, 'g')"
    return text


def _hex(digits: str) -> str:
    values = f"list_transform(string_split(lower({digits}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)"
    return f"list_reduce({values}, lambda a, b: a * 16 + b)"


def _decoded(reference: str) -> str:
    """One character reference of HTML5 decoded; ``names`` and ``c1`` are columns."""
    digits = f"regexp_extract({reference}, '^&#[xX]?0*([0-9a-fA-F]*)', 1)"
    number = f"(CASE WHEN lower(substr({reference}, 3, 1)) = 'x' THEN {_hex(digits)} ELSE {digits}::BIGINT END)"
    name = f"substr({reference}, 2)"
    begins = ", ".join(f"names[substr({name}, 1, {n})] || substr({name}, {n + 1})" for n in warc.SHORT)
    lost = "chr(65533)"
    return f"""CASE WHEN substr({reference}, 1, 2) <> '&#' THEN coalesce(names[{name}], {begins}, {reference})
      WHEN {digits} = '' OR length({digits}) > 7 THEN {lost}
      WHEN {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN {lost}
      WHEN {number} BETWEEN 128 AND 159 THEN c1[{number} - 127]
      WHEN {number} = 160 THEN ' ' ELSE chr({number}::INT) END"""


def _decode(text: str) -> str:
    between = f"string_split_regex({text}, '{warc.REFERENCE}')"
    found = f"list_transform(regexp_extract_all({text}, '{warc.REFERENCE}'), lambda r: {_decoded('r')})"
    places = f"range(1, len({between}) + 1)"
    return f"array_to_string(list_transform({places}, lambda i: {between}[i] || coalesce({found}[i], '')), '')"


_NAMES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(warc.NAMES.items()))
_C1 = ", ".join(f"chr({ord(c)})" for c in warc.C1)


def _literal(text: str) -> str:
    return "chr(10)" if text == "\n" else "'" + text.replace("'", "''") + "'"


def _uuid(name: str, *parts: str) -> str:
    h = "md5(concat_ws('|', '" + name + "', " + ", ".join(parts) + "))"
    cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


_CRLF = "chr(13) || chr(10)"

# crc32 of an ASCII text, a byte at a time with the usual table.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _crc32(text: str, table: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


def _edit(label: str, initial: str, cost: str) -> str:
    """A way's label, its cost in six digits and its audit, with one more edit."""
    return f"lpad((left({label}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({label}, 7) || '{initial}'"


def _least(*ways: str) -> str:
    return "least(" + ", ".join(ways) + ")"


def _kept(label: str, role: str) -> str:
    return f"CASE WHEN free AND initial = '{role}' THEN {_edit(label, 'K', 'extra')} END"


def _changed(label: str) -> str:
    return f"CASE WHEN free THEN {_edit(label, 'R', '2 + extra')} END"


# Least labels of the states nothing, system, user, assistant before a row, from those after the
# row before; at most two rows are inserted between two others, as more never pay.
_INSERTED = f"""n0 AS l0, ns AS ls, {_least("nu", _edit("n0", "I", "2"), _edit("ns", "I", "2"), _edit("na", "I", "2"))} AS lu,
       {_least("na", _edit("nu", "I", "2"), _edit("n0", "II", "4"), _edit("ns", "II", "4"))} AS la"""

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), trimmed AS (
  SELECT *, regexp_replace(line, '{line_dedup.EDGES}', '', 'g') AS body FROM lines
), shared AS (
  SELECT body FROM trimmed WHERE body <> ''
  GROUP BY body HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
)
SELECT doc_id, count(*) AS n_lines, count(s.body) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.body IS NULL), '')) AS clean_sha256
FROM trimmed t LEFT JOIN shared s ON t.body = s.body
GROUP BY doc_id""",
    "op3_near_dedup": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots ON roots.a = d.doc_id""",
    "op4_substring_dedup": f"""
WITH worded AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM worded)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM repeated
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM worded
), judged AS (
  SELECT words.*, gone.place IS NOT NULL AS removed FROM words LEFT JOIN gone USING (doc_id, place)
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT removed) AS rest
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)""",
    "op5_warc": f"""
WITH listed(k, v) AS (
  VALUES {_NAMES}
), known AS (
  SELECT map(list(k), list(v)) AS names, [{_C1}] AS c1 FROM listed
), base AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), response AS (
  SELECT page_id, html, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri,
         {_uuid("response", "coalesce(page_id::VARCHAR, '')", "url", "md5(html)")} AS rid,
         'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF}
           || 'Content-Length: ' || strlen(html) AS headers
  FROM base
), stripped AS (
  SELECT *, {_replaced("html", warc.STRIP)} AS bare, regexp_extract(html, '{warc.TITLE}', 1) AS heading FROM response
), decoded AS (
  SELECT *, CASE WHEN contains(bare, '&') THEN {_decode("bare")} ELSE bare END AS plain,
         CASE WHEN contains(heading, '&') THEN {_decode("heading")} ELSE heading END AS head
  FROM stripped, known
), derived AS (
  SELECT *, {_replaced("plain", warc.TIDY)} AS txt, 'sha256:' || sha256(html) AS payload_digest,
         {_uuid("conversion", "rid")} AS cid, {_uuid("metadata", "rid")} AS mid,
         trim(regexp_replace(head, '{warc.BREAKS}', ' ', 'g')) AS title,
         regexp_extract(html, '{warc.LANGUAGE}', 1) AS language
  FROM decoded
), records AS (
  SELECT page_id, cid AS record_id, 'conversion' AS warc_type, rid AS refers_to, mid AS concurrent_to,
         target_uri, 'text/plain; charset=utf-8' AS content_type, payload_digest, txt AS block
  FROM derived
  UNION ALL
  SELECT page_id, mid, 'metadata', rid, cid, target_uri, 'application/warc-fields', payload_digest,
         'http-status: ' || replace(headers, {_CRLF}, {_CRLF} || 'http-header: ') || {_CRLF}
         || 'source-block-digest: sha256:' || sha256(headers || {_CRLF} || {_CRLF} || html) || {_CRLF}
         || 'source-payload-digest: ' || payload_digest || {_CRLF} || 'conversion: ' || cid || {_CRLF}
         || 'title: ' || title || {_CRLF} || 'language: ' || language || {_CRLF}
         || 'text-length: ' || strlen(txt) || {_CRLF}
  FROM derived
)
SELECT page_id, record_id, warc_type, refers_to, concurrent_to, target_uri, '{warc.DATE}' AS date,
       content_type, payload_digest, 'sha256:' || sha256(block) AS block_digest,
       strlen(block)::BIGINT AS content_length, block
FROM records""",
    "op7_mixing": f"""
WITH hashed AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS first
  FROM documents
), copied AS (
  SELECT *, row_number() OVER (PARTITION BY source, first) AS copy FROM hashed
), sized AS (
  SELECT doc_id, source, size, CASE WHEN copy = 1 THEN first ELSE md5(concat_ws('|', first, copy::VARCHAR)) END AS u
  FROM copied
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum({mixing.MAX_EPOCHS} * source_size) OVER (
            ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
         / sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), chosen AS (
  SELECT min_by(level, cap / w) AS level FROM levels WHERE cap > w * level
), filled AS (
  SELECT source, source_size, CASE WHEN cap <= w * chosen.level THEN cap::DOUBLE ELSE w * chosen.level END AS target
  FROM levels, chosen
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM filled
), placed AS (
  SELECT d.doc_id, d.size, d.u, b.*, target - whole * source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
), cut AS (
  SELECT *, max(u) FILTER (WHERE earlier + size / 2 <= rest) OVER (PARTITION BY source) AS last FROM placed
)
SELECT doc_id, size, source_size, target, size * (whole + coalesce(u <= last, false)::BIGINT) AS taken FROM cut""",
    "op8_quality_rules": f"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM worded)
), repeated AS (
  SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), lined AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM worded)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
         coalesce(lined.n - lined.d, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lined.n, 0)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))})))::BIGINT
           AS n_stop_words
  FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN lined USING (doc_id)
)
SELECT *, NOT ({" AND ".join(f"({r.verdict()})" for r in quality.BASE_RULES)}) AS base_failed,
       {" AND ".join(f"({r.verdict()})" for r in (*quality.BASE_RULES, *quality.RULES))} AS kept
FROM measured""",
    "op12_conversation_repair": f"""
WITH RECURSIVE codes AS (
  SELECT {_CRC_TABLE} AS crc
), keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k,
         dense_rank() OVER (ORDER BY conv_id) AS g
  FROM conversations
), drawn AS (
  SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("k", "crc")} % 20 AS d FROM keyed, codes
), damaged AS (
  SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank,
         row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
  FROM placed
), seq AS (
  SELECT g, i, turn, role, text, initial, is_blank, again AND NOT is_blank AS is_again,
         cut AND NOT again AND NOT is_blank AS is_cut, NOT (again OR is_blank) AS free, cut::INT AS extra,
         lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair
  FROM judged
), counted AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_again) AS duplicate,
         count(*) FILTER (WHERE is_cut) AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM seq GROUP BY g
), ways AS (
  SELECT g, 0::BIGINT AS i, {_INSERTED}
  FROM (SELECT g, '000000' AS n0, NULL::VARCHAR AS ns, NULL::VARCHAR AS nu, NULL::VARCHAR AS na FROM counted)
  UNION ALL
  SELECT g, i, {_INSERTED}
  FROM (
    SELECT w.g, s.i, {_edit("l0", "D", "3")} AS n0, {_least(_edit("ls", "D", "3"), _kept("l0", "s"))} AS ns,
           {_least(_edit("lu", "D", "3"), *(_kept(x, "u") for x in ("l0", "ls", "la")), *(_changed(x) for x in ("l0", "ls", "la")))} AS nu,
           {_least(_edit("la", "D", "3"), _kept("lu", "a"), _changed("lu"))} AS na
    FROM ways w JOIN seq s ON w.g = s.g AND s.i = w.i + 1
  )
), best AS (
  SELECT c.*, left(least(l0, la), 6)::BIGINT AS cost, substr(least(l0, la), 7) AS audit
  FROM counted c JOIN ways w ON c.g = w.g AND c.n = w.i
), edits AS (
  SELECT g, p, substr(audit, p, 1) AS edit FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)
), numbered AS (
  SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY g ORDER BY p) AS i,
         sum((edit <> 'D')::INT) OVER (PARTITION BY g ORDER BY p) AS e
  FROM edits
), lines AS (
  SELECT n.g, n.p, n.e, n.edit, CASE WHEN n.edit <> 'I' THEN s.role END AS role,
         CASE WHEN n.edit = 'I' THEN '' ELSE s.text END AS text
  FROM numbered n LEFT JOIN seq s ON n.g = s.g AND n.i = s.i WHERE n.edit <> 'D'
), headed AS (
  SELECT *, max((e = 1 AND edit = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY g) AS system FROM lines
), written AS (
  SELECT g, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY p) AS t
  FROM headed GROUP BY g
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) k LEFT JOIN best ON k.g = best.g LEFT JOIN written w ON k.g = w.g""",
    "op13_lexical_search": f"""
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}') AS t
  FROM documents
), facts AS (
  SELECT d, doc_id, len(t)::BIGINT AS n FROM found WHERE len(t) > 0
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM facts
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}')) AS term
  FROM benchmark
), held AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM found)
  WHERE term IN (SELECT term FROM asked) GROUP BY d, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term, docs
), scored AS (
  SELECT item_id, d, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN facts USING (d), totals
  GROUP BY item_id, d, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {lexical_search.BEST}""",
}
