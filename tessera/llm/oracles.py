"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import COMMENT, LEAST_COSINE, MENTIONS, TEMPLATES, TERM

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents
), n AS (
  SELECT doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM d
), t AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), b AS (
  SELECT n.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM n LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR n_symbols > 0.2 * greatest(1, n_words)
  OR NOT (word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words)
  OR length(text) - length(replace(text, '!', '')) > 0.3 * greatest(1, n_words)
  OR (len(lines) > 3 AND (length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', '')) > 0.3 * len(lines))
  OR (len(lines) > 3 AND len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•·]'))) > 0.9 * len(lines))
  OR n_dup_lines > 0.5 * len(lines)
  OR (n_words > 5 AND len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) > 0.5 * n_words)
  OR length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < 0.5 * word_chars
  OR (n_words > 20 AND len(list_distinct(words)) < 0.02 * n_words)) AS kept
FROM b
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS MATERIALIZED (SELECT doc_id, q, least(128, n - 49 - q) AS m, substr(h, 2 * q + 1, 2 * 177) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 49, 128)) AS q FROM d)),
w AS MATERIALIZED (SELECT doc_id, q + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, q, h, unnest(range(0, m)) AS i FROM parts)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
c AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS gap FROM w JOIN f USING (s) WHERE m < doc_id),
g AS (SELECT doc_id, i, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
pieces AS (
  SELECT doc_id, a AS p, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT d.doc_id, d.n, coalesce(max(b), 0), any_value(d.n) FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.n
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY p, x) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, coalesce(r.n, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1) r ON r.doc_id = d.doc_id
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql() -> str:
    texts = ", ".join(f"({n}, {quoted(name)}, {quoted(text)})" for n, (name, text) in enumerate(TEMPLATES))
    speaks = lambda x: f"regexp_matches({x}, {quoted(MENTIONS)})"
    bare = lambda x: f"regexp_replace({x}, {quoted(COMMENT)}, '')"
    return rf"""
WITH templates(template, license, body) AS (VALUES {texts}),
counted AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), {quoted(TERM)})) AS term FROM templates) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln((1 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM counted GROUP BY term),
vec AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM counted JOIN idf USING (term)),
files AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id // 1000, doc_id || '.txt') AS path, coalesce(text, '') AS text,
    {speaks("coalesce(string_split(text, chr(10))[1], '')")} AS whole FROM documents
), lines AS (
  SELECT doc_id, text, whole, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted(COMMENT)})) AS marks FROM files WHERE whole OR {speaks("text")}
), cut AS (
  SELECT doc_id, text, whole, lines, array_to_string(list_transform(lines, lambda x, i:
    CASE WHEN i = 1 THEN '' WHEN marks[i] = marks[i - 1] THEN chr(10) ELSE chr(1) END || CASE WHEN marks[i] AND (i = 1 OR NOT marks[i - 1]) THEN chr(2) ELSE '' END || {bare("x")}), '') AS joined FROM lines
), units AS (
  SELECT doc_id, unnest(u) AS body, unnest(range(len(u))) AS unit FROM (SELECT doc_id, list_concat(CASE WHEN whole THEN [text] ELSE [] END,
    list_filter(list_transform(lines, lambda x: {bare("x")}), lambda x: {speaks("x")}),
    list_filter(string_split_regex(joined, '\x01|\n[ \t]*\n'), lambda x: {speaks("x")} AND contains(x, chr(10)) AND x <> joined),
    list_filter(string_split(joined, chr(1)), lambda x: starts_with(x, chr(2)) AND {speaks("x")} AND contains(x, chr(10)))) AS u FROM cut)
), terms AS (SELECT doc_id, unit, unnest(regexp_extract_all(lower(body), {quoted(TERM)})) AS term FROM units),
weighed AS (SELECT doc_id, unit, term, count(*) * coalesce(any_value(idf), ln(1 + {len(TEMPLATES)}) + 1) AS w FROM terms LEFT JOIN idf USING (term) GROUP BY 1, 2, 3),
lengths AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS length FROM weighed GROUP BY 1, 2),
dots AS (SELECT doc_id, unit, template, license, sum(w * weight) AS dot FROM weighed JOIN vec USING (term) GROUP BY 1, 2, 3, 4),
scored AS (SELECT doc_id, unit, template, license, round(dot / length, 6) AS cosine FROM dots JOIN lengths USING (doc_id, unit) WHERE round(dot / length, 6) >= {LEAST_COSINE}),
best AS (SELECT doc_id, license, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, unit, template) = 1),
known AS (SELECT f.doc_id, path, whole, regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine FROM files f LEFT JOIN best USING (doc_id)),
licensed AS (SELECT dir, license, cosine FROM known WHERE license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, license) = 1),
nearest AS (
  SELECT d.dir, l.dir AS up, l.license AS from_license, l.cosine AS from_cosine FROM (SELECT DISTINCT dir FROM known) d JOIN licensed l ON l.dir = '' OR l.dir = d.dir OR starts_with(d.dir, l.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1
)
SELECT doc_id, path, coalesce(license, from_license) AS license, coalesce(cosine, from_cosine) AS cosine,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN from_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN license IS NULL AND from_license IS NOT NULL THEN up END AS from_dir
FROM known LEFT JOIN nearest USING (dir)
"""

#: Words of the resampling and contamination queries: A-Z lower-cased, characters from 128 on part of words.
PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLING = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d), bw AS MATERIALIZED (SELECT unnest({PLAIN_WORDS}) AS word FROM benchmark),
t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
codes AS (SELECT word, t, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT word FROM dw UNION SELECT word FROM bw), t),
words AS MATERIALIZED (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM codes),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN words USING (word) GROUP BY 1), b AS (SELECT bucket, count(*) AS n FROM bw JOIN words USING (word) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(b.n, 0) + 1 AS DOUBLE) * (sizes.s + 10000) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (sizes.t + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM words) LEFT JOIN s USING (bucket) LEFT JOIN b USING (bucket), sizes),
sums AS (SELECT r, CAST(sum(gain) AS BIGINT) AS g, count(*) AS n FROM dw JOIN words USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM d LEFT JOIN sums USING (r)
), noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(CAST(u AS DOUBLE)))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS all_of FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * all_of // 100 THEN k END AS rank FROM noisy LEFT JOIN drawn USING (r)
"""

CONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {PLAIN_WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
m AS MATERIALIZED (SELECT r, i, n, item FROM dw JOIN iw USING (n, s)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round as two tables: the parts with their nearest entries, and the entries moved to the floored means."""
    steps = []
    nearest = f"""(SELECT vec_id, label, part, piece, min(({entries} * list_sum(list_transform(range(1, len(piece) + 1), lambda i: (piece[i] - center[i]) * (piece[i] - center[i]))) + entry)) AS best
      FROM p JOIN b{{n}} USING (part) GROUP BY ALL)"""
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED {nearest.format(n=n)},
m{n} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS center FROM (
  SELECT part, best % {entries} AS entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM (SELECT part, best, unnest(piece) AS x, unnest(range(len(piece))) AS i FROM a{n}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.center, b{n}.center) AS center FROM b{n} LEFT JOIN m{n} USING (part, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x) AS BIGINT)) AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, vec[part * (len(vec) // {parts}) + 1 : (part + 1) * (len(vec) // {parts})] AS piece FROM v, range({parts}) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, piece AS center FROM p QUALIFY entry < {entries}),
{", ".join(steps)},
codes AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM {nearest.format(n=rounds)} GROUP BY 1, 2),
books AS (SELECT sha256(string_agg(array_to_string(center, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, books
"""
