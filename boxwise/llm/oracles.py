"""SQL for the queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

OP5 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

#: The water level by rounds, as the text of the contract has it: what is above a ceiling is reshared until nothing is.
OP9 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM t GROUP BY source
), rounds AS (
  SELECT 0 AS round, source, source_size, weight, 2.0 * source_size AS cap, false AS full_,
    1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS target
  FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, cap, full_ OR target >= cap,
    CASE WHEN full_ OR target >= cap THEN cap
      ELSE target + sum(greatest(target - cap, 0)) OVER () * weight / sum(CASE WHEN full_ OR target >= cap THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, max(CASE WHEN target > cap THEN 1 ELSE 0 END) OVER () AS more FROM rounds) WHERE more = 1
), rated AS (
  SELECT source, source_size, round(target, 6) AS target, coalesce(round(target, 6) / nullif(source_size, 0), 0) AS rate
  FROM rounds WHERE round = (SELECT max(round) FROM rounds)
), seeds AS (SELECT CAST(unnest(range(16)) AS BIGINT) AS seed
), drawn AS (
  SELECT t.doc_id, t.size, r.source, r.source_size, r.target, r.rate, k.seed, floor(r.rate) AS whole,
    ((('0x' || substr(m, 1, 8))::BIGINT + ('0x' || substr(m, 9, 8))::BIGINT * k.seed) % 4294967296) / 4294967296.0 < r.rate - floor(r.rate) AS hit
  FROM t JOIN rated r ON t.source IS NOT DISTINCT FROM r.source, seeds k
), totals AS (
  SELECT source, seed, abs(sum(CASE WHEN hit THEN size ELSE 0 END) - any_value((rate - floor(rate)) * source_size)) AS off_
  FROM drawn GROUP BY source, seed
), best AS (
  SELECT source, seed FROM totals QUALIFY row_number() OVER (PARTITION BY source ORDER BY off_, seed) = 1
)
SELECT d.doc_id, d.size, d.source_size, round(d.target, 6) AS target, CAST((d.whole + CASE WHEN d.hit THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed
"""

_ID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>'"
_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "''", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·",
    "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€",
}


def _uuid(expression: str) -> str:
    return f"(SELECT {_ID} FROM (SELECT sha256({expression}) AS h))"


def _unescaped(text: str) -> str:
    for name, char in _ENTITIES.items():
        text = f"replace({text}, '{name}', '{char}')"
    number = "(CASE WHEN lower(x[3]) = 'x' THEN ('0x' || x[4:-2])::BIGINT ELSE x[3:-2]::BIGINT END)"
    char = f"CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN replace(a, x, chr({number}::INT)) ELSE a END"
    found = f"list_distinct(regexp_extract_all({text}, '&#(?:[0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});'))"
    return f"replace(list_reduce(list_prepend({text}, {found}), lambda a, x: {char}), '&amp;', '&')"


def _tidy(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\f\x0B\x{{A0}}]+', ' ', 'g'), ' ?\n[ \n]*', E'\n', 'g'), E' \n')"


_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html"
    r"|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
_TAG = "<[a-zA-Z/!?][^>]*>"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace(body, '{_HIDDEN}', '', 'g'), '{_BLOCK}', E'\\n', 'g'), '{_TAG}', '', 'g')"
_TITLE = f"regexp_replace(regexp_extract(body, '(?is)<title\\b[^>]*>(.*?)</title', 1), '{_TAG}', '', 'g')"
OP1 = rf"""
WITH p AS (
  SELECT page_id, url AS target_uri, '2026-01-01T00:00:00Z' AS refers_to_date, coalesce(html, '') AS body FROM pages
), r AS (
  SELECT *, '200' AS source_status,
    E'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ' || strlen(body) AS source_headers,
    'sha256:' || sha256(body) AS source_payload_digest,
    {_uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(target_uri, '') || '|' || sha256(body)")} AS refers_to,
    {_tidy(_unescaped(_TEXT))} AS text, replace({_tidy(_unescaped(_TITLE))}, E'\n', ' ') AS title,
    regexp_extract(body, '(?is)<html\b[^>]*?\slang=["'']?([A-Za-z-]+)', 1) AS language,
    len(regexp_extract_all(body, '(?i)<a\b[^>]*?\shref=')) AS links
  FROM p
), i AS (
  SELECT *, 'sha256:' || sha256(source_headers || E'\r\n\r\n' || body) AS source_block_digest,
    {_uuid("'metadata|' || refers_to")} AS metadata_id, {_uuid("'conversion|' || refers_to")} AS conversion_id
  FROM r
), m AS (
  SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
    'title: ' || title || E'\r\nlanguage: ' || language || E'\r\nlinks: ' || links || E'\r\ncharacters: ' || length(text)
    || E'\r\nsource-status: 200\r\nsource-content-type: text/html; charset=utf-8\r\nsource-payload-digest: ' || source_payload_digest
    || E'\r\nconversion-record-id: ' || conversion_id || E'\r\n' AS block
  FROM i
  UNION ALL
  SELECT *, 'conversion', conversion_id, 'text/plain; charset=utf-8', text FROM i
)
SELECT page_id, warc_type, record_id, content_type, block, refers_to, refers_to_date, target_uri, source_status, source_headers,
  source_payload_digest, source_block_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length
FROM m
"""

_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT row_, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM t GROUP BY ALL HAVING count(DISTINCT row_) >= 3
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS lang_total FROM k GROUP BY 1
), c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (total + v) AS p, 1 + 1000000000 * (all_n + 1) // (lang_total + v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

#: CRC-32 by bytes: the table of a byte from the polynomial, then one step for each byte of each distinct feature.
OP13 = rf"""
WITH RECURSIVE byte_table AS (
  SELECT i AS byte, 0 AS step, i::BIGINT AS crc FROM range(256) x(i)
  UNION ALL SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM byte_table WHERE step < 8
), lookup AS MATERIALIZED (SELECT list(crc ORDER BY byte) AS crcs FROM byte_table WHERE step = 8
), words AS MATERIALIZED (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS MATERIALIZED (
  SELECT kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS feature
  FROM words
), hashed AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(feature) + 1), lambda i: ('0x' || hex(encode(feature))[2 * i - 1 : 2 * i])::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), lookup
), counts AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features JOIN hashed USING (feature) GROUP BY 1
), totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE kind = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES = {"op1_warc_derivatives": OP1, "op5_exact_dedup": OP5, "op9_mixing": OP9, "op12_divergence": OP12, "op13_resampling": OP13}
