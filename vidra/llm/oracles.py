"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w
), g AS (
  SELECT doc_id, len(gs) AS n, unnest(gs) AS s FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS u, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT x, y FROM pairs WHERE 100 * i >= 80 * u UNION SELECT y, x FROM pairs WHERE 100 * i >= 80 * u
), reach(a, b) AS (
  SELECT x, y FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x
)
SELECT doc_id, len(gs)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = doc_id
"""

BASE_OP3 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM p
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again WHERE twice) GROUP BY 1
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


def _base_op4() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    each = f"list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN {digits}[i]::INT WHEN {digits}[i]::INT > 4 THEN 2 * {digits}[i]::INT - 9 ELSE 2 * {digits}[i]::INT END)"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(p, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'))) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND list_sum({each}) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    ]
    parts = []
    for k, (kind, pattern, valid) in enumerate(kinds):
        # What stands before a match and the match itself; their lengths add up to its place.
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {k} AS k, e - length(m) AS a, e, m FROM (SELECT doc_id, regexp_extract(c, '(?s)^.*?({pattern})$', 1) AS m, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e "
            f"FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?{pattern}') AS cs FROM documents))) WHERE {valid}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    return (
        f"WITH s AS ({' UNION ALL '.join(parts)}), g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, a) AS spans FROM s GROUP BY 1) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind, *_ in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM documents d LEFT JOIN g USING (doc_id)"
    )


def _base_op10() -> str:
    # The phrases and their labels.
    phrases = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM x WHERE array_to_string(ws[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in phrases)
    return (
        rf"WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents), x AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), p AS ({places}), "
        "g AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM p GROUP BY 1) "
        "SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op7_ngram_jaccard": OP7, "base_op3": BASE_OP3, "base_op4": _base_op4(), "base_op10": _base_op10()}
