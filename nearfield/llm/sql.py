"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '')"
_SOLID = r"'[^\x20\x09-\x0D]'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (s) WHERE doc_id > least)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + 9], ' ') AS s
       FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINES = rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY ls[i], ls[i + 1], ls[i + 2] ORDER BY doc_id, i) AS nth
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
      WHERE regexp_matches(ls[i], {_SOLID}) OR regexp_matches(ls[i + 1], {_SOLID}) OR regexp_matches(ls[i + 2], {_SOLID})),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM w WHERE nth > 1)),
each AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM l LEFT JOIN kept USING (doc_id)
"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, x, {_WORDS} AS ws, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, {_SOLID})) AS ls
           FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
e AS (SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
n AS (SELECT *, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM e WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM n WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE k > 1) GROUP BY doc_id),
q AS (SELECT doc_id, x, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR length(regexp_replace(x, '[^A-Z]+', '', 'g')) > length(regexp_replace(x, '[^a-z]+', '', 'g'))
            OR 100 * length(regexp_replace(x, '[^!]+', '', 'g')) > 30 * n_words) AS kept
FROM b
"""
