"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import line_dedup, near_dedup
from . import quality_rules as Q

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _count(x: str, characters: str) -> str:
    return f"(length({x}) - length(translate({x}, '{characters}', '')))"


_BOILER = " OR ".join(f"contains(low, '{p}')" for p in Q.BOILERPLATE)
_SPLIT = r"len(regexp_split_to_array(bare, '(?:^|\s)(?:\||»|›|>|·|•)(?:\s|$)'))"

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, {_WORDS.format('t')} AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM rep, LATERAL (SELECT unnest([i, i + 1, i + 2]) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, x.i AS i, x.line AS line, {_TRIM.format('x.line')} AS bare, lower(x.line) AS low0 FROM d, LATERAL (SELECT unnest(list_transform(string_split(t, chr(10)), lambda v, k: {{'i': k, 'line': v}})) AS x)),
l2 AS (SELECT *, lower(bare) AS low, length(bare) AS size FROM l),
f AS (SELECT *, bare <> '' AND ({_count('bare', Q.SYMBOLS)} * 100 > size * {Q.MAX_LINE_SYMBOL_PERCENT}
  OR ({_count('bare', '!')} > 2 AND {_count('bare', '!')} * 100 > size * 4) OR (size >= 8 AND bare = upper(bare) AND bare <> low) OR {_SPLIT} > 3 OR (size < 200 AND ({_BOILER}))
  OR (size < 80 AND NOT regexp_matches(bare, '[.!?:;,…"”’»)\\]]$') AND len({_WORDS.format('bare')}) < 3)) AS failed FROM l2),
o AS (SELECT *, failed OR (len({_WORDS.format('bare')}) >= 3 AND row_number() OVER (PARTITION BY doc_id, failed, line ORDER BY i) > 1) AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare <> '') - count(DISTINCT CASE WHEN bare <> '' THEN line END) AS n_dup, count(*) FILTER (gone) AS n_failed,
  coalesce(sum(length(array_to_string({_WORDS.format('line')}, ''))) FILTER (NOT gone), 0) AS left_chars FROM o GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {_count('t', Q.SYMBOLS)}::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  n_lines::BIGINT AS n_lines, n_failed::BIGINT AS n_failed_lines, left_chars FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN a ON a.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words) AND (n_failed_lines = 0 OR left_chars * 100 >= word_chars * {Q.MIN_KEPT_PERCENT}) AS kept, n_lines, n_failed_lines FROM b
"""

OP7 = line_dedup.OP7_SQL

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {near_dedup.PERCENT} * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT y, root FROM r JOIN u ON u.x = node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""
