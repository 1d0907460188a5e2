"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

from palimpsest.llm.license_scan import PHRASES, TEMPLATES, template_words, window_words
from palimpsest.llm.quality_rules import RULES, STOP_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _fail(base: bool) -> str:
    return " OR ".join(r.sql() for r in RULES if r.base or not base)


def _templates() -> str:
    rows = ", ".join(f"({k}, '{label}', {template_words(text)}, {window_words(text, 80)})" for k, (label, text) in enumerate(TEMPLATES))
    return f"t(k, label, own, width) AS (VALUES {rows})"


_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES)
_LICENSE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, {_LOWER} AS low, {_LICENSE_WORDS.format(_LOWER)} AS w FROM documents),
p(phrase, size, label) AS (VALUES {_PHRASES}),
i AS (SELECT u, w, unnest(range(0, len(w))) AS i FROM d),
h AS (SELECT u, i, label FROM i JOIN p ON array_to_string(list_slice(w, i + 1, i + size), ' ') = phrase AND i + size <= len(w)),
b AS (SELECT u, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS l FROM h GROUP BY u),
{_templates()},
n AS (SELECT u, list_distinct({_LICENSE_WORDS.format("line")}) AS w FROM (SELECT u, unnest(string_split(low, chr(10))) AS line FROM d)),
m AS (SELECT u, label, len(list_intersect(n.w, t.own)) AS shared, len(t.own) AS size FROM n, t),
tw AS (SELECT k, label, unnest(own) AS x, len(own) AS size, width, greatest(1, (len(own) * 80 + 99) // 100) AS due FROM t),
o AS (SELECT i.u, i.i, tw.* FROM i JOIN tw ON tw.x = i.w[i.i + 1]),
q AS (SELECT u, k FROM o GROUP BY u, k, due HAVING count(DISTINCT x) >= due),
oq AS MATERIALIZED (SELECT o.* FROM o JOIN q ON q.u = o.u AND q.k = o.k),
v AS (SELECT a.u, a.label, a.size, a.due, count(DISTINCT b.x) AS shared FROM oq a JOIN oq b ON a.u = b.u AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.width - 1 GROUP BY a.u, a.k, a.i, a.label, a.size, a.due),
f AS (SELECT u, list(DISTINCT label) AS l, max(shared / size) AS share FROM
    (SELECT u, label, shared, size FROM m WHERE shared >= greatest(1, (size * 80 + 99) // 100) UNION ALL SELECT u, label, shared, size FROM v WHERE shared >= due) b GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(f.l, [])))), ','), '') AS labels,
    CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (u) LEFT JOIN f USING (u)
"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
g AS (SELECT u, i, list_slice(w, i, i + 4) AS g FROM (SELECT u, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS n FROM g),
r AS (SELECT u, count(DISTINCT p) AS n FROM (SELECT u, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY u),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, '!', '')) AS n_marks,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_distinct(w)) AS n_distinct,
    len([x FOR x IN w IF lower(x) IN ({_STOPS})]) AS n_stop, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (u))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, ({_fail(True)}) AS base_failed, NOT ({_fail(False)}) AS kept FROM m
"""


def components_sql(source: str, size: int, percent: int) -> str:
    """CTEs that end in ``comp (doc_id, n_shingles, component_id)`` for a table with doc_id and text."""
    return rf"""
w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM {source}),
g AS (SELECT doc_id, list_slice(w, i, i + {size - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(g, chr(10))) AS g FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= {percent} * (x.n + y.n - p.i)),
f AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT DISTINCT a AS x, a AS y FROM f UNION SELECT c.x, f.b FROM c JOIN f ON c.y = f.a),
comp AS (SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.y, w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM c GROUP BY x) m ON m.x = w.doc_id)"""


OP5 = f"WITH RECURSIVE {components_sql('documents', 3, 90)} SELECT doc_id, n_shingles, component_id FROM comp"

OP8 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

ORACLES = {"op1_license_scan": OP1, "op3_quality_rules": OP3, "op5_ngram_jaccard_join": OP5, "op8_exact_dedup": OP8}
