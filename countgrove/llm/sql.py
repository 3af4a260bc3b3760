"""DuckDB SQL of the queries that SQL can express.

The others need hash functions (crc32, XXH64), iterative fits or page parsing that SQL lacks;
they are tested against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from . import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole FROM sums),
levels AS (SELECT *, (whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
goals AS (SELECT source, source_size, least(w * max(level) OVER (), cap) AS target,
  CAST('0x' || substr(md5(concat_ws('|', 'mix', source)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM levels),
placed AS (SELECT d.*, g.source_size, g.target, g.u,
  CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS e,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
dealt AS (SELECT *, CAST(floor(u + e * n) - floor(u + e * (n - 1)) AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM dealt"""

ROTATION = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
views AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM turns WHERE speaker <> 'system'),
shown AS (SELECT t.*, v.perspective, CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
  ELSE '<|user:' || speaker || '|>' END || chr(10) AS head FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.of),
whole AS (SELECT *, head || body || '<|end|>' || chr(10) AS rendered FROM shown),
placed AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
  ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM whole)
SELECT conv_id, perspective, turn, speaker, rendered, start,
  CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN start + length(rendered) END AS mask_end FROM placed"""

VECTORS = """
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.a LEFT JOIN counts c ON e.vec_id = c.a"""


FILL_IN_MIDDLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
  WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
  array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS t FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * totals.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, totals.docs),
sized AS (SELECT d, doc_id, 100 - 90 + (90 * len(t) * totals.docs) // totals.words AS m FROM docs, totals WHERE len(t) > 0),
scores AS (SELECT item_id, d, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (d) GROUP BY item_id, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _divergence(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    return f"sqrt(greatest(sum({part.format(x=p, m=m)} + {part.format(x=q, m=m)}) / 2, 0))"


def _rules() -> str:
    """The word and character statistics, references, distances and verdicts of the quality rules."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    one = "[" + "".join("\\" + c if c in "\\]^-" else c for c in rules.MARKS) + "]"
    return rf"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS d FROM documents),
split AS (SELECT d, lang, unnest(regexp_extract_all(text, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM docs),
runs AS (SELECT d, i, count(*) OVER (PARTITION BY d, w, w2, w3) AS n FROM (SELECT d, i, w, lead(w) OVER k AS w2, lead(w, 2) OVER k AS w3
  FROM split WINDOW k AS (PARTITION BY d ORDER BY i)) WHERE w3 IS NOT NULL),
repeats AS (SELECT d, count(DISTINCT i + o) AS n_repeat_words FROM runs, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY d),
lines AS (SELECT d, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT d, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}') GROUP BY d),
chars AS (SELECT d, CASE WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 0 WHEN regexp_matches(c, {_quoted(one)}) THEN 4
  WHEN c = '!' THEN 5 WHEN regexp_matches(c, '[#*$%&|<>]') THEN 6 WHEN regexp_matches(c, '\p{{Ll}}') THEN 1 WHEN regexp_matches(c, '\p{{Lu}}|\p{{Lt}}') THEN 2
  WHEN regexp_matches(c, '\p{{Nd}}') THEN 3 WHEN regexp_matches(c, '\p{{Lm}}|\p{{Lo}}') THEN 7 ELSE 8 END AS k, count(*) AS n
  FROM (SELECT d, unnest(string_split(text, '')) AS c FROM docs WHERE text <> '') GROUP BY ALL),
base AS (SELECT d, doc_id, lang, len(regexp_extract_all(text, '{WORD}')) AS n_words,
  CAST(length(text) - coalesce((SELECT n FROM chars x WHERE x.d = docs.d AND k = 0), 0) AS BIGINT) AS word_chars,
  CAST(coalesce((SELECT n FROM chars x WHERE x.d = docs.d AND k = 6), 0) AS BIGINT) AS n_symbols,
  CAST(coalesce((SELECT n_dup_lines FROM lines x WHERE x.d = docs.d), 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce((SELECT n_repeat_words FROM repeats x WHERE x.d = docs.d), 0) AS BIGINT) AS n_repeat_words, length(text) AS size FROM docs),
bare AS (SELECT d, lang, translate(trim(w, {_quoted(rules.TRIMMED)}), '{upper}', '{upper.lower()}') AS w FROM split),
common AS (SELECT lang, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM bare
  WHERE lang IS NOT NULL AND trim(w, '{rules.SYMBOLS}') <> '' GROUP BY lang, w) WHERE r <= {rules.COMMON}),
langs AS (SELECT DISTINCT lang FROM common),
bins AS (SELECT lang, w FROM common UNION ALL SELECT lang, NULL FROM langs),
counted AS (SELECT d, lang, w, count(*) AS n FROM bare GROUP BY ALL),
own AS (SELECT x.d, x.lang AS home, c.lang, c.w, x.n FROM counted x JOIN common c ON x.w = c.w),
rest AS (SELECT b.d, b.lang AS home, l.lang, NULL AS w, b.n_words - coalesce((SELECT sum(n) FROM own o WHERE o.d = b.d AND o.lang = l.lang), 0) AS n
  FROM base b, langs l),
hist AS (SELECT * FROM own UNION ALL SELECT * FROM rest),
word_ref AS (SELECT lang, w, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM hist WHERE home = lang GROUP BY lang, w),
word_near AS (SELECT d, min(js) AS word_distance FROM (SELECT b.d, r.lang, {_divergence("(coalesce(h.n, 0) / b.n_words)", "r.q")} AS js
  FROM base b JOIN word_ref r ON b.n_words >= {rules.MIN_WORDS} LEFT JOIN hist h ON h.d = b.d AND h.lang = r.lang AND h.w IS NOT DISTINCT FROM r.w
  GROUP BY b.d, r.lang) GROUP BY d),
kinds AS (SELECT unnest(range(9)) AS k),
class_ref AS (SELECT l.lang, kinds.k, coalesce(s.n, 0) / sum(coalesce(s.n, 0)) OVER (PARTITION BY l.lang) AS q FROM langs l, kinds
  LEFT JOIN (SELECT b.lang, c.k, sum(c.n) AS n FROM chars c JOIN base b USING (d) GROUP BY ALL) s ON s.lang = l.lang AND s.k = kinds.k),
class_near AS (SELECT d, min(js) AS class_distance FROM (SELECT b.d, r.lang, {_divergence("(coalesce(c.n, 0) / b.size)", "r.q")} AS js
  FROM base b JOIN class_ref r ON b.size >= {rules.MIN_CHARS} LEFT JOIN chars c ON c.d = b.d AND c.k = r.k GROUP BY b.d, r.lang) GROUP BY d),
judged AS (SELECT b.*, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words AS base_failed,
  coalesce(class_distance <= {rules.CLASS_LIMIT} + {rules.CLASS_NOISE} / sqrt(greatest(size, 1)), true)
    AND coalesce(word_distance <= {rules.WORD_LIMIT} + {rules.WORD_NOISE} / sqrt(greatest(n_words, 1)), true) AS near
  FROM base b LEFT JOIN class_near USING (d) LEFT JOIN word_near USING (d))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, near AND NOT base_failed AS kept FROM judged"""


QUALITY_RULES = _rules()
