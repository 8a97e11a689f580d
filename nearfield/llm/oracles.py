"""The queries' SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .quality import POLICIES, RULES, mask

from .quality import POLICIES, RULES, mask

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_PLAIN}) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWERED}, {_PLAIN}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i : i + 9] AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(k) AS size FROM bw),
dw AS (SELECT doc_id, size, i, w[i : i + size - 1] AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, n WHERE len(w) >= size)),
h AS (SELECT dw.doc_id, dw.size, dw.i, bw.item FROM dw JOIN bw ON bw.k = dw.k),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_ESCAPED = r"replace(replace({x}, '\', '\\'), '<|', '<\|')"
_ROLE, _TEXT = "coalesce(role, '')", "coalesce(text, '')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text FROM conversations
UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)),
l AS (SELECT *, 12 + length(replace({_ESCAPED.format(x="role")}, chr(10), '\\n')) + 1 + length({_ESCAPED.format(x="text")}) + 11 AS size,
row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS most FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS whole FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
(sum(whole) FILTER (role = 'assistant' OR n = most))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY conv_id
"""

NEARDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SPACED}) AS w FROM documents),
g AS (SELECT w, min(doc_id) AS rep FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT rep, w[i : i + 4] AS k FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM g)),
n AS (SELECT rep, count(*) AS size FROM s GROUP BY rep),
m AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT m.a, m.b FROM m JOIN n x ON x.rep = m.a JOIN n y ON y.rep = m.b WHERE 100 * common >= 75 * (x.size + y.size - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep, rep AS root FROM g UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.rep WHERE r.root < u.b),
c AS (SELECT rep, min(root) AS root FROM r GROUP BY rep)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN g ON g.w = d.w LEFT JOIN n ON n.rep = g.rep LEFT JOIN c ON c.rep = g.rep
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
x AS (SELECT doc_id, i, w[i : i + 19] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM f WHERE n > 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d WHERE len(w) > 0),
k AS (SELECT p.doc_id, string_agg(p.w[p.place], ' ' ORDER BY p.place) AS kept FROM p ANTI JOIN g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY p.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 200) AS k FROM (SELECT doc_id, hx, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM x),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE r > 1),
a AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS b, max(i) + 100 AS e FROM a GROUP BY doc_id, run),
c AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last FROM s GROUP BY doc_id),
q AS (SELECT doc_id, run, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM s),
h AS (SELECT q.doc_id, string_agg(substr(hx, (2 * before + 1)::BIGINT, (2 * (b - before))::BIGINT), '' ORDER BY run) AS hx FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(coalesce(h.hx, '') || substr(d.hx, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h ON h.doc_id = d.doc_id
"""

_BITS = " + ".join(f"(CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END)" for k, r in enumerate(RULES))
_GAP = r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS l FROM documents),
x AS (SELECT doc_id, i, w[i : i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM y WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_GAP}', '', 'g'))::BIGINT AS word_chars,
(length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
length(t) - length(translate(t, '{_UP}', '')) AS n_capitals, length(t) - length(translate(t, '0123456789', '')) AS n_digits,
length(t) - length(translate(t, '{{}}[]\=', '')) AS n_braces, len(l) AS n_lines,
len(list_filter(l, lambda v: contains(t, chr(10)) AND ends_with(rtrim(v), '...'))) AS n_ellipses,
len(list_filter(l, lambda v: contains(t, chr(10)) AND regexp_matches(ltrim(v), '^[-*•] '))) AS n_bullets,
len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask(POLICIES["base"])}) <> 0 AS base_failed, (failed & {mask(POLICIES["v1"])}) = 0 AS kept, failed FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": DECONTAMINATE, "op4_chat": CHAT, "op6_neardup": NEARDUP, "op8_suffix": SUFFIX, "op9_substring": SUBSTRING, "op10_quality_rules": QUALITY}
