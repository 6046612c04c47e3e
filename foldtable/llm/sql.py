"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from . import license_scan

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPE = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|im_start|>') + length(replace({_ESCAPE.format("role")}, chr(10), '\\n')) + 1
        + length({_ESCAPE.format("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM starts),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs JOIN sizes ON len(w) >= n),
met AS (SELECT p.doc_id, p.k, p.n, x.item FROM
    (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM places) p JOIN windows x ON p.n = x.n AND p.win = x.win),
spots AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM met),
hits AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Five hexadecimal digits are twenty bits, and so four digits of base32.
_HEX = " + ".join(f"((strpos('0123456789abcdef', substr(h, CAST(5 * g + {k + 1} AS INT), 1)) - 1) << {16 - 4 * k})" for k in range(5))
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> {s}) & 31) + 1 AS INT), 1)" for s in (15, 10, 5, 0))

WARC = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, octet_length(encode(body)) AS size, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS kept FROM bodies),
fives AS (SELECT page_id, g, {_HEX} AS v FROM (SELECT page_id, h, unnest(range(8)) AS g FROM digests)),
names AS (SELECT page_id, string_agg({_BASE32}, '' ORDER BY g) AS payload_digest FROM fives GROUP BY page_id)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM digests JOIN names USING (page_id)
"""

EMBEDDINGS = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

_LETTERS = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate("ABCDE"))

FILTERS = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM docs),
masks AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, mask),
f(c, b) AS (VALUES {_LETTERS}),
orders AS (SELECT [p.c, q.c, r.c, s.c, t.c] AS cs, [p.b, q.b, r.b, s.b, t.b] AS bs FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
asked AS (SELECT array_to_string(cs, '') AS filter_order, k AS step, CAST(list_sum(bs[1:k - 1]) AS INT) AS before, bs[k] AS bit FROM orders, range(1, 6) x(k)),
steps AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM masks, asked GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM steps
"""

_DIGIT = "(strpos('0123456789ABCDEF', substr(h, {}, 1)) - 1)"

SPELLING = f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM told),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST(16 * {_DIGIT.format("CAST(2 * i + 1 AS INT)")} + {_DIGIT.format("CAST(2 * i + 2 AS INT)")} AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INT) + 1]))) AS x FROM bytes, crc),
spoiled AS (SELECT CASE WHEN x % 97 = 0 THEN substr(run, 1, CAST(x % length(run) AS INT)) || substr(run, CAST(x % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, k, substr(word, 1, CAST(k AS INT)) || substr(word, CAST(k AS INT) + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS k) u),
near AS MATERIALIZED (SELECT l.word AS a, w.word AS b, w.n FROM less l JOIN words w ON w.word = l.rest UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
    UNION SELECT l.word, r.word, r.n FROM less l JOIN less r ON l.k = r.k AND l.rest = r.rest WHERE l.word <> r.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
led(word, root, next) AS (SELECT word, word, form FROM forms UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN forms f ON f.word = l.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN led USING (word) WHERE next IS NULL
"""


def _licenses() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = license_scan.Templates(license_scan.TEMPLATES, {})
    names = {k: w.decode() for w, k in rows.number.items()}
    templates = ", ".join(f"({half}, {quoted(label)}, {need}, [{', '.join(quoted(names[x]) for x in numbers)}])" for half, label, numbers, need in rows.rows)
    phrases = ", ".join(f"({quoted(label)}, {quoted(p)}, {len(p.split())})" for label, p in license_scan.PHRASES)
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
templates(half, label, need, t) AS (VALUES {templates}), phrases(label, p, n) AS (VALUES {phrases}),
places AS (SELECT rid, k - 1 AS place, label FROM (SELECT rid, w, label, p, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, phrases WHERE len(w) >= n) u WHERE array_to_string(w[k:k + n - 1], ' ') = p),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY rid),
blocks AS (SELECT rid, half, list_distinct(w[s + 1:s + 2 * half]) AS b FROM (SELECT rid, w, half, unnest(range(0, len(w), half)) AS s FROM docs, (SELECT DISTINCT half FROM templates) h) u),
met AS (SELECT rid, label, common / len(t) AS part FROM (SELECT rid, label, need, t, len(list_intersect(b, t)) AS common FROM blocks JOIN templates USING (half)) u WHERE common >= need),
more AS (SELECT rid, list(DISTINCT label) AS more, max(part) AS best FROM met GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


ORACLE_SQL = {
    "op3_chat_formatting": CHAT,
    "op8_decontamination": DECONTAMINATION,
    "op9_warc": WARC,
    "op10_embedding_near_dedup": EMBEDDINGS,
    "op11_filter_audit": FILTERS,
    "op12_spelling": SPELLING,
    "op13_license_scan": _licenses(),
}
