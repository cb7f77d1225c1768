"""SQL counterparts of the operators that SQL can express.

The others rest on hashes, models or searches that SQL has no words for; tests hold them against brute force.
"""

from __future__ import annotations

CHAT_WINDOWS = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), chr(10), '\n'), ':', '\c') AS erole,
         replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS etext FROM said
), counted AS (
  SELECT *, CAST(ceil((strlen(erole) + strlen(etext) + 14) / 4.0) AS BIGINT) AS tokens, length(erole) + length(etext) + 14 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext) AS nth FROM escaped
), led AS (
  SELECT *, max(CASE WHEN nth = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_tokens,
         max(CASE WHEN nth = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_chars,
         sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) AS running FROM counted
), spans AS (
  SELECT *, running - lead_tokens AS until, nth = 1 AND lead_tokens > 0 AS is_lead,
         CASE WHEN nth = 1 AND lead_tokens > 0 THEN 0 ELSE running - lead_tokens - tokens END AS since,
         greatest(64, 512 - 96 - lead_tokens) AS room FROM led
), bucketed AS (
  SELECT *, greatest(0, floor((until - 1) / room)) AS bucket, NOT is_lead AND floor(since / room) < greatest(0, floor((until - 1) / room)) AS crosses
  FROM spans
), filled AS (
  SELECT *, sum(CASE WHEN is_lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, bucket) AS filled,
         max(until) OVER (PARTITION BY conv_id, bucket) AS bucket_until FROM bucketed
), windowed AS (
  SELECT *, bucket * 2 + CASE WHEN crosses AND filled > room THEN 0 ELSE 1 END AS win,
         NOT is_lead AND CASE WHEN crosses AND filled > room THEN until ELSE bucket_until END - since <= 96 AS tail FROM filled
), wins AS (
  SELECT conv_id, win, min(nth) AS first, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS next FROM windowed GROUP BY conv_id, win
), chars AS (
  SELECT w.conv_id, sum(w.chars) + sum(CASE WHEN w.tail AND n.next IS NOT NULL THEN w.chars ELSE 0 END)
         + sum(CASE WHEN w.nth = n.first AND n.first > 1 THEN w.lead_chars ELSE 0 END) AS formatted_chars
  FROM windowed w JOIN wins n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.win = n.win GROUP BY w.conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS told,
         coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS learned FROM counted GROUP BY conv_id
)
SELECT w.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole w JOIN chars c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""

POISSON_MIX = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, sqrt(size) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight * ((SELECT sum(size) FROM weighed WHERE size > 0)
         / (SELECT sum(weight) FROM weighed WHERE size > 0)) / size ELSE 1.0 END AS whole FROM weighed
), parted AS (
  SELECT source, greatest(1, CAST(ceil(whole / 64.0) AS INTEGER)) AS draws, whole / greatest(1, CAST(ceil(whole / 64.0) AS INTEGER)) AS rate FROM rates
), bounds(source, rate, k, p, below) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM parted
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM bounds WHERE k < 180
), keyed AS (
  SELECT row_number() OVER () AS r, *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS doc_key FROM documents
), numbers AS (
  SELECT r, k.source, unnest(range(draws)) AS draw, doc_key FROM keyed k JOIN parted p ON k.source IS NOT DISTINCT FROM p.source
), drawn AS (
  SELECT r, source, CAST('0x' || substr(md5('7:' || doc_key || CASE WHEN draw > 0 THEN ':draw ' || draw ELSE '' END), 1, 13) AS BIGINT)
         / 4503599627370496.0 AS uniform FROM numbers
), copies AS (
  SELECT d.r, unnest(range(count(*))) AS "copy" FROM drawn d JOIN bounds b ON d.source IS NOT DISTINCT FROM b.source AND b.below <= d.uniform GROUP BY d.r
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c."copy" AS INTEGER) AS "copy",
       CAST('0x' || substr(md5('7 order:' || doc_key || ':' || CAST(c."copy" AS VARCHAR)), 1, 13) AS BIGINT) AS shuffle_key
FROM keyed d JOIN copies c ON d.r = c.r
"""

CONVERSATION_TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS origin, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
         )) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT c.conv_id, t.nth AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.origin AND t.nth <= c.h
), led AS (
  SELECT c.*, (SELECT count(*) FROM heads x WHERE x.conv_id = c.conv_id) AS n_head FROM convs c
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL SELECT c.conv_id, c.n_head + t.nth - c.h, role, text FROM led c JOIN turns t ON t.conv_id = c.conv_id AND t.nth > c.h
), paths AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(role || chr(10) || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), totals AS (
  SELECT conv_id, max(depth) AS total FROM paths GROUP BY conv_id
), nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '') AS ends
  FROM paths JOIN totals USING (conv_id) GROUP BY node
), linked AS (
  SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), counted AS (
  SELECT n.*, l.parent, (SELECT count(*) FROM linked k WHERE k.parent = n.node) AS n_children FROM nodes n LEFT JOIN linked l ON l.node = n.node
), below AS (
  SELECT p.node, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM counted n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""

BLOCK_SEARCH = r"""
WITH folded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (
  SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM folded WHERE len(terms) > 0
), sums AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, n_docs
), scored AS (
  SELECT item_id, tf.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs ON docs.r = tf.r, sums GROUP BY item_id, tf.r
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat_windows": CHAT_WINDOWS, "op9_poisson_mix": POISSON_MIX, "op12_conversation_trie": CONVERSATION_TRIE, "op13_block_search": BLOCK_SEARCH,
    }
