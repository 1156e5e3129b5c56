"""DuckDB SQL of the training-data queries that SQL can express."""

_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_DECONTAMINATION = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS raw FROM benchmark
), item_words AS (
  SELECT item_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM items
), item_windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM item_words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS t(i) WHERE len(words) > 0
), doc_words AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> ''),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(generate_series(1, greatest(len(words) - size + 1, 0))) AS t(i) WHERE len(words) >= size
), hits AS (
  SELECT d.doc_id, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w ON d.size = w.size AND d.win = w.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words w USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

_SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), wins AS (
  SELECT doc_id, i, hash(array_to_string(words[i : i + 49], ' ')) AS h, md5_number(array_to_string(words[i : i + 49], ' ')) AS m
  FROM w, unnest(generate_series(1, len(words) - 49)) AS t(i) WHERE len(words) >= 50
), firsts AS (
  SELECT h, m, min(doc_id) AS first_id FROM wins GROUP BY h, m
), gone AS (
  SELECT wins.doc_id, list(DISTINCT i) AS starts FROM wins JOIN firsts USING (h, m) WHERE wins.doc_id > first_id GROUP BY wins.doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT k) AS places FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS k FROM (SELECT doc_id, unnest(starts) AS s FROM gone)) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE (SELECT list(x ORDER BY k) FROM (SELECT unnest(words) AS x, generate_subscripts(words, 1) AS k) WHERE NOT list_contains(places, k)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN covered USING (doc_id)
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS t(i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), m AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], '\### Assistant: </turn> ok' FROM range(2) r(k)
), f AS (
  SELECT *, length('<turn>' || replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>') || chr(10) || replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>') || '</turn>') AS size FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT lang, source, k, unnest(words) AS term FROM d
), t AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), l AS (
  SELECT lang, CAST(sum(n) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS v FROM t GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (t.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_INTERACTION = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS k
), o AS (
  SELECT [p.k, q.k, r.k, s.k, t.k] AS places FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), st AS (
  SELECT places, array_to_string(list_transform(places, lambda i: 'ABCDE'[i]), '') AS filter_order, k AS step, places[k] AS own, places[1 : k - 1] AS earlier FROM o, x
), r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (NOT fails[own] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false)) AS kept,
         sum(n) FILTER (fails[own] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false)) AS removed,
         sum(n) FILTER (fails[own] AND coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false)) AS redundant,
         sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
         sum(good) FILTER (fails[own] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false)) AS good_lost,
         sum(toxic) FILTER (fails[own] AND NOT coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false)) AS toxic_lost
  FROM m, st GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r
"""

#: The pages of these tables have one article each, of headings and paragraphs; white space is ASCII, and
#: the character references are those of HTML's own marks.
_MAIN_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h[1-6])>'), lambda x: trim(regexp_replace(
         replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)),
         '[\x20\x09-\x0D]+', ' ', 'g'))) AS blocks FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: regexp_replace(x, '&amp;?', '&', 'g')), lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

SQL = {
    "op2_minhash_near_dedup": _NEAR,
    "op3_warc": _WARC,
    "op5_benchmark_decontamination": _DECONTAMINATION,
    "op8_chat_formatting": _CHAT,
    "op9_substring_dedup": _SUBSTRINGS,
    "op11_source_divergence": _DIVERGENCE,
    "op12_filter_interaction": _INTERACTION,
    "op13_main_text": _MAIN_TEXT,
}
