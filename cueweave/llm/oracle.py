"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

URLS = r"""
WITH RECURSIVE pages_ AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT src, CASE
      WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
        THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh')
        THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS dst
  FROM tags),
urls AS (
  SELECT DISTINCT url FROM pages UNION SELECT src FROM links WHERE dst LIKE '%://%' UNION SELECT dst FROM links WHERE dst LIKE '%://%'),
known AS (
  SELECT url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM urls),
placed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/+$', '') || query END AS place FROM known),
rules(action, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
own AS (
  SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM placed JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY url),
edges AS (
  SELECT DISTINCT a.place AS a, b.place AS b
  FROM links l JOIN placed a ON a.url = l.src JOIN placed b ON b.url = l.dst WHERE a.place <> b.place),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
parts AS (SELECT a AS place, least(a, min(b)) AS component FROM reach GROUP BY a),
inherited AS (
  SELECT coalesce(component, place) AS grp, min(action) AS action
  FROM placed JOIN own USING (url) LEFT JOIN parts USING (place) GROUP BY 1)
SELECT g.page_id, g.host, g.path, o.rule, coalesce(o.action, i.action, 'allow') AS verdict,
       c.component, CASE WHEN o.action IS NULL THEN i.action END AS inherited
FROM pages_ g LEFT JOIN own o ON o.url = g.url LEFT JOIN placed p ON p.url = g.url
LEFT JOIN parts c ON c.place = p.place LEFT JOIN inherited i ON i.grp = coalesce(c.component, p.place)
"""

CALLS = """
WITH asked AS (
  SELECT conv_id, turn, length(text) AS n, md5(text) AS d, 'c' || conv_id || '-' || turn || '-' AS base,
         CAST(length(text) % 10 + 1 AS VARCHAR) AS k
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
calls AS (
  SELECT conv_id, turn, n, d, 0 AS pos, base || '0' AS call_id, 'search' AS name,
         '{"k":' || CASE WHEN n % 7 = 0 THEN '"' || k || '"' ELSE k END || ',"q":"' || d || '"}' AS args,
         CAST([] AS VARCHAR[]) AS refs, CASE WHEN n % 7 = 0 THEN 'invalid_arguments' END AS problem FROM asked
  UNION ALL
  SELECT conv_id, turn, n, d, 1, base || '1', 'read',
         CASE WHEN n % 19 <> 0 THEN '{"doc":"${' || base || '0}","lines":[3,1]}' END,
         CASE WHEN n % 19 <> 0 THEN [base || '0'] ELSE CAST([] AS VARCHAR[]) END,
         CASE WHEN n % 19 = 0 THEN 'bad_json' END FROM asked
  UNION ALL
  SELECT conv_id, turn, n, d, 2, base || '2', 'compare',
         '{"a":"${' || base || '0}","b":"${' || base || '1}","exact":true}', [base || '0', base || '1'], NULL
  FROM asked WHERE n % 2 = 0
  UNION ALL
  SELECT conv_id, turn, n, d, 3, base || '3', 'guess', '{}', CAST([] AS VARCHAR[]), 'unknown_tool' FROM asked WHERE n % 11 = 0
  UNION ALL
  SELECT conv_id, turn, n, d, 4, base || '4', 'read', '{"doc":"${' || base || '5}"}', [base || '5'], NULL FROM asked WHERE n % 13 = 0
  UNION ALL
  SELECT conv_id, turn, n, d, 5, base || '5', 'read', '{"doc":"${' || base || '4}"}', [base || '4'], NULL FROM asked WHERE n % 13 = 0),
sound AS (SELECT conv_id, call_id, refs FROM calls WHERE problem IS NULL),
level0 AS (SELECT conv_id, call_id, 0 AS level FROM sound WHERE len(refs) = 0),
needs AS (SELECT conv_id, call_id, unnest(refs) AS ref FROM sound),
level1 AS (
  SELECT n.conv_id, n.call_id, 1 AS level FROM needs n LEFT JOIN level0 l ON l.conv_id = n.conv_id AND l.call_id = n.ref
  GROUP BY ALL HAVING count(l.level) = count(*)),
upto1 AS (SELECT * FROM level0 UNION ALL SELECT * FROM level1),
level2 AS (
  SELECT n.conv_id, n.call_id, 1 + max(l.level) AS level FROM needs n LEFT JOIN upto1 l ON l.conv_id = n.conv_id AND l.call_id = n.ref
  GROUP BY n.conv_id, n.call_id HAVING count(l.level) = count(*) AND max(l.level) = 1),
levels AS (SELECT * FROM upto1 UNION ALL SELECT * FROM level2),
told AS (
  SELECT c.conv_id, c.turn, c.pos, c.call_id, c.name, l.level, c.args, c.problem,
         CASE WHEN (c.n + c.pos) % 5 <> 0 THEN md5(c.d || c.pos) END AS result
  FROM calls c LEFT JOIN levels l USING (conv_id, call_id)),
stated AS (
  SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN level IS NULL THEN 'unordered'
                 WHEN result IS NULL THEN 'no_result' ELSE 'ok' END AS status FROM told)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, call_id, name, CAST(level AS INTEGER) AS level, status,
       '{"arguments":' || coalesce(args, 'null') || ',"id":"' || call_id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
       || ',"name":"' || name || '","result":' || coalesce('"' || result || '"', 'null') || ',"status":"' || status || '"}' AS json
FROM stated
UNION ALL
SELECT conv_id, turn, NULL, 'x' || turn, NULL, NULL, 'orphan_result',
       '{"arguments":null,"id":"x' || turn || '","level":null,"name":null,"result":"' || md5(text) || '","status":"orphan_result"}'
FROM conversations WHERE role <> 'assistant' AND length(text) % 17 = 0
"""

VECTORS = """
WITH RECURSIVE given AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT * FROM given WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM given LEFT JOIN counts ON counts.a = vec_id LEFT JOIN parts ON parts.a = vec_id
"""

STRETCHES = """
WITH docs AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
blocks AS (
  SELECT doc_id, p0, substr(h, 2 * p0 + 1, 298) AS piece
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 100)) AS p0 FROM docs)),
stretches AS (
  SELECT doc_id, p0 + j AS i, substr(piece, 2 * j + 1, 100) AS s
  FROM (SELECT doc_id, p0, piece, unnest(range(0, length(piece) // 2 - 49)) AS j FROM blocks)),
first AS (SELECT s, min(doc_id) AS first_id FROM stretches GROUP BY s HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM stretches JOIN first USING (s) WHERE first_id < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM later),
counted AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM counted GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

# -- sharding -----------------------------------------------------------------------

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, lowest bit first


def _after_zeros(state: int, n_bytes: int) -> int:
    """A CRC-32 register once ``n_bytes`` zero bytes have passed."""
    for _ in range(8 * n_bytes):
        state = state >> 1 ^ (POLYNOMIAL if state & 1 else 0)
    return state


def _linear(value: str, images: list[int], start: str) -> str:
    """XOR of ``start`` and the images of the bits that are set in ``value``."""
    for i, image in enumerate(images):
        start = f"xor({start}, ({value} >> {i} & 1) * {image})"
    return start


def _crc32(blobs: str, piece: int = 64) -> str:
    """CTEs ending in ``crcs`` (id, crc): the CRC-32 of ``h``, texts in hex, of the CTE ``blobs`` (id, h).

    Texts are cut in pieces from the end, and the registers of the pieces are put together.
    """
    byte = _linear("xor(c, x)", [_after_zeros(1 << i, 1) for i in range(8)], "c >> 8")
    joined = _linear("c", [_after_zeros(1 << i, piece) for i in range(32)], "x")
    return f"""
pieces AS (
  SELECT id, p, CASE WHEN p = 0 THEN 4294967295 ELSE 0 END AS c0,
         substr(h, greatest(length(h) - 2 * {piece} * (n - p), 0) + 1,
                length(h) - 2 * {piece} * (n - p - 1) - greatest(length(h) - 2 * {piece} * (n - p), 0)) AS q
  FROM (SELECT id, h, n, unnest(range(n)) AS p
        FROM (SELECT id, h, greatest((length(h) + 2 * {piece} - 1) // (2 * {piece}), 1) AS n FROM {blobs}))),
registers AS (
  SELECT id, p, list_reduce([('0x' || q[2*i+1:2*i+2])::BIGINT FOR i IN range(length(q) // 2)],
                            lambda c, x: {byte}, c0::BIGINT) AS r FROM pieces),
crcs AS (
  SELECT id, xor(list_reduce(list(r ORDER BY p), lambda c, x: {joined}), 4294967295) AS crc FROM registers GROUP BY id)"""


def _shards(shards: int = 24) -> str:
    return f"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h,
         ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[:16])::UBIGINT AS key FROM documents),
jump(id, k, b, j) AS (
  SELECT id, key::UHUGEINT, -1::BIGINT, 0::BIGINT FROM given
  UNION ALL
  SELECT id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 >> 33) + 1 AS DOUBLE)))::BIGINT
  FROM (SELECT id, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2
        FROM jump WHERE j < {shards + 1})),
told AS (
  SELECT id, max(b) FILTER (WHERE b < {shards})::INT AS shard, max(b) FILTER (WHERE b <= {shards})::INT AS grown_shard
  FROM jump GROUP BY id),{_crc32("given")}
SELECT doc_id, length(h) // 2 + 8 AS size, crc AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, length(h), crc) - 1 AS slot, grown_shard
FROM given JOIN told USING (id) JOIN crcs USING (id)
"""


AUDIT = r"""
WITH given AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM given GROUP BY text),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN coalesce(first_id < g.doc_id, false) THEN 'E' ELSE '' END) AS fails
  FROM given g JOIN firsts USING (text) LEFT JOIN marks m ON m.doc_id = g.doc_id),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM flags GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
cells AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, fails,
         contains(fails, f) AS failed, translate(fails, before, '') <> fails AS gone FROM counts, steps),
told AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (WHERE NOT failed AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE failed AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fails = f), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n_toxic) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM cells GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f) REPLACE (CAST(step AS INTEGER) AS step), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told
"""


def _tries() -> str:
    return rf"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
given AS (SELECT DISTINCT c AS id, hex(encode(CAST(c AS VARCHAR))) AS h FROM turns),{_crc32("given")},
convs AS (SELECT id AS c, id - id % 20 AS base, crc % 4 AS h FROM crcs),
rows_ AS (
  SELECT k.c, 0 AS part, i, t, w FROM convs k JOIN turns s ON s.c = k.base AND s.i < k.h
  UNION ALL SELECT k.c, 1, i, t, w FROM convs k JOIN turns s ON s.c = k.c AND s.i >= k.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, t, w FROM rows_),
keyed AS (SELECT c, d, w, md5(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM placed),
paths AS (
  SELECT c, 0 AS d, 0 AS w, '' AS key, NULL AS up FROM convs
  UNION ALL SELECT c, d, w, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') FROM keyed),
nodes AS (
  SELECT key, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, any_value(w) AS w, count(*) AS n FROM paths GROUP BY key),
kids AS (SELECT up AS key, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
ends AS (
  SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest
  FROM (SELECT c, arg_max(key, d) AS key FROM paths GROUP BY c) GROUP BY key),
below AS (
  SELECT a.key, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM nodes n JOIN paths a ON a.c = n.conv_id AND a.d <= n.depth LEFT JOIN kids ON kids.key = n.key GROUP BY a.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN nodes p ON p.key = n.up LEFT JOIN kids ON kids.key = n.key
LEFT JOIN ends ON ends.key = n.key
"""


def statements() -> dict[str, str]:
    """SQL by query name."""
    return {
        "op1_redirect_equivalence": URLS,
        "op4_tool_calls": CALLS,
        "op7_grid_order_join": VECTORS,
        "op9_interval_expansion": STRETCHES,
        "op11_jump_hash": _shards(),
        "op12_filter_audit": AUDIT,
        "op13_prefix_trie": _tries(),
    }
