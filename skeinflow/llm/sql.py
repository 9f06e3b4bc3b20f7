"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from skeinflow.llm import line_dedup, secret_scan, source_mixing

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_WORDS = rf"list_filter(regexp_split_to_array({LOWER}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
ALNUM_WORDS = rf"list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {WORDS} AS a FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 12], ' ')) AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS f FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN m USING (k), range(0, 13) t(j) WHERE f < doc_id),
p AS (SELECT doc_id, i, a[i] AS word FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, count(r.p) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (r.p IS NULL) AS kept FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.i GROUP BY 1)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

#: A line's place is doc_id * 2^24 + position: doc_ids are unique and lines of a text are fewer.
_LINE_WORDS = r"list_filter(regexp_split_to_array(norm, '[ \t\x0b\f\r]+'), lambda w: w <> '')"
LINE_DEDUP = f"""WITH l AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, pos, norm, doc_id * 16777216 + pos AS place FROM l WHERE len({_LINE_WORDS}) > 0),
d AS (SELECT norm, min(place) AS f FROM o GROUP BY norm),
w AS (SELECT norm, f, {_LINE_WORDS} AS a FROM d WHERE len({_LINE_WORDS}) >= {line_dedup.EDIT_WORDS}),
v AS (SELECT norm, f, i, md5(array_to_string(a[:i - 1] || a[i + 1:], ' ')) AS k FROM (SELECT norm, f, a, unnest(range(1, len(a) + 1)) AS i FROM w)),
h AS (SELECT norm, f, md5(array_to_string(a, ' ')) AS k FROM w),
vi AS (SELECT k, i, min(f) AS least FROM v GROUP BY k, i), vk AS (SELECT k, min(f) AS least FROM v GROUP BY k), hk AS (SELECT k, min(f) AS least FROM h GROUP BY k),
n AS (SELECT norm FROM v JOIN vi USING (k, i) WHERE least < f UNION SELECT norm FROM v JOIN hk USING (k) WHERE least < f UNION SELECT norm FROM h JOIN vk USING (k) WHERE least < f UNION SELECT norm FROM h JOIN hk USING (k) WHERE least < f),
g AS (SELECT o.doc_id, o.pos FROM o JOIN d USING (norm) LEFT JOIN n ON n.norm = o.norm WHERE place > f OR n.norm IS NOT NULL),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

_FOLDED = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_ASSIGN = _FOLDED + r"""[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str) -> str:
    """Of a text t: its matches with positions, from the lengths of matches and of the pieces between them."""
    pattern = pattern.replace("'", "''")
    found = f"regexp_extract_all(t, '{pattern}')"
    cut = f"regexp_split_to_array(t, '{pattern}')"
    value = f"regexp_extract_all(t, '{pattern}', 2)[i]" if kind == 0 else "NULL"
    start = f"coalesce(list_sum(list_transform({cut}[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: len(x))), 0)"
    return f"SELECT doc_id, {kind} AS kind, CAST(start AS BIGINT) AS start, CAST(start + len(text) AS BIGINT) AS stop, text, value FROM (SELECT doc_id, {found}[i] AS text, {value} AS value, {start} AS start FROM (SELECT doc_id, t, unnest(range(1, len({found}) + 1)) AS i FROM d WHERE len({found}) > 0))"


_TERMS = f"[{', '.join(map(str, secret_scan.terms(secret_scan.WINDOW)))}]"
_LIMITS = {k: secret_scan.limit(secret_scan.WINDOW, v) for k, v in secret_scan.THRESHOLDS.items()}
_KINDS = f"[{', '.join(repr(k) for k in secret_scan.KINDS)}]"
_LISTED = f"{_KINDS}[kind + 1] || ':' || start || ':' || stop"
SECRETS = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, kind, start, stop FROM ({_spans(0, _ASSIGN)}) WHERE len(value) >= 6 UNION ALL SELECT doc_id, kind, start, stop FROM ({_spans(1, secret_scan.ACCESS)}) UNION ALL SELECT doc_id, kind, start, stop FROM ({_spans(2, secret_scan.HEX)})),
c AS (SELECT doc_id, start, text, CASE WHEN regexp_full_match(text, '[0-9a-fA-F]+') THEN {_LIMITS['hex']} WHEN regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]') THEN {_LIMITS['mixed']} ELSE {_LIMITS['one_case']} END AS most FROM ({_spans(3, secret_scan.CANDIDATE)})
 WHERE regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]') AND NOT ({' OR '.join(f"regexp_matches(text, '{p}')" for p in secret_scan.ALLOWED)})
 AND NOT (len(string_split(text, '/')) > 2 AND list_bool_and(list_transform(string_split(text, '/'), lambda p: len(p) <= {secret_scan.PATH_PIECE_LENGTH} AND regexp_matches(p, '{secret_scan.PATH_PIECE}'))))),
w AS (SELECT doc_id, start, text, most, i, list_sum(list_transform(map_values(list_histogram(string_split(substring(text, i + 1, {secret_scan.WINDOW}), ''))), lambda n: {_TERMS}[CAST(n AS BIGINT) + 1])) AS total FROM (SELECT *, unnest(range(0, len(text) - {secret_scan.WINDOW - 1})) AS i FROM c)),
h AS (SELECT doc_id, start + min(i) AS start, start + max(i) + {secret_scan.WINDOW} AS stop, substring(text, min(i) + 1, max(i) - min(i) + {secret_scan.WINDOW}) AS text FROM w WHERE total <= most GROUP BY doc_id, start, text),
a AS (SELECT * FROM b UNION ALL SELECT doc_id, 3 AS kind, start, stop FROM h WHERE NOT regexp_matches(text, '{secret_scan.PLACEHOLDER}')),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
 string_agg({_LISTED}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({_LISTED}, ',' ORDER BY start, kind) AS spans FROM a GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN g USING (doc_id)"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS a FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(a[i:i + 4], ' ')) AS k FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, least(len(a), 1) + 1))) AS i FROM w)),
n AS (SELECT w.doc_id, count(k) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""

DECONTAMINATION = f"""WITH w AS (SELECT doc_id, {ALNUM_WORDS} AS a FROM documents), b AS (SELECT item_id, {ALNUM_WORDS} AS a, least(13, len(a)) AS k FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, k, md5(array_to_string(a[i:i + k - 1], ' ')) AS h FROM (SELECT item_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM b WHERE k > 0)),
g AS (SELECT doc_id, i, k, md5(array_to_string(a[i:i + k - 1], ' ')) AS h FROM (SELECT doc_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM p) t WHERE len(a) >= k)),
f AS (SELECT doc_id, i, k, item_id FROM g JOIN p USING (k, h)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM f, range(0, 13) t(j) WHERE j < k GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY 1)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit > 0 AND 20 * n_hit >= len(a), false) AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('{source_mixing.SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
c AS (SELECT CAST(least({source_mixing.MAX_SHARDS}, greatest(1, ceil(count(*) / {source_mixing.SHARD_DOCS}))) AS BIGINT) AS shards FROM d),
z AS (SELECT d.*, CAST('0x' || substring(h, 1, 8) AS BIGINT) % shards AS shard FROM d, c),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER f AS place, sum(n) OVER () AS total, coalesce(sum(3 * n) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s WINDOW f AS (ORDER BY 3 * n / w, source NULLS LAST)),
v AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM o),
t AS (SELECT source, n, total, least(CAST(3 * n AS DOUBLE), w * (SELECT arg_min(level, place) FROM v WHERE level * w <= 3 * n)) AS target FROM v),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r FROM t, LATERAL (SELECT unnest(range(CAST(ceil(total / {source_mixing.BLOCK}) AS BIGINT) + 1)) AS k) WHERE target > 0),
b AS (SELECT source, count(*) AS blocks FROM q WHERE r <= (SELECT ceil(max(total) / {source_mixing.BLOCK}) FROM t) GROUP BY 1),
p AS (SELECT z.source, z.shard, CAST(sum(size) AS BIGINT) AS words, max(blocks) AS blocks FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source GROUP BY 1, 2),
u AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard, k) AS r FROM p, LATERAL (SELECT unnest(range(blocks)) AS k) WHERE words > 0),
a AS (SELECT source, shard, count(*) AS quota FROM u WHERE r <= blocks GROUP BY 1, 2),
m AS (SELECT p.source, p.shard, p.words, least({source_mixing.BLOCK} * coalesce(a.quota, 0), 3 * p.words) AS quota FROM p LEFT JOIN a ON a.source IS NOT DISTINCT FROM p.source AND a.shard = p.shard),
e AS (SELECT z.doc_id, z.size, z.source, z.shard, coalesce(sum(size) OVER (PARTITION BY z.source, z.shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
SELECT e.doc_id, e.size, t.n AS source_size, round(t.target, 6) AS target, CAST(CASE WHEN coalesce(m.words, 0) = 0 THEN 0 ELSE (m.quota // m.words) * e.size + least(greatest(m.quota % m.words - e.start, 0), e.size) END AS BIGINT) AS taken
FROM e JOIN t ON t.source IS NOT DISTINCT FROM e.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM e.source AND m.shard = e.shard"""

_BARE = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i')"
_HOST = rf"regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')"
_PATH = rf"regexp_replace(regexp_extract({_BARE}, '^[^/?]*([^?]*)', 1), '/+$', '')"
_KEPT = rf"list_filter(string_split(regexp_extract({_BARE}, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]*|gclid|fbclid|ref|sessionid)='))"
WARC = f"""WITH c AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, {_HOST} || {_PATH} || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string(list_sort({_KEPT}), '&') ELSE '' END AS canonical_url FROM pages),
l AS (SELECT v.page_id, max(r.page_id) AS refers_to_page FROM c v JOIN c r ON r.canonical_url = v.canonical_url AND r.page_id <= v.page_id + 5000 GROUP BY 1)
SELECT c.page_id, c.canonical_url, refers_to_page, CASE WHEN substring(r.digest, 1, 16) = substring(c.digest, 1, 16) THEN 'resolved' ELSE 'mismatch' END AS outcome,
 CAST(CASE WHEN substring(r.digest, 1, 16) = substring(c.digest, 1, 16) THEN 200 ELSE 304 END AS INTEGER) AS status, CASE WHEN substring(r.digest, 1, 16) = substring(c.digest, 1, 16) THEN 'text/html' END AS content_type,
 strftime(make_timestamp(CAST(c.page_id + 5000 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN substring(r.digest, 1, 16) = substring(c.digest, 1, 16) THEN r.digest ELSE sha256('') END AS payload_sha256
FROM c JOIN l USING (page_id) JOIN c r ON r.page_id = refers_to_page"""

ORACLE_SQL = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_line_dedup": LINE_DEDUP,
    "op3_secret_scan": SECRETS,
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op7_warc_revisits": WARC,
    "op9_source_mixing": MIXING,
    "op10_benchmark_decontamination": DECONTAMINATION,
}
