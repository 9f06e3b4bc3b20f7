"""The registered queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions import html as H
from skeinflow.functions import json as J
from skeinflow.functions import text as T
from skeinflow.functions import url as U
from skeinflow.functions import vector as V
from skeinflow.operators import cache as C
from skeinflow.operators import conversation, filters, frontier, rank, routing, sets
from skeinflow.plans import fixtures as X
from skeinflow.plans.fixtures import quoted
from skeinflow.sources.expert_config import EXPERTS
from skeinflow.sources.tables import experts, table
from skeinflow.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the of reation thention"
SIM = 0.3
STARTS = ["https://a.com/"]
NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def any_in(text: str, values) -> str:
    """SQL: is one of the strings in the text."""
    return f"coalesce(len(list_filter({listed(values)}, lambda k: contains({text}, k))) > 0, false)"


def any_ends(text: str, values) -> str:
    return f"coalesce(len(list_filter({listed(values)}, lambda k: ends_with({text}, k))) > 0, false)"


SQL_NETLOC = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
SQL_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
SQL_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
SQL_SENTENCES = r"string_split(regexp_replace(text, '([.!?¿¡…])\s+', '\1' || chr(1), 'g'), chr(1))"
SQL_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"
SQL_TITLE = "trim(regexp_extract(lower(html), '<title[^>]*>(.*?)</title>', 1))"
SQL_INNER = "coalesce(nullif(regexp_extract(lower(html), '<body[^>]*>(.*?)</body>', 1, 's'), ''), lower(html))"
SQL_BODY = f"substring(regexp_replace(regexp_replace(regexp_replace({SQL_INNER}, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g'), 1, 5000)"
SQL_EXCLUDED = f"(list_contains({listed(U.SOCIAL_DOMAINS)}, regexp_replace(lower({SQL_NETLOC}), '^www\\.', '')) or {any_ends(f"regexp_replace(lower({SQL_NETLOC}), '^www\\.', '')", ['.' + d for d in U.SOCIAL_DOMAINS])})"
SQL_PARAMETERS = f"len(list_distinct(list_transform(list_filter(string_split({SQL_QUERY}, '&'), lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: regexp_extract(p, '^([^=]*)=', 1))))"
SQL_CRAWLABLE = f"""(url <> '' and not {any_ends('lower(url)', U.STATIC_EXTENSIONS)}
 and (not contains(lower(url), 'wikipedia.org') or (not {any_in('lower(url)', U.WIKIPEDIA_EXCLUDED)} and starts_with({SQL_PATH}, '/wiki/') and length({SQL_PATH}) >= 7))
 and (not (contains(lower(url), 'reddit.com') or contains(lower(url), 'redd.it')) or (not {any_in('lower(url)', U.REDDIT_EXCLUDED)} and contains(lower(url), '/comments/')))
 and (not contains(lower(url), 'github.com') or not {any_in('lower(url)', U.GITHUB_EXCLUDED)})
 and not {any_in('lower(url)', U.GENERAL_EXCLUDED)} and length(url) <= 500 and {SQL_PARAMETERS} <= 10)"""
SQL_LAST = f"regexp_extract(regexp_replace({SQL_PATH}, '/+$', ''), '([^/]*)$', 1)"
SQL_HTML = f"(url <> '' and not regexp_matches(url, '^(javascript|mailto|tel|data):') and (not contains({SQL_LAST}, '.') or list_contains({listed(U.HTML_EXTENSIONS)}, lower(regexp_extract({SQL_LAST}, '(\\.[^.]*)$', 1)))))"
SQL_RAW = f"""({any_in(f'lower({SQL_NETLOC})', U.RAW_HOSTS)} or (contains(lower({SQL_NETLOC}), 'gitlab.com') and contains({SQL_PATH}, '/-/raw/')) or (contains(lower({SQL_NETLOC}), 'bitbucket.org') and contains({SQL_PATH}, '/raw/'))
 or {any_in('lower(url)', U.PASTEBINS)} or ({any_in(f'lower({SQL_NETLOC})', U.CODE_HOSTS)} and ({any_ends(f"lower(regexp_replace({SQL_PATH}, '/+$', ''))", U.RAW_EXTENSIONS)} or {any_ends('lower(url)', U.RAW_EXTENSIONS)})))"""
SQL_UNION_URLS = f"(SELECT url FROM pages UNION ALL SELECT url FROM {X.URLS.sql})"


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").unionAll(X.URLS.frame(spark).select("url"))


# Text


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, CASE WHEN length(text) // 4 > 50 THEN substring(text, 1, 200) || {quoted(T.TRUNCATED)} ELSE text END AS text FROM documents")
def truncate_content(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_tokens("text", 50).alias("text"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, a[i] AS sentence FROM (SELECT doc_id, {SQL_SENTENCES} AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("ord", "sentence"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {SQL_SENTENCES} AS a FROM documents),
u AS (SELECT doc_id, i, a[i] AS sent, length(a[i]) // 4 AS tk FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s)),
r AS (SELECT doc_id, i, tk AS cur, 0 AS ch FROM u WHERE i = 1 UNION ALL
 SELECT u.doc_id, u.i, CASE WHEN r.cur + u.tk > 256 THEN u.tk ELSE r.cur + u.tk END, CASE WHEN r.cur + u.tk > 256 THEN r.ch + 1 ELSE r.ch END FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1)
SELECT r.doc_id, CAST(r.ch AS INTEGER) AS chunk_index, string_agg(u.sent, ' ' ORDER BY u.i) AS chunk FROM r JOIN u USING (doc_id, i) GROUP BY 1, 2""")
def chunk_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks("text")).alias("chunk_index", "chunk"))


@query(rf"SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({listed(T.STOPWORDS)}, w)))) AS word FROM benchmark")
def query_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.query_words("text")).alias("word"))


@query(f"SELECT page_id, ({any_in('lower(html)', T.NOISE_KEYWORDS)} AND NOT {any_in('lower(html)', ['reation', 'thention'])}) AS noise FROM pages")
def noise_flag(spark, d):
    return table(spark, d, "pages").select("page_id", T.is_noise("html", T.query_words(F.lit(QUERY))).alias("noise"))


@query(f"SELECT doc_id, CAST(len(list_filter({listed(QUERY.split())}, lambda w: contains(lower(text), w))) AS INTEGER) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def keyword_score_topk(spark, d):
    return rank.top_k(table(spark, d, "documents").select("doc_id", T.keyword_score("text", F.lit(QUERY)).alias("score")), 20, F.col("score"), "doc_id")


@query(rf"""WITH w AS (SELECT DISTINCT item_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g')) AS w FROM benchmark),
r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn FROM w WHERE length(w) > 3 AND NOT list_contains({listed(T.PREFLIGHT_STOPWORDS)}, w))
SELECT item_id, string_agg(w, ',' ORDER BY rn) AS anchors FROM r WHERE rn <= 2 GROUP BY 1""")
def anchor_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.anchor_keywords("text"), ",").alias("anchors")).where("anchors <> ''")


@query(rf"""SELECT id, CASE WHEN s = '' THEN text ELSE s END AS text FROM (SELECT id, text, regexp_replace(regexp_replace(text, '<think>.*?</think>\s*', '', 'gs'), '^\s+|\s+$', '', 'g') AS s FROM {X.THINK.sql})
UNION ALL SELECT conv_id * 1000 + turn, trim(text, chr(10) || chr(9) || ' ' || chr(13)) FROM conversations WHERE length(text) > 0""")
def think_strip(spark, d):
    wrapped = table(spark, d, "conversations").where("length(text) > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("<think>plan\n</think>\n"), "text").alias("text"))
    return X.THINK.frame(spark).unionByName(wrapped.select(F.col("id"), "text")).select(F.col("id").cast("bigint").alias("id"), T.strip_think("text").alias("text"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(right(text, 6000), chr(10)), lambda r: regexp_replace(r, '\s+$', '')), lambda r: r <> '')[-20:] AS a FROM documents),
p AS (SELECT doc_id, a, list_transform(range(1, len(a)), lambda i: coalesce(list_min(list_filter(range(1, least(len(a[i]), len(a[i + 1])) + 1), lambda k: substring(a[i], k, 1) <> substring(a[i + 1], k, 1))) - 1, least(len(a[i]), len(a[i + 1])))) AS b FROM l WHERE len(a) >= 4),
c AS (SELECT doc_id, CAST(len(a) AS INTEGER) AS lines, CAST(len(a) - len(list_distinct(a)) AS INTEGER) AS exact, list_sort(list_filter(b, lambda x: x >= 12)) AS s FROM p),
m AS (SELECT *, CAST(len(s) AS INTEGER) AS shared, CAST(coalesce(s[len(s) // 2 + 1], 0) AS INTEGER) AS median, CAST(floor(coalesce(s[len(s) // 2 + 1], 0) / 3.7) AS INTEGER) AS tokens FROM c)
SELECT d.doc_id, coalesce(lines, 0) AS lines, coalesce(exact, 0) AS exact, coalesce(shared, 0) AS shared, coalesce(median, 0) AS median, coalesce(tokens, 0) AS tokens,
 CASE WHEN lines IS NULL OR (exact = 0 AND shared = 0) THEN '' WHEN exact >= greatest(2, lines // 3) THEN 'verbatim' WHEN shared >= greatest(2, (lines - 1) // 2) THEN CASE WHEN tokens >= 4 THEN 'template' ELSE 'template_short' END ELSE 'partial' END AS verdict FROM documents d LEFT JOIN m USING (doc_id)""")
def repetition_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", T.repetition_tail("text").alias("t")).select("doc_id", "t.*")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(right(text, 6000), chr(10)), lambda r: regexp_replace(r, '\s+$', '')), lambda r: r <> '') AS a FROM documents), m AS (SELECT doc_id, a[-20:] AS a FROM l)
SELECT doc_id, CAST(len(a) AS INTEGER) AS lines, CAST(len(a) - len(list_distinct(a)) AS INTEGER) AS exact FROM m WHERE len(a) >= 4""")
def repetition_exact(spark, d):
    found = table(spark, d, "documents").select("doc_id", T.repetition_tail("text").alias("t"))
    return found.select("doc_id", "t.lines", "t.exact").where("lines >= 4")


@query(f"""SELECT doc_id, CASE WHEN octet_length(encode(text)) > 101 THEN left(text, n) || CASE WHEN octet_length(encode(left(text, n))) < 101 THEN '�' ELSE '' END || {quoted(T.TRUNCATED)} ELSE text END AS text
FROM (SELECT doc_id, text, list_max(list_filter(range(0, 102), lambda k: octet_length(encode(left(text, k))) <= 101)) AS n FROM documents)""")
def byte_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_bytes("text", 101).alias("text"))


@query(f"SELECT conv_id, turn, {any_in("replace(replace(text, '▶️', '▶'), '►', '▶')", T.PROTOCOL_MARKERS)} AS marker, (contains(lower(text), 'traceback (most recent call last)') OR contains(lower(text), 'traceback:') OR (contains(lower(text), 'exception') AND contains(lower(text), 'file \"')) OR regexp_matches(lower(text), 'file \".+\", line \\d+')) AS error, {any_in('lower(text)', T.TOOL_PHRASES)} AS tool FROM conversations WHERE text IS NOT NULL")
def preserve_error(spark, d):
    turns = table(spark, d, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", T.has_marker("text").alias("marker"), T.is_traceback("text").alias("error"), T.is_tool_request("text").alias("tool"))


SQL_FENCE = "(?s)```(\\w*)\\s*\\n(.*?)(?:```|\\z)"
SQL_NAMES = r"list_concat(regexp_extract_all(text, '(?m)^class\s+([A-Za-z_]\w*)', 1), regexp_extract_all(text, '(?m)^(?:async )?def\s+([A-Za-z_]\w*)', 1))"


@query(f"""WITH p AS (SELECT id, regexp_split_to_array(text, '{SQL_FENCE}') AS plain, regexp_extract_all(text, '{SQL_FENCE}', 1) AS lang, regexp_extract_all(text, '{SQL_FENCE}', 2) AS body FROM {X.CODE.sql}),
s AS (SELECT id, 2 * i AS n, 'text' AS kind, '' AS lang, plain[i] AS text FROM (SELECT id, plain, unnest(range(1, len(plain) + 1)) AS i FROM p) UNION ALL SELECT id, 2 * i + 1, 'code', lang[i], body[i] FROM (SELECT id, lang, body, unnest(range(1, len(body) + 1)) AS i FROM p))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS ord, kind, lang, text, array_to_string({SQL_NAMES}, ',') AS names,
 '```' || lang || chr(10) || {quoted(T.STUB[0])} || (length(text) // 4) || {quoted(T.STUB[1])} || CASE WHEN len({SQL_NAMES}) > 0 THEN array_to_string({SQL_NAMES}[1:8], ', ') ELSE 'none' END || {quoted(T.STUB[2])} || chr(10) || '```' AS stub FROM s WHERE kind = 'code' OR text <> ''""")
def code_segments(spark, d):
    found = X.CODE.frame(spark).select("id", F.posexplode(T.segments("text")).alias("ord", "s"))
    return found.select("id", "ord", "s.kind", "s.lang", "s.text", F.array_join(T.defined_names("s.text"), ",").alias("names"), T.code_stub(F.col("s.text"), F.col("s.lang")).alias("stub"))


@query("SELECT doc_id, substring(sha256(lower(text)), 1, 16) AS short_hash, md5(text) AS md5 FROM documents")
def hash_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_hash("text").alias("short_hash"), F.md5(F.col("text").cast("binary")).alias("md5"))


# URLs and pages


@query(f"SELECT url, {SQL_NETLOC} AS netloc, {SQL_PATH} AS path, {SQL_QUERY} AS query, regexp_replace(url, '[?#].*', '') AS media_key, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS schemed FROM {SQL_UNION_URLS}")
def url_parts(spark, d):
    return all_urls(spark, d).select("url", U.netloc("url").alias("netloc"), U.path("url").alias("path"), U.query("url").alias("query"), U.media_key("url").alias("media_key"), U.ensure_scheme("url").alias("schemed"))


@query(f"SELECT url, {SQL_EXCLUDED} AS excluded FROM {SQL_UNION_URLS}")
def domain_excluded(spark, d):
    return all_urls(spark, d).select("url", U.is_domain_excluded("url").alias("excluded"))


@query(f"SELECT url, {SQL_CRAWLABLE} AS valid FROM {SQL_UNION_URLS}")
def valid_url(spark, d):
    return all_urls(spark, d).select("url", U.is_crawlable("url").alias("valid"))


@query(f"SELECT url, {SQL_HTML} AS html FROM {SQL_UNION_URLS}")
def is_html_url(spark, d):
    return all_urls(spark, d).select("url", U.is_html("url").alias("html"))


@query(f"SELECT url, {SQL_RAW} AS raw FROM {SQL_UNION_URLS}")
def raw_url_split(spark, d):
    return all_urls(spark, d).select("url", U.is_raw_file("url").alias("raw"))


@query(rf"""SELECT url, CASE WHEN regexp_matches(url, '(?i)^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$') THEN regexp_replace(url, '(?i)^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$', 'https://raw.githubusercontent.com/\1/\2/\3/\4')
 WHEN regexp_matches(url, '(?i)^(https?://gitlab\.com/[^/]+/[^/]+)/-/blob/([^/]+)/(.+)$') THEN regexp_replace(url, '(?i)^(https?://gitlab\.com/[^/]+/[^/]+)/-/blob/([^/]+)/(.+)$', '\1/-/raw/\2/\3') END AS raw FROM {SQL_UNION_URLS}""")
def blob_to_raw(spark, d):
    return all_urls(spark, d).select("url", U.blob_to_raw("url").alias("raw"))


@query(rf"""WITH t AS (SELECT *, regexp_extract(url, '^https?://([a-z]+)\.wikipedia\.org/wiki/.+', 1) AS lang, regexp_replace(regexp_replace(url_decode(regexp_extract(url, '^https?://[a-z]+\.wikipedia\.org/wiki/(.+)', 1)), '[#?].*$', ''), '/+$', '') AS k FROM (SELECT * FROM {X.WIKI.sql} UNION ALL SELECT 1000 + page_id, url, 'page' FROM pages)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lang <> 'es', ord) AS rn, min(ord) OVER (PARTITION BY k) AS first FROM t WHERE k <> '')
SELECT ord, url, title, 0 AS kind, ord AS first FROM t WHERE k = '' UNION ALL SELECT ord, url, title, 1, first FROM r WHERE rn = 1""")
def wiki_dedup(spark, d):
    found = X.WIKI.frame(spark).unionByName(table(spark, d, "pages").select((1000 + F.col("page_id")).alias("ord"), "url", F.lit("page").alias("title")))
    return sets.wikipedia_once(found, "es").select("ord", "url", "title", "position.kind", F.col("position.ord").alias("first"))


@query(rf"SELECT url, regexp_matches(translate(lower({SQL_PATH}), '_-', '  '), '(^|[^\w])apache spark([^\w]|$)') AS homonym FROM {SQL_UNION_URLS}")
def homonym_slug(spark, d):
    return all_urls(spark, d).select("url", U.mentions("url", F.array(F.lit("Apache Spark"))).alias("homonym"))


@query(f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title("html").alias("title"))


@query(f"SELECT page_id, {SQL_BODY} AS body FROM pages")
def page_body(spark, d):
    return table(spark, d, "pages").select("page_id", H.body_text("html").alias("body"))


@query(f"SELECT page_id, {any_in(f"({SQL_TITLE} || ' ' || {SQL_BODY})", ['reation', 'thention'])} AS found, regexp_matches(lower(substring(html, 1, 10240)), '<html|<!doctype|<\\?xml') AS html FROM pages")
def page_keywords(spark, d):
    return table(spark, d, "pages").select("page_id", H.has_keywords("html", T.preflight_keywords(F.lit(QUERY))).alias("found"), H.looks_like_html("html").alias("html"))


SQL_ORIGIN = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {SQL_NETLOC}"
SQL_LINKS = f"""SELECT page_id, url, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN a[i] = '' OR starts_with(a[i], '#') OR starts_with(a[i], 'javascript:') THEN NULL WHEN starts_with(a[i], 'http') THEN a[i]
 WHEN starts_with(a[i], '/') THEN {SQL_ORIGIN} || a[i] ELSE {SQL_ORIGIN} || '/' || a[i] END AS link FROM (SELECT page_id, url, regexp_extract_all(html, 'href=["''](.*?)["'']', 1) AS a FROM pages), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)"""


def page_links(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", F.posexplode(H.links("html")).alias("ord", "href"))
    return links.select("page_id", "url", "ord", U.absolute_link("href", "url").alias("link"))


@query(f"SELECT page_id, ord, link FROM ({SQL_LINKS}) WHERE link IS NOT NULL")
def link_extract(spark, d):
    return page_links(spark, d).where("link is not null").select("page_id", "ord", "link")


@query(f"SELECT page_id, count(*) AS n FROM (SELECT page_id, lower({SQL_NETLOC}) AS host, lower(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS other FROM ({SQL_LINKS}) WHERE link IS NOT NULL) WHERE host = other GROUP BY 1")
def same_host_links(spark, d):
    links = page_links(spark, d).where("link is not null")
    return links.where(F.lower(U.netloc("url")) == F.lower(U.netloc("link"))).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT {SQL_NETLOC} AS domain, count(*) AS n FROM pages WHERE {SQL_NETLOC} <> '' GROUP BY 1")
def domain_histogram(spark, d):
    return filters.frequent_domain(table(spark, d, "pages"))


@query(f"""WITH u AS (SELECT count(*) AS urls, count_if(len(list_filter(string_split({SQL_PATH}, '/'), lambda p: regexp_matches(p, '[-_]'))) > 0) AS slugs FROM pages),
t AS (SELECT {SQL_NETLOC} AS domain, count(*) AS n FROM pages WHERE {SQL_NETLOC} <> '' GROUP BY 1 ORDER BY n DESC, domain DESC LIMIT 1)
SELECT urls, slugs, CASE WHEN urls = 0 THEN 'pseudo_adaptive' WHEN n > 0.5 * urls AND {any_in('domain', U.KNOWLEDGE_DOMAINS)} THEN 'bfs_deep' WHEN slugs > 0.5 * urls THEN 'pseudo_adaptive' ELSE 'research_filter' END AS mode FROM u, t""")
def auto_mode(spark, d):
    return filters.research_mode(table(spark, d, "pages"))


@query(f"""WITH s AS (SELECT page_id, html, CASE WHEN {SQL_EXCLUDED} THEN 'domain' WHEN NOT {SQL_CRAWLABLE} OR NOT {SQL_HTML} THEN 'static' WHEN NOT regexp_matches(lower(substring(html, 1, 10240)), '<html|<!doctype|<\\?xml') THEN 'accessibility' END AS stage FROM pages),
k AS (SELECT page_id, stage, stage IS NULL AND {any_in(f"({SQL_TITLE} || ' ' || {SQL_BODY})", ['reation', 'thention'])} AS ok FROM s)
SELECT page_id, CASE WHEN stage IS NULL AND NOT ok THEN 'keywords' ELSE stage END AS reject_stage FROM k""")
def validation_cascade(spark, d):
    return filters.validate_urls(table(spark, d, "pages"), QUERY).select("page_id", "reject_stage")


# Vectors


@query("SELECT vec_id, round(s, 6) AS sim FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) ORDER BY round(s, 6) DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    one = vectors.where("vec_id = 0").select("embedding").limit(1).scalar()
    return rank.top_k(vectors.select("vec_id", "embedding", one.alias("q")).select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("sim")), 10, F.col("sim"), "vec_id")


@query("SELECT vec_id, round(least(1.0, s + CASE WHEN label = 3 THEN 0.15 ELSE 0 END), 6) AS sim FROM (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS s FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 10")
def boosted_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    one = vectors.where("vec_id = 1").select("embedding").limit(1).scalar()
    sim = vectors.select("vec_id", "label", "embedding", one.alias("q")).select("vec_id", "label", F.round(V.cosine("embedding", "q"), 6).alias("s"))
    return rank.top_k(sim.select("vec_id", F.round(V.boosted(F.col("s"), F.when(F.col("label") == 3, 0.15).otherwise(0.0)), 6).alias("sim")), 10, F.col("sim"), "vec_id")


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < 50), s AS (SELECT q.vec_id, e.label, max(round(list_cosine_similarity(q.embedding::DOUBLE[], e.x), 6)) AS score FROM embeddings q, e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM s) SELECT vec_id, CASE WHEN score >= 0.35 THEN CAST(label AS VARCHAR) ELSE 'none' END AS expert_id, score FROM r WHERE rn = 1""")
def nearest_group(spark, d):
    vectors = table(spark, d, "embeddings")
    examples = vectors.where("vec_id < 50").select(F.col("label").alias("expert_ord"), F.col("label").cast("string").alias("expert_id"), "embedding")
    return routing.by_similarity(vectors.select("vec_id", "embedding"), examples, "vec_id", threshold=0.35, default="none")


SQL_PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > {SIM}"


@query(SQL_PAIRS)
def sim_pairs(spark, d):
    return V.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", SIM)


@query(f"""WITH RECURSIVE p AS (SELECT a, b FROM ({SQL_PAIRS})), n AS (SELECT v.vec_id, row_number() OVER (ORDER BY v.vec_id) AS i, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS earlier FROM embeddings v LEFT JOIN p ON p.b = v.vec_id GROUP BY v.vec_id),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, n.vec_id) END FROM r JOIN n ON n.i = r.i + 1)
SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)""")
def greedy_dedup(spark, d):
    vectors = table(spark, d, "embeddings")
    return sets.greedy_independent(vectors.select("vec_id"), V.similar_pairs(vectors, "vec_id", "embedding", SIM), "vec_id")


# Sets, joins, caches


@query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY 2")
def search_union_first(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id")
    return sets.first_by(docs, ["key"], "doc_id").select("doc_id", "key")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS cached FROM documents")
def cache_split(spark, d):
    return C.split(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select("doc_id", "cached")


@query("SELECT doc_id, CASE WHEN first < doc_id THEN first END AS copy_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents)")
def content_hash_skip(spark, d):
    return sets.earlier_copies(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "copy_of")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return C.latest(table(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query(f"SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING epoch({NOW}) - epoch(max(ts)) <= 43200)")
def ttl_valid(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return C.valid_groups(table(spark, d, "events"), "user_id", "ts", now, 43200).select("event_id")


@query(f"SELECT user_id FROM events GROUP BY 1 HAVING epoch({NOW}) - epoch(max(ts)) <= 21600")
def exclusion_any(spark, d):
    return C.excluded(table(spark, d, "events"), "user_id", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'purchase' DESC, event_id) AS rn FROM events) WHERE rn = 1")
def kv_upsert(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value", "ts", "event_type")
    newest = lambda df: sets.first_by(df.withColumn("_a", -F.col("ts").cast("double")), ["user_id"], "_a", "event_id").drop("_a")
    return C.upsert(newest(events.where("event_type <> 'purchase'")), newest(events.where("event_type = 'purchase'")), "user_id").select("user_id", "event_id", "value")


@query()
def lru_state(spark, d):
    return C.replay(X.OPERATIONS.frame(spark), 2, 8.0)


SQL_WHOLE = f"regexp_replace(regexp_replace(regexp_replace({SQL_INNER}, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g')"


def sql_chunks(source: str, key: str) -> str:
    """SQL: common table expressions u, r and ch (key, chunk_index, chunk) of a query with key and text."""
    return f"""t AS ({source}), a AS (SELECT {key}, {SQL_SENTENCES} AS a FROM t),
u AS (SELECT {key}, i, a[i] AS sent, length(a[i]) // 4 AS tk FROM (SELECT {key}, a, unnest(range(1, len(a) + 1)) AS i FROM a)),
r AS (SELECT {key}, i, tk AS cur, 0 AS ch FROM u WHERE i = 1 UNION ALL
 SELECT u.{key}, u.i, CASE WHEN r.cur + u.tk > 256 THEN u.tk ELSE r.cur + u.tk END, CASE WHEN r.cur + u.tk > 256 THEN r.ch + 1 ELSE r.ch END FROM r JOIN u ON u.{key} = r.{key} AND u.i = r.i + 1),
ch AS (SELECT r.{key}, CAST(r.ch AS INTEGER) AS chunk_index, string_agg(u.sent, ' ' ORDER BY u.i) AS chunk FROM r JOIN u USING ({key}, i) GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {sql_chunks(f"SELECT url, min({SQL_WHOLE}) AS text FROM pages GROUP BY 1", "url")}
SELECT url, 0 AS chunk_index, sha256(text) AS content_hash, 0.0::DOUBLE AS ts, true AS relevant FROM t WHERE length(url) % 2 = 0
UNION ALL SELECT url, chunk_index, sha256(text), 1.0::DOUBLE, NULL FROM ch JOIN t USING (url) WHERE length(url) % 2 = 1""")
def page_cache(spark, d):
    pages = table(spark, d, "pages").select("url", H.whole_text("html").alias("text"))
    pages = sets.first_by(pages, ["url"], "text")
    stored = pages.where("length(url) % 2 = 0").select("url", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit(0.0).alias("ts"), F.lit(True).alias("relevant"))
    return C.page_chunks(pages, stored, "url", "text", F.lit(1.0)).select("url", "chunk_index", "content_hash", "ts", "relevant")


SQL_MEDIA = "CASE WHEN starts_with(src, '//') THEN 'https:' || src WHEN starts_with(src, 'http') THEN src ELSE 'https://a.com' || CASE WHEN starts_with(src, '/') THEN src ELSE '/' || src END END"


@query(f"""WITH m AS (SELECT page_id * 1000 + ord AS ord, link || CASE WHEN ord % 2 = 0 THEN '?w=' || ord ELSE '' END AS url FROM ({SQL_LINKS}) WHERE link IS NOT NULL UNION ALL SELECT 10000000 + ord, {SQL_MEDIA} FROM {X.MEDIA.sql} WHERE score >= 6 AND src <> '')
SELECT ord, url FROM (SELECT ord, url, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*', '') ORDER BY ord) AS rn FROM m) WHERE rn = 1""")
def media_dedup(spark, d):
    found = page_links(spark, d).where("link is not null").select((F.col("page_id") * 1000 + F.col("ord")).alias("ord"), F.when(F.col("ord") % 2 == 0, F.concat("link", F.lit("?w="), "ord")).otherwise(F.col("link")).alias("url"))
    media = X.MEDIA.frame(spark).where("score >= 6 and src <> ''").select((F.lit(10_000_000).cast("long") + F.col("ord")).alias("ord"), U.absolute_media("src", "base").alias("url"))
    return sets.media_once(found.unionByName(media)).select("ord", "url")


@query(f"""SELECT string_agg('[![m' || ord || '](https://thumbs.example/t?size=300&url=' || replace(url_encode(url), '%2F', '/') || ')](' || url || ')', chr(10) ORDER BY ord) AS markdown
FROM (SELECT ord, {SQL_MEDIA} AS url FROM {X.MEDIA.sql} WHERE score >= 6 AND src <> '' ORDER BY ord LIMIT 5)""")
def media_markdown(spark, d):
    media = X.MEDIA.frame(spark).where("score >= 6 and src <> ''").select("ord", F.concat(F.lit("m"), F.col("ord")).alias("title"), U.absolute_media("src", "base").alias("url"))
    return rank.media_markdown(media, "https://thumbs.example/t", 300)


# Budgets, batches, decisions


@query("SELECT page_id, budget FROM (SELECT page_id, CAST(floor(4000 / greatest(1.0, pow(row_number() OVER (ORDER BY page_id), 0.7))) AS INTEGER) AS budget FROM pages) WHERE budget >= 700")
def token_budget(spark, d):
    pages = filters.ordinal(table(spark, d, "pages").select("page_id"), ["page_id"], "n")
    return pages.select("page_id", rank.token_budget(F.col("n") + 1).alias("budget")).where("budget is not null")


@query("SELECT doc_id, used_before FROM (SELECT doc_id, CAST(coalesce(sum(length(text) // 4) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM documents) WHERE used_before < 20000")
def budget_running_total(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))
    return rank.within_budget(docs, ["doc_id"], "tokens", 20000).select("doc_id", "used_before")


SQL_JUDGED = "SELECT d.doc_id, d.source, length(d.text) // 4 AS tokens, l.quality FROM documents d JOIN labels l USING (doc_id)"


@query(f"SELECT source, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(CASE WHEN sum(tokens) = 0 THEN 1.0 ELSE coalesce(sum(CASE WHEN quality = 1 THEN tokens END), 0) / sum(tokens) END, 6) AS ratio, CASE WHEN sum(tokens) = 0 THEN 1.0 ELSE coalesce(sum(CASE WHEN quality = 1 THEN tokens END), 0) / sum(tokens) END >= 0.6 AS enough FROM ({SQL_JUDGED}) GROUP BY 1")
def relevance_ratio(spark, d):
    judged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return filters.relevance(judged.withColumn("tokens", T.estimate_tokens("text")), F.col("quality") == 1, F.col("tokens"), ["source"])


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1")
def relevance_filter(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where(F.coalesce("quality", F.lit(1)) == 1).select("doc_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch FROM documents")
def batch_of_ten(spark, d):
    return filters.numbered_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "batch")


SQL_DECISIONS = "SELECT b.doc_id, b.batch, CASE WHEN b.batch % 7 = 3 THEN 'KEEP' ELSE coalesce(CASE WHEN l.quality = 1 THEN 'KEEP' WHEN l.quality = 0 THEN 'REJECT' END, 'REJECT') END AS decision FROM (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch FROM documents) b LEFT JOIN labels l USING (doc_id)"


def decided(spark, d):
    items = filters.numbered_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    answers = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "KEEP").otherwise("REJECT").alias("decision"), F.lit(False).alias("failed"), F.lit(None).cast("long").alias("batch"))
    broken = items.where("batch % 7 = 3").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("decision"), F.lit(True).alias("failed"), "batch").distinct()
    return filters.decide(items, answers.unionByName(broken), "doc_id").select("doc_id", "batch", "decision")


@query(SQL_DECISIONS)
def llm_decision_join(spark, d):
    return decided(spark, d)


@query(f"""WITH x AS ({SQL_DECISIONS}), k AS (SELECT count(*) AS n FROM x WHERE decision = 'KEEP'), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM x WHERE decision <> 'KEEP')
SELECT doc_id, false AS refilled FROM x WHERE decision = 'KEEP' UNION ALL SELECT doc_id, true FROM r, k WHERE rn <= 500 - k.n""")
def refill_minimum(spark, d):
    return filters.refill(decided(spark, d), "doc_id", 500).select("doc_id", "refilled")


@query("""WITH b AS (SELECT doc_id // 50 AS batch, string_agg(CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, ',' ORDER BY doc_id) AS flags, count(*) AS n FROM labels GROUP BY 1)
SELECT batch, CASE WHEN batch % 5 IN (3, 4) THEN array_to_string(list_transform(range(n), lambda i: 'true'), ',') ELSE flags END AS flags FROM b""")
def json_array_repair(spark, d):
    """Replies to batches of labels: plain, in prose, without the closing bracket, one flag short, without any."""
    rows = F.array_sort(F.collect_list(F.struct("doc_id", F.when(F.col("quality") == 1, "true").otherwise("false").alias("flag"))))
    told = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(rows.alias("r")).withColumn("flags", F.array_join(F.col("r.flag"), ", "))
    kind = F.col("batch") % 5
    reply = F.when(kind == 1, F.concat(F.lit("Here you are:\n```json\n["), "flags", F.lit("]\n```\nDone."))).when(kind == 2, F.concat(F.lit("["), "flags", F.lit(", "))).when(kind == 3, F.concat(F.lit("["), "flags", F.lit(", true]")))
    reply = reply.when(kind == 4, F.lit("no idea")).otherwise(F.concat(F.lit("["), "flags", F.lit("]")))
    return told.select("batch", F.array_join(F.transform(J.parse_flags(reply, F.size("r")), lambda b: b.cast("string")), ",").alias("flags"))


@query()
def normalize_content(spark, d):
    return J.normalise_content(X.CONTENT.frame(spark), "content", "id")


def worded(spark, d):
    """Items of the benchmark with their words, and a reply that proposes words 3 to 9, the first word in capitals first and one twice, and warns of two."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    items = table(spark, d, "benchmark").where("text is not null").select("item_id", words.alias("w")).where("size(w) >= 9")
    found = F.concat(F.array(F.upper(F.get("w", 0)), F.get("w", 2)), F.slice("w", 3, 7))
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(found), F.lit("\n```\n// Homonyms to avoid: "), F.get("w", 0), F.lit("; N/A, "), F.get("w", 1), F.lit(" , none"))
    return items.select("item_id", F.get("w", 0).alias("q"), reply.alias("reply"))


SQL_ITEM_WORDS = "SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark WHERE text IS NOT NULL"


@query(f"""WITH i AS (SELECT item_id, w[1] AS q, list_concat([w[1], w[3]], list_filter([w[3], w[4], w[5]], lambda x: lower(x) <> lower(w[1]))) AS a, w FROM ({SQL_ITEM_WORDS}) WHERE len(w) >= 9),
x AS (SELECT item_id, a, unnest(range(1, len(a) + 1)) AS k FROM (SELECT item_id, CASE WHEN lower(w[3]) = lower(w[1]) THEN list_concat([w[1]], list_filter([w[3], w[4], w[5]], lambda x: lower(x) <> lower(w[1]))) ELSE a END AS a FROM i))
SELECT item_id, string_agg(word, '|' ORDER BY k) AS queries FROM (SELECT item_id, a[k] AS word, min(k) AS k FROM x GROUP BY 1, 2) GROUP BY 1""")
def expansion_merge(spark, d):
    return worded(spark, d).select("item_id", F.array_join(J.expansions("q", J.parse_strings("reply")), "|").alias("queries"))


@query(f"SELECT item_id, array_to_string(list_filter([w[1], w[2]], lambda x: lower(x) NOT IN ('none', 'ninguno')), '|') AS homonyms FROM ({SQL_ITEM_WORDS}) WHERE len(w) >= 9")
def homonym_comment(spark, d):
    return worded(spark, d).select("item_id", F.array_join(J.homonyms("reply"), "|").alias("homonyms"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Conversations and routing

SQL_TIERS = """SELECT conv_id, turn, role, text, CASE WHEN role IN ('user', 'assistant') THEN sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS pos,
 sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) - 1 AS last FROM conversations"""


@query(f"SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CASE WHEN pos IS NULL THEN NULL WHEN last - pos <= 0 THEN 'current' WHEN last - pos <= 4 THEN 'recent' ELSE 'old' END AS tier FROM ({SQL_TIERS})")
def conv_tier(spark, d):
    return conversation.tiers(table(spark, d, "conversations")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "tier")


@query(rf"""WITH t AS (SELECT *, CASE WHEN pos IS NULL THEN NULL WHEN last - pos <= 0 THEN 'current' WHEN last - pos <= 4 THEN 'recent' ELSE 'old' END AS tier FROM ({SQL_TIERS})),
o AS (SELECT *, tier IN ('recent', 'old') AND coalesce(text, '') <> '' AND length(text) // 4 >= 300 AND NOT {any_in("replace(replace(text, '▶️', '▶'), '►', '▶')", T.PROTOCOL_MARKERS)}
 AND NOT (contains(lower(text), 'traceback (most recent call last)') OR contains(lower(text), 'traceback:') OR (contains(lower(text), 'exception') AND contains(lower(text), 'file "')) OR regexp_matches(lower(text), 'file ".+", line \d+')) AS able FROM t),
w AS (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i, CASE tier WHEN 'recent' THEN 0.75::DOUBLE ELSE 0.4::DOUBLE END AS rate FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM o WHERE able)),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(a[i]) DESC, i) AS r FROM w),
c AS (SELECT conv_id, turn, string_agg(a[i], ' ' ORDER BY i) AS short FROM k WHERE r <= ceil(len(a) * rate) GROUP BY 1, 2)
SELECT o.conv_id, o.turn, tier, CASE WHEN able THEN short ELSE text END AS compressed FROM o LEFT JOIN c USING (conv_id, turn)""")
def compress(spark, d):
    return conversation.compress(table(spark, d, "conversations")).select("conv_id", "turn", "tier", "compressed")


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {any_in('lower(text)', e['keywords'])} THEN {quoted(e['id'])}" for e in EXPERTS) + " END AS expert FROM conversations")
def router_keyword(spark, d):
    return routing.keyword_expert(table(spark, d, "conversations"), experts(spark)).select("conv_id", "turn", "expert")


@query("""WITH c AS (SELECT conv_id, turn, trim(lower(text)) AS base, string_agg(CASE WHEN role IN ('user', 'assistant') THEN role || ':' || substring(text, 1, 80) END, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ctx FROM conversations)
SELECT conv_id, turn, CASE WHEN ctx IS NULL THEN base ELSE base || '::' || substring(md5(ctx), 1, 8) END AS cache_key FROM c""")
def router_cache_key(spark, d):
    return routing.cache_key(table(spark, d, "conversations")).select("conv_id", "turn", "cache_key")


def routed(spark, d):
    turns = table(spark, d, "conversations")
    bucket = F.pmod(F.length("text"), F.lit(4))
    return turns.withColumn("new_expert", F.when(bucket < 2, "experto-en-neovim").when(bucket == 2, "experto-en-arch-linux").otherwise(routing.DEFAULT))


def sql_sticky(routed: str) -> str:
    """SQL: common table expressions up to k (conv_id, turn, expert) of turns with new_expert."""
    words = SQL_WORDS.format("coalesce({0}, '')")
    return f"""n AS ({routed}), h AS (SELECT *, string_agg(CASE WHEN role = 'user' THEN text END, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS said FROM n),
s AS (SELECT conv_id, turn, new_expert, len(list_intersect({words.format('text')}, {words.format('said')})) AS shared, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM h WHERE role = 'user'),
k AS (SELECT conv_id, turn, i, new_expert AS expert FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN s.new_expert <> k.expert AND s.shared < 2 THEN s.new_expert ELSE k.expert END FROM k JOIN s ON s.conv_id = k.conv_id AND s.i = k.i + 1)"""


@query(f"""WITH RECURSIVE {sql_sticky("SELECT conv_id, turn, role, text, CASE WHEN length(text) % 4 < 2 THEN 'experto-en-neovim' WHEN length(text) % 4 = 2 THEN 'experto-en-arch-linux' ELSE 'generalista' END AS new_expert FROM conversations")}
SELECT conv_id, turn, expert FROM k""")
def sticky_switch(spark, d):
    return routing.sticky(routed(spark, d))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'cached' WHEN turn % 3 = 0 THEN 'progrmador' WHEN length(text) % 2 = 0 THEN 'progrmador' ELSE 'generalista' END AS expert FROM conversations""")
def classify_cascade(spark, d):
    turns = table(spark, d, "conversations")
    none = F.lit(None).cast("string")
    cached, semantic = F.when(F.col("turn") % 5 == 0, "cached"), F.when(F.col("turn") % 3 == 0, "progrmador")
    model = routing.model_answer(F.when(F.length("text") % 2 == 0, " Progrmador \nbecause").otherwise("unsure"), ["progrmador"])
    return turns.select("conv_id", "turn", routing.classify(cached, F.lit("progrmador"), model, semantic, none).alias("expert"))


GUIDE = f"{routing.GUIDANCE[0]}neovim_docs{routing.GUIDANCE[1]}the official Neovim documentation and community plugins{routing.GUIDANCE[3]}".replace("'", "''")


@query(f"""WITH f AS (SELECT *, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM conversations)
SELECT conv_id, turn, role, CASE WHEN turn = first AND conv_id % 2 = 0 THEN text || chr(10) || chr(10) || '{GUIDE}' ELSE text END AS text FROM f
UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', '{GUIDE}' FROM f WHERE first IS NULL AND conv_id % 2 = 0""")
def rag_inject(spark, d):
    turns = table(spark, d, "conversations").withColumn("expert_id", F.when(F.col("conv_id") % 2 == 0, "experto-en-neovim").otherwise("progrmador"))
    return routing.inject_guidance(turns, experts(spark)).select("conv_id", "turn", "role", "text")


# Frontiers


@query(f"WITH RECURSIVE e AS (SELECT * FROM {X.EDGES.sql}), r AS (SELECT 'https://a.com/' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 3) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def bfs_levels(spark, d):
    return frontier.bfs_levels(X.EDGES.frame(spark), spark.createDataFrame([(u,) for u in STARTS], "url string"), 3)


def crawl_tokens(spark):
    edges = X.EDGES.frame(spark)
    return edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct().withColumn("tokens", F.lit(500))


@query()
def frontier_adaptive(spark, d):
    return frontier.pseudo_adaptive(spark, X.EDGES.frame(spark), STARTS, "spark", crawl_tokens(spark))


@query()
def frontier_guided(spark, d):
    return frontier.guided(spark, X.EDGES.frame(spark), STARTS, "spark", crawl_tokens(spark))


@query()
def frontier_bfs_deep(spark, d):
    return frontier.bfs_deep(spark, X.EDGES.frame(spark), STARTS, "spark", crawl_tokens(spark), max_tokens=2500)


#: Letters that the paths of the test pages hold, so that scores differ.
LINK_WORDS = "a e th on"


@query(rf"""WITH e AS (SELECT url AS src, link AS dst, min(page_id * 1000 + ord) AS ord FROM ({SQL_LINKS}) WHERE link IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord) AS n FROM e),
s AS (SELECT *, CAST(len(list_filter({listed(LINK_WORDS.split())}, lambda w: contains(lower(dst), w))) AS INTEGER) AS score FROM n WHERE n <= 15),
h AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, ord) AS r FROM s WHERE score > 0 AND lower(regexp_extract(src, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) = lower(regexp_extract(dst, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)))
SELECT src AS source, dst AS url, score FROM h WHERE r <= 3""")
def research_two_level(spark, d):
    links = page_links(spark, d).where("link is not null").groupBy(F.col("url").alias("src"), F.col("link").alias("dst")).agg(F.min(F.col("page_id") * 1000 + F.col("ord")).alias("ord"))
    return frontier.two_levels(links, table(spark, d, "pages").select("url").distinct(), LINK_WORDS)


# Streams


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return stateful.drain(stateful.tumbling(stateful.read_table(spark, d, "events")), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return stateful.drain(stateful.sessions(stateful.read_table(spark, d, "events")), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    return stateful.drain(stateful.seen_once(stateful.read_table(spark, d, "events"), ["event_id"]).select("event_id"), "append")


@query("""SELECT conv_id * 100 + turn AS request_id, coalesce(text, '') AS text, CASE WHEN (conv_id + turn) % 3 = 2 THEN NULL ELSE 'stop' END AS finish_reason, CASE WHEN (conv_id + turn) % 3 = 0 THEN CAST(length(coalesce(text, '')) AS INTEGER) END AS completion_tokens FROM conversations""")
def token_assembly(spark, d):
    """Turns as streams of lines and put together again: server-sent events, JSON lines, reasoning only; with junk and late lines."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"))
    piece = lambda i: F.substring(F.col("text"), i * 40 + 1, F.lit(40))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), piece)
    name = lambda x, field: F.to_json(F.struct(x.alias(field)))
    line = lambda x: F.when(F.col("kind") == 1, F.concat(F.lit('{"message":'), name(x, "content"), F.lit(',"done":false}'))).otherwise(F.concat(F.lit('data: {"choices":[{"delta":'), F.when(F.col("kind") == 0, name(x, "content")).otherwise(name(x, "reasoning_content")), F.lit("}]}")))
    late = F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')
    ends = F.when(F.col("kind") == 0, F.array(F.lit("junk"), F.lit('data: {"choices":[{"delta":{},"finish_reason":"stop"}]}'), F.concat(F.lit('data: {"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":'), F.length("text").cast("string"), F.lit("}}")), F.lit("data: [DONE]"), late))
    ends = ends.when(F.col("kind") == 1, F.array(F.lit('{"message":{"content":""},"done":true,"done_reason":"stop"}'), late)).otherwise(F.array(F.lit(": a comment"), F.lit("data: [DONE]"), late))
    return stateful.assemble(turns.select("request_id", F.posexplode(F.concat(F.transform(pieces, line), ends)).alias("ord", "line")))


# The flagship


@query(rf"""WITH RECURSIVE g AS (SELECT page_id, url, html FROM pages WHERE NOT {SQL_EXCLUDED} AND {SQL_CRAWLABLE} AND {SQL_HTML} AND (contains(lower({SQL_NETLOC}), 'wikipedia.org') OR regexp_matches(lower(substring(html, 1, 10240)), '<html|<!doctype|<\?xml'))),
{sql_chunks(f"SELECT page_id, {SQL_WHOLE} AS text FROM g", "page_id")},
x AS (SELECT page_id, chunk_index, chunk, CAST(len(list_filter({listed(QUERY.split())}, lambda w: contains(lower(chunk), w))) AS INTEGER) AS score FROM ch WHERE NOT ({any_in('lower(chunk)', T.NOISE_KEYWORDS)} AND NOT {any_in('lower(chunk)', ['reation', 'thention'])})),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM x), p AS (SELECT page_id, sum(score) AS s FROM b WHERE rank <= 3 GROUP BY 1),
o AS (SELECT page_id, CAST(row_number() OVER (ORDER BY s DESC, page_id) AS INTEGER) AS place FROM p), f AS (SELECT page_id, place, CAST(floor(4000 / greatest(1.0, pow(place, 0.7))) AS INTEGER) AS budget FROM o WHERE place <= 20)
SELECT page_id, url, {SQL_TITLE} AS title, chunk_index, rank, score, place, budget, CASE WHEN length(chunk) // 4 > 256 THEN substring(chunk, 1, 1024) || {quoted(T.TRUNCATED)} ELSE chunk END AS chunk
FROM b JOIN f USING (page_id) JOIN g USING (page_id) WHERE rank <= 3 AND budget >= 700""")
def entry_retrieval(spark, d):
    """Pages worth reading, chunked, without furniture, the best three chunks of each within a decaying token budget."""
    pages = filters.validate_urls(table(spark, d, "pages")).where("reject_stage is null")
    chunks = pages.select("page_id", "url", H.title("html").alias("title"), F.posexplode(T.chunks(H.whole_text("html"))).alias("chunk_index", "chunk"))
    words = T.query_words(F.lit(QUERY))
    scored = chunks.where(~T.is_noise("chunk", words)).withColumn("score", T.keyword_score("chunk", F.lit(QUERY)))
    best = rank.top_k_by(scored, ["page_id"], 3, "score", "chunk_index")
    total = best.groupBy("page_id").agg(F.sum("score").alias("page_score"))
    place = total.orderBy(F.col("page_score").desc(), "page_id").limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.col("page_score").desc(), "page_id")))
    budget = place.select("page_id", "place", rank.token_budget(F.col("place")).alias("budget")).where("budget is not null")
    return best.join(budget, "page_id").select("page_id", "url", "title", "chunk_index", "rank", "score", "place", "budget", T.truncate_tokens("chunk", 256).alias("chunk"))
