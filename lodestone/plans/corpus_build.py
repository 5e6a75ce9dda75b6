"""Queries of the corpus job over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import corpus_build as ops
from lodestone.sources.tables import table

RULES = [("disallow", "/en/9"), ("allow", "/en/97"), ("disallow", "/fr"), ("allow", "/fr"), ("disallow", "/"), ("allow", "/en"), ("allow", "/es"), ("allow", "/de")]


def page_items(spark: SparkSession, d: str) -> DataFrame:
    return ops.page_items(table(spark, d, "pages"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.canonical_url(F.col("url")).alias("url"))


def page_robots(spark: SparkSession, d: str) -> DataFrame:
    return ops.robots_verdict(table(spark, d, "pages"), RULES, "/de/1")


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    return ops.corpus_rows(table(spark, d, "pages"), table(spark, d, "documents")).select("id", "kind", "title", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.corpus_rows(table(spark, d, "pages"), table(spark, d, "documents"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "document").alias("documents"), F.min(F.length("text")).cast("long").alias("shortest"))


def document_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clipped(F.col("text")).alias("excerpt"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunks(table(spark, d, "documents")).select("doc_id", "chunk", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def same_story_titles(spark: SparkSession, d: str) -> DataFrame:
    return ops.same_stories(ops.page_items(table(spark, d, "pages")))


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages as feed items and read again: the host is their category, the language of their path a tag."""
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    host, lang = F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.regexp_extract("url", "^https?://[^/?#]*/([a-z]+)/", 1)
    xml = F.concat(F.lit("<item><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), safe, F.lit('</link><category domain="category">'), host, F.lit('</category><category domain="post_tag">'), lang, F.lit("</category></item>"))
    out = ops.feed_items(table(spark, d, "pages").select("page_id", xml.alias("xml")))
    return out.select("page_id", "title", "url", F.array_join("categories", ",").alias("categories"), F.array_join("tags", ",").alias("tags"))


QUERIES = {f.__name__: f for f in (page_items, page_urls, page_robots, corpus_rows, corpus_manifest, document_excerpts, document_chunks, same_story_titles, feed_items)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decoded_sql(x: str) -> str:
    for name, value in t.ENTITIES.items():
        x = f"regexp_replace({x}, '(?i)&{name};', {_q(value)}, 'g')"
    return x


def url_sql(x: str) -> str:
    part = lambda i: f"regexp_extract(trim({x}), '(?i)^https?://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', {i})"
    kept = f"list_filter(string_split(regexp_replace({part(3)}, '^\\?', ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|mc_cid|mc_eid)(=|$)'))"
    path = f"regexp_replace({part(2)}, '/+$', '')"
    return f"CASE WHEN regexp_matches(trim({x}), '(?i)^https?://[^/?#]') THEN 'https://' || regexp_replace(lower({part(1)}), '^www\\.', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END ELSE trim({x}) END"


def html_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)</?(?:{t.BLOCK_TAGS})(?:\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{t.INLINE_TAGS})(?:\\s[^>]*)?/?>', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({decoded_sql(x)}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


def page_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "iframe"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"trim(regexp_replace({html_sql(x)}, '\\s+', ' ', 'g'))"


def clip_sql(x: str, limit: int = 400) -> str:
    """RE2 repeats at most 1000 times and looks at no place behind: the end of a sentence is found by its position instead."""
    ends = f"list_filter(range(1, {limit + 1}), lambda i: regexp_matches(substr({x}, i + 1, 1), '\\s') AND (substr({x}, i, 1) IN ('!', '?') OR (substr({x}, i, 1) = '.' AND NOT regexp_matches(substr({x}, i - 1, 1), '[0-9]'))))"
    words = f"rtrim(regexp_extract(substr({x}, 1, {limit}), '(?s)^(.*)\\s\\S*$', 1))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN coalesce(list_max({ends}), 0) >= 40 THEN substr({x}, 1, list_max({ends})) WHEN length({words}) > 0 THEN {words} ELSE substr({x}, 1, {limit}) END"


HEAD = "string_split(html, '</head>')[1]"
META = lambda n: f"nullif(regexp_extract({HEAD}, '(?is)<meta[^>]*(?:name|property)=\"{n}\"[^>]*content=\"([^\"]*)\"', 1), '')"
ITEMS = f"""items AS (SELECT page_id, {url_sql('url')} AS url, trim(regexp_replace({decoded_sql(f"regexp_extract({HEAD}, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title,
  {decoded_sql(f"coalesce({META('description')}, {META('og:description')})")} AS description, {page_sql('html')} AS text FROM pages)"""
REPAIRED = "text"
for _bad, _good in t.MOJIBAKE.items():
    REPAIRED = f"replace({REPAIRED}, {_q(_bad)}, {_q(_good)})"
CORPUS = f"""{ITEMS}, cut AS (SELECT doc_id, text, regexp_split_to_array({REPAIRED}, '\\n-{{5,}}')[1] AS body FROM documents),
rows AS (SELECT 'page-' || page_id AS id, 'page' AS kind, title, text FROM items UNION ALL
  SELECT 'doc-' || doc_id, 'document', substr(string_split(text, chr(10))[1], 1, 120), trim(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT starts_with(x, '>')), chr(10))) FROM cut),
kept AS (SELECT * FROM rows WHERE length(text) >= 40)"""

ORACLE_SQL = {
    "page_items": f"WITH {ITEMS} SELECT *, {clip_sql('text')} AS excerpt FROM items",
    "page_urls": f"SELECT page_id, {url_sql('url')} AS url FROM pages",
    "page_robots": f"""WITH rules(allow, prefix) AS (VALUES {', '.join(f"({int(k == 'allow')}, '{p}')" for k, p in RULES)}), p AS (SELECT page_id, regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, any_value(path) AS path, coalesce(arg_max(allow, length(prefix) * 2 + allow) = 1, true) AND NOT starts_with(any_value(path), '/de/1') AS allowed FROM p LEFT JOIN rules ON starts_with(path, prefix) GROUP BY page_id""",
    "corpus_rows": f"WITH {CORPUS} SELECT id, kind, title, length(text) AS chars, md5(text) AS digest FROM kept",
    "corpus_manifest": f"WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (kind = 'page') AS pages, count(*) FILTER (kind = 'document') AS documents, min(length(text)) AS shortest FROM kept",
    "document_excerpts": f"SELECT doc_id, {clip_sql('text')} AS excerpt FROM documents",
    "same_story_titles": f"""WITH {ITEMS}, sets AS (SELECT DISTINCT list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3))) AS w FROM items),
big AS (SELECT w, array_to_string(w, ' ') AS key, len(w) AS n FROM sets WHERE len(w) >= 2), pairs AS (SELECT a.key AS a, b.key AS b, len(list_intersect(a.w, b.w)) AS s, a.n AS an, b.n AS bn FROM big a JOIN big b ON a.key < b.key)
SELECT a, b FROM pairs WHERE (s >= 2 AND s / (an + bn - s) >= 0.6) OR (s >= 3 AND s / least(an, bn) >= 0.8)""",
    "feed_items": f"SELECT page_id, 'page ' || page_id AS title, {url_sql('url')} AS url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS categories, regexp_extract(url, '^https?://[^/?#]*/([a-z]+)/', 1) AS tags FROM pages",
}
