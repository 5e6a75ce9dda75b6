"""Queries of the feed sources: pages and documents that Spark writes as sitemaps, feeds and article files and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import snapshots
from lodestone.plans.corpus_build import clip_sql, html_sql, url_sql
from lodestone.plans.live import shared_folder
from lodestone.sources import feeds as ops
from lodestone.sources.tables import table

HOST, CUTOFF = "news.example.org", "2024-02-01T00:00:00Z"
MOST_URLS = 50_000
LANG = "^https?://[^/?#]*/([a-z]+)/"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _day(key: Column) -> Column:
    """A day of the first three months of 2024, by key."""
    return F.concat(F.lit("2024-0"), (key % 3 + 1).cast("string"), F.lit("-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))


def _safe(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _xml_files(rows: DataFrame, path: str, root: str) -> None:
    """rows: part, value (elements). One file of one root for each part."""
    rows = rows.select(F.coalesce("part", F.lit("")).alias("part"), F.lit(1).alias("at"), "value")
    ends = F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(value).alias("value")) for at, value in ((0, f"<{root}>"), (2, f"</{root}>")))))
    whole = rows.unionByName(rows.select("part").distinct().select("part", ends.alias("e")).select("part", "e.*"))
    whole.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps by language, of 50,000 pages at most as the protocol has it, all but the French ones in an index that names one
    without pages too; some entries are broken, some without address."""
    p, path = F.col("page_id"), _folder(spark, "sitemap")
    loc = F.when(p % 43 == 5, "").when(p % 41 == 3, F.concat(F.lit("<loc>"), _safe(F.col("url")))).otherwise(F.concat(F.lit("<loc>"), _safe(F.col("url")), F.lit("</loc>")))
    part = F.concat_ws("-", F.regexp_extract("url", LANG, 1), F.floor(p / MOST_URLS).cast("string"))
    pages = table(spark, d, "pages").select(part.alias("part"), F.concat(F.lit("<url>"), loc, F.lit("<lastmod>"), _day(p), F.lit("T00:00:00Z</lastmod></url>")).alias("value"))
    _xml_files(pages, f"{path}/maps", "urlset")
    named = pages.select("part").filter("part not like 'fr-%'").distinct().union(spark.range(1).select(F.lit("none")))
    listed = named.select(F.lit("index").alias("part"), F.concat(F.lit("<sitemap><loc>https://example.org/maps/"), "part", F.lit(".xml</loc></sitemap>")).alias("value"))
    _xml_files(listed, f"{path}/index", "sitemapindex")
    entries = ops.xml_records(spark, f"{path}/maps", "url", ops.PLACE).withColumn("sitemap", F.concat(F.regexp_extract("file", "/part=([^/]*)/", 1), F.lit(".xml")))
    out = ops.sitemap_urls(ops.xml_records(spark, f"{path}/index", "sitemap", ops.PLACE), entries)
    return out.select("sitemap", "url", F.unix_seconds("lastmod").alias("lastmod"), "reason")


def _shown(items: DataFrame) -> DataFrame:
    return items.select("id", "url", "title", F.unix_seconds("date").alias("date"), F.array_join("categories", "|").alias("categories"), F.array_join("tags", "|").alias("tags"), F.md5("excerpt").alias("digest"), "reason")


def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as RSS items of one host; some keep their own host, some are broken."""
    p, path = F.col("page_id"), _folder(spark, "rss")
    link = F.when(p % 9 == 1, F.col("url")).otherwise(F.concat(F.lit(f"http://www.{HOST}"), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1)))
    day = F.date_format(F.to_date(_day(p)), "dd MMM yyyy")
    item = F.concat(F.lit("<item><title>page &amp;amp; "), p.cast("string"), F.lit("</title><link>"), _safe(link), F.lit("</link><pubDate>"), day, F.lit(" 00:00:00 GMT</pubDate><description>&lt;p&gt;of "), F.regexp_extract("url", LANG, 1), F.when(p % 37 == 2, F.lit("</description><category></item>")).otherwise(F.lit('&lt;/p&gt;</description><category>Pages</category><category>uncategorized</category><category domain="post_tag">one</category><category domain="post_tag">ONE</category></item>')))
    _xml_files(table(spark, d, "pages").select(F.floor(p / MOST_URLS).cast("string").alias("part"), item.alias("value")), path, "rss")
    return _shown(ops.feed_articles(ops.xml_records(spark, path, "item", ops.RSS), HOST, CUTOFF))


def article_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as article JSON, whole texts; some of another host, some broken lines."""
    p, path = F.col("doc_id"), _folder(spark, "articles")
    term = lambda name, taxonomy: F.struct(name.alias("name"), F.lit(taxonomy).alias("taxonomy"))
    terms = F.array(F.array(term(F.col("source"), "category"), term(F.lit("Uncategorized"), "category")), F.array(term(F.col("lang"), "post_tag"), term(F.upper("lang"), "post_tag")))
    rendered = lambda c: F.struct(c.alias("rendered"))
    host = F.when(p % 7 == 2, "other.example.org").otherwise(HOST)
    post = F.struct(p.alias("id"), F.concat(F.lit("https://"), host, F.lit("/"), p.cast("string"), F.lit("/")).alias("link"), F.concat(_day(p), F.lit("T00:00:00")).alias("date_gmt"), rendered(F.substring_index("text", "\n", 1)).alias("title"), rendered(F.col("text")).alias("excerpt"), F.struct(terms.alias("wp:term")).alias("_embedded"))
    line = F.to_json(post)
    table(spark, d, "documents").select(F.when(p % 53 == 4, F.substr(line, F.lit(2))).otherwise(line)).write.text(path)
    return _shown(ops.articles(ops.json_records(spark, path), HOST, CUTOFF))


def curated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as curated entries: some with a number for an id, without a title, with blank text, or broken."""
    p, path = F.col("doc_id"), _folder(spark, "curated")
    entry = F.struct(F.concat(F.lit("d"), p.cast("string")).alias("id"), F.when(p % 13 != 4, F.col("lang")).alias("title"), F.when(p % 17 == 5, F.lit(" \t")).otherwise(F.col("text")).alias("text"), F.col("source").alias("category"))
    line = F.to_json(entry)
    line = F.when(p % 53 == 4, F.substr(line, F.lit(2))).when(p % 11 == 3, F.replace(line, F.concat(F.lit('"d'), p.cast("string"), F.lit('"')), p.cast("string"))).otherwise(line)
    table(spark, d, "documents").select(line).write.text(path)
    return ops.curated(spark, path).select("id", "title", F.md5("text").alias("digest"), "category", "reason")


def snapshot_current(spark: SparkSession, d: str) -> DataFrame:
    """Half the pages are published, then all; a third is written but not published."""
    path, pages = _folder(spark, "pages"), table(spark, d, "pages").select("page_id", "url")
    for version, rows, seen in (("1", pages.filter("page_id % 2 = 0"), True), ("2", pages, True), ("3", pages.filter("page_id % 3 = 0"), False)):
        snapshots.write_snapshot(rows, path, version)
        if seen:
            snapshots.publish(spark, path, version)
    return snapshots.current(spark, path)


QUERIES = {f.__name__: f for f in (sitemap_pages, feed_pages, article_documents, curated_documents, snapshot_current)}
DAY = lambda p: f"('2024-0' || ({p} % 3 + 1) || '-' || lpad(({p} % 28 + 1)::VARCHAR, 2, '0'))"
SECONDS = lambda p: f"epoch({DAY(p)}::TIMESTAMP)::BIGINT"
OLD = f"TIMESTAMP '{CUTOFF[:10]}'"
LINE = lambda x: f"trim(regexp_replace({html_sql(x)}, '\\s+', ' ', 'g'))"


ORACLE_SQL = {
    "sitemap_pages": f"""WITH p AS (SELECT *, regexp_extract(url, '{LANG}', 1) AS lang, page_id % 43 <> 5 AND page_id % 41 = 3 AS bad FROM pages)
SELECT lang || '-' || page_id // {MOST_URLS} || '.xml' AS sitemap, CASE WHEN NOT bad AND page_id % 43 <> 5 THEN {url_sql('url')} END AS url, CASE WHEN NOT bad THEN {SECONDS('page_id')} END AS lastmod,
  CASE WHEN bad THEN 'corrupt' WHEN page_id % 43 = 5 THEN 'no address' WHEN lang = 'fr' THEN 'unlisted' END AS reason FROM p UNION ALL SELECT 'none.xml', NULL, NULL, 'empty sitemap'""",
    "feed_pages": f"""WITH p AS (SELECT *, page_id % 37 = 2 AS bad, {url_sql(f"CASE WHEN page_id % 9 = 1 THEN url ELSE 'http://www.{HOST}' || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) END")} AS link FROM pages),
q AS (SELECT *, regexp_replace(split_part(link, '?', 1), '^https?://[^/]+', '') AS path FROM p)
SELECT CASE WHEN bad THEN '{HOST}-item' ELSE '{HOST}-' || coalesce(nullif(list_last(string_split(rtrim(path, '/'), '/')), ''), 'item') END AS id, CASE WHEN NOT bad THEN link END AS url, CASE WHEN NOT bad THEN 'page & ' || page_id END AS title,
  CASE WHEN NOT bad THEN {SECONDS('page_id')} END AS date, CASE WHEN bad THEN '' ELSE 'Pages' END AS categories, CASE WHEN bad THEN '' ELSE 'one' END AS tags, CASE WHEN NOT bad THEN md5('of ' || regexp_extract(url, '{LANG}', 1)) END AS digest,
  CASE WHEN bad THEN 'corrupt' WHEN NOT starts_with(link, 'https://{HOST}/') THEN 'other host' WHEN {DAY('page_id')}::TIMESTAMP < {OLD} THEN 'before the cutoff' END AS reason FROM q""",
    "article_documents": f"""WITH p AS (SELECT *, doc_id % 53 = 4 AS bad, {LINE("string_split(text, chr(10))[1]")} AS title, {LINE('text')} AS excerpt FROM documents)
SELECT CASE WHEN NOT bad THEN '{HOST}-' || doc_id END AS id, CASE WHEN NOT bad THEN 'https://' || CASE WHEN doc_id % 7 = 2 THEN 'other.example.org' ELSE '{HOST}' END || '/' || doc_id END AS url, CASE WHEN NOT bad THEN title END AS title, CASE WHEN NOT bad THEN {SECONDS('doc_id')} END AS date,
  CASE WHEN bad THEN '' ELSE coalesce(source, '') END AS categories, CASE WHEN bad THEN '' ELSE coalesce(lang, '') END AS tags, CASE WHEN NOT bad THEN md5({clip_sql('excerpt')}) END AS digest,
  CASE WHEN bad THEN 'corrupt' WHEN doc_id % 7 = 2 THEN 'other host' WHEN {DAY('doc_id')}::TIMESTAMP < {OLD} THEN 'before the cutoff' WHEN coalesce(title, '') = '' THEN 'no title' WHEN coalesce(excerpt, '') = '' THEN 'no excerpt' END AS reason FROM p""",
    "curated_documents": """WITH p AS (SELECT *, doc_id % 53 = 4 AS bad, CASE WHEN doc_id % 17 = 5 THEN ' ' || chr(9) ELSE text END AS body FROM documents)
SELECT CASE WHEN bad THEN NULL WHEN doc_id % 11 = 3 THEN doc_id::VARCHAR ELSE 'd' || doc_id END AS id, CASE WHEN NOT bad AND doc_id % 13 <> 4 THEN lang END AS title, CASE WHEN NOT bad THEN md5(body) END AS digest, CASE WHEN NOT bad THEN source END AS category,
  CASE WHEN bad THEN 'corrupt' WHEN doc_id % 11 = 3 THEN 'no id' WHEN doc_id % 13 = 4 OR lang IS NULL THEN 'no title' WHEN body IS NULL THEN 'no text' WHEN source IS NULL THEN 'no category' WHEN regexp_matches(body, '^\\s*$') THEN 'blank text' END AS reason FROM p""",
    "snapshot_current": "SELECT page_id, url FROM pages",
}
