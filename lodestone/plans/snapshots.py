"""Queries of the snapshot job: pages with even ids are the snapshot, those with odd ids the fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import snapshots as ops
from lodestone.plans.corpus_build import ITEMS as PAGE_ITEMS, clip_sql
from lodestone.operators.corpus_build import page_items
from lodestone.plans.live import shared_folder
from lodestone.sources.tables import table

TODAY, FIRST, LAST = "2024-06-30", "2024-02-01", "2024-12-31"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Pages as items: four share an id, pages with one remainder share a url, every third has tags."""
    p = F.col("page_id")
    day = lambda n: F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (n % 700).cast("int")), "yyyy-MM-dd")
    rows = page_items(table(spark, d, "pages")).select(
        F.col("page_id").alias("pos"), F.concat(F.lit("p"), F.floor(p / 4).cast("string")).alias("id"), F.concat(F.lit("http://www.example.org/item/"), (p % 97).cast("string"), F.lit("/?utm_source=x")).alias("url"),
        "title", day(p * 37).alias("date"), F.when(p % 5 == 0, day(p * 53)).alias("modified"), F.when(p % 3 == 0, F.array(F.concat(F.lit("t"), (p % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("tags"), F.col("text").alias("excerpt"),
    )
    return ops.required(rows)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _items(spark, d)
    return rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1")


def snapshot_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("pos", "id", "url", "title", "date", "modified", F.array_join("tags", ",").alias("tags"), "excerpt")


def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    return ops.merged(*_halves(spark, d)).select("id", "url", "title", "date", "modified", F.array_join("tags", ",").alias("tags"))


def snapshot_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The merge as a walk in order of arrival, chains over both keys included."""
    return ops.upserted(*_halves(spark, d), shared_folder(spark)).select("id", "url", "title", "date", "modified", F.array_join("tags", ",").alias("tags"))


def snapshot_deletes(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    new = new.filter("pos % 8 < 5")
    return ops.covered_deletes(ops.merged(old, new), new, FIRST, LAST, True).select("id", "url", "date")


def snapshot_first_seen(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    previous = ops.first_of(old, ("id",), ("pos",)).select("id", F.when(F.col("pos") % 10 == 0, F.lit("no day")).otherwise(F.col("date")).alias("first_seen"))
    return ops.first_seen(ops.first_of(new, ("id",), ("pos",)), previous, TODAY)


def snapshot_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_of(_items(spark, d), ("id", "url"), ("pos",)).select("pos", "id", "url")


def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ops.manifest(_items(spark, d))


def snapshot_order(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest items, undated last, ids break ties."""
    rows = ops.first_of(_items(spark, d), ("id",), ("pos",))
    return rows.orderBy(F.desc_nulls_last(ops.parsed(F.col("date"))), "id").limit(50).select("id", "date")


QUERIES = {f.__name__: f for f in (snapshot_items, snapshot_merge, snapshot_upserts, snapshot_deletes, snapshot_first_seen, snapshot_first_wins, snapshot_manifest, snapshot_order)}

ROWS = f"""{PAGE_ITEMS}, rows AS (SELECT page_id AS pos, 'p' || (page_id // 4) AS id, 'https://example.org/item/' || (page_id % 97) AS url, nullif(title, '') AS title,
  strftime(DATE '2023-06-01' + (page_id * 37 % 700)::INT, '%Y-%m-%d') AS date, CASE WHEN page_id % 5 = 0 THEN strftime(DATE '2023-06-01' + (page_id * 53 % 700)::INT, '%Y-%m-%d') END AS modified,
  CASE WHEN page_id % 3 = 0 THEN 't' || (page_id % 7) ELSE '' END AS tags, {clip_sql('text')} AS excerpt FROM items WHERE title <> '' AND text <> '')"""
MERGED = """both_ AS (SELECT *, pos % 2 AS inc, coalesce(modified, date) AS stamp, CASE WHEN pos % 2 = 1 THEN -pos ELSE pos END AS tie FROM chosen),
one AS (SELECT * REPLACE (coalesce(first_value(nullif(tags, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY stamp DESC, inc DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS tags) FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY stamp DESC, inc DESC, tie) = 1),
merged AS (SELECT * REPLACE (coalesce(first_value(nullif(tags, '') IGNORE NULLS) OVER (PARTITION BY url ORDER BY stamp DESC, inc DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS tags) FROM one QUALIFY row_number() OVER (PARTITION BY url ORDER BY stamp DESC, inc DESC, tie) = 1)"""
ORACLE_SQL = {
    "snapshot_items": f"WITH {ROWS} SELECT * FROM rows",
    "snapshot_merge": f"WITH {ROWS}, chosen AS (SELECT * FROM rows), {MERGED} SELECT id, url, title, date, modified, tags FROM merged",
    "snapshot_upserts": f"""WITH RECURSIVE {ROWS},
o AS (SELECT row_number() OVER (ORDER BY pos % 2, pos) AS n, pos, pos % 2 = 1 AS inc, id, url, coalesce(modified, date) AS stamp, tags FROM rows),
w AS (SELECT 0::BIGINT AS n, []::STRUCT(pos BIGINT, id VARCHAR, url VARCHAR, stamp VARCHAR, tags VARCHAR)[] AS items, []::STRUCT(k VARCHAR, pl BIGINT)[] AS ids, []::STRUCT(k VARCHAR, pl BIGINT)[] AS urls
  UNION ALL SELECT n, CASE WHEN pl IS NULL THEN list_append(items, it) WHEN wins THEN list_concat(list_concat(items[1:pl - 1], [it]), items[pl + 1:]) ELSE items END,
    CASE WHEN wins THEN list_append(list_filter(ids, lambda x: x.k <> it.id AND x.k IS DISTINCT FROM old.id), {{'k': it.id, 'pl': coalesce(pl, len(items) + 1)}}) ELSE ids END,
    CASE WHEN wins THEN list_append(list_filter(urls, lambda x: x.k <> it.url AND x.k IS DISTINCT FROM old.url), {{'k': it.url, 'pl': coalesce(pl, len(items) + 1)}}) ELSE urls END
  FROM (SELECT *, pl IS NULL OR stamp > old.stamp OR stamp = old.stamp AND inc AS wins, {{'pos': pos, 'id': id, 'url': url, 'stamp': stamp, 'tags': CASE WHEN tags = '' THEN coalesce(old.tags, '') ELSE tags END}} AS it
    FROM (SELECT *, items[pl] AS old FROM (SELECT o.*, w.items, w.ids, w.urls, coalesce(list_filter(w.ids, lambda x: x.k = o.id)[1].pl, list_filter(w.urls, lambda x: x.k = o.url)[1].pl) AS pl FROM w JOIN o ON o.n = w.n + 1)))),
z AS (SELECT unnest(items) AS i FROM w WHERE n = (SELECT max(n) FROM w))
SELECT i.id AS id, i.url AS url, r.title, r.date, r.modified, i.tags AS tags FROM z JOIN rows r ON r.pos = i.pos""",
    "snapshot_deletes": f"""WITH {ROWS}, chosen AS (SELECT * FROM rows WHERE pos % 2 = 0 OR pos % 8 < 5), {MERGED}, fetched AS (SELECT * FROM rows WHERE pos % 2 = 1 AND pos % 8 < 5)
SELECT id, url, date FROM merged WHERE NOT (date BETWEEN '{FIRST}' AND '{LAST}' AND id NOT IN (SELECT id FROM fetched) AND url NOT IN (SELECT url FROM fetched))""",
    "snapshot_first_seen": f"""WITH {ROWS}, old AS (SELECT id, CASE WHEN pos % 10 = 0 THEN NULL ELSE date::DATE END AS old FROM rows WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)
SELECT id, CASE WHEN old <= DATE '{TODAY}' THEN old ELSE DATE '{TODAY}' END AS first_seen FROM (SELECT DISTINCT id FROM rows WHERE pos % 2 = 1) LEFT JOIN old USING (id)""",
    "snapshot_first_wins": f"WITH {ROWS}, one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) SELECT pos, id, url FROM one QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1",
    "snapshot_manifest": f"WITH {ROWS} SELECT count(*) AS total, count(*) FILTER (tags <> '') AS tagged, min(date) AS oldest, max(date) AS newest, count(DISTINCT title) AS titles FROM rows",
    "snapshot_order": f"WITH {ROWS}, one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) SELECT id, date FROM one ORDER BY date DESC NULLS LAST, id LIMIT 50",
}
