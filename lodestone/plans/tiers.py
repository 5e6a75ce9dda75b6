"""Queries of evidence tiers and snapshot freshness. Each eight documents stand for the ranked hits of one question; orders are
the pins of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import tiers as ops
from lodestone.sources.tables import table

AS_OF, DAYS, CUT = "1998-08-05", 14, 500


def _hits(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    day = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (i * 37 % 5000).cast("int")), "yyyy-MM-dd")
    rows = table(spark, d, "documents").select(
        "doc_id", F.floor(i / 8).alias("question_id"), (i % 8 + 1).alias("rank"), F.when(i % 5 == 0, "brc").when(i % 5 == 1, "doc").otherwise("essay").alias("kind"),
        F.substring(F.substring_index(text, "\n", 1), 1, 60).alias("title"), F.substring(text, 1, 300).alias("excerpt"), F.when(i % 3 > 0, day).otherwise("").alias("date"),
        F.when(i % 4 > 0, F.concat(F.lit("https://archive.example/"), (i % 50).cast("string"))).otherwise(F.concat(F.lit("local:"), i.cast("string"))).alias("url"),
    )
    asked = rows.filter("rank = 1").select("question_id", ops.keywords(F.col("title")).alias("keys"))
    keys = F.col("keys")
    found = rows.join(asked, "question_id")
    return found.select("*", ops.shares_term(keys, "title", "excerpt", "url").alias("engages"), ops.shares_term(keys, "title", without=False).alias("in_title"), ops.shares_term(keys, "excerpt", without=False).alias("in_excerpt"))


def _cited(hits: DataFrame) -> DataFrame:
    return hits.filter("rank between 3 and 6")


def tier_spec_first(spark: SparkSession, d: str) -> DataFrame:
    return ops.spec_first(_hits(spark, d))


def tier_primaries(spark: SparkSession, d: str) -> DataFrame:
    return ops.primary_documents(_hits(spark, d)).select("question_id", "doc_id", "place")


def tier_attached(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return ops.with_primaries(_cited(hits).filter("kind = 'essay' or question_id % 2 = 0"), ops.primary_documents(hits))


def tier_identity(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return ops.identity_set(hits, ops.primary_documents(hits), ["brc"])


def tier_public_claims(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return ops.public_claims(hits.filter("rank % 2 = 0").select("question_id", "doc_id"), hits)


def tier_grounded(spark: SparkSession, d: str) -> DataFrame:
    return ops.grounded(_hits(spark, d).filter("rank > 1"))


def tier_linkable(spark: SparkSession, d: str) -> DataFrame:
    return ops.linkable_dated(_hits(spark, d))


def tier_reports(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return ops.reports(ops.numbered_once(_cited(hits).withColumn("section", F.lit(0)).withColumn("pos", F.col("rank"))), hits.select("doc_id", "title", "date"))


def tier_spec_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = _hits(spark, d).groupBy("question_id").agg(F.max((F.col("kind") == "brc") & F.col("engages")).alias("has_spec"))
    return ops.spec_summary(runs.withColumn("expects_spec", F.col("question_id") % 2 == 0))


def document_cuts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ops.clean_cut(F.coalesce("text", F.lit("")), CUT).alias("cut"))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("unknown")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("snapshot"), stamp.alias("fetched_at"), F.lit("1992-06-01").cast("timestamp").alias("file_time"), "o_orderkey")


def snapshot_stale(spark: SparkSession, d: str) -> DataFrame:
    return ops.stale_snapshots(ops.freshness(_manifests(spark, d)), AS_OF, DAYS)


def snapshot_newest(spark: SparkSession, d: str) -> DataFrame:
    return ops.freshness(_manifests(spark, d)).agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd").alias("newest"))


def catalogue_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.category_counts(table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 > 0, F.col("source")).otherwise("").alias("category")))


def activity_sources(spark: SparkSession, d: str) -> DataFrame:
    """One of the files isn't there."""
    return ops.activity_sources(spark, {"events": f"{d}/events.parquet", "letters": f"{d}/letters.parquet"})


def answers_cacheable(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", ops.cacheable(F.coalesce("text", F.lit("")), i % 4, i % 10 == 0).alias("cacheable"))


QUERIES = {
    f.__name__: f
    for f in (
        tier_spec_first, tier_primaries, tier_attached, tier_identity, tier_public_claims, tier_grounded, tier_linkable, tier_reports, tier_spec_summary,
        document_cuts, snapshot_stale, snapshot_newest, catalogue_counts, activity_sources, answers_cacheable,
    )
}

HITS = r"""r AS (SELECT doc_id, doc_id // 8 AS question_id, doc_id % 8 + 1 AS rank, CASE doc_id % 5 WHEN 0 THEN 'brc' WHEN 1 THEN 'doc' ELSE 'essay' END AS kind,
  left(split_part(coalesce(text, ''), chr(10), 1), 60) AS title, left(coalesce(text, ''), 300) AS excerpt,
  CASE WHEN doc_id % 3 > 0 THEN strftime(DATE '2010-01-01' + (doc_id * 37 % 5000)::INT, '%Y-%m-%d') ELSE '' END AS date,
  CASE WHEN doc_id % 4 > 0 THEN 'https://archive.example/' || doc_id % 50 ELSE 'local:' || doc_id END AS url FROM documents),
k AS (SELECT question_id, list_distinct([w FOR w IN regexp_extract_all(lower(title), '[\p{L}\p{N}]+') IF length(w) > 3]) AS keys FROM r WHERE rank = 1),
h AS (SELECT r.*, len(keys) = 0 OR len([w FOR w IN keys IF contains(lower(title || ' ' || excerpt || ' ' || url), w)]) > 0 AS engages,
  len([w FOR w IN keys IF contains(lower(title), w)]) > 0 AS in_title, len([w FOR w IN keys IF contains(lower(excerpt), w)]) > 0 AS in_excerpt,
  url LIKE 'http%' AS link, kind <> 'essay' AS is_primary FROM r JOIN k USING (question_id)),
p AS (SELECT question_id, doc_id, url, row_number() OVER (PARTITION BY question_id ORDER BY date, rank, doc_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id) AS r FROM (
    SELECT *, bool_or(engages) OVER (PARTITION BY question_id) AS any_one FROM h WHERE is_primary AND date <> '') WHERE engages OR NOT any_one) WHERE r <= 8)"""
ONCE = """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY section, pos, doc_id) AS n, doc_id FROM (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, url ORDER BY section, pos, doc_id) = 1)"""
MANIFESTS = "m AS (SELECT o_orderpriority AS snapshot, max(CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE::TIMESTAMP ELSE TIMESTAMP '1992-06-01' END) AS stamp FROM orders GROUP BY ALL)"
ORACLE_SQL = {
    "tier_spec_first": f"WITH {HITS} SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE kind WHEN 'brc' THEN 0 WHEN 'doc' THEN 1 ELSE 2 END + CASE WHEN engages THEN 0 ELSE 10 END, rank, doc_id) AS place FROM h",
    "tier_primaries": f"WITH {HITS} SELECT question_id, doc_id, place FROM p",
    "tier_attached": f"""WITH {HITS}, c AS (SELECT * FROM h WHERE rank BETWEEN 3 AND 6 AND (kind = 'essay' OR question_id % 2 = 0)),
u AS (SELECT question_id, doc_id, url, 0 AS section, place AS pos FROM p WHERE place <= 3 AND question_id NOT IN (SELECT question_id FROM c WHERE is_primary)
  UNION ALL SELECT question_id, doc_id, url, 1, rank FROM c) {ONCE}""",
    "tier_identity": f"""WITH {HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY question_id, kind ORDER BY rank) AS c FROM h),
d AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN kind = 'brc' AND c = 1 THEN 0 WHEN kind <> 'brc' AND c = 1 THEN 1 ELSE 2 END, rank) AS place FROM c),
u AS (SELECT question_id, doc_id, url, 0 AS section, place AS pos FROM d WHERE place <= 7 UNION ALL SELECT question_id, doc_id, url, 1, place FROM p WHERE place = 1)
SELECT * FROM ({ONCE}) WHERE n <= 5""",
    "tier_public_claims": f"WITH {HITS} SELECT question_id, doc_id FROM h WHERE rank % 2 = 0 AND engages AND link",
    "tier_grounded": f"WITH {HITS} SELECT question_id, CASE WHEN bool_or(link) THEN bool_or(in_title) FILTER (link) ELSE bool_or(in_excerpt) END AS grounded FROM h WHERE rank > 1 GROUP BY ALL",
    "tier_linkable": f"WITH {HITS} SELECT question_id, count(*) FILTER (link) AS linkable, count(*) FILTER (date <> '') AS dated FROM h GROUP BY ALL",
    "tier_reports": f"""WITH {HITS}, u AS (SELECT *, 0 AS section, rank AS pos FROM h WHERE rank BETWEEN 3 AND 6), n AS ({ONCE})
SELECT question_id, string_agg('[' || n || '] ' || trim(title, ' ') || ' (' || CASE WHEN date = '' THEN 'undated' ELSE strftime(date::DATE, '%B %Y') END || ')', chr(10) ORDER BY n) AS report FROM n JOIN h USING (question_id, doc_id) GROUP BY question_id""",
    "tier_spec_summary": f"""WITH {HITS}, q AS (SELECT question_id % 2 = 0 AS e, bool_or(kind = 'brc' AND engages) AS s FROM h GROUP BY question_id)
SELECT count(*) FILTER (e) AS expected, count(*) FILTER (e AND s) AS met, count(*) FILTER (e AND NOT s) AS missed, count(*) FILTER (NOT e AND s) AS unasked FROM q""",
    "document_cuts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), {CUT}) AS s FROM documents),
b AS (SELECT *, instr(reverse(s), chr(10)) AS line, coalesce(least(nullif(instr(reverse(s), ' .'), 0), nullif(instr(reverse(s), ' !'), 0), nullif(instr(reverse(s), ' ?'), 0)), 0) AS sentence, instr(reverse(s), ' ') AS space FROM d)
SELECT doc_id, CASE WHEN length(t) <= {CUT} THEN t WHEN line > 0 AND {CUT} - line + 1 > {CUT} / 2 THEN left(t, {CUT} - line)
  WHEN sentence > 0 AND {CUT} - sentence > {CUT} / 2 THEN left(t, {CUT} - sentence) WHEN space > 0 AND {CUT} - space + 1 > {CUT} / 2 THEN left(t, {CUT} - space) ELSE s END AS cut FROM b""",
    "snapshot_stale": f"WITH {MANIFESTS} SELECT snapshot, strftime(stamp, '%Y-%m-%d') AS updated_on, TIMESTAMP '{AS_OF}' > stamp + INTERVAL {DAYS} DAY AS stale FROM m",
    "snapshot_newest": f"WITH {MANIFESTS} SELECT strftime(max(stamp), '%Y-%m-%d') AS newest FROM m",
    "catalogue_counts": "SELECT count(DISTINCT nullif(CASE WHEN doc_id % 9 > 0 THEN source ELSE '' END, '')) AS categories, count(*) AS listings FROM documents",
    "activity_sources": "SELECT 'events' AS subject, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events UNION ALL SELECT 'letters', 0, NULL",
    "answers_cacheable": "SELECT doc_id, doc_id % 10 <> 0 AND length(trim(coalesce(text, ''), ' ')) >= 200 AND doc_id % 4 > 0 AS cacheable FROM documents",
}
