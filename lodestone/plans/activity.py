"""Queries of the activity job over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import activity as ops
from lodestone.sources.tables import activity

OFFSET = 5


def activity_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(activity(spark, d))


def activity_years(spark: SparkSession, d: str) -> DataFrame:
    return ops.years(activity(spark, d))


def activity_months(spark: SparkSession, d: str) -> DataFrame:
    return ops.months(activity(spark, d))


def activity_month_axis(spark: SparkSession, d: str) -> DataFrame:
    return ops.month_axis(activity(spark, d))


def activity_hours(spark: SparkSession, d: str) -> DataFrame:
    return ops.hours(activity(spark, d), OFFSET)


def activity_peaks(spark: SparkSession, d: str) -> DataFrame:
    peaks = ops.peak(ops.hours(activity(spark, d), OFFSET))
    return peaks.withColumn("day_part", F.when(F.col("start_hour").isNotNull(), ops.day_part(F.col("start_hour"))))


def activity_weekdays(spark: SparkSession, d: str) -> DataFrame:
    return ops.weekdays(activity(spark, d), OFFSET)


def activity_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ops.clusters(ops.hours(activity(spark, d)))


def activity_filtered(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(ops.chosen(activity(spark, d), "posts", 2024)).select("subject_id", "total")


def activity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ops.overlap(ops.peak(ops.hours(activity(spark, d))), 0)


def activity_joint_effort(spark: SparkSession, d: str) -> DataFrame:
    points = activity(spark, d)
    lead = points.select(F.col("subject_id").alias("lead")).distinct()
    return ops.joint_effort(points, lead.select("lead", (F.col("lead") + 1).alias("first"), (F.col("lead") + 2).alias("second")))


QUERIES = {f.__name__: f for f in (activity_totals, activity_years, activity_months, activity_month_axis, activity_hours, activity_peaks, activity_weekdays, activity_clusters, activity_filtered, activity_overlap, activity_joint_effort)}

POINTS = """points AS (SELECT user_id AS subject_id, ts, CASE event_type WHEN 'view' THEN 'emails' WHEN 'click' THEN 'posts' ELSE 'other' END AS kind FROM events)"""
MONTHS = """months AS (SELECT subject_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (kind = 'emails') AS emails, count(*) FILTER (kind = 'posts') AS posts, count(*) AS total FROM points WHERE kind IN ('emails', 'posts') GROUP BY ALL)"""


def hours_sql(offset: int) -> str:
    return f"""grid AS (SELECT subject_id, hour FROM (SELECT DISTINCT subject_id FROM points), range(24) r(hour)),
hours AS (SELECT g.subject_id, g.hour::INT AS hour, count(p.ts) AS total, count(p.ts) FILTER (p.kind = 'emails') AS emails, count(p.ts) FILTER (p.kind = 'posts') AS posts
  FROM grid g LEFT JOIN points p ON p.subject_id = g.subject_id AND (hour(p.ts) + {offset}) % 24 = g.hour GROUP BY ALL),
windows AS (SELECT a.subject_id, a.hour, sum(b.total) AS s FROM hours a JOIN hours b ON a.subject_id = b.subject_id AND (b.hour - a.hour + 24) % 24 < 8 GROUP BY ALL),
peaks AS (SELECT subject_id, CASE WHEN s > 0 THEN hour END AS start_hour, CASE WHEN s > 0 THEN s::BIGINT END AS peak_total FROM windows QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY s DESC, hour) = 1),
active AS (SELECT *, max(total) OVER (PARTITION BY subject_id) AS top, total >= 0.35 * max(total) OVER (PARTITION BY subject_id) AND max(total) OVER (PARTITION BY subject_id) > 0 AS on_ FROM hours),
clusters AS (SELECT a.subject_id, CASE WHEN bool_or(a.on_) THEN greatest(count(*) FILTER (a.on_ AND NOT b.on_), 1) ELSE 0 END AS clusters FROM active a JOIN active b ON a.subject_id = b.subject_id AND b.hour = (a.hour + 23) % 24 GROUP BY ALL),
covered AS (SELECT subject_id, start_hour, list_transform(range(8), lambda i: (start_hour + i) % 24) AS hs FROM peaks)"""


ORACLE_SQL = {
    "activity_totals": f"WITH {POINTS} SELECT subject_id, count(*) AS total, count(*) FILTER (kind = 'emails') AS emails, count(*) FILTER (kind = 'posts') AS posts FROM points GROUP BY ALL",
    "activity_years": f"WITH {POINTS} SELECT DISTINCT subject_id, year(ts)::BIGINT AS year FROM points",
    "activity_months": f"WITH {POINTS}, {MONTHS} SELECT * FROM months",
    "activity_month_axis": f"""WITH {POINTS}, {MONTHS}, axis AS (SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS m FROM points))
SELECT s.subject_id, a.month, coalesce(emails, 0) AS emails, coalesce(posts, 0) AS posts, coalesce(total, 0) AS total FROM (SELECT DISTINCT subject_id FROM points) s CROSS JOIN axis a LEFT JOIN months m ON m.subject_id = s.subject_id AND m.month = a.month""",
    "activity_hours": f"WITH {POINTS}, {hours_sql(OFFSET)} SELECT * FROM hours",
    "activity_peaks": f"""WITH {POINTS}, {hours_sql(OFFSET)}, parts AS (SELECT subject_id, (h // 6) AS part, count(*) AS n FROM (SELECT subject_id, unnest(hs) AS h FROM covered WHERE start_hour IS NOT NULL) GROUP BY subject_id, (h // 6) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, part) = 1)
SELECT p.subject_id, start_hour, peak_total, CASE part WHEN 0 THEN 'overnight' WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' WHEN 3 THEN 'evening' END AS day_part FROM peaks p LEFT JOIN parts USING (subject_id)""",
    "activity_weekdays": f"""WITH {POINTS}, c AS (SELECT subject_id, count(*) FILTER (dayofweek(ts + INTERVAL {OFFSET} HOUR) BETWEEN 1 AND 5) AS weekday, count(*) FILTER (dayofweek(ts + INTERVAL {OFFSET} HOUR) IN (0, 6)) AS weekend FROM points GROUP BY ALL)
SELECT *, floor(weekday * 100 / (weekday + weekend) + 0.5)::BIGINT AS weekday_pct, floor(weekend * 100 / (weekday + weekend) + 0.5)::BIGINT AS weekend_pct FROM c""",
    "activity_clusters": f"WITH {POINTS}, {hours_sql(0)} SELECT subject_id, clusters::BIGINT AS clusters FROM clusters",
    "activity_filtered": f"WITH {POINTS} SELECT subject_id, count(*) AS total FROM points WHERE kind = 'posts' AND year(ts) = 2024 GROUP BY ALL",
    "activity_overlap": f"""WITH {POINTS}, {hours_sql(0)} SELECT c.subject_id, CASE WHEN c.start_hour IS NOT NULL AND l.start_hour IS NOT NULL THEN floor(len(list_intersect(c.hs, l.hs)) * 100 / 8 + 0.5)::BIGINT END AS overlap_pct FROM covered c, covered l WHERE l.subject_id = 0 AND c.subject_id <> 0""",
    "activity_joint_effort": f"""WITH {POINTS}, {hours_sql(0)}, t AS (SELECT subject_id, sum(total) AS timed FROM hours GROUP BY ALL), j AS (
SELECT l.subject_id AS lead, l.subject_id + 1 AS first, l.subject_id + 2 AS second, clusters, p.peak_total, timed,
  CASE WHEN l.start_hour IS NOT NULL AND a.start_hour IS NOT NULL THEN floor(len(list_intersect(l.hs, a.hs)) * 100 / 8 + 0.5)::BIGINT END AS first_pct,
  CASE WHEN l.start_hour IS NOT NULL AND b.start_hour IS NOT NULL THEN floor(len(list_intersect(l.hs, b.hs)) * 100 / 8 + 0.5)::BIGINT END AS second_pct,
  CASE WHEN l.start_hour IS NOT NULL AND (a.start_hour IS NOT NULL OR b.start_hour IS NOT NULL) THEN floor(len(list_intersect(l.hs, list_concat(CASE WHEN a.start_hour IS NULL THEN [] ELSE a.hs END, CASE WHEN b.start_hour IS NULL THEN [] ELSE b.hs END))) * 100 / 8 + 0.5)::BIGINT END AS union_pct
FROM covered l JOIN clusters USING (subject_id) JOIN peaks p USING (subject_id) JOIN t USING (subject_id) LEFT JOIN covered a ON a.subject_id = l.subject_id + 1 LEFT JOIN covered b ON b.subject_id = l.subject_id + 2)
SELECT lead, first, second, clusters::BIGINT AS clusters, first_pct, second_pct, union_pct, peak_total IS NOT NULL AND (coalesce(peak_total / timed < 0.5 OR clusters >= 2, false) OR (first_pct IS NOT NULL AND second_pct IS NOT NULL AND coalesce(union_pct >= greatest(first_pct, second_pct) + 25, false))) AS composite FROM j""",
}
