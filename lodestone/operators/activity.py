"""Activity series of subjects: months, hours, peaks, and what they say of who was at work.

Input is one long table (subject_id, ts, kind). Hours and weekdays are taken at a fixed whole-hour offset from UTC. Every
result holds at most 24 rows, or one a month, for each subject, so only these small aggregates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("emails", "posts")
PEAK_HOURS = 8
ACTIVE_SHARE = 0.35


def normalised_kind(kind: Column) -> Column:
    """emails and posts by any of their spellings, all else 'other'."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("email", "emails", "e-mail", "e-mails"), "emails").when(k.isin("post", "posts"), "posts").otherwise("other")


def chosen(points: DataFrame, kind: str = "both", year: int | None = None) -> DataFrame:
    """Points of a kind (both: every kind, 'other' too) and a year (None: all)."""
    out = points if kind == "both" else points.filter(F.col("kind") == kind)
    return out if year is None else out.filter(F.year("ts") == year)


def shifted(offset: int) -> Column:
    return F.col("ts") + F.make_dt_interval(hours=F.lit(offset))


def totals(points: DataFrame) -> DataFrame:
    return points.groupBy("subject_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def years(points: DataFrame) -> DataFrame:
    return points.select("subject_id", F.year("ts").cast("long").alias("year")).distinct()


def months(points: DataFrame) -> DataFrame:
    """Counts by month; 'other' kinds count for neither column and not for the total."""
    kept = points.filter(F.col("kind").isin(*KINDS)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    counted = kept.groupBy("subject_id", "month").pivot("kind", list(KINDS)).count().na.fill(0, list(KINDS))
    return counted.select("subject_id", "month", *KINDS, (F.col("emails") + F.col("posts")).alias("total"))


def month_axis(points: DataFrame) -> DataFrame:
    """The same months for every subject, from the first to the last of any, zeros filled in."""
    bounds = points.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    axis = bounds.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    # one row a month in the broadcast side; the grid is subjects times months, which is the result itself
    grid = points.select("subject_id").distinct().crossJoin(F.broadcast(axis))
    return grid.join(months(points), ["subject_id", "month"], "left").na.fill(0)


def hours(points: DataFrame, offset: int = 0) -> DataFrame:
    """24 rows for each subject: hour, total, emails, posts."""
    hour = F.pmod(F.hour("ts") + F.lit(offset), F.lit(24))
    counted = points.groupBy("subject_id", hour.alias("hour")).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    grid = counted.select("subject_id").distinct().select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(counted, ["subject_id", "hour"], "left").na.fill(0)


def peak(hourly: DataFrame, window: int = PEAK_HOURS) -> DataFrame:
    """subject_id, start_hour, peak_total: the fullest stretch of hours around the clock, the earliest of equals; null
    without any activity."""
    doubled = hourly.select("subject_id", "hour", "total").unionByName(hourly.filter(F.col("hour") < window - 1).select("subject_id", (F.col("hour") + 24).alias("hour"), "total"))
    w = Window.partitionBy("subject_id").orderBy("hour").rowsBetween(0, window - 1)
    best = doubled.withColumn("s", F.sum("total").over(w)).filter("hour < 24").groupBy("subject_id").agg(F.max(F.struct("s", (-F.col("hour")).alias("h"))).alias("m"))
    some = F.col("m.s") > 0
    return best.select("subject_id", F.when(some, -F.col("m.h")).alias("start_hour"), F.when(some, F.col("m.s")).alias("peak_total"))


def day_part(start: Column) -> Column:
    """The part of the day that holds most of a window's hours; of equals overnight, morning, afternoon, evening in this order."""
    inside = F.transform(F.sequence(F.lit(0), F.lit(PEAK_HOURS - 1)), lambda i: F.pmod(start + i, F.lit(24)))
    names = ("overnight", "morning", "afternoon", "evening")

    def held(part: int) -> Column:
        n = F.size(F.filter(inside, lambda h: F.floor(h / 6) == part))
        return F.struct(n.alias("n"), F.lit(-part).alias("k"), F.lit(names[part]).alias("name"))

    return F.array_max(F.array(*map(held, range(4))))["name"]


def weekdays(points: DataFrame, offset: int = 0) -> DataFrame:
    weekend = F.dayofweek(shifted(offset)).isin(1, 7)
    counted = points.groupBy("subject_id").agg(F.count_if(~weekend).alias("weekday"), F.count_if(weekend).alias("weekend"))
    share = lambda c: F.floor(F.col(c) * 100 / (F.col("weekday") + F.col("weekend")) + 0.5).cast("long").alias(f"{c}_pct")
    return counted.select("subject_id", "weekday", "weekend", share("weekday"), share("weekend"))


def clusters(hourly: DataFrame) -> DataFrame:
    """Runs of hours around the clock with at least 35 % of the fullest hour; all hours are one run."""
    by = Window.partitionBy("subject_id")
    top = F.max("total").over(by)
    marked = hourly.withColumn("active", (top > 0) & (F.col("total") >= top * ACTIVE_SHARE))
    before = F.coalesce(F.lag("active").over(by.orderBy("hour")), F.last("active").over(by.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    runs = marked.withColumn("begins", F.col("active") & ~before).groupBy("subject_id").agg(F.count_if("begins").alias("n"), F.max("active").alias("some"))
    return runs.select("subject_id", F.when(F.col("some"), F.greatest("n", F.lit(1))).otherwise(0).cast("long").alias("clusters"))


def window_hours(start: Column, window: int = PEAK_HOURS) -> Column:
    return F.when(start.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.pmod(start + i, F.lit(24)).cast("int")))


def percent(part: Column, whole: Column | int) -> Column:
    return F.floor(part * 100 / whole + 0.5).cast("long")


def overlap(peaks: DataFrame, lead: int) -> DataFrame:
    """How much of the lead subject's peak hours each other subject's cover, in percent; null where either has no peak."""
    of_lead = peaks.filter(F.col("subject_id") == lead).select(F.col("start_hour").alias("lead_start"))
    both = peaks.filter(F.col("subject_id") != lead).crossJoin(F.broadcast(of_lead))  # one row
    shared = F.size(F.array_intersect(window_hours(F.col("start_hour")), window_hours(F.col("lead_start"))))
    return both.select("subject_id", F.when(F.col("start_hour").isNotNull() & F.col("lead_start").isNotNull(), percent(shared, PEAK_HOURS)).alias("overlap_pct"))


def joint_effort(points: DataFrame, triples: DataFrame) -> DataFrame:
    """For each lead with two candidates (lead, first, second): does the lead's activity look like several people's?

    Spread: the peak holds under half of it, or it has two clusters or more. Union: the candidates' peaks together cover at
    least 25 points more of the lead's than the better one alone. composite: either; null peaks give no verdict of union.
    """
    hourly = hours(points)
    peaks = peak(hourly).join(hourly.groupBy("subject_id").agg(F.sum("total").alias("timed")), "subject_id").join(clusters(hourly), "subject_id").withColumn("hours", window_hours(F.col("start_hour")))
    out = triples.join(peaks.select(F.col("subject_id").alias("lead"), F.col("hours").alias("h0"), "peak_total", "timed", "clusters"), "lead")
    for n, name in ((1, "first"), (2, "second")):
        out = out.join(peaks.select(F.col("subject_id").alias(name), F.col("hours").alias(f"h{n}")), name, "left")
    cover = lambda h: F.when(F.col("h0").isNotNull() & h.isNotNull(), percent(F.size(F.array_intersect("h0", h)), PEAK_HOURS))
    none = F.array().cast("array<int>")
    union = F.array_union(F.coalesce("h1", none), F.coalesce("h2", none))
    out = out.select("lead", "first", "second", "peak_total", "timed", "clusters", cover(F.col("h1")).alias("first_pct"), cover(F.col("h2")).alias("second_pct"), F.when(F.col("h1").isNotNull() | F.col("h2").isNotNull(), cover(union)).alias("union_pct"))
    spread = F.coalesce((F.col("peak_total") / F.col("timed") < 0.5) | (F.col("clusters") >= 2), F.lit(False))
    beats = F.coalesce(F.col("union_pct") >= F.greatest("first_pct", "second_pct") + 25, F.lit(False)) & F.col("first_pct").isNotNull() & F.col("second_pct").isNotNull()
    return out.withColumn("composite", F.col("peak_total").isNotNull() & (spread | beats)).select("lead", "first", "second", "clusters", "first_pct", "second_pct", "union_pct", "composite")
