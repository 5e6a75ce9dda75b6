from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import activity as ops


def points(spark, rows):
    return spark.createDataFrame([(s, datetime.fromisoformat(ts), k) for s, ts, k in rows], "subject_id long, ts timestamp, kind string")


def hourly(spark, hours, subject=1):
    return points(spark, [(subject, f"2009-01-0{1 + n % 9}T{h:02}:15:00", "posts") for n, h in enumerate(hours)])


def test_weekdays(spark):
    p = points(spark, [(1, "2009-01-05T10:00", "emails"), (1, "2009-01-06T10:00", "posts"), (1, "2009-01-10T10:00", "posts")])
    r = ops.weekdays(p).first()
    assert (r.weekday, r.weekend, r.weekday_pct, r.weekend_pct) == (2, 1, 67, 33)
    late = points(spark, [(1, "2009-01-09T22:00", "posts")])
    assert ops.weekdays(late, 10).first().weekend == 1 and ops.weekdays(late).first().weekend == 0


def test_hours_and_peak(spark):
    p = points(spark, [(1, "2009-01-05T14:00", "posts")])
    assert {r.hour for r in ops.hours(p, 2).filter("total > 0").collect()} == {16}
    assert ops.hours(p).count() == 24
    steady = ops.hours(hourly(spark, [*range(10, 18)] * 3))
    r = ops.peak(steady).first()
    assert (r.start_hour, r.peak_total) == (10, 24)
    # around midnight, and the earliest of equal stretches
    assert ops.peak(ops.hours(hourly(spark, [22, 23, 0, 1, 2, 3, 4, 5]))).first().start_hour == 22
    assert ops.peak(ops.hours(hourly(spark, [7]))).first().start_hour == 0


def test_clusters_and_composite(spark):
    assert ops.clusters(ops.hours(hourly(spark, [*range(10, 18)]))).first().clusters == 1
    assert ops.clusters(ops.hours(hourly(spark, [*range(24)]))).first().clusters == 1
    both = hourly(spark, [8, 9, 10, 11, 20, 21, 22, 23])
    assert ops.clusters(ops.hours(both)).first().clusters == 2
    triple = spark.createDataFrame([(1, 2, 3)], "lead long, first long, second long")
    one = hourly(spark, [*range(10, 18)] * 2).unionByName(hourly(spark, [*range(10, 18)], 2))
    r = ops.joint_effort(one, triple).first()
    assert (r.first_pct, r.second_pct, r.composite) == (100, None, False)
    assert ops.joint_effort(both, triple).first().composite


def test_overlap(spark):
    p = hourly(spark, range(0, 8), 1).unionByName(hourly(spark, range(8, 16), 2)).unionByName(hourly(spark, range(0, 8), 3))
    assert {r.subject_id: r.overlap_pct for r in ops.overlap(ops.peak(ops.hours(p)), 1).collect()} == {2: 0, 3: 100}


def test_months(spark):
    p = points(spark, [(1, "2009-01-05T10:00", "emails"), (1, "2009-03-06T10:00", "posts"), (2, "2009-02-01T00:00", "posts"), (3, "2009-02-01T00:00", "other")])
    got = {(r.subject_id, r.month): r.total for r in ops.month_axis(p).collect()}
    assert [got[1, m] for m in ("2009-01", "2009-02", "2009-03")] == [1, 0, 1]
    assert [got[2, m] for m in ("2009-01", "2009-02", "2009-03")] == [0, 1, 0]
    assert [got[3, m] for m in ("2009-01", "2009-02", "2009-03")] == [0, 0, 0]
    assert ops.totals(ops.chosen(p, "both")).filter("subject_id = 3").first().total == 1
    assert ops.chosen(p, "posts", 2009).count() == 2 and ops.chosen(p, "both", 2010).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_order_of_rows_does_not_matter(spark, n):
    p = hourly(spark, [3, 3, 9, 15, 15, 22]).repartition(n)
    assert ops.peak(ops.hours(p)).first().peak_total == 3
    assert [r.kind for r in p.select(ops.normalised_kind(F.lit(" E-Mail ")).alias("kind")).distinct().collect()] == ["emails"]
