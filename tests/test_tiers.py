from pyspark.sql import functions as F

from lodestone.operators import tiers
from lodestone.streaming import live


def test_cuts_in_the_last_half(spark):
    cases = {"short": "short", "one two\nthree four five": "one two\nthree", "a. " + "b" * 30: "a. " + "b" * 13, "first words. then more": "first words.", "x" * 40: "x" * 16}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.cut for r in df.select("text", tiers.clean_cut(F.col("text"), 16).alias("cut")).collect()}
    assert got == cases


def test_primaries_come_first_where_none_is_cited(spark):
    cited = spark.createDataFrame([(1, 10, 1, "essay", "u1"), (1, 11, 2, "essay", "p1"), (2, 20, 1, "brc", "u2")], "question_id long, doc_id long, rank long, kind string, url string")
    primaries = spark.createDataFrame([(1, 5, "p1", 1), (1, 6, "p2", 2), (2, 7, "p3", 1)], "question_id long, doc_id long, url string, place long")
    assert sorted(map(tuple, tiers.with_primaries(cited, primaries).collect())) == [(1, 1, 5), (1, 2, 6), (1, 3, 10), (2, 1, 20)]


def test_unqualified_primaries_only_where_none_engages(spark):
    rows = [(1, 1, 1, "brc", "2020-02-01", "a", False), (1, 2, 2, "doc", "2019-01-01", "b", True), (2, 3, 1, "brc", "2020-01-01", "c", False), (2, 4, 2, "doc", "", "d", True), (3, 5, 1, "essay", "2020-01-01", "e", True)]
    hits = spark.createDataFrame(rows, "question_id long, doc_id long, rank long, kind string, date string, url string, engages boolean")
    assert sorted((r.question_id, r.doc_id, r.place) for r in tiers.primary_documents(hits).collect()) == [(1, 2, 1), (2, 3, 1)]
    assert tiers.primary_documents(hits.limit(0)).count() == 0


def test_missing_files_and_unreadable_stamps(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz '2024-03-02 10:00:00' AS ts").write.parquet(f"{tmp_path}/a")
    got = {r.subject: (r.n, r.first_day) for r in tiers.activity_sources(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/none"}).collect()}
    assert got == {"a": (1, "2024-03-02"), "b": (0, None)}
    pins = spark.createDataFrame([("x", "2024-01-20", "2023-01-01"), ("y", "soon", "2024-01-01")], "snapshot string, fetched_at string, file_time string")
    stale = {r.snapshot: (r.updated_on, r.stale) for r in tiers.stale_snapshots(tiers.freshness(pins), "2024-01-30").collect()}
    assert stale == {"x": ("2024-01-20", False), "y": ("2024-01-01", True)}


def test_payments_without_a_transaction_reuse_none(spark):
    p = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "t", 3), (4, "t", 4)], "payment_id long, txid string, paid_at long")
    assert [r.payment_id for r in live.reused(p).collect()] == [4]
