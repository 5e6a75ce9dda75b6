import glob
import os

from pyspark.sql import functions as F

from lodestone.operators import tiers


def test_a_pin_without_a_stamp_takes_its_files_time(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/a")
    for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/a/*.parquet"))):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    times = tiers.file_times(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/none"})
    assert {r.snapshot: r.t for r in times.select("snapshot", F.unix_seconds("file_time").alias("t")).collect()} == {"a": 1_700_000_001, "b": None}
    pins = spark.createDataFrame([("a", "no stamp"), ("b", "2024-01-02T00:00:00Z")], "snapshot string, fetched_at string").join(times, "snapshot", "left")
    got = {r.snapshot: r.t for r in tiers.freshness(pins).select("snapshot", F.unix_seconds("updated_at").alias("t")).collect()}
    assert got == {"a": 1_700_000_001, "b": 1_704_153_600}
