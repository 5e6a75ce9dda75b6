"""Late rows of a stream: told apart before the watermark drops them, kept in a table of their own and counted."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replayed(rows: DataFrame, arrival: Column, folder: str) -> DataFrame:
    """The rows as a stream of files, one for each value of arrival (int), read one after another in its order."""
    spark, path = rows.sparkSession, f"{folder}/replay-{uuid.uuid4().hex}"
    rows.withColumn("arrival", arrival).repartition("arrival").write.partitionBy("arrival").parquet(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/arrival=*/*.parquet")):  # files are read by age
        place = int(status.getPath().getParent().getName().partition("=")[2])
        fs.setTimes(status.getPath(), 1_600_000_000_000 + 60_000 * place, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(f"{path}/arrival=*/")


def split_late(stream: DataFrame, delay_ms: int, folder: str, column: str = "ts") -> DataFrame:
    """All rows that a stream has now, with batch (long) and late (boolean): older than the newest of the batches before by more than delay_ms.

    Each batch writes a folder of its own, replaced if the batch is done again, and reads what the folders before have as
    their newest; so a failure neither loses nor doubles a row. The first batch has no late rows, a row without a time is
    never late. kept + late = all rows, whatever the order."""
    spark, path = stream.sparkSession, f"{folder}/late-{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        known = own.read.parquet(f"{path}/newest").filter(F.col("batch") < batch).agg(F.max("newest").alias("newest")).first().newest if batch else None
        late = F.lit(False) if known is None else F.coalesce(F.unix_millis(column) < known - delay_ms, F.lit(False))
        rows.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        rows.agg(F.coalesce(F.unix_millis(F.max(column)), F.lit(known).cast("long")).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return _read(spark, f"{path}/rows", stream)


def _read(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    return spark.read.schema(f"{fields}, late boolean, batch long").parquet(path)


def late_counts(rows: DataFrame, column: str = "ts") -> DataFrame:
    """day, kept, late, newest_batch: how many rows of a day came in time, how many too late, and the last batch with one of it."""
    by = rows.groupBy(F.to_date(column).alias("day"))
    return by.agg(F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("late"), F.max("batch").alias("newest_batch"))
