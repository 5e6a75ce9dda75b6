"""Live tallies, bursts and matches. The same functions work on batches and on streams; event time is a TIMESTAMP."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.streaming.ordered import LATE, Purchase

TTL_HOURS = 6


def tallies(ratings: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, mode, up, down of ratings (ts, rating, mode); rows more than ten minutes late are dropped in a stream."""
    by = ratings.withWatermark("ts", LATE).groupBy(F.window("ts", width), "mode")
    return by.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down")).select(F.col("window.start").alias("window_start"), "mode", "up", "down")


def totals(ratings: DataFrame) -> DataFrame:
    """up, down by mode, and overall (mode null); a rating without a mode counts only overall."""
    each = lambda rows: rows.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    return each(ratings.filter("mode is not null").groupBy("mode")).unionByName(each(ratings.groupBy()).withColumn("mode", F.lit(None).cast("string")))


def bursts(requests: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """user_id, window_start, n: windows in which a user made more than `limit` requests."""
    by = requests.withWatermark("ts", LATE).groupBy(F.window("ts", width), "user_id")
    return by.agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("user_id", F.col("window.start").alias("window_start"), "n")


def matched_payments(quotes: DataFrame, payments: DataFrame, minutes: int = 10, how: str = "leftOuter") -> DataFrame:
    """Each quote (quote_id, user_id, quoted_at) with the payments of its user within ten minutes, or without one. Two streams
    keep a quote until the watermark has passed its time; a stream gives quotes without a payment only after that."""
    q, p = quotes.withWatermark("quoted_at", LATE), payments.withWatermark("paid_at", LATE).withColumnRenamed("user_id", "payer")
    inside = (F.col("user_id") == F.col("payer")) & (F.col("paid_at") >= F.col("quoted_at")) & (F.col("paid_at") <= F.col("quoted_at") + F.make_dt_interval(mins=F.lit(minutes)))
    return q.join(p, inside, how).select("quote_id", "user_id", "payment_id")


def reused(payments: DataFrame) -> DataFrame:
    """Payments whose transaction an earlier payment used; payments without one used none."""
    return payments.filter("txid is not null").withColumn("r", F.row_number().over(Window.partitionBy("txid").orderBy("paid_at", "payment_id"))).filter("r > 1").select("payment_id", "txid")


def latest_state(changes: DataFrame) -> DataFrame:
    """Each key's last status."""
    return changes.groupBy("key").agg(F.max_by("status", F.struct("ts", "change_id")).alias("status"), F.count("*").alias("changes"))


def first_within_ttl(answers: DataFrame, hours: int = TTL_HOURS) -> DataFrame:
    """change_id of the answers (key, ts, change_id) that stand: the first of a key, then the first that comes `hours` or
    more after the last that stood; reading doesn't extend it. A task walks its sorted rows with one key's state at a time,
    so memory is bounded also for a key with very many rows."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, None
        for b in batches:
            out = []
            for k, ts, i in zip(b.column("key").to_pylist(), b.column("us").to_pylist(), b.column("change_id").to_pylist()):
                if k != key or until is None or ts >= until:
                    key, until = k, ts + hours * 3_600_000_000
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["change_id"])

    rows = answers.select("key", F.unix_micros("ts").alias("us"), "change_id")
    return rows.repartition("key").sortWithinPartitions("key", "us", "change_id").mapInArrow(walk, "change_id long")


def purchase_states(changes: DataFrame) -> DataFrame:
    """key, status, rejected of streaming changes (key, status, ts and, if there, change_id) as they arrive, in update mode: of what a
    micro-batch brings, all rows of a key are sorted by time and change_id first. Where rows of different micro-batches may
    come in the wrong order, use ordered.walked_stream, which waits for the watermark."""
    order = ["ts", "change_id"] if "change_id" in changes.columns else ["ts"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Purchase((*state.get, 0) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        own.walk(key[0], [(0, 0, s) for s in rows["status"]], 0)
        state.update((own.status, own.rejected))
        yield pd.DataFrame([(key[0], own.status, own.rejected)], columns=["key", "status", "rejected"])

    return changes.groupBy("key").applyInPandasWithState(step, "key long, status string, rejected long", "status string, rejected long", "update", "NoTimeout")


def price(chars: F.Column, rate: float) -> F.Column:
    """Whole units for a text of so many characters: 0.0001 each for 100 at least, at nine tenths of the rate."""
    return F.ceil(F.greatest(chars, F.lit(100)) * 0.0001 / (rate * 0.9) * 1e8).cast("long")


def drained(stream: DataFrame, mode: str, keys: list[str], folder: str, order: str | None = None) -> DataFrame:
    """All that a stream gives for the input there is, each key's last row (of one batch the one with the largest `order`).
    A batch has a folder of its own, which is replaced if the batch is done again, so no row is written twice."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/__batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    fields = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    rows = spark.read.schema(f"{fields}, __batch long").parquet(f"{path}/out")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch"), *([F.desc(order)] if order else [])))
    return rows.withColumn("__r", last).filter("__r = 1").drop("__r", "__batch")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of files, event time as TIMESTAMP."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))
