"""Driver tables as the inputs of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which kind of activity an event type stands for; any other type is 'other'.
KIND_OF_EVENT = {"view": "emails", "click": "posts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, ts (UTC), kind: one row for each event."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(k)) for e, k in KIND_OF_EVENT.items()), F.lit("other"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind (source), lang, title (the first line, at most 120 characters), text."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 120)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"), "lang", title.alias("title"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
