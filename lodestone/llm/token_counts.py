"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import word_bpe
from lodestone.llm.common import documents, new_path, slices, whole_text

CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def normalised(text: F.Column) -> F.Column:
    """White space runs as one space: the tokenizer drops white space, so equal normalised contents have equal counts."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; a cache that doesn't exist yet is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def missing(docs: DataFrame, keyed: DataFrame, known: DataFrame) -> DataFrame:
    """digest, text: one row of each content of docs (keyed: doc_id, digest) that isn't known. Texts are shuffled once."""
    lacking = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    # the id as a key that is never null: the join's keys are plain columns, so the rows lie by them when one a content is taken
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    left = docs.select(named, normalised(whole_text()).alias("text")).withColumn("digest", F.sha2("text", 256))
    # repeated rows of an id and text lie together after that join: one of them is encoded, and the cache holds one row a digest
    return left.join(lacking.select(named, "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("digest", "text")


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns are ignored).

    Contents are known by the digest of the normalised text, tokenizers by the digest of their file. The two are joined to
    the cache at cache_path; of the contents it lacks one row each is encoded and appended. Digests are shuffled, and
    texts once where the missing digests are too many to be broadcast. One job at a time may append to a cache. A null text counts as empty, a null or repeated doc_id keeps its rows, an empty table gives none.
    """
    spark, path = docs.sparkSession, tokenizer_path or word_bpe.default_path()
    version = word_bpe.version(path)
    text = whole_text()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(normalised(text), 256).alias("digest"))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    misses = missing(docs, keyed, known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, keeps=path):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(word_bpe.text_counts(b.column("text"), path))], ["digest", "n_tokens"])

    counted = misses.mapInArrow(encode, "digest string, n_tokens long").withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").option("compression", "zstd").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), new_path(spark, "token-cache"))
