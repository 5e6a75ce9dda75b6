"""What the operators of this subpackage share: work tables, texts as Arrow words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage defines it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return (F.crc32(F.col(name).cast("string")) % n).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names it, else, in local mode only, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            own = spark.sparkContext.getCheckpointDir()
        found = own
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a written table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of written(). Only once all that was made of them is a written table itself: a lost executor's work is
    then never done again from them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the table that told_apart broadcasts: of fixed size, one MB. More rows only mean that more of the others are joined with them.
APART_BITS = 23


def told_apart(rows: DataFrame, key: Column, marked: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key may stand in marked (there it is own), and those whose key surely doesn't.

    A bit for each hash tells, so only the first part has to meet marked in a join, with whatever its rows carry."""
    taken = {c.lower() for c in rows.columns}
    at, bucket, bits = (next(n for n in (f"{x}{k}" for k in range(len(taken) + 1)) if n not in taken) for x in ("at", "bucket", "bits"))
    place, inside = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << APART_BITS)), F.col(at).bitwiseAND(F.lit(32767))
    table = marked.select(place(own).alias(at)).groupBy(F.shiftright(at, 15).alias(bucket)).agg(F.bitmap_construct_agg(inside).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(inside, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    told = rows.withColumn(at, place(key)).withColumn(bucket, F.shiftright(at, 15)).join(F.broadcast(written(table, "bits")), bucket, "left")
    return told.filter(there).select(rows.columns), told.filter(~there).select(rows.columns)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, an action's shuffle files go when it has ended. For actions that run once and whose result is kept elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of an Arrow batch within small_batches: texts and sets of a batch are in memory several times.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a Python worker keeps between tasks, by name.
kept: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go(keeps: str | None = None) -> None:
    """Gives memory back that the worker has free, with all that it kept under other names: workers live on between tasks,
    and what one operator no longer needs would be missing to the next."""
    for name in [k for k in kept if k != keeps]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Each batch in parts of about max_bytes of text (one row at least), so that a task's memory doesn't follow the batch size.
    keeps: the name of what the task has in kept."""
    let_go(keeps)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    let_go(keeps)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    values, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return values.filter(full), before[at]


def listed(values: pa.Array) -> list[str]:
    """As to_pylist, without a scalar a value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def raw_bytes(values: pa.Array) -> np.ndarray:
    """The bytes of all values (none null), one after another."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each value, and the distinct values."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values for each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
