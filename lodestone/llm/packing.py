"""Sum-of-squares packing of documents into sequences."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import word_bpe
from lodestone.llm.common import documents, slices, small_batches, whole_text, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs together. More of them leave fewer half-empty sequences; the number of groups grows with the input.
GROUP_PIECES = 16_384


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, placed in the order given.

    open_bins[g] counts the open bins with gap g. A length s moves a bin from gap g to g - s (or opens one, g = capacity);
    of all places the one with the smallest sum of squared counts is taken: first an open bin with the smallest gap, a new
    one only where it is strictly better. Full bins aren't counted, which -0.5 at gap 0 says.
    """
    open_bins = np.zeros(capacity + 1)
    open_bins[0] = -0.5
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        if s == 0:  # takes no room
            where[k] = max(0, used - 1)
            used = max(used, 1)
            continue
        gaps = open_bins[s:capacity]
        change = np.where(gaps > 0, 2 * open_bins[: capacity - s] - 2 * gaps + 2, np.inf)
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * open_bins[capacity - s] + 1:
            gap = s + best
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        where[k], offset[k] = b, capacity - gap
        if gap > s:
            open_bins[gap - s] += 1
            stacks[gap - s].append(b)
    return where, offset


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and its end id in pieces of at most capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for b in slices(batches, keeps=tokenizer_path):
            ids, at = word_bpe.text_ids(b.column("text"), tokenizer_path)
            rows = []
            for doc, i, j in zip(b.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist()):
                own = np.concatenate([ids[i:j], end])
                rows += [(doc, n, a, len(own[a : a + capacity]), zlib.crc32(own[a : a + capacity])) for n, a in enumerate(range(0, len(own), capacity))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]), pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]), preserve_index=False)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text (null: empty, which is its end id alone); other columns are ignored, repeated rows are packed each
    for itself, an empty table gives no rows. Only documents longer than capacity are cut. Lengths, not texts, are dealt
    over groups of about group_pieces by a hash of their place in the written table, so that equal rows part too; each group
    is packed longest first by the smallest sum of squares, ties by id, piece and digest. A group's memory is bounded by
    group_pieces, the number of groups grows with the input.
    """
    with small_batches(docs.sparkSession):
        pieces = written(cut_pieces(docs, tokenizer_path or word_bpe.default_path(), capacity, end_id), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="group").assign(sequence_id=key[0] * (1 << 32) + where, offset=offset)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
