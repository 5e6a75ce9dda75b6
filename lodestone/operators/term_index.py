"""A term index as written tables: postings once, read by term ever after.

    postings  bucket, term, segment, at (places of the documents in their segment), tf0, tf1, .. (by field), masks, counts
              (how many of them hold the term in which fields); a segment's own row, of an empty term in bucket -1, has ids
              and lengths as well
    terms     bucket, term, fields, df: documents by the very fields that hold the term
    stats     n, length (by field): one row

Postings and terms lie in folders by the term's hash, sorted by term inside, so a search reads the buckets of its terms and
skips row groups by the terms' bounds. Documents are read once, when the index is built; a segment is up to SEGMENT of them
that follow each other, and what is shuffled is a row a segment and term. A search brings the rows of a segment together,
adds up its scores and keeps what can be among the best, so no table of all questions and documents is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.retrieval import K1, B, round_robin, top

BUCKETS = 64
#: The bucket of the rows that stand for a document as a whole; their term is empty.
WHOLE = -1
#: Documents of a segment (places are shorts), and queries that are scored together: both bound a task's table of scores.
SEGMENT, QUERIES = 2048, 512


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]
    buckets: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def kept(self, rows: DataFrame, label: str) -> DataFrame:
        """The rows as a table beside the index: computed once, and of a size that Spark knows."""
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _laid_out(rows: DataFrame, path: str) -> None:
    # rebalanced: a bucket with a very frequent term is several tasks' work, small buckets share one
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def _schema(fields: int) -> str:
    tf = ", ".join(f"tf{k} array<int>" for k in range(fields))
    return f"term string, segment long, at array<short>, {tf}, masks array<int>, counts array<long>, ids array<long>, lengths array<long>"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each document has."""
    return column.flatten(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _segment(docs: pa.RecordBatch, number: int, fields: int) -> pa.RecordBatch:
    """The postings of some documents (doc_id, w0, w1, .., lengths), a row a term, and the row of the segment itself."""
    n = docs.num_rows
    found = [_words(docs.column(f"w{k}")) for k in range(fields)]
    coded = pa.chunked_array([w for w, _ in found]).combine_chunks().dictionary_encode()
    place = np.concatenate([np.repeat(np.arange(n), size) for _, size in found])
    field = np.repeat(np.arange(fields), [len(w) for w, _ in found])
    held, where = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + place, return_inverse=True)
    tf = np.stack([np.bincount(where[field == k], minlength=len(held)) for k in range(fields)])
    term, place = np.divmod(held, max(n, 1))
    terms, first = np.unique(term, return_index=True)
    cuts = np.append(first, len(held))
    mask = ((tf > 0) << np.arange(fields)[:, None]).sum(0)
    kinds, counts = np.unique(term << fields | mask, return_counts=True)
    of_term = np.searchsorted(kinds >> fields, np.append(terms, len(coded.dictionary)))
    sizes = np.stack([size for _, size in found])
    own = docs.column("lengths")
    lengths = [sizes[:, i].tolist() if x is None else x for i, x in enumerate(own.to_pylist())]
    # the segment's own row comes first
    after = lambda x, m: np.concatenate([[0], m + x])
    m, e = len(terms), np.zeros(len(terms), np.int64)
    columns = {
        "term": pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(terms)).cast(pa.string())]),
        "segment": pa.array(np.full(m + 1, number)),
        "at": _lists(np.concatenate([np.arange(n), place]), after(cuts, n), pa.int16()),
        **{f"tf{k}": _lists(np.concatenate([sizes[k], tf[k]]), after(cuts, n), pa.int32()) for k in range(fields)},
        "masks": _lists(kinds & ((1 << fields) - 1), after(of_term, 0), pa.int32()),
        "counts": _lists(counts, after(of_term, 0), pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array(np.append([0, n], n + e), pa.int32()), docs.column("doc_id")),
        "lengths": _lists(np.array(lengths, np.int64).ravel(), np.append([0, n * fields], n * fields + e), pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build(docs: DataFrame, fields: tuple[str, ...], path: str, buckets: int = BUCKETS, analyse: Callable[[Column], Column] = t.content_words) -> TermIndex:
    """Writes the index of docs (doc_id, the fields; other columns only where `analyse` uses them) to path.

    analyse: a text's terms; queries must be cut by the same rules (see functions.analysers).

    A null field has no words; a document without any still counts in n. doc_id is unique: rows that repeat an id are one
    document with the sum of its counts. No documents give empty tables. Occurrences are counted where they are read; only
    rows whose id others have are shuffled, and a document is in one task's memory.
    """
    spark, found = docs.sparkSession, TermIndex(docs.sparkSession, path, tuple(fields), buckets)
    names = [f"w{k}" for k in range(len(fields))]
    words = lambda rows: rows.select(F.col("doc_id").cast("long"), *(analyse(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(w) for f, w in zip(fields, names)))
    none = F.lit(None).cast("array<long>").alias("lengths")
    repeated = found.kept(docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    if repeated.isEmpty():
        rows = words(docs).select("doc_id", *names, none)
    else:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
        length = F.array(*(F.size(w).cast("long") for w in names))
        merged = words(docs.join(repeated, same, "left_semi")).groupBy("doc_id").agg(*(F.flatten(F.collect_list(w)).alias(w) for w in names), F.max(length).alias("lengths"))
        rows = words(docs.join(repeated, same, "left_anti")).select("doc_id", *names, none).unionByName(merged.sortWithinPartitions("doc_id"))

    most = SEGMENT

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for start in range(0, b.num_rows, most):
                yield _segment(b.slice(start, most), number, len(names))
                number += 1

    bucket = F.when(F.col("term") == "", WHOLE).otherwise(bucket_of(F.col("term"), buckets))
    _laid_out(rows.mapInArrow(posted, _schema(len(fields))).withColumn("bucket", bucket), f"{path}/postings")
    each = _postings(found).filter(F.col("bucket") != WHOLE).select("bucket", "term", F.explode(F.arrays_zip("masks", "counts")).alias("e"))
    _laid_out(each.groupBy("bucket", "term", F.col("e.masks").alias("fields")).agg(F.sum("e.counts").alias("df")), f"{path}/terms")
    total = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))
    whole = _postings(found).filter(F.col("bucket") == WHOLE)
    whole.agg(F.coalesce(F.sum(F.size("at").cast("long")), F.lit(0)).alias("n"), F.array(*(total(f"tf{k}") for k in range(len(fields)))).alias("length")).write.mode("overwrite").parquet(f"{path}/stats")
    return found


def _chosen(index: TermIndex, boosts: dict[str, float]) -> int:
    unknown = boosts.keys() - set(index.fields)
    if unknown:
        raise ValueError(f"the index has no field {sorted(unknown)}")
    return sum(1 << k for k, f in enumerate(index.fields) if f in boosts)


def term_frequency(index: TermIndex, fields: tuple[str, ...]) -> DataFrame:
    """term, df: the documents that hold a term in one of the fields. From the small table of terms."""
    held = F.col("fields").bitwiseAND(F.lit(_chosen(index, dict.fromkeys(fields, 1.0)))) > 0
    return _terms(index).filter(held).groupBy("term").agg(F.sum("df").alias("df"))


def _terms(index: TermIndex) -> DataFrame:
    return index.spark.read.schema("term string, fields int, df long, bucket int").parquet(f"{index.path}/terms")


def _postings(index: TermIndex) -> DataFrame:
    return index.spark.read.schema(f"{_schema(len(index.fields))}, bucket int").parquet(f"{index.path}/postings")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one segment and group of queries, which follow each other, as one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        of = [b.column(c).to_numpy() for c in ("segment", "group")]
        cuts = [0, *(np.flatnonzero((of[0][1:] != of[0][:-1]) | (of[1][1:] != of[1][:-1])) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if y == x:
                continue
            if held and any(held[0].column(c)[0] != b.column(c)[x] for c in ("segment", "group")):
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.concat_batches(held)


def _scores(rows: pa.RecordBatch, boosts: list[tuple[int, float]], fields: int, most: int | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Query, doc_id and score: all documents of a segment that share a term with a query, or the best of each. The segment's
    own row comes first."""
    first = rows.slice(0, 1)
    ids, lengths = first.column("ids").flatten(), first.column("lengths").flatten().to_numpy().reshape(-1, fields)
    rows = rows.slice(1)
    if not rows.num_rows:
        return np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0)
    at, cuts = rows.column("at").flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(rows.column("at").offsets.to_numpy()))])
    tf = sum(b * rows.column(f"tf{k}").flatten().to_numpy() for k, b in boosts)
    length = sum(b * lengths[:, k] for k, b in boosts)
    held = tf > 0
    cuts, at, tf = np.concatenate([[0], np.cumsum(held)])[cuts], at[held], tf[held]
    norm = K1 * (1 - B + B * length / rows.column("mean")[0].as_py()) if len(at) else length
    value = tf * (K1 + 1) / (tf + norm[at])
    query, weight = rows.column("query").flatten().to_numpy(), rows.column("weight").flatten().to_numpy()
    row = np.repeat(np.arange(rows.num_rows), np.diff(rows.column("query").offsets.to_numpy()))
    total, seen = np.zeros((query.max() + 1, len(ids))), np.zeros((query.max() + 1, len(ids)), bool)
    for q, w, a, b in zip(query.tolist(), weight.tolist(), cuts[row].tolist(), cuts[row + 1].tolist()):
        total[q, at[a:b]] += w * value[a:b]
        seen[q, at[a:b]] = True
    total = np.round(total, 9)
    q, d = np.nonzero(seen)
    if most is not None:
        # by query, score and id, of which a null comes first
        by = np.lexsort((ids.fill_null(np.iinfo(np.int64).min).to_numpy()[d], -total[q, d], q))
        q, d = q[by], d[by]
        own = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        keep = np.arange(len(q)) - np.repeat(own, np.diff(np.append(own, len(q)))) < most
        q, d = q[keep], d[keep]
    return q, ids.take(pa.array(d)), total[q, d]


def search(index: TermIndex, terms: DataFrame, boosts: dict[str, float], max_df_share: float = 1.0, keys: tuple[str, ...] = ("question_id",), most: int | None = None) -> DataFrame:
    """keys, doc_id, score: fielded BM25 of every document for every query that shares a term with it; with `most` only rows
    that can be among so many best of their query (`best` takes those).

    terms: keys, term and, if there, weight (one otherwise). With a max_df_share below one, terms in more of the documents
    count as stop words. The driver asks which buckets the terms lie in (numbers, as many as there are buckets at most) and
    how many queries there are; only those buckets are read. Queries are dealt into groups of about QUERIES; rows of a
    segment meet once a group, with the group's queries of each term.
    """
    chosen = _chosen(index, boosts)
    fields, by_field = len(index.fields), [(k, float(boosts[f])) for k, f in enumerate(index.fields) if f in boosts]
    asked = terms.withColumn("weight", (F.col("weight") if "weight" in terms.columns else F.lit(1.0)).cast("double")).filter(F.col("term") != "")
    asked = index.kept(asked.select(*keys, "term", "weight", bucket_of(F.col("term"), index.buckets).alias("bucket")), "asked")
    about = asked.agg(F.collect_set("bucket").alias("buckets"), F.count_distinct(F.struct(*keys)).alias("n")).first()
    read, groups = F.col("bucket").isin(sorted(about.buckets)), about.n // QUERIES + 1
    queries = asked.select(*keys).distinct().withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))
    queries = queries.withColumn("query", F.row_number().over(Window.partitionBy("group").orderBy(*keys)) - 1)
    queries = index.kept(queries, "queries")
    wanted = asked.select("bucket", "term").distinct()
    held = F.col("fields").bitwiseAND(F.lit(chosen)) > 0
    df = _terms(index).filter(read & held).join(wanted, ["bucket", "term"]).groupBy("term").agg(F.sum("df").alias("df"))
    boosted = sum((F.get("length", F.lit(k)) * F.lit(b) for k, b in by_field), F.lit(0.0))
    stats = index.table("stats").filter("n > 0").select("n", (boosted / F.col("n")).alias("mean"))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).filter(F.col("df") <= F.col("n") * max_df_share).select("term", idf.alias("idf"), "mean")
    known = [asked[k].eqNullSafe(queries[k]) for k in keys]
    each = asked.join(queries, known).select("bucket", "term", "group", "query", "weight").join(weights, "term")
    pairs = F.array_sort(F.collect_list(F.struct("query", (F.col("weight") * F.col("idf")).alias("weight"))))
    asking = each.groupBy("bucket", "term", "group").agg(pairs.alias("pairs"), F.first("mean").alias("mean"))
    asking = index.kept(asking.select("bucket", "term", "group", "mean", F.col("pairs.query").alias("query"), F.col("pairs.weight").alias("weight")), "asking")
    columns = ["segment", "group", "term", "at", *(f"tf{k}" for k, _ in by_field), "ids", "lengths", "mean", "query", "weight"]
    postings = _postings(index)
    found = postings.filter(read).join(asking, ["bucket", "term"]).select(columns)
    whole = postings.filter(F.col("bucket") == WHOLE).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    empty = {"mean": F.lit(None).cast("double"), "query": F.lit(None).cast("array<int>"), "weight": F.lit(None).cast("array<double>")}
    rows = found.unionByName(whole.withColumns(empty).select(columns)).repartition("segment", "group").sortWithinPartitions("segment", "group", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _together(batches):
            q, ids, score = _scores(g, by_field, fields, most)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), g.column("group")[0].as_py()), pa.int32()), pa.array(q, pa.int32()), ids, pa.array(score)], ["group", "query", "doc_id", "score"])

    scored = rows.mapInArrow(run, "group int, query int, doc_id long, score double")
    return scored.join(queries, ["group", "query"]).select(*keys, "doc_id", "score")


def best(index: TermIndex, terms: DataFrame, boosts: dict[str, float], k: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """keys, doc_id, score, rank: the k best documents of each query, as a written table: k rows a query."""
    return index.kept(top(search(index, terms, boosts, keys=keys, most=k), k, keys), "best")


def named_ids(first: DataFrame, texts: DataFrame, covered: DataFrame, pattern: str, most: int = 3) -> DataFrame:
    """question_id, place, query: what the first hop's texts name (by pattern) and nothing covers yet, at most `most` a question.

    first: question_id, rank, doc_id. texts: doc_id, text, read whole. covered: question_id, text: the question itself, the
    titles that the first hop has; a name inside one of them, case aside, is covered. Names come in order of their first
    place (rank, then place in the text)."""
    named = first.join(texts.select("doc_id", "text"), "doc_id").select("question_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "query"))
    names = named.groupBy("question_id", "query").agg(F.min(F.struct("rank", "pos")).alias("at"))
    known = covered.groupBy("question_id").agg(F.lower(F.array_join(F.collect_set(F.coalesce("text", F.lit(""))), "\n")).alias("known"))
    fresh = names.join(known, "question_id", "left").filter(~F.contains(F.coalesce("known", F.lit("")), F.lower("query")))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("at", "query"))
    return fresh.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("question_id", "place", "query")


def second_hop(index: TermIndex, first: DataFrame, names: DataFrame, boosts: dict[str, float], per_query: int = 2, most: int = 4) -> DataFrame:
    """question_id, hop, place, doc_id: the first hop's rows (question_id, rank, doc_id), and behind them what a second round of
    queries finds.

    Each name (question_id, place, query) is a query of its own over the same postings; its best rows are merged in turns,
    without what the first hop has, at most `most` a question. A question without names keeps its first hop."""
    terms = names.select("question_id", F.col("place").alias("pos"), F.explode(F.array_distinct(t.content_words(F.col("query")))).alias("term"))
    ranked = best(index, terms, boosts, per_query, ("question_id", "pos"))
    merged = round_robin(ranked).join(first.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    added = merged.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("place")).cast("long")).filter(F.col("place") <= most)
    rows = lambda x, hop, place: x.select("question_id", F.lit(hop).cast("long").alias("hop"), F.col(place).cast("long").alias("place"), "doc_id")
    return rows(first, 1, "rank").unionByName(rows(added, 2, "place"))
