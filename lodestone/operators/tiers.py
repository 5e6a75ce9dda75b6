"""Tiers of evidence, gates before citations are shown, freshness of snapshots, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.retrieval import diverse_pick

#: Kinds from the strongest down, others after them; the first two are primary.
KIND_RANK = {"brc": 0, "doc": 1, "symbol": 1}
LINK, DAY = r"^https?://", r"^\d{4}-\d{2}-\d{2}"


def keywords(text: Column) -> Column:
    """Distinct words of more than three letters."""
    return F.array_distinct(F.filter(t.words(text), lambda w: F.length(w) > 3))


def shares_term(keys: Column, *fields: str, without: bool = True) -> Column:
    """Whether any key occurs in the fields, however inflected. Without keys: as told."""
    there = F.lower(F.concat_ws(" ", *fields))
    return F.when(F.size(keys) == 0, F.lit(without)).otherwise(F.exists(keys, lambda k: F.contains(there, k)))


def is_primary(kind: Column) -> Column:
    return kind.isin(*KIND_RANK)


def spec_first(hits: DataFrame) -> DataFrame:
    """question_id, doc_id, place. hits: question_id, doc_id, rank, kind, engages. Specifications first, what doesn't engage the
    question ten places of kind behind, ties by rank."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv)), F.col("kind")), F.lit(2))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(rank + F.when(F.col("engages"), 0).otherwise(10), "rank", "doc_id"))
    return hits.select("question_id", "doc_id", place.cast("long").alias("place"))


def primary_documents(hits: DataFrame, k: int = 8) -> DataFrame:
    """question_id, doc_id, url, place: the k best dated primary documents that engage the question, oldest first. Where none
    engages, those that don't."""
    dated = hits.filter(is_primary(F.col("kind")) & F.col("date").rlike(DAY))
    w = Window.partitionBy("question_id")
    fit = dated.withColumn("any", F.max("engages").over(w)).filter(F.col("engages") | ~F.col("any"))
    best = fit.withColumn("r", F.row_number().over(w.orderBy("rank", "doc_id"))).filter(F.col("r") <= k)
    return best.select("question_id", "doc_id", "url", F.row_number().over(w.orderBy("date", "rank", "doc_id")).cast("long").alias("place"))


def numbered_once(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """question_id, n, doc_id: rows in the order of section and pos, each url where it first comes."""
    order = Window.partitionBy("question_id").orderBy("section", "pos", "doc_id")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "url").orderBy("section", "pos", "doc_id"))).filter("r = 1")
    out = first.select("question_id", F.row_number().over(order).cast("long").alias("n"), "doc_id")
    return out if cap is None else out.filter(F.col("n") <= cap)


def with_primaries(cited: DataFrame, primaries: DataFrame, most: int = 3) -> DataFrame:
    """Citations (question_id, doc_id, rank, kind, url) with up to `most` primaries before them, where none is cited yet."""
    have = cited.filter(is_primary(F.col("kind"))).select("question_id").distinct()
    added = primaries.filter(F.col("place") <= most).join(have, "question_id", "left_anti").select("question_id", "doc_id", "url", F.lit(0).alias("section"), F.col("place").alias("pos"))
    return numbered_once(added.unionByName(cited.select("question_id", "doc_id", "url", F.lit(1).alias("section"), F.col("rank").cast("long").alias("pos"))))


def identity_set(hits: DataFrame, primaries: DataFrame, pinned: list[str], picks: int = 7, cap: int = 5) -> DataFrame:
    """A dossier of diverse picks and the oldest primary document, each url once, at most cap."""
    picked = diverse_pick(hits.withColumn("category", F.col("kind")), pinned, picks).join(hits.select("question_id", "doc_id", "url"), ["question_id", "doc_id"])
    rows = picked.select("question_id", "doc_id", "url", F.lit(0).alias("section"), F.col("place").alias("pos"))
    return numbered_once(rows.unionByName(primaries.filter("place = 1").select("question_id", "doc_id", "url", F.lit(1).alias("section"), F.col("place").alias("pos"))), cap)


def public_claims(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """The claims (question_id, doc_id) whose source engages the question and can be linked."""
    kept = hits.filter(F.col("engages") & F.col("url").rlike(LINK)).select("question_id", "doc_id")
    return claims.join(kept, ["question_id", "doc_id"], "left_semi")


def grounded(hits: DataFrame) -> DataFrame:
    """question_id, grounded: a title of a linkable source shares the subject; without such sources, an excerpt does. hits: as
    above and in_title, in_excerpt."""
    link = F.col("url").rlike(LINK)
    any_link, title = F.max(link), F.max(F.when(link, F.col("in_title")))
    return hits.groupBy("question_id").agg(F.when(any_link, title).otherwise(F.max("in_excerpt")).alias("grounded"))


def linkable_dated(hits: DataFrame) -> DataFrame:
    """question_id, linkable, dated: how many sources can be linked, and how many have a day."""
    return hits.groupBy("question_id").agg(F.count_if(F.col("url").rlike(LINK)).alias("linkable"), F.count_if(F.col("date").rlike(DAY)).alias("dated"))


def clean_cut(text: Column, limit: int, more: str = "") -> Column:
    """The text's beginning, cut at a line end, else after a sentence (. ! or ? and a space), else at a space; only where that
    lies in the last half. more: what is put at the end of a text that wasn't cut after a sentence."""
    head = F.substring(text, 1, limit)

    def last(mark: str) -> Column:
        back = F.instr(F.reverse(head), mark[::-1])
        return F.when(back > 0, limit - back - len(mark) + 2)  # where the mark begins

    line, sentence, space = last("\n"), F.greatest(last(". "), last("! "), last("? ")), last(" ")
    at = F.coalesce(F.when(line > limit / 2, line - 1), F.when(sentence > limit / 2, sentence), F.when(space > limit / 2, space - 1), F.lit(limit))
    cut = F.substr(text, F.lit(1), at)
    if more:
        after = ~F.coalesce(line > limit / 2, F.lit(False)) & F.coalesce(sentence > limit / 2, F.lit(False))
        cut = F.when(after, cut).otherwise(F.concat(F.rtrim(cut), F.lit(more)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def reports(cited: DataFrame, titles: DataFrame) -> DataFrame:
    """question_id, report: a line for each citation (question_id, n, doc_id) with its title and month. titles: doc_id, title, date."""
    month = F.coalesce(F.date_format(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), "MMMM yyyy"), F.lit("undated"))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.trim("title"), F.lit(" ("), month, F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return cited.join(titles, "doc_id").groupBy("question_id").agg(F.array_join(lines, "\n").alias("report"))


def spec_summary(runs: DataFrame) -> DataFrame:
    """expected, met, missed, unasked. runs: expects_spec, has_spec."""
    e, h = F.col("expects_spec"), F.col("has_spec")
    return runs.agg(F.count_if(e).alias("expected"), F.count_if(e & h).alias("met"), F.count_if(e & ~h).alias("missed"), F.count_if(~e & h).alias("unasked"))


def file_times(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """snapshot, file_time: when the newest of a snapshot's files was written, from the files' own metadata; a snapshot that isn't
    there, or has no rows, has none. What freshness() falls back to where a pin has no readable stamp."""

    def one(snapshot: str, path: str) -> DataFrame:
        try:
            rows = spark.read.parquet(path).select(F.col("_metadata.file_modification_time").alias("t"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows = spark.createDataFrame([], "t timestamp")
        return rows.agg(F.max("t").alias("file_time")).select(F.lit(snapshot).alias("snapshot"), "file_time")

    return reduce(DataFrame.unionByName, (one(*x) for x in paths.items()))


def freshness(manifests: DataFrame) -> DataFrame:
    """snapshot, updated_at: the newest of its pins' stamps, or of its files' times where a stamp can't be read."""
    stamp = F.coalesce(F.try_to_timestamp("fetched_at"), F.col("file_time").cast("timestamp"))
    return manifests.groupBy("snapshot").agg(F.max(stamp).alias("updated_at"))


def stale_snapshots(fresh: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """snapshot, updated_on, stale."""
    return fresh.select("snapshot", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"), (F.to_timestamp(F.lit(as_of)) > F.col("updated_at") + F.make_dt_interval(F.lit(days))).alias("stale"))


def category_counts(listings: DataFrame) -> DataFrame:
    """categories (empty ones don't count) and listings."""
    return listings.agg(F.count_distinct(F.when(F.col("category") != "", F.col("category"))).alias("categories"), F.count("*").alias("listings"))


def read_each(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """subject and the rows of its file; a file that isn't there has no rows. In no order: see in_order()."""

    def one(subject: str, path: str) -> DataFrame:
        try:
            rows = spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        return rows.select(F.lit(subject).alias("subject"), "*")

    return reduce(DataFrame.unionByName, (one(*x) for x in paths.items()))


def in_order(rows: DataFrame, date: str = "ts") -> DataFrame:
    """The rows of all sources, oldest first, those without a date last; ties by subject."""
    return rows.orderBy(F.col(date).asc_nulls_last(), "subject")


def activity_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """subject, n, first_day: every subject, also one without rows."""
    rows = read_each(spark, paths, "ts timestamp_ntz").groupBy("subject").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))
    subjects = spark.createDataFrame([(s,) for s in paths], "subject string")
    return subjects.join(rows, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first_day")


def cacheable(answer: Column, citations: Column, failed: Column, least: int = 200) -> Column:
    """Whether an answer may be kept: whole, long enough, and with a source."""
    return ~failed & (F.length(F.trim(answer)) >= least) & (citations > 0)
