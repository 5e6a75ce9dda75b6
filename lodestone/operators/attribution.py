"""Which cited sources an answer used, and what it offers next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

#: Source classes from the strongest down. Fixed values of this library.
CLASS_WEIGHT = ("primary", "spec", "record", "news", "commentary", "other")


def usage_tokens(text: Column) -> Column:
    """Words of four letters or more without function words, repeats included."""
    return F.filter(t.words(text), lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(set(t.STOP_WORDS))))


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def usage(citations: DataFrame, answers: DataFrame, floor: int = 3) -> DataFrame:
    """answer_id, n, usage, kept. citations: answer_id, n, source (title and excerpt). answers: answer_id, answer.

    A point for each distinct shared word, two for each bigram of the source that the answer holds (repeats count). Sources
    under the floor go, unless none reaches it or the answer cites only one.
    """
    a = answers.withColumn("at", usage_tokens(F.col("answer"))).withColumn("ab", F.array_distinct(bigrams(F.col("at")))).select("answer_id", "answer", "at", "ab")
    c = citations.withColumn("ct", usage_tokens(F.col("source"))).withColumn("cb", bigrams(F.col("ct"))).select("answer_id", "n", "ct", "cb")
    # a hash set for the answer's bigrams: overlap by explode would shuffle every bigram
    scored = c.join(a, "answer_id").withColumn("usage", F.size(F.array_intersect("ct", "at")) + 2 * F.size(F.filter("cb", lambda b: F.array_contains("ab", b))))
    w = Window.partitionBy("answer_id")
    reached = F.max(F.col("usage") >= floor).over(w)
    return scored.select("answer_id", "n", F.col("usage").cast("long").alias("usage"), ((F.col("usage") >= floor) | ~reached | (F.count("*").over(w) < 2) | (F.trim("answer") == "")).alias("kept"))


def provenance(answers: DataFrame) -> DataFrame:
    """answer_id, provenance. answers: answer_id, general (boolean), classes (array), mode. A general answer is 'general';
    one class is that class, several are 'mixed', none falls back to the mode it was retrieved by."""
    known = F.filter(F.array_distinct("classes"), lambda c: c.isNotNull())
    return answers.select("answer_id", F.when(F.col("general"), "general").when(F.size(known) == 1, known[0]).when(F.size(known) > 1, "mixed").otherwise(F.col("mode")).alias("provenance"))


def source_label(urls: DataFrame, labels: dict[str, str]) -> DataFrame:
    """page_id, label: the label of the longest host suffix that has one, else the second-level domain."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#]*)", 1)), r"^www\.", "")
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    found = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())
    return urls.select("page_id", F.coalesce(F.get(found, 0), F.try_element_at(parts, F.lit(-2)), host).alias("label"))


def follow_ups(citations: DataFrame, k: int = 3, longest: int = 90) -> DataFrame:
    """answer_id, place, suggestion: at most k questions of other citations' titles, one a subject, not too long, and none
    that repeats the question itself. citations: answer_id, n, title, question."""
    text = F.concat(F.lit("What about "), F.trim("title"), F.lit("?"))
    rows = citations.withColumn("suggestion", text).withColumn("subject", F.get(t.subject_terms(F.col("title")), 0)).filter((F.length("suggestion") <= longest) & F.col("subject").isNotNull())
    rows = rows.filter(t.normal_question(F.col("title")) != t.normal_question(F.col("question")))
    fresh = rows.withColumn("r", F.row_number().over(Window.partitionBy("answer_id", "subject").orderBy("n"))).filter("r = 1")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("n")).cast("long")).filter(F.col("place") <= k).select("answer_id", "place", "suggestion")
