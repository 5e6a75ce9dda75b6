"""Auditing retrieval and answers: flags, counts, severity, depths and rubrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t

THIN = 1500
#: Letters of a distinctive word.
DISTINCTIVE = 5
FLAGS = ("NONE", "THIN", "NO-SPEC-FOR-MECHANISM", "ESSAY-ONLY", "TITLE-MISMATCH")


def flagged(runs: DataFrame) -> DataFrame:
    """runs: question_id, question, category, expects_spec, titles, kinds (arrays, one entry a source), evidence_chars.
    Adds flags, an array of those that apply, in fixed order."""
    n = F.size("titles")
    asked = F.filter(F.array_distinct(t.content_words(F.col("question"))), lambda w: F.length(w) > 2)
    shares = F.exists("titles", lambda x: F.arrays_overlap(t.words(x), asked))
    rules = (n == 0, F.col("evidence_chars") < THIN, F.col("expects_spec") & ~F.exists("kinds", lambda k: k == "spec"), (n > 0) & F.forall("kinds", lambda k: k == "essay"), (n > 0) & (F.size(asked) > 0) & ~shares)
    return runs.withColumn("flags", F.array_compact(F.array(*(F.when(rule, name) for rule, name in zip(rules, FLAGS)))))


def flag_counts(runs: DataFrame) -> DataFrame:
    """Questions, flags and clean runs by category, and overall (category null)."""
    has = lambda f: F.count_if(F.array_contains("flags", f)).alias(f.lower().replace("-", "_"))
    return runs.rollup("category").agg(F.count("*").alias("questions"), *map(has, FLAGS), F.count_if(F.size("flags") == 0).alias("clean"))


def worst(runs: DataFrame, k: int = 10) -> DataFrame:
    """The k runs with the highest severity; ties go by less evidence, then id. A specification that was expected and found
    but doesn't lead (kinds come in the order of the sources), and titles that share no distinctive word with the question,
    count too, flagged or not."""
    on = lambda f: F.array_contains("flags", f)
    points = F.when(on("NONE"), 1000).when(on("THIN"), 400).otherwise(0) + F.when(on("TITLE-MISMATCH"), 350).otherwise(0) + F.when(on("NO-SPEC-FOR-MECHANISM"), 300).otherwise(0) + F.when(on("ESSAY-ONLY"), 250).otherwise(0)
    n, asked = F.size("titles"), F.filter(F.array_distinct(t.content_words(F.col("question"))), lambda w: F.length(w) >= DISTINCTIVE)
    behind = F.col("expects_spec") & (n > 0) & ~F.coalesce(F.get("kinds", F.lit(0)) == "spec", F.lit(False)) & F.exists("kinds", lambda k: k == "spec")
    apart = (n > 0) & ~on("NONE") & ~F.exists("titles", lambda x: F.arrays_overlap(t.words(x), asked))
    points = points + F.when(behind, 80).otherwise(0) + F.when(apart, 60).otherwise(0)
    points = points + F.when(~on("NONE"), F.greatest(F.lit(0), THIN - F.col("evidence_chars")) / 50).otherwise(0.0)
    return runs.select("question_id", F.round(points, 6).alias("severity"), "evidence_chars").orderBy(F.desc("severity"), "evidence_chars", "question_id").limit(k)


def by_depth(runs: DataFrame, depths: list[str]) -> DataFrame:
    """One row for each question, its evidence and number of flags side by side for each depth."""
    return runs.groupBy("question_id").pivot("depth", depths).agg(F.first("evidence_chars").alias("chars"), F.first(F.size("flags").cast("long")).alias("flags"))


def rubric(cases: DataFrame) -> DataFrame:
    """cases: question_id, answer, must_mention, must_not_mention (arrays), min_chars, guard. One row each: passed and the
    number of assertions that failed."""
    low = F.lower("answer")
    missing = F.size(F.filter("must_mention", lambda w: ~F.contains(low, F.lower(w))))
    wrong = F.size(F.filter("must_not_mention", lambda w: F.contains(low, F.lower(w))))
    failed = (missing + wrong + (F.length("answer") < F.col("min_chars")).cast("int")).cast("long")
    return cases.select("question_id", "guard", failed.alias("failed"), (failed == 0).alias("passed"))


def rubric_totals(results: DataFrame) -> DataFrame:
    """Passes of builders and guards, and whether the run as a whole passes: it fails if a guard does."""
    return results.agg(F.count_if(F.col("passed") & ~F.col("guard")).alias("builders_passed"), F.count_if(F.col("passed") & F.col("guard")).alias("guards_passed"), F.count("*").alias("cases"), F.every(F.col("passed") | ~F.col("guard")).alias("ok"))


def linted(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """doc_id, labels: the canonical label of each forbidden pattern that a text holds; only texts with any."""
    labels = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), label) for p, label in terms.items())))
    return docs.select("doc_id", labels.alias("labels")).filter("size(labels) > 0")
