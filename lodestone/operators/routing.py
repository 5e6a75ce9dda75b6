"""Which sources a question goes to, which of its words carry its subject, and what its answer is given beside the main evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t


def subject_lexicon(questions: DataFrame, docs: DataFrame, least_docs: int = 8, share: float = 0.02) -> DataFrame:
    """question_id, term, df, specific: the stems that carry each question's subject.

    Stems that stand in max(least_docs, share of all) documents are generic: they go unless nothing else is left (then
    specific is false). Where a question of several stems holds one that no document has, only stems of fewer than
    least_docs documents stay. Documents' stems are cut down to the asked ones before they are counted. Questions
    without stems give no rows.
    """
    asked = questions.select("question_id", F.explode(t.subject_terms(F.col("question"))).alias("term"))
    held = docs.select(F.explode(t.subject_terms(F.col("text"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    n = docs.agg(F.count("*").alias("n"))  # one row
    known = asked.join(held.groupBy("term").agg(F.count("*").alias("df")), "term", "left").crossJoin(n)
    known = known.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("generic", F.col("df") >= F.greatest(F.lit(least_docs), F.floor(F.col("n") * share)))
    own = Window.partitionBy("question_id")
    first = known.withColumn("specific", F.bool_or(~F.col("generic")).over(own)).filter(~F.col("specific") | ~F.col("generic"))
    unseen = F.bool_or(F.col("df") == 0).over(own) & (F.count("*").over(own) > 1)
    return first.withColumn("unseen", unseen).filter(~F.col("unseen") | (F.col("df") < least_docs)).select("question_id", "term", "df", "specific")


def met(question: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (question.rlike(p) for p in patterns), F.lit(False))


def asks_for_news(question: Column, vetoes: list[str], strong: list[str], named: list[str], activity: list[str], year: str) -> Column:
    """No veto, and a strong cue, or an activity of something named or in a year. Null and blank questions don't."""
    found = met(question, strong) | met(question, activity) & (met(question, named) | question.rlike(year))
    return F.coalesce((F.trim(question) != "") & ~met(question, vetoes) & found, F.lit(False))


def catalogue_kinds(question: Column, nouns: dict[str, str], default: str) -> Column:
    """The kinds whose nouns (kind: pattern) a question holds, in the order given; the default kind where it holds none."""
    found = F.array_compact(F.array(*(F.when(question.rlike(p), k) for k, p in nouns.items())))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def sole_category(question: Column, categories: dict[str, str]) -> Column:
    """The one category (name: pattern) that a question meets; null where it meets none or several."""
    found = F.array_compact(F.array(*(F.when(question.rlike(p), c) for c, p in categories.items())))
    return F.when(F.size(found) == 1, F.get(found, 0))


def located(locators: DataFrame, numbers: DataFrame, names: DataFrame, number_base: str, name_base: str) -> DataFrame:
    """doc_id, url of locators (doc_id, locator): spec://N by the index of numbers (number, path), repo://NAME/PATH by the
    index of names (name, full_name), http addresses as they are; null for anything that no index knows. Indexes hold one
    row a key: of several the smallest counts. Spark broadcasts them where their size allows."""
    loc = F.col("locator")
    rows = locators.withColumn("number", F.regexp_extract(loc, "^spec://([0-9]{1,18})$", 1).try_cast("long"))
    rows = rows.withColumn("name", F.nullif(F.regexp_extract(loc, "^repo://([^/]+)/", 1), F.lit(""))).withColumn("rest", F.regexp_extract(loc, "^repo://[^/]+/(.*)$", 1))
    paths = numbers.groupBy("number").agg(F.min("path").alias("path"))
    homes = names.groupBy("name").agg(F.min("full_name").alias("full_name"))
    url = F.when(loc.rlike("^https?://"), loc).otherwise(F.coalesce(F.concat(F.lit(number_base), "path"), F.concat(F.lit(name_base), "full_name", F.lit("/"), "rest")))
    return rows.join(paths, "number", "left").join(homes, "name", "left").select("doc_id", url.alias("url"))


def appended(main: DataFrame, modes: DataFrame, curated: DataFrame, others: list[DataFrame]) -> DataFrame:
    """question_id, mode, n, section, doc_id: curated evidence first, then the main one, then the others in turn.

    main, curated, others: question_id, pos, doc_id. modes: question_id, mode; a question in mode none that gets a row is
    in mode reference, questions without rows keep theirs and have null n, section and doc_id."""
    parts = [p.select("question_id", F.lit(i).alias("section"), "pos", "doc_id") for i, p in enumerate([curated, main, *others])]
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("section", "pos", "doc_id")).cast("long")
    rows = reduce(DataFrame.unionByName, parts).withColumn("n", n).drop("pos")
    mode = F.when((F.col("mode") == "none") & F.col("n").isNotNull(), "reference").otherwise(F.col("mode"))
    return modes.join(rows, "question_id", "left").select("question_id", mode.alias("mode"), "n", "section", "doc_id")
