"""Which listings of a directory a question gets: a category's own, some of every category, or what its topics find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The kind whose listings have categories; a question's category binds no other kind.
CATEGORISED = "app"


def spread_by_kind(listings: DataFrame, cap: int) -> DataFrame:
    """kind, item, place: for each kind a round-robin over its categories, the largest first, in catalogue order inside."""
    own = Window.partitionBy("kind", "category")
    rows = listings.withColumn("round", F.row_number().over(own.orderBy("pos", "item"))).withColumn("size", F.count("*").over(own)).filter(F.col("round") <= cap)
    # each category has given cap rows at most
    place = F.row_number().over(Window.partitionBy("kind").orderBy("round", F.desc("size"), "category"))
    return rows.withColumn("place", place).filter(F.col("place") <= cap).select("kind", "item", "place")


def planned(questions: DataFrame, listings: DataFrame, scored: DataFrame, cap: int = 6, least: float = 0.0, share: float = 0.35) -> DataFrame:
    """question_id, mode, place, item: each question's one plan, and at most `cap` listings by it.

    questions: question_id, topics (array), kinds (array, not empty), category (null: none). listings: item, kind, category, pos.
    scored: question_id, item, score of what the topics find. Without topics a question with a category browses it (in
    catalogue order), one without gets a spread of its first kind; so does one whose category has nothing of its kinds.
    With topics it searches: scores of at least `least` and a share of the best found, of its kinds and in its category;
    where that leaves nothing the category is dropped (mode search_any). A search that finds nothing gives no rows, ties go
    to the smaller item. Spreads and categories are cut to cap rows before questions meet them.
    """
    none = F.size(F.coalesce("topics", F.array().cast("array<string>"))) == 0
    asked = questions.withColumn("mode", F.when(~none, "search").when(F.col("category").isNotNull(), "browse").otherwise("spread"))
    by_question = Window.partitionBy("question_id")

    own = listings.withColumn("r", F.row_number().over(Window.partitionBy("kind", "category").orderBy("pos", "item"))).filter(F.col("r") <= cap)
    browsed = asked.filter("mode = 'browse'").join(own, "category").filter(F.array_contains("kinds", F.col("kind")))
    browsed = browsed.withColumn("place", F.row_number().over(by_question.orderBy("pos", "item"))).filter(F.col("place") <= cap).select("question_id", "mode", "place", "item")

    left = asked.filter("mode = 'browse'").join(browsed.select("question_id"), "question_id", "left_anti").unionByName(asked.filter("mode = 'spread'"))
    spread = left.select("question_id", F.get("kinds", F.lit(0)).alias("kind")).join(spread_by_kind(listings, cap), "kind").select("question_id", F.lit("spread").alias("mode"), "place", "item")

    found = scored.join(asked.filter("mode = 'search'").select("question_id", "kinds", F.col("category").alias("wanted")), "question_id").withColumn("best", F.max("score").over(by_question))
    found = found.filter(F.col("score") >= F.greatest(F.lit(least), F.col("best") * share)).join(listings.select("item", "kind", "category"), "item").filter(F.array_contains("kinds", F.col("kind")))
    inside = F.col("wanted").isNull() | (F.col("kind") != CATEGORISED) | F.coalesce(F.col("category") == F.col("wanted"), F.lit(False))
    found = found.withColumn("inside", inside).withColumn("any", F.bool_or("inside").over(by_question)).filter(F.col("inside") | ~F.col("any"))
    place = F.row_number().over(by_question.orderBy(F.desc("score"), "item"))
    searched = found.withColumn("place", place).filter(F.col("place") <= cap).select("question_id", F.when(F.col("any"), "search").otherwise("search_any").alias("mode"), "place", "item")

    both = browsed.unionByName(spread).unionByName(searched)
    return both.withColumn("place", F.col("place").cast("long"))
