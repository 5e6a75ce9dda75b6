"""Term statistics and ranked retrieval for whole tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

K1, B = 1.2, 0.75


def postings(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """doc_id, term, tf (weighted by the boosts of the fields the term stands in), length (weighted as well).

    One row for each occurrence; bm25 groups them. Where more than one query is asked of the same documents, term_index holds
    them counted."""
    rows = docs.select("doc_id", *(t.content_words(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)))
    length = sum((F.size(f"w{i}") * F.lit(float(b)) for i, b in enumerate(fields.values())), F.lit(0.0))
    each = F.flatten(F.array(*(_boosted(f"w{i}", b) for i, b in enumerate(fields.values()))))
    return rows.select("doc_id", length.alias("length"), F.explode(each).alias("e")).select("doc_id", "length", "e.term", "e.boost")


def _boosted(column: str, boost: float) -> Column:
    return F.transform(F.col(column), lambda w: F.struct(w.alias("term"), F.lit(float(boost)).alias("boost")))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df: in how many documents a content word stands."""
    return docs.select(F.explode(F.array_distinct(t.content_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def generic_terms(docs: DataFrame, candidates: list[str], least_docs: int = 8, share: float = 0.02) -> DataFrame:
    """term, df of those candidates (stems) that stand in at least max(least_docs, share of all) documents."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(t.subject_terms(F.col("text"))).alias("term")).filter(F.col("term").isin(candidates)).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).filter(F.col("df") >= F.greatest(F.lit(least_docs), F.floor(F.col("n") * share))).select("term", "df")


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, term: distinct content words of each question."""
    return questions.select("question_id", F.explode(F.array_distinct(t.content_words(F.col("question")))).alias("term"))


def bm25(terms: DataFrame, docs: DataFrame, fields: dict[str, float], max_df_share: float = 1.0, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """keys, doc_id, score: fielded BM25 of every document for every query that shares a term with it.

    terms: keys, term and, if there, weight (one otherwise). With a max_df_share below one, terms in more of the documents
    count as stop words. Documents' terms are cut down to the queries' vocabulary before anything is grouped, so only rows that can score
    are shuffled; Spark broadcasts that vocabulary only where its size allows.
    """
    weight = F.col("weight") if "weight" in terms.columns else F.lit(1.0)
    asked = terms.withColumn("weight", weight)
    posted = postings(docs, fields).join(asked.select("term").distinct(), "term")
    tf = posted.groupBy("doc_id", "term").agg(F.sum("boost").alias("tf"), F.first("length").alias("length"))
    sizes = docs.select(sum((F.size(t.content_words(F.col(f))) * F.lit(float(b)) for f, b in fields.items()), F.lit(0.0)).alias("length"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.crossJoin(F.broadcast(stats)).filter(F.col("df") <= F.col("n") * max_df_share).select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    part = F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return asked.join(weights, "term").join(tf, "term").groupBy(*keys, "doc_id").agg(F.round(F.sum(part), 9).alias("score"))


def floored(scored: DataFrame, least: float, relative: float, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Rows with at least a fixed score and a share of their query's best. Best after `top`: the same rows, and a query's window
    holds k of them."""
    return scored.withColumn("top", F.max("score").over(Window.partitionBy(*keys))).filter(F.col("score") >= F.greatest(F.lit(least), F.col("top") * relative)).drop("top")


def top(scored: DataFrame, k: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """The k best of each query, with their rank; ties go by the smaller document id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def variants(questions: DataFrame, cap: int = 3) -> DataFrame:
    """question_id, pos, query: the question, its first sentence and its longest words, distinct without case, at most cap."""
    first = F.regexp_extract("question", r"(?s)^(.*?[.!?])(\s|$)", 1)
    longest = F.array_join(F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(t.content_words(F.col("question"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 6), " ")
    rows = questions.select("question_id", F.posexplode(F.array("question", first, longest)).alias("pos", "query")).filter(F.trim("query") != "")
    key = F.lower(F.trim("query"))
    fresh = rows.withColumn("r", F.row_number().over(Window.partitionBy("question_id", key).orderBy("pos"))).filter("r = 1")
    kept = fresh.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy("pos")).cast("long"))
    return kept.filter(F.col("pos") <= cap).select("question_id", "pos", "query")


def best_of_variants(scored: DataFrame, per_query: int) -> DataFrame:
    """Each query's best rows first, then the best score of each document over all phrasings of the question."""
    return top(scored, per_query, ("question_id", "pos")).groupBy("question_id", "doc_id").agg(F.max("score").alias("score"))


def round_robin(ranked: DataFrame) -> DataFrame:
    """Ranked lists (question_id, pos, rank, doc_id) as one: every first before any second; a document where it first comes."""
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("rank", "pos"))).filter("r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "pos")).cast("long")).select("question_id", "place", "doc_id")


def prefix_expansions(terms: DataFrame, vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """term, word: vocabulary words that a query term of at least `least` letters begins. Words are entered under all their
    beginnings, so this is an equi join."""
    longer = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(least), F.length("word") - 1), lambda n: F.substr("word", F.lit(1), n))).alias("term"))
    return terms.select("term").distinct().join(longer.filter(F.length("word") > least), "term")


def deletions(word: Column) -> Column:
    """The word, and all that is left of it without one letter."""
    n = F.length(word)
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n))), word))


def fuzzy_expansions(terms: DataFrame, vocabulary: DataFrame, share: float = 0.1) -> DataFrame:
    """term, word: vocabulary words within one edit of a query term that is long enough for one (rounded share of its length;
    longer terms are allowed one as well). Words that are one edit apart share a deletion."""
    asked = terms.select("term").distinct().filter(F.round(F.length("term") * share) >= 1)
    left = asked.select("term", F.explode(deletions(F.col("term"))).alias("key"))
    right = vocabulary.filter(F.length("word") >= 4).select("word", F.explode(deletions(F.col("word"))).alias("key"))
    return left.join(right, "key").filter((F.col("term") != F.col("word")) & (F.levenshtein("term", "word", 1) == 1)).select("term", "word").distinct()


def spread(items: DataFrame, cap: int) -> DataFrame:
    """category, item, pos: a round-robin over categories, the largest first, in catalogue order inside; at most cap items."""
    sized = items.withColumn("round", F.row_number().over(Window.partitionBy("category").orderBy("pos"))).withColumn("size", F.count("*").over(Window.partitionBy("category")))
    return sized.filter(F.col("round") <= cap).orderBy("round", F.desc("size"), "category").limit(cap).select("category", "item", F.col("round").cast("long").alias("round"))


def diverse_pick(ranked: DataFrame, pinned: list[str], k: int) -> DataFrame:
    """question_id, doc_id, place: pinned categories' rows first, then the best of each category not seen yet, then by rank."""
    in_cat = F.row_number().over(Window.partitionBy("question_id", "category").orderBy("rank"))
    is_pinned = F.col("category").isin(pinned)
    priority = F.when(is_pinned & (F.col("c") == 1), 0).when(~is_pinned & (F.col("c") == 1), 1).otherwise(2)
    placed = ranked.withColumn("c", in_cat).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(priority, "rank")).cast("long"))
    return placed.filter(F.col("place") <= k).select("question_id", "doc_id", "place")


def age_months(date: Column, as_of: Column) -> Column:
    """Whole calendar months between two days, at least 0; 120 for an unknown date."""
    months = (F.year(as_of) - F.year(date)) * 12 + F.month(as_of) - F.month(date) - (F.day(as_of) < F.day(date)).cast("int")
    return F.when(date.isNull(), 120).otherwise(F.greatest(months, F.lit(0))).cast("long")


def freshness(months: Column) -> Column:
    return F.when(months > 18, "dated").when(months <= 6, "current").otherwise("ageing")


def recency_weight(months: Column, half_life: float = 12.0) -> Column:
    return F.when(months <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -months / F.lit(half_life)))


def seeded_sample(items: DataFrame, sessions: DataFrame, n: int, seed: int, last: DataFrame | None = None) -> DataFrame:
    """session, item: n distinct items for each session, or all where there are fewer; not the same set as in last (session,
    item) while the items allow another.

    Items stand in a circle in the order of their hashes; a session takes n of them from a place of its own, and the n after
    them where last holds just those. Sessions meet items by place, so nothing is paired with everything. Null sessions and
    items are left out, repeated ones count once.
    """
    number = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string"))), 1, 12), 16, 10).cast("long")
    hashed = items.select("item").filter("item is not null").distinct().withColumn("h", number(F.col("item"))).withColumn("bucket", F.shiftright("h", 36))
    # at most 4,096 buckets: the window over them is bounded
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("bucket").agg(F.count("*").alias("k")).select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", "item")) - 1
    circle = hashed.join(starts, "bucket").select(place.alias("place"), "item")
    size = hashed.agg(F.count("*").alias("size"))  # one row
    places = sessions.select("session").filter("session is not null").distinct().crossJoin(size).filter("size > 0")
    taken = lambda p: p.select("session", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), "size") - 1)).alias("i"), "size", "from").select("session", F.pmod(F.col("from") + F.col("i"), "size").alias("place")).join(circle, "place").select("session", "item")
    places = places.withColumn("from", F.pmod(number(F.col("session")), "size"))
    if last is not None:
        shown = last.select("session", "item").distinct()
        both = taken(places).withColumn("new", F.lit(1)).join(shown.withColumn("old", F.lit(1)), ["session", "item"], "full")
        same = both.groupBy("session").agg(F.every(F.col("new").isNotNull() & F.col("old").isNotNull()).alias("same"))
        places = places.join(same, "session", "left").withColumn("from", F.col("from") + F.when(F.col("same"), n).otherwise(0))
    return taken(places)


def question_shape(question: Column, rules: list[tuple[str, str]]) -> Column:
    """The shape of the first rule (pattern, shape) that a question meets, else 'general'."""
    out = F.when(F.lit(False), "")
    for pattern, shape in rules:
        out = out.when(question.rlike(pattern), shape)
    return out.otherwise("general")


def vetoed(question: Column, pattern: str, veto: str) -> Column:
    return question.rlike(pattern) & ~question.rlike(veto)


def expanded(questions: DataFrame, phrases: list[tuple[str, str]], heads: list[tuple[str, str]]) -> DataFrame:
    """question_id, query: short queries beside the question: for each phrase rule (pattern, phrase) that it meets without
    holding the phrase, and for the first head rule; else, of three content words or more, the first of four letters."""
    q = F.col("question")
    added = [F.when(q.rlike(p) & ~F.contains(F.lower(q), F.lit(x.lower())), x) for p, x in phrases]
    first = F.coalesce(*(F.when(q.rlike(p), x) for p, x in heads), F.when(F.size(t.content_words(q)) >= 3, F.get(F.filter(t.content_words(q), lambda w: F.length(w) > 3), 0)))
    return questions.select("question_id", F.explode(F.array_distinct(F.array_compact(F.array(*added, first)))).alias("query"))


def reply_skips(questions: DataFrame) -> DataFrame:
    """question_id, courtesy, bare, short: questions that need no rewriting, that are a single word, or up to three words."""
    key = t.normal_question(F.col("question"))
    n = F.size(F.filter(F.split(key, " "), lambda w: w != ""))
    return questions.select("question_id", key.rlike(r"^(thanks|thank you|hello|hi|ok|okay|great|merci|danke|gracias)( .{0,12})?$").alias("courtesy"), (n == 1).alias("bare"), (n <= 3).alias("short"))
