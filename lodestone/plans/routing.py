"""Queries of question routing: benchmark items are the questions, documents the corpus, parts and suppliers the indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import directory
from lodestone.operators import routing as ops
from lodestone.plans.retrieval import content_sql, stem_sql
from lodestone.plans.tiers import HITS, _hits
from lodestone.sources.tables import corpus, questions, table


def whole(word: str) -> str:
    """A pattern for a word that no letter of any language touches."""
    return rf"(?i)(?:^|[^\p{{L}}]){word}(?:[^\p{{L}}]|$)"


VETOES, STRONG, NAMED, ACTIVITY = [whole("who")], [whole("news"), whole("said")], [whole("the")], [whole("of"), whole("with")]
YEAR = "(?:^|[^0-9])20[0-9]{2}(?:[^0-9]|$)"
NOUNS = {"app": whole("for"), "block": whole("in"), "organisation": whole("from")}
CATEGORIES = {"time": whole("(?:when|after)"), "place": whole("(?:at|on)"), "person": whole("(?:he|she)")}
NUMBER_BASE, NAME_BASE = "https://specs.example/", "https://code.example/"


def subject_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return ops.subject_lexicon(questions(spark, d), corpus(spark, d))


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    news = ops.asks_for_news(q, VETOES, STRONG, NAMED, ACTIVITY, YEAR)
    return questions(spark, d).select("question_id", news.alias("news"), F.array_join(ops.catalogue_kinds(q, NOUNS, "app"), ",").alias("kinds"), ops.sole_category(q, CATEGORIES).alias("category"))


def locator_urls(spark: SparkSession, d: str) -> DataFrame:
    """Documents' locators by id: parts' numbers, suppliers' names, addresses, and such as no index knows."""
    i = F.col("doc_id")
    spec, repo = F.concat(F.lit("spec://"), (i % 5000).cast("string")), F.concat(F.lit("repo://Supplier#"), F.lpad((i % 50).cast("string"), 9, "0"), F.lit("/src/"), i.cast("string"))
    loc = F.when(i % 4 == 0, spec).when(i % 4 == 1, repo).when(i % 4 == 2, F.concat(F.lit("https://archive.example/"), i.cast("string"))).otherwise("local")
    numbers = table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("path"))
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string")).alias("full_name"))
    return ops.located(table(spark, d, "documents").select("doc_id", loc.alias("locator")), numbers, names, NUMBER_BASE, NAME_BASE)


def evidence_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two questions of three have main evidence; even ones get specifications first, each fifth one essays as news behind it."""
    hits = _hits(spark, d).select("question_id", F.col("rank").alias("pos"), "doc_id", "kind")
    q = F.col("question_id")
    main = hits.filter((q % 3 > 0) & F.col("pos").between(3, 6))
    modes = hits.select("question_id").distinct().withColumn("mode", F.when(q % 3 > 0, "answer").otherwise("none"))
    return ops.appended(main, modes, hits.filter((q % 2 == 0) & (F.col("kind") == "brc")), [hits.filter((q % 5 == 0) & (F.col("kind") == "essay"))])


def directory_plans(spark: SparkSession, d: str) -> DataFrame:
    """Parts are listings of three kinds, their brands the categories; a nation asks for a part's first word, for a brand, for
    both or neither. A listing's score is how many of the topics its name holds."""
    part = table(spark, d, "part")
    kind = F.element_at(F.array(F.lit("app"), F.lit("app"), F.lit("block"), F.lit("org")), (F.col("p_partkey") % 4 + 1).cast("int"))
    listings = part.select(F.col("p_partkey").alias("item"), kind.alias("kind"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("pos"))
    n = F.col("n_nationkey")
    named = table(spark, d, "nation").join(part.select(F.col("p_partkey").alias("n_nationkey"), "p_name", "p_brand"), "n_nationkey", "left")
    topics = F.when(n % 3 > 0, F.slice(F.split("p_name", " "), 1, 1)).otherwise(F.array().cast("array<string>"))
    category = F.when(n % 5 == 4, "No such brand").when(n % 2 == 0, F.col("p_brand"))
    questions = named.select(n.alias("question_id"), topics.alias("topics"), F.when(n % 4 == 0, F.array(F.lit("app"), F.lit("block"))).otherwise(F.array(F.lit("app"))).alias("kinds"), category.alias("category"))
    words = part.select(F.col("p_partkey").alias("item"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("topic"))
    scored = questions.select("question_id", F.explode("topics").alias("topic")).join(words, "topic").groupBy("question_id", "item").agg(F.count("*").cast("double").alias("score"))
    return directory.planned(questions, listings, scored)


QUERIES = {f.__name__: f for f in (directory_plans, subject_lexicon, question_routes, locator_urls, evidence_appended)}

any_sql = lambda patterns: " OR ".join(f"regexp_matches(text, '{p}')" for p in patterns)
list_sql = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in rules.items()) + "], lambda x: x IS NOT NULL)"
STEMS = f"unnest(list_distinct(list_filter(list_transform({content_sql('text')}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3))) AS term"
ORACLE_SQL = {
    "directory_plans": """WITH l AS (SELECT p_partkey AS item, ['app', 'app', 'block', 'org'][(p_partkey % 4 + 1)::INT] AS kind, p_brand AS category, string_split(p_name, ' ') AS w FROM part),
q AS (SELECT n_nationkey AS question_id, CASE WHEN n_nationkey % 3 > 0 THEN string_split(p_name, ' ')[1] END AS topic, CASE WHEN n_nationkey % 4 = 0 THEN ['app', 'block'] ELSE ['app'] END AS kinds,
  CASE WHEN n_nationkey % 5 = 4 THEN 'No such brand' WHEN n_nationkey % 2 = 0 THEN p_brand END AS category, CASE WHEN n_nationkey % 3 > 0 AND p_name IS NOT NULL THEN 'search' WHEN n_nationkey % 5 = 4 OR n_nationkey % 2 = 0 AND p_brand IS NOT NULL THEN 'browse' ELSE 'spread' END AS mode FROM nation LEFT JOIN part ON p_partkey = n_nationkey),
b AS (SELECT question_id, mode, row_number() OVER (PARTITION BY question_id ORDER BY item) AS place, item FROM q JOIN l USING (category) WHERE mode = 'browse' AND list_contains(kinds, kind) QUALIFY place <= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, category ORDER BY item) AS round, count(*) OVER (PARTITION BY kind, category) AS size FROM l), s AS (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY round, size DESC, category) AS place FROM r QUALIFY place <= 6),
f AS (SELECT question_id, item, q.category IS NULL OR kind <> 'app' OR l.category = q.category AS inside FROM q JOIN l ON list_contains(w, topic) WHERE mode = 'search' AND list_contains(kinds, kind)),
a AS (SELECT *, bool_or(inside) OVER (PARTITION BY question_id) AS any_ FROM f)
SELECT question_id, mode, place, item FROM b UNION ALL SELECT question_id, 'spread', place, item FROM q JOIN s ON s.kind = kinds[1] WHERE mode = 'spread' OR mode = 'browse' AND question_id NOT IN (SELECT question_id FROM b)
UNION ALL SELECT question_id, CASE WHEN any_ THEN 'search' ELSE 'search_any' END, row_number() OVER (PARTITION BY question_id ORDER BY item) AS place, item FROM a WHERE inside OR NOT any_ QUALIFY place <= 6""",
    "subject_lexicon": f"""WITH a AS (SELECT item_id AS question_id, {STEMS} FROM benchmark), s AS (SELECT doc_id, {STEMS} FROM documents), f AS (SELECT term, count(*) AS df FROM s GROUP BY ALL),
g AS (SELECT question_id, term, coalesce(df, 0) AS df, coalesce(df, 0) >= greatest(8, floor((SELECT count(*) FROM documents) * 0.02)) AS generic FROM a LEFT JOIN f USING (term)),
o AS (SELECT *, bool_or(NOT generic) OVER (PARTITION BY question_id) AS specific FROM g),
k AS (SELECT *, bool_or(df = 0) OVER (PARTITION BY question_id) AND count(*) OVER (PARTITION BY question_id) > 1 AS unseen FROM o WHERE NOT specific OR NOT generic)
SELECT question_id, term, df, specific FROM k WHERE NOT unseen OR df < 8""",
    "question_routes": f"""WITH q AS (SELECT *, {list_sql(NOUNS)} AS k, {list_sql(CATEGORIES)} AS c FROM benchmark)
SELECT item_id AS question_id, coalesce(trim(text) <> '' AND NOT ({any_sql(VETOES)}) AND ({any_sql(STRONG)} OR ({any_sql(ACTIVITY)}) AND ({any_sql(NAMED + [YEAR])})), false) AS news,
  CASE WHEN len(k) = 0 THEN 'app' ELSE array_to_string(k, ',') END AS kinds, CASE WHEN len(c) = 1 THEN c[1] END AS category FROM q""",
    "locator_urls": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{NUMBER_BASE}' || replace(p_brand, '#', '-') WHEN 1 THEN '{NAME_BASE}n' || s_nationkey || '/s' || s_suppkey || '/src/' || doc_id WHEN 2 THEN 'https://archive.example/' || doc_id END AS url
FROM documents LEFT JOIN part ON p_partkey = doc_id % 5000 LEFT JOIN supplier ON s_name = 'Supplier#' || lpad((doc_id % 50)::VARCHAR, 9, '0')""",
    "evidence_appended": f"""WITH {HITS}, u AS (SELECT question_id, 0 AS section, rank, doc_id FROM h WHERE question_id % 2 = 0 AND kind = 'brc' UNION ALL SELECT question_id, 1, rank, doc_id FROM h WHERE question_id % 3 > 0 AND rank BETWEEN 3 AND 6
  UNION ALL SELECT question_id, 2, rank, doc_id FROM h WHERE question_id % 5 = 0 AND kind = 'essay'),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY section, rank, doc_id) AS n FROM u)
SELECT question_id, CASE WHEN question_id % 3 > 0 THEN 'answer' WHEN n IS NULL THEN 'none' ELSE 'reference' END AS mode, n, section, doc_id FROM (SELECT DISTINCT question_id FROM h) LEFT JOIN n USING (question_id)""",
}
