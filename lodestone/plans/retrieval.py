"""Queries of the retrieval job: benchmark items are the questions, documents the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import analysers
from lodestone.functions import text as t
from lodestone.operators import retrieval as ops
from lodestone.operators import term_index
from lodestone.plans.live import shared_folder
from lodestone.sources.tables import corpus, questions, table

TEXT = {"text": 1.0}
FIELDS = {"title": 2.0, "text": 1.0}
GENERICS = ["the", "tion", "ment", "ing", "and", "ou", "ble", "there", "ough", "with"]
SHAPES = [(r"(?i)\bhow\b", "mechanism"), (r"(?i)\bwas\b.*\bby\b", "history"), (r"[!?]", "quote"), (r"(?i)\bthe\b.*\bof\b", "concept")]
AS_OF = "1998-08-02"


#: Names of a second hop: capitalised words of seven letters or more.
NAME = "[A-Z][a-z]{6,}"
_built: dict[tuple, term_index.TermIndex] = {}


def index(spark: SparkSession, d: str) -> term_index.TermIndex:
    """The term index of the documents, built by the first query of a session that asks for it and kept in the shared folder;
    built anew where the documents' files or the folder have changed since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path)
    key = (spark.sparkContext.applicationId, d, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime())
    known = _built.get(key)
    if known is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{known.path}/stats/_SUCCESS")
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return term_index.TermIndex(spark, known.path, known.fields, known.buckets)
    _built[key] = found = term_index.build(corpus(spark, d), ("title", "text"), f"{shared_folder(spark)}/term-index-{uuid.uuid4().hex}")
    return found


def top_passages(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents for each question, with at least a quarter of the best one's score."""
    best = term_index.best(index(spark, d), ops.query_terms(questions(spark, d)), TEXT, 3)
    return ops.floored(best, 0.0, 0.25).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def fielded_passages(spark: SparkSession, d: str) -> DataFrame:
    best = term_index.best(index(spark, d), ops.query_terms(questions(spark, d)), FIELDS, 4)
    return ops.floored(best, 2.0, 0.3).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return term_index.term_frequency(index(spark, d), ("text",))


def second_hop_passages(spark: SparkSession, d: str) -> DataFrame:
    """The four best documents for each question, and what the names in their whole texts lead to."""
    asked, docs, own = questions(spark, d), corpus(spark, d), index(spark, d)
    first = term_index.best(own, ops.query_terms(asked), TEXT, 4)
    covered = asked.select("question_id", F.col("question").alias("text")).unionByName(first.join(docs, "doc_id").select("question_id", F.col("title").alias("text")))
    return term_index.second_hop(own, first, term_index.named_ids(first, docs, covered, NAME), TEXT)


def _collections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a language as their collection."""
    name = F.when(F.col("lang") == "de", "news").when(F.col("lang") == "fr", "catalogue").otherwise("archive")
    return corpus(spark, d).withColumn("collection", name)


def collection_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Each collection's document frequencies, by its own token rules."""
    terms = analysers.by_collection(F.col("collection"))(F.col("text"))
    rows = _collections(spark, d).select("collection", F.explode(F.array_distinct(terms)).alias("term"))
    return rows.groupBy("collection", "term").agg(F.count("*").alias("df"))


def news_passages(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of one collection for each question, both cut by that collection's rules."""
    news = analysers.COLLECTIONS["news"]
    own = term_index.build(_collections(spark, d).filter("collection = 'news'"), ("text",), f"{shared_folder(spark)}/news-index-{uuid.uuid4().hex}", analyse=news.terms)
    terms = questions(spark, d).select("question_id", F.explode(F.array_distinct(news.terms(F.col("question")))).alias("term"))
    return term_index.best(own, terms, TEXT, 3).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def generic_terms(spark: SparkSession, d: str) -> DataFrame:
    return ops.generic_terms(corpus(spark, d), GENERICS)


def question_variants(spark: SparkSession, d: str) -> DataFrame:
    return ops.variants(questions(spark, d))


def _variant_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of each phrasing."""
    terms = ops.variants(questions(spark, d)).select("question_id", "pos", F.explode(F.array_distinct(t.content_words(F.col("query")))).alias("term"))
    return term_index.best(index(spark, d), terms, TEXT, 3, ("question_id", "pos"))


def best_of_variants(spark: SparkSession, d: str) -> DataFrame:
    return ops.top(ops.best_of_variants(_variant_scores(spark, d), 3), 3).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return ops.round_robin(_variant_scores(spark, d))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return term_index.term_frequency(index(spark, d), ("text",)).select(F.col("term").alias("word"))


def prefix_expansions(spark: SparkSession, d: str) -> DataFrame:
    found = ops.prefix_expansions(ops.query_terms(questions(spark, d)), _vocabulary(spark, d))
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


def fuzzy_expansions(spark: SparkSession, d: str) -> DataFrame:
    return ops.fuzzy_expansions(ops.query_terms(questions(spark, d)), _vocabulary(spark, d))


def prefix_scores(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the question's terms and, at three eighths of their weight, the words that they begin."""
    terms = ops.query_terms(questions(spark, d))
    longer = terms.join(ops.prefix_expansions(terms, _vocabulary(spark, d), 6), "term").select("question_id", F.col("word").alias("term"), F.lit(0.375).alias("weight"))
    both = terms.withColumn("weight", F.lit(1.0)).unionByName(longer).groupBy("question_id", "term").agg(F.max("weight").alias("weight"))
    return term_index.best(index(spark, d), both, TEXT, 3).select("question_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def catalogue_spread(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("item"), F.col("p_partkey").alias("pos"))
    return ops.spread(parts, 40)


def diverse_passages(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    ranked = term_index.best(index(spark, d), ops.query_terms(questions(spark, d)), TEXT, 24).join(docs.select("doc_id", F.col("kind").alias("category")), "doc_id")
    return ops.diverse_pick(ranked, ["src1"], 7)


def order_freshness(spark: SparkSession, d: str) -> DataFrame:
    months = ops.age_months(F.to_date("o_orderdate"), F.to_date(F.lit(AS_OF)))
    return table(spark, d, "orders").select("o_orderkey", months.alias("months")).withColumn("freshness", ops.freshness(F.col("months"))).withColumn("weight", F.round(ops.recency_weight(F.col("months")), 6))


def question_shapes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    words = F.size(t.words(q)).cast("long")
    return questions(spark, d).select("question_id", ops.question_shape(q, SHAPES).alias("shape"), ops.vetoed(q, r"(?i)\bthe\b", r"(?i)\bfrom\b").alias("topical"), (words > 40).alias("broad"), (words <= 6).alias("short"))


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("question_id", F.array_join(F.array_sort(t.subject_terms(F.col("question"))), " ").alias("terms"))


def seeded_samples(spark: SparkSession, d: str) -> DataFrame:
    """Users are sessions; each third one has just seen the sample that the seed gives."""
    sessions = table(spark, d, "events").select(F.col("user_id").alias("session"))
    pool = questions(spark, d).select(F.col("question_id").alias("item"))
    return ops.seeded_sample(pool, sessions, 4, 7, last=ops.seeded_sample(pool, sessions.filter("session % 3 = 0"), 4, 7))


def unseen_questions(spark: SparkSession, d: str) -> DataFrame:
    shown = term_index.best(index(spark, d), ops.query_terms(questions(spark, d)), TEXT, 1).filter("score >= 60").select("question_id")
    return questions(spark, d).select("question_id").join(shown, "question_id", "left_anti")


QUERIES = {f.__name__: f for f in (top_passages, fielded_passages, second_hop_passages, collection_frequency, news_passages, document_frequency, generic_terms, question_variants, best_of_variants, round_robin, prefix_expansions, fuzzy_expansions, prefix_scores, catalogue_spread, diverse_passages, order_freshness, question_shapes, question_terms, seeded_samples, unseen_questions)}

STOP = ", ".join(f"'{w}'" for w in sorted(set(t.STOP_WORDS)))


def words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def content_sql(x: str) -> str:
    return f"list_filter({words_sql(x)}, lambda w: NOT list_contains([{STOP}], w) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"


def terms_sql(x: str, a: analysers.Analyser) -> str:
    """As Analyser.terms without the ids that stay whole: no driver table holds one, tests do."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(t.STOP_WORDS) | a.stop))
    found = f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_filter({found}, lambda w: NOT list_contains([{stop}], w) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"


def stem_sql(w: str) -> str:
    return f"CASE WHEN length({w}) > 5 AND ends_with({w}, 'ing') THEN left({w}, length({w}) - 3) WHEN length({w}) > 4 AND ends_with({w}, 'ed') THEN left({w}, length({w}) - 2) WHEN length({w}) > 4 AND ends_with({w}, 'es') THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"


def docs_sql(fields: dict[str, float]) -> str:
    title = "substr(string_split(text, chr(10))[1], 1, 120)"
    each = " UNION ALL ".join(f"SELECT doc_id, unnest({content_sql(title if f == 'title' else 'text')}) AS term, {b} AS boost FROM documents" for f, b in fields.items())
    return f"""posts AS ({each}), sizes AS (SELECT d.doc_id, coalesce(sum(boost), 0) AS length FROM documents d LEFT JOIN posts p ON p.doc_id = d.doc_id GROUP BY ALL),
tf AS (SELECT doc_id, term, sum(boost) AS tf FROM posts WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes)"""


QUESTIONS = f"asked AS (SELECT item_id AS question_id, 1 AS pos, unnest(list_distinct({content_sql('text')})) AS term, 1.0 AS weight FROM benchmark)"
VARIANTS = f"""raw AS (SELECT item_id AS question_id, 0 AS p, text AS query FROM benchmark UNION ALL SELECT item_id, 1, regexp_extract(text, '(?s)^(.*?[.!?])(\\s|$)', 1) FROM benchmark
  UNION ALL SELECT item_id, 2, array_to_string(list_transform(list_sort(list_transform(list_distinct({content_sql('text')}), lambda w: {{'n': -length(w), 'w': w}}))[1:6], lambda x: x.w), ' ') FROM benchmark),
fresh AS (SELECT * FROM raw WHERE trim(query) <> '' QUALIFY row_number() OVER (PARTITION BY question_id, lower(trim(query)) ORDER BY p) = 1),
variants AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY p) AS pos, query FROM fresh QUALIFY pos <= 3)"""
VARIANT_TERMS = f"asked AS (SELECT question_id, pos, unnest(list_distinct({content_sql('query')})) AS term, 1.0 AS weight FROM variants)"
SCORED = """scored AS (SELECT question_id, pos, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), stats GROUP BY ALL)"""
VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({content_sql('text')}) AS word FROM documents)"


def top_sql(k: int, least: float, relative: float) -> str:
    return f"""kept AS (SELECT * FROM scored QUALIFY score >= greatest({least}, max(score) OVER (PARTITION BY question_id) * {relative}))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM kept QUALIFY rank <= {k}"""


#: (place, rest) for the word itself (place 0) and for each letter left out. DuckDB's edit distance counts bytes, so places decide.
DELETED = lambda x: f"list_transform(range(0, length({x}) + 1), lambda i: {{'i': i, 'key': CASE WHEN i = 0 THEN {x} ELSE substr({x}, 1, i - 1) || substr({x}, i + 1) END}})"
MONTHS = f"greatest((year(DATE '{AS_OF}') - year(o_orderdate)) * 12 + month(DATE '{AS_OF}') - month(o_orderdate) - (day(DATE '{AS_OF}') < day(o_orderdate))::INT, 0)"
HASH = lambda x: f"('0x' || substr(md5('7|' || {x}::VARCHAR), 1, 12))::BIGINT"
ORACLE_SQL = {
    "seeded_samples": f"""WITH c AS (SELECT item, row_number() OVER (ORDER BY {HASH('item')}, item) - 1 AS place FROM (SELECT DISTINCT item_id AS item FROM benchmark WHERE item_id IS NOT NULL)), z AS (SELECT count(*) AS size FROM c),
s AS (SELECT DISTINCT user_id AS session FROM events WHERE user_id IS NOT NULL)
SELECT session, item FROM (SELECT session, ({HASH('session')} % size + i + CASE WHEN session % 3 = 0 THEN 4 ELSE 0 END) % size AS place FROM s, z, range(0, 4) r(i) WHERE i < size) JOIN c USING (place)""",
    "top_passages": f"WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED}, {top_sql(3, 0.0, 0.25)}",
    "fielded_passages": f"WITH {QUESTIONS}, {docs_sql(FIELDS)}, {SCORED}, {top_sql(4, 2.0, 0.3)}",
    "collection_frequency": f"""WITH c AS (SELECT CASE lang WHEN 'de' THEN 'news' WHEN 'fr' THEN 'catalogue' ELSE 'archive' END AS collection, text FROM documents),
k AS ({" UNION ALL ".join(f"SELECT collection, unnest(list_distinct({terms_sql('text', a)})) AS term FROM c WHERE collection = '{n}'" for n, a in analysers.COLLECTIONS.items())}) SELECT collection, term, count(*) AS df FROM k GROUP BY ALL""",
    "news_passages": f"""WITH asked AS (SELECT item_id AS question_id, 1 AS pos, unnest(list_distinct({terms_sql('text', analysers.COLLECTIONS['news'])})) AS term, 1.0 AS weight FROM benchmark),
posts AS (SELECT doc_id, unnest({terms_sql('text', analysers.COLLECTIONS['news'])}) AS term, 1.0 AS boost FROM documents WHERE lang = 'de'), sizes AS (SELECT d.doc_id, coalesce(sum(boost), 0) AS length FROM documents d LEFT JOIN posts p ON p.doc_id = d.doc_id WHERE lang = 'de' GROUP BY ALL),
tf AS (SELECT doc_id, term, sum(boost) AS tf FROM posts WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes), {SCORED}
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 3""",
    "second_hop_passages": f"""WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED}, first AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 4),
covered AS (SELECT question_id, lower(string_agg(x, chr(10))) AS known FROM (SELECT item_id AS question_id, text AS x FROM benchmark UNION ALL SELECT question_id, substr(string_split(text, chr(10))[1], 1, 120) FROM first JOIN documents USING (doc_id)) GROUP BY ALL),
named AS (SELECT question_id, rank, unnest(regexp_extract_all(text, '{NAME}')) AS query, generate_subscripts(regexp_extract_all(text, '{NAME}'), 1) AS pos FROM first JOIN documents USING (doc_id)),
names AS (SELECT question_id, query, min({{'r': rank, 'p': pos}}) AS at_ FROM named GROUP BY ALL),
hops AS (SELECT question_id, query, row_number() OVER (PARTITION BY question_id ORDER BY at_, query) AS pos FROM names JOIN covered USING (question_id) WHERE NOT contains(known, lower(query)) QUALIFY pos <= 3),
asked2 AS (SELECT question_id, pos, unnest(list_distinct({content_sql('query')})) AS term, 1.0 AS weight FROM hops),
tf2 AS (SELECT doc_id, term, sum(boost) AS tf FROM posts WHERE term IN (SELECT term FROM asked2) GROUP BY ALL), df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY ALL),
{SCORED.replace('scored', 'scored2').replace('asked', 'asked2').replace('JOIN df ', 'JOIN df2 ').replace('JOIN tf ', 'JOIN tf2 ')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY score DESC, doc_id) AS rank FROM scored2 QUALIFY rank <= 2),
once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank, pos) = 1),
added AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, pos) AS place FROM once ANTI JOIN first USING (question_id, doc_id) QUALIFY place <= 4)
SELECT question_id, 1::BIGINT AS hop, rank AS place, doc_id FROM first UNION ALL SELECT question_id, 2, place, doc_id FROM added""",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({content_sql('text')})) AS term FROM documents) GROUP BY ALL",
    "generic_terms": f"""WITH s AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform({content_sql('text')}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3))) AS term FROM documents)
SELECT term, count(*) AS df FROM s WHERE term IN ({', '.join(f"'{g}'" for g in GENERICS)}) GROUP BY term HAVING count(*) >= greatest(8, floor((SELECT count(*) FROM documents) * 0.02))""",
    "question_variants": f"WITH {VARIANTS} SELECT * FROM variants",
    "best_of_variants": f"""WITH {VARIANTS}, {VARIANT_TERMS}, {docs_sql(TEXT)}, {SCORED}, few AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY question_id, pos ORDER BY score DESC, doc_id) <= 3), best AS (SELECT question_id, doc_id, max(score) AS score FROM few GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM best QUALIFY rank <= 3""",
    "round_robin": f"""WITH {VARIANTS}, {VARIANT_TERMS}, {docs_sql(TEXT)}, {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3), first AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank, pos) = 1)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, pos) AS place, doc_id FROM first""",
    "prefix_expansions": f"""WITH {QUESTIONS}, {VOCABULARY}, longer AS (SELECT word, unnest(list_transform(range(3, length(word)), lambda n: left(word, n))) AS term FROM vocabulary WHERE length(word) > 3)
SELECT term, count(*) AS n, min(word) AS first_word FROM longer WHERE term IN (SELECT term FROM asked) GROUP BY ALL""",
    "fuzzy_expansions": f"""WITH {QUESTIONS}, {VOCABULARY}, l AS (SELECT term, unnest({DELETED('term')}, recursive := true) FROM (SELECT DISTINCT term FROM asked WHERE length(term) >= 5)), r AS (SELECT word, unnest({DELETED('word')}, recursive := true) FROM vocabulary WHERE length(word) >= 4)
SELECT DISTINCT term, word FROM l JOIN r USING (key) WHERE term <> word AND ((length(term) = length(word) AND l.i = r.i) OR (l.i = 0 AND length(word) = length(term) + 1) OR (r.i = 0 AND length(term) = length(word) + 1))""",
    "prefix_scores": f"""WITH plain AS (SELECT item_id AS question_id, unnest(list_distinct({content_sql('text')})) AS term FROM benchmark), {VOCABULARY}, longer AS (SELECT word, unnest(list_transform(range(6, length(word)), lambda n: left(word, n))) AS term FROM vocabulary WHERE length(word) > 6),
asked AS (SELECT question_id, 1 AS pos, term, max(weight) AS weight FROM (SELECT question_id, term, 1.0 AS weight FROM plain UNION ALL SELECT question_id, word, 0.375 FROM plain JOIN longer USING (term)) GROUP BY ALL), {docs_sql(TEXT)}, {SCORED}, {top_sql(3, 0.0, 0.0)}""",
    "catalogue_spread": """WITH s AS (SELECT p_brand AS category, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS round, count(*) OVER (PARTITION BY p_brand) AS size FROM part)
SELECT category, item, round FROM s ORDER BY round, size DESC, category LIMIT 40""",
    "diverse_passages": f"""WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED}, ranked AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 24),
c AS (SELECT r.*, source, row_number() OVER (PARTITION BY question_id, source ORDER BY rank) AS c FROM ranked r JOIN documents USING (doc_id))
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN c > 1 THEN 2 WHEN source = 'src1' THEN 0 ELSE 1 END, rank) AS place FROM c QUALIFY place <= 7""",
    "order_freshness": f"WITH m AS (SELECT o_orderkey, {MONTHS} AS months FROM orders) SELECT o_orderkey, months, CASE WHEN months > 18 THEN 'dated' WHEN months <= 6 THEN 'current' ELSE 'ageing' END AS freshness, round(CASE WHEN months <= 0 THEN 1.0 ELSE pow(2.0, -months / 12.0) END, 6) AS weight FROM m",
    "question_shapes": f"""SELECT item_id AS question_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{s}'" for p, s in SHAPES)} ELSE 'general' END AS shape, regexp_matches(text, '(?i)\\bthe\\b') AND NOT regexp_matches(text, '(?i)\\bfrom\\b') AS topical, len({words_sql('text')}) > 40 AS broad, len({words_sql('text')}) <= 6 AS short FROM benchmark""",
    "question_terms": f"SELECT item_id AS question_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({content_sql('text')}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3))), ' ') AS terms FROM benchmark",
    "unseen_questions": f"WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED} SELECT item_id AS question_id FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM scored WHERE score >= 60)",
}
