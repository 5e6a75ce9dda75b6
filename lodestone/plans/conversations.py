"""Queries of the conversation, reply and attribution jobs over conversations, pages and the retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import attribution, conversations as ops
from lodestone.plans.retrieval import QUESTIONS, SCORED, STOP, TEXT, content_sql, docs_sql, stem_sql, words_sql
from lodestone.plans.retrieval import top_passages as passages
from lodestone.sources.tables import corpus, questions, table

LABELS = {"example.com": "Example Commerce", "example.org": "Example Trust", "spam-farm.example.org": "Spam"}


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return ops.valid_threads(table(spark, d, "conversations"))


def thread_messages(spark: SparkSession, d: str) -> DataFrame:
    return ops.cleaned(_messages(spark, d))


def thread_context(spark: SparkSession, d: str) -> DataFrame:
    return ops.context_window(_messages(spark, d), 4, 1500)


def thread_prior_questions(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_prior_question(_messages(spark, d))


def thread_asked_before(spark: SparkSession, d: str) -> DataFrame:
    return ops.asked_before(_messages(spark, d))


def most_asked_questions(spark: SparkSession, d: str) -> DataFrame:
    return ops.most_asked(_messages(spark, d))


def thread_export(spark: SparkSession, d: str) -> DataFrame:
    return ops.export(_messages(spark, d)).select("conv_id", F.md5("markdown").alias("digest"), F.length("markdown").cast("long").alias("chars"))


def thread_search(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's name is no word here, so regions' first letters with a common ending make the queries."""
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lower(F.substring("r_name", 1, 2)), F.lit(" ent")).alias("query"))
    return ops.search_threads(_messages(spark, d), queries)


def reply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as replies: a third gives its length as a rewrite, a third a bare verdict, the rest no object."""
    m = _messages(spark, d).filter("role = 'assistant'")
    n = F.length("text") % 4
    reply = F.when(n == 0, F.concat(F.lit('ok {"verdict":"revise","rewrite":"'), F.length("text").cast("string"), F.lit('"} end'))).when(n == 1, F.lit('{"verdict":"pass"}')).when(n == 2, F.lit('{"verdict":"maybe"}')).otherwise(F.regexp_replace("text", "[{}]", ""))
    return ops.reply_check(m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), reply.alias("reply")))


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as replies to the turn before: a third repeats its words, a third says what nobody asked."""
    m = ops.with_prior_question(_messages(spark, d)).filter("prior is not null")
    n = F.length("prior") % 3
    own = F.when(n == 0, F.regexp_replace(F.substring("prior", 1, 300), r"[^A-Za-z ]", "")).when(n == 1, "zzzqq xxyyw { nothing").otherwise("")
    reply = F.concat(F.lit('note {"verdict":"pass","rewrite":"'), own, F.lit('","used":[2,0,2,9,1]} end'))
    return m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), reply.alias("reply"), F.col("prior").alias("question"), F.lit(None).cast("string").alias("context"), F.lit(3).alias("n_citations"))


def reply_anchors(spark: SparkSession, d: str) -> DataFrame:
    found = ops.anchored_replies(_anchored(spark, d))
    return found.select("reply_id", F.md5("rewrite").alias("digest"), F.array_join("used", ",").alias("used"), "reason")


def thread_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by their first question's first word as threads: what a thread asks again."""
    m = _messages(spark, d)
    return ops.asked_before(m.withColumn("turn", F.col("conv_id") * 1000 + F.col("turn")).withColumn("text", F.substring_index("text", " ", 2)).withColumn("conv_id", F.col("conv_id") % 7))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    source = F.concat_ws(" ", "title", F.substring("text", 1, 1200))
    return passages(spark, d).join(docs, "doc_id").select(F.col("question_id").alias("answer_id"), F.col("rank").alias("n"), source.alias("source"), "title", F.col("lang").alias("class"))


def citation_usage(spark: SparkSession, d: str) -> DataFrame:
    answers = questions(spark, d).select(F.col("question_id").alias("answer_id"), F.col("question").alias("answer"))
    return attribution.usage(_cited(spark, d), answers)


def answer_provenance(spark: SparkSession, d: str) -> DataFrame:
    found = _cited(spark, d).groupBy("answer_id").agg(F.collect_set("class").alias("classes"))
    every = questions(spark, d).select(F.col("question_id").alias("answer_id"), (F.length("question") < 60).alias("general"))
    return attribution.provenance(every.join(found, "answer_id", "left").select("answer_id", "general", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.lit("none").alias("mode")))


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return attribution.source_label(table(spark, d, "pages"), LABELS)


def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select(F.col("question_id").alias("answer_id"), "question")
    return attribution.follow_ups(_cited(spark, d).join(q, "answer_id"))


QUERIES = {f.__name__: f for f in (thread_messages, thread_context, thread_prior_questions, thread_asked_before, most_asked_questions, thread_export, thread_search, thread_repeats, reply_verdicts, reply_anchors, citation_usage, answer_provenance, source_labels, follow_ups)}

VALID = "m AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('system', 'user', 'assistant') AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)"
KEY = "trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
USE = lambda x: f"list_filter({words_sql(x)}, lambda w: length(w) >= 4 AND NOT list_contains([{STOP}], w))"
TOP3 = f"""WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED}, kept AS (SELECT * FROM scored QUALIFY score >= max(score) OVER (PARTITION BY question_id) * 0.25),
best AS (SELECT question_id AS answer_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS n, doc_id FROM kept QUALIFY n <= 3)"""
FOLD = lambda x: f"translate(lower({x}), '{ops.FOLDED[0]}', '{ops.FOLDED[1]}')"
SUBJECT = lambda x: f"list_filter(list_transform({content_sql(x)}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3)"
ORACLE_SQL = {
    "thread_search": f"""WITH {VALID}, q AS (SELECT r_regionkey AS query_id, list_distinct(list_filter(string_split_regex({FOLD("lower(left(r_name, 2)) || ' ent'")}, '\\s+'), lambda x: x <> '')) AS terms FROM region),
f AS (SELECT query_id, conv_id, turn, text, terms, list_filter(terms, lambda x: contains({FOLD('text')}, x)) AS found FROM m, q),
h AS (SELECT *, list_min(list_transform(found, lambda x: strpos({FOLD('text')}, x))) AS p FROM f WHERE len(found) > 0),
g AS (SELECT query_id, conv_id, any_value(terms) AS terms, list_distinct(flatten(list(found))) AS found, min(turn) AS turn, arg_min(substr(text, greatest(p - 52, 1), 104), turn) AS snippet FROM h GROUP BY ALL)
SELECT query_id, conv_id, turn, snippet FROM g WHERE len(found) = len(terms)""",
    "thread_messages": f"WITH {VALID} SELECT conv_id, turn, role, regexp_replace(text, '\\s?\\[[0-9]+\\]', '', 'g') AS text FROM m QUALIFY trim(text) <> '' OR turn = max(turn) OVER (PARTITION BY conv_id)",
    "thread_context": f"WITH {VALID}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m) SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS used FROM b WHERE back > 1 QUALIFY back <= 5 AND used <= 1500",
    "thread_prior_questions": f"WITH {VALID} SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM m WHERE role = 'user'",
    "thread_asked_before": f"WITH {VALID} SELECT conv_id, turn FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, {KEY} ORDER BY turn) > 1",
    "most_asked_questions": f"WITH {VALID} SELECT {KEY} AS key, count(*) AS n, count(DISTINCT conv_id) AS threads FROM m WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, key LIMIT 20",
    "thread_export": f"""WITH {VALID}, e AS (SELECT conv_id, '# ' || coalesce(substr(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '\\s+', ' ', 'g'), 1, 60), 'Untitled') || chr(10) || chr(10) ||
  string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM m GROUP BY conv_id) SELECT conv_id, md5(markdown) AS digest, length(markdown) AS chars FROM e""",
    "thread_repeats": f"""WITH {VALID}, k AS (SELECT conv_id % 7 AS conv_id, conv_id * 1000 + turn AS turn, array_to_string(string_split(text, ' ')[1:2], ' ') AS text FROM m WHERE role = 'user')
SELECT conv_id, turn FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, {KEY} ORDER BY turn) > 1""",
    "reply_anchors": f"""WITH {VALID}, p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM m WHERE role = 'user'),
r AS (SELECT conv_id * 1000 + turn AS reply_id, prior, CASE length(prior) % 3 WHEN 0 THEN regexp_replace(substr(prior, 1, 300), '[^A-Za-z ]', '', 'g') WHEN 1 THEN 'zzzqq xxyyw {{ nothing' ELSE '' END AS w FROM p WHERE prior IS NOT NULL),
s AS (SELECT *, CASE WHEN trim(w) <> '' AND NOT (list_has_any({SUBJECT('w')}, {SUBJECT('prior')}) OR list_has_any(regexp_extract_all(w, '\\b[A-Z][A-Z0-9]+\\b'), regexp_extract_all(prior, '\\b[A-Z][A-Z0-9]+\\b'))) THEN 'no anchor' END AS reason FROM r)
SELECT reply_id, CASE WHEN reason IS NULL THEN md5(w) END AS digest, CASE WHEN reason IS NULL THEN '2,1' END AS used, reason FROM s""",
    "reply_verdicts": f"""WITH {VALID} SELECT conv_id * 1000 + turn AS reply_id, CASE length(text) % 4 WHEN 0 THEN 'revise' WHEN 1 THEN 'pass' END AS verdict, CASE length(text) % 4 WHEN 0 THEN length(text)::VARCHAR END AS rewrite,
  CASE length(text) % 4 WHEN 2 THEN 'unknown verdict' WHEN 3 THEN 'no object' END AS reason FROM m WHERE role = 'assistant'""",
    "citation_usage": f"""{TOP3}, c AS (SELECT answer_id, n, {USE("concat_ws(' ', substr(string_split(d.text, chr(10))[1], 1, 120), substr(d.text, 1, 1200))")} AS ct, {USE('q.text')} AS ta, q.text AS answer FROM best JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = answer_id),
s AS (SELECT answer_id, n, answer, len(list_intersect(list_distinct(ct), ta)) + 2 * len(list_filter(list_transform(range(1, len(ct)), lambda i: ct[i] || ' ' || ct[i + 1]), lambda b: list_contains(list_transform(range(1, len(ta)), lambda i: ta[i] || ' ' || ta[i + 1]), b))) AS usage FROM c)
SELECT answer_id, n, usage::BIGINT AS usage, usage >= 3 OR NOT bool_or(usage >= 3) OVER (PARTITION BY answer_id) OR count(*) OVER (PARTITION BY answer_id) < 2 OR trim(answer) = '' AS kept FROM s""",
    "answer_provenance": f"""{TOP3}, k AS (SELECT answer_id, list_distinct(list(lang)) AS classes FROM best JOIN documents USING (doc_id) GROUP BY ALL)
SELECT item_id AS answer_id, CASE WHEN length(text) < 60 THEN 'general' WHEN len(classes) = 1 THEN classes[1] WHEN len(classes) > 1 THEN 'mixed' ELSE 'none' END AS provenance FROM benchmark LEFT JOIN k ON answer_id = item_id""",
    "follow_ups": f"""{TOP3}, c AS (SELECT answer_id, n, 'What about ' || trim(title) || '?' AS suggestion, title, question, list_filter(list_transform({content_sql('title')}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3)[1] AS subject
  FROM (SELECT answer_id, n, substr(string_split(d.text, chr(10))[1], 1, 120) AS title, q.text AS question FROM best JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = answer_id)),
k AS (SELECT * FROM c WHERE length(suggestion) <= 90 AND subject IS NOT NULL AND {KEY.replace('text', 'title')} <> {KEY.replace('text', 'question')} QUALIFY row_number() OVER (PARTITION BY answer_id, subject ORDER BY n) = 1)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY n) AS place, suggestion FROM k QUALIFY place <= 3""",
    "source_labels": """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'Spam' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'Example Trust' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'Example Commerce' ELSE coalesce(string_split(host, '.')[-2], host) END AS label FROM h""",
}
