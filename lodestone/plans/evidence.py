"""Queries of the evidence and evaluation jobs: the candidates are the retrieved passages of each benchmark question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import duplicates, evaluation, evidence as ops, retrieval, term_index
from lodestone.plans.retrieval import QUESTIONS, SCORED, TEXT, content_sql, docs_sql, index, stem_sql, words_sql
from lodestone.sources.tables import corpus, questions, table

BUDGET = {"primary": 2, "spec": 3, "essay": 1}
LINT = {r"(?i)\bworthless\b": "worthless", r"(?i)\bgnu general public\b": "licence", r"(?i)released under the mit": "licence-mit"}


def _candidates(spark: SparkSession, d: str, k: int = 12) -> DataFrame:
    """The best k passages with what packing asks of them: the language makes the tier, the source the theme."""
    docs = corpus(spark, d)
    ranked = term_index.best(index(spark, d), retrieval.query_terms(questions(spark, d)), TEXT, k)
    tier = F.when(F.col("lang") == "en", "essay").when(F.col("lang") == "de", "spec").otherwise("primary")
    # texts are joined after the top-k: candidates are small until then
    return ranked.join(docs, "doc_id").select("question_id", "doc_id", "rank", F.round("score", 6).alias("score"), "title", F.substring("text", 1, 400).alias("excerpt"), tier.alias("tier"), F.col("kind").alias("theme"), F.concat_ws("/", "kind", "lang").alias("series"), F.concat(F.lit("https://example.org/"), "kind").alias("url"), F.length("text").alias("chars"))


def evidence_relevance(spark: SparkSession, d: str) -> DataFrame:
    return ops.relevance(_candidates(spark, d), questions(spark, d))


def evidence_slots(spark: SparkSession, d: str) -> DataFrame:
    return ops.slots(_candidates(spark, d), BUDGET).select("question_id", "doc_id", "tier", "place")


def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    return ops.text_budget(_candidates(spark, d), 2000, 300).select("question_id", "doc_id", F.md5("excerpt").alias("digest"), "used")


def evidence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ops.numbered(_candidates(spark, d))


def evidence_citations(spark: SparkSession, d: str) -> DataFrame:
    return ops.capped_citations(_candidates(spark, d))


def evidence_collectors(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    other = c.withColumn("rank", F.row_number().over(ops.Window.partitionBy("question_id").orderBy("chars", "doc_id")))
    return ops.merged_collectors(c.filter("rank <= 5").select("question_id", "doc_id", "rank"), other.filter("rank <= 5").select("question_id", "doc_id", "rank"))


def evidence_claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders claim, their lines' parts are the hits; parts of one maker are known by their name."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "supports").when(F.col("o_orderstatus") == "O", "contradicts").otherwise("open").alias("status"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("support"))
    hits = table(spark, d, "part").filter(F.col("p_partkey") % 3 > 0).select(F.col("p_partkey").alias("hit_id"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).alias("locator"))
    return ops.claims_with_hits(orders.join(lines, orders.claim_id == lines.l_orderkey), hits)


def evidence_second_hop(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).join(corpus(spark, d).select("doc_id", "text"), "doc_id")
    own = questions(spark, d).select("question_id", F.explode(F.regexp_extract_all("question", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("query"))
    return ops.second_hop(c.select("question_id", "rank", "text"), own, "[A-Z][a-z]{6,}")


def evidence_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return ops.deduplicated(_candidates(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Whole candidates as hits: two documents in a row are the two forms of one text, the language and the first word its title."""
    whole = _candidates(spark, d).join(corpus(spark, d).select("doc_id", "text"), "doc_id")
    slug = F.floor(F.col("doc_id") / 2).cast("string")
    kind = F.when(F.col("doc_id") % 2 == 0, "principle").otherwise("essay")
    return whole.select("question_id", "rank", F.concat_ws(":", kind, F.lit("medium"), slug).alias("id"), kind.alias("kind"), F.concat(F.lit("own://essay/medium/"), slug).alias("locator"), F.concat_ws(" ", "tier", F.substring_index("title", " ", 1)).alias("title"), F.lit(None).cast("string").alias("date"), F.col("text").alias("excerpt"), F.array("theme").alias("themes"))


def evidence_collapsed(spark: SparkSession, d: str) -> DataFrame:
    kept = duplicates.collapsed(_hits(spark, d))
    return kept.select("question_id", "place", "id", F.md5("excerpt").alias("digest"), F.array_join("aliases", ",").alias("aliases"))


def evidence_aliases(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.alias_map(duplicates.collapsed(_hits(spark, d)))


def evidence_keys(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return h.select("question_id", "id", "rank", duplicates.pair_key(F.col("id"), F.col("locator")).alias("pair"), duplicates.title_key(F.col("title")).alias("title_key"), duplicates.cluster_key(F.col("id"), F.col("kind"), F.when(F.col("rank") % 2 == 0, F.col("themes")), F.col("title")).alias("cluster"))


def evidence_diversified(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d, 24)
    return ops.diversified(c.withColumn("on_subject", F.col("rank") <= 2))


def evidence_same_story(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d, 24)
    return ops.same_story_suppressed(c.withColumn("age", F.col("doc_id") % 40))


def evidence_prose(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d, 2)
    pairs = c.groupBy(F.col("question_id").alias("key")).agg(F.max_by("excerpt", -F.col("rank")).alias("a"), F.max_by("excerpt", "rank").alias("b"))
    return ops.merged_prose(pairs)


def _runs(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    found = _candidates(spark, d, k).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "tier"))), lambda x: x["tier"]).alias("kinds"), F.sum("chars").cast("long").alias("evidence_chars"))
    q = questions(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("question_id") % 4).cast("string"))).withColumn("expects_spec", F.col("question_id") % 3 == 0)
    none = F.array().cast("array<string>")
    # questions without candidates stay, as rows that found nothing
    rows = q.join(found, "question_id", "left").select("question_id", "question", "category", "expects_spec", F.coalesce("titles", none).alias("titles"), F.coalesce("kinds", none).alias("kinds"), F.coalesce("evidence_chars", F.lit(0)).cast("long").alias("evidence_chars"))
    return evaluation.flagged(rows)


def eval_flags(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("question_id", F.array_join("flags", ",").alias("flags"), "evidence_chars")


def eval_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.flag_counts(_runs(spark, d))


def eval_worst(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.worst(_runs(spark, d))


def eval_depths(spark: SparkSession, d: str) -> DataFrame:
    both = _runs(spark, d, 1).withColumn("depth", F.lit("quick")).unionByName(_runs(spark, d, 3).withColumn("depth", F.lit("deep")))
    return evaluation.by_depth(both, ["quick", "deep"])


def _rubric(spark: SparkSession, d: str) -> DataFrame:
    best = _candidates(spark, d, 1).select("question_id", F.concat_ws(" ", "title", "excerpt").alias("answer"))
    words = F.slice(t.content_words(F.col("question")), 1, 3)
    cases = questions(spark, d).join(best, "question_id", "left").select("question_id", F.coalesce("answer", F.lit("")).alias("answer"), words.alias("must_mention"), F.array(F.lit("idiot"), F.lit("password")).alias("must_not_mention"), F.lit(100).alias("min_chars"), (F.col("question_id") % 2 == 0).alias("guard"))
    return evaluation.rubric(cases)


def eval_rubric(spark: SparkSession, d: str) -> DataFrame:
    return _rubric(spark, d)


def eval_rubric_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rubric_totals(_rubric(spark, d))


def term_lint(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.linted(table(spark, d, "documents"), LINT).select("doc_id", F.array_join("labels", ",").alias("labels"))


QUERIES = {f.__name__: f for f in (evidence_relevance, evidence_slots, evidence_budget, evidence_numbers, evidence_citations, evidence_collectors, evidence_claims, evidence_second_hop, evidence_deduplicated, evidence_collapsed, evidence_aliases, evidence_keys, evidence_diversified, evidence_same_story, evidence_prose, eval_flags, eval_flag_counts, eval_worst, eval_depths, eval_rubric, eval_rubric_totals, term_lint)}


def candidates_sql(k: int, name: str = "c") -> str:
    return f"""{name} AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, substr(string_split(text, chr(10))[1], 1, 120) AS title, substr(text, 1, 400) AS excerpt,
  CASE lang WHEN 'en' THEN 'essay' WHEN 'de' THEN 'spec' ELSE 'primary' END AS tier, source, length(text) AS chars FROM scored JOIN documents USING (doc_id) QUALIFY rank <= {k})"""


HEAD = f"WITH {QUESTIONS}, {docs_sql(TEXT)}, {SCORED}"
C12 = f"{HEAD}, {candidates_sql(12)}"
SUBJECT = lambda x: f"list_distinct(list_filter(list_transform({content_sql(x)}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 3))"


def runs_sql(k: int, name: str) -> str:
    return f"""{candidates_sql(k, 'c' + name)}, f{name} AS (SELECT question_id, list(title) AS titles, list(tier ORDER BY rank) AS kinds, sum(chars)::BIGINT AS chars FROM c{name} GROUP BY ALL),
q{name} AS (SELECT item_id AS question_id, 'c' || (item_id % 4) AS category, item_id % 3 = 0 AS spec, list_filter(list_distinct({content_sql('text')}), lambda w: length(w) > 2) AS asked, list_filter(list_distinct({content_sql('text')}), lambda w: length(w) >= 5) AS distinctive, coalesce(titles, []) AS titles, coalesce(kinds, []) AS kinds, coalesce(chars, 0) AS evidence_chars FROM benchmark LEFT JOIN f{name} ON question_id = item_id),
r{name} AS (SELECT *, list_filter([CASE WHEN len(titles) = 0 THEN 'NONE' END, CASE WHEN evidence_chars < 1500 THEN 'THIN' END, CASE WHEN spec AND NOT list_contains(kinds, 'spec') THEN 'NO-SPEC-FOR-MECHANISM' END,
  CASE WHEN len(titles) > 0 AND len(list_filter(kinds, lambda x: x <> 'essay')) = 0 THEN 'ESSAY-ONLY' END, CASE WHEN len(titles) > 0 AND len(asked) > 0 AND len(list_filter(titles, lambda x: list_has_any({words_sql('x')}, asked))) = 0 THEN 'TITLE-MISMATCH' END], lambda x: x IS NOT NULL) AS flags FROM q{name})"""


def has_sql(f: str) -> str:
    return f"list_contains(flags, '{f}')"


RUNS = f"{HEAD}, {runs_sql(3, '3')}"
RUBRIC = f"""{HEAD}, {candidates_sql(1)}, a AS (SELECT item_id AS question_id, coalesce(title || ' ' || excerpt, '') AS answer, {content_sql('text')}[1:3] AS must FROM benchmark LEFT JOIN c ON question_id = item_id),
res AS (SELECT question_id, question_id % 2 = 0 AS guard, (len(list_filter(must, lambda w: NOT contains(lower(answer), lower(w)))) + contains(lower(answer), 'idiot')::INT + contains(lower(answer), 'password')::INT + (length(answer) < 100)::INT)::BIGINT AS failed FROM a)"""
TITLE = "concat_ws(' ', tier, string_split(title, ' ')[1])"
STEMS = f"list_filter(list_transform({content_sql('title')}, lambda w: {stem_sql('w')}), lambda w: length(w) > 2)[1:2]"
PLAIN = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
SENTENCES = lambda x: f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
ORACLE_SQL = {
    "evidence_prose": f"""{HEAD}, {candidates_sql(2)}, p AS (SELECT question_id AS key, arg_min(excerpt, rank) AS a, arg_max(excerpt, rank) AS b FROM c GROUP BY ALL),
l AS (SELECT key, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS longer, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS other FROM p),
k AS (SELECT *, list_transform({SENTENCES('longer')}, lambda s: {PLAIN('s')}) AS known FROM l)
SELECT key, concat_ws(' ', longer, nullif(array_to_string(list_filter({SENTENCES('other')}, lambda s: {PLAIN('s')} <> '' AND NOT list_contains(known, {PLAIN('s')})), ' '), '')) AS prose FROM k""",
    "evidence_keys": f"""{C12}, k AS (SELECT question_id, doc_id, rank, source, {TITLE} AS title FROM c), s AS (SELECT *, string_split_regex(title, '\\s+[—–-]\\s+|:\\s+')[1] AS head, nullif(trim(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '') AS title_key FROM k)
SELECT question_id, CASE WHEN doc_id % 2 = 0 THEN 'principle' ELSE 'essay' END || ':medium:' || (doc_id // 2) AS id, rank, 'medium:' || (doc_id // 2) AS pair, title_key,
  CASE WHEN rank % 2 = 0 THEN 'theme:' || lower(source) ELSE coalesce('series:' || nullif(array_to_string({STEMS.replace('title', 'head')}, '-'), ''), 'title:' || title_key) END AS cluster FROM s""",
    "evidence_relevance": f"""{C12}, m AS (SELECT c.question_id, c.doc_id, tier, {SUBJECT('q.text')} AS s, {SUBJECT('title')} AS tt, {SUBJECT('excerpt')} AS et FROM c JOIN benchmark q ON q.item_id = c.question_id),
pairs AS (SELECT question_id, doc_id, tier, unnest(s) AS a, tt, et FROM m), hit AS (SELECT question_id, doc_id, tier, a, {{}} FROM pairs),
flat AS (SELECT question_id, doc_id, any_value(tier) AS tier, bool_or(len(list_filter(tt, lambda b: MATCH)) > 0) AS t, bool_or(len(list_filter(et, lambda b: MATCH)) > 0) AS e FROM pairs GROUP BY ALL)
SELECT m.question_id, m.doc_id, coalesce(t, false) AS in_title, coalesce(t, false) OR (m.tier = 'primary' AND coalesce(e, false)) AS qualifies FROM m LEFT JOIN flat USING (question_id, doc_id)""".replace("hit AS (SELECT question_id, doc_id, tier, a, {} FROM pairs),\n", "").replace("MATCH", "(a = b OR (least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)) AND (abs(length(a) - length(b)) <= 3 OR (least(length(a), length(b)) >= 6 AND abs(length(a) - length(b)) <= 8))))"),
    "evidence_slots": f"{C12} SELECT question_id, doc_id, tier, row_number() OVER (PARTITION BY question_id, tier ORDER BY rank) AS place FROM c QUALIFY place <= CASE tier WHEN 'primary' THEN 2 WHEN 'spec' THEN 3 ELSE 1 END",
    "evidence_budget": f"{C12}, e AS (SELECT *, CASE WHEN length(excerpt) > 300 THEN substr(excerpt, 1, 299) || '…' ELSE excerpt END AS x FROM c) SELECT question_id, doc_id, md5(x) AS digest, (sum(length(x)) OVER (PARTITION BY question_id ORDER BY rank))::BIGINT AS used FROM e QUALIFY used <= 2000",
    "evidence_numbers": f"{C12}, b AS (SELECT *, min(rank) OVER (PARTITION BY question_id, source) AS best FROM c) SELECT question_id, doc_id, dense_rank() OVER (PARTITION BY question_id ORDER BY best) AS n FROM b",
    "evidence_citations": f"{C12}, k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY tier <> 'primary', rank) <= 5) SELECT question_id, doc_id, tier, row_number() OVER (PARTITION BY question_id ORDER BY tier <> 'primary', rank) AS n FROM k",
    "evidence_collectors": f"""{C12}, o AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY chars, doc_id) AS rank FROM c), b AS (SELECT question_id, doc_id, rank, 0 AS side FROM c WHERE rank <= 5 UNION ALL SELECT question_id, doc_id, rank, 1 FROM o WHERE rank <= 5),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank, side) = 1) SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, side) AS place, side FROM f""",
    "evidence_claims": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT o_orderkey AS claim_id, string_agg(CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE p_partkey::VARCHAR END, ',' ORDER BY p_partkey) AS refs
FROM orders JOIN l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus IN ('F', 'O') AND p_partkey % 3 > 0 GROUP BY ALL""",
    "evidence_second_hop": f"""{C12}, x AS (SELECT question_id, rank, unnest(regexp_extract_all(text, '[A-Z][a-z]{{6,}}')) AS query, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{{6,}}'), 1) AS pos FROM c JOIN documents USING (doc_id)),
own AS (SELECT item_id AS question_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{6,}}')) AS query FROM benchmark), f AS (SELECT question_id, query, min({{'r': rank, 'p': pos}}) AS at_ FROM x GROUP BY ALL)
SELECT question_id, query, row_number() OVER (PARTITION BY question_id ORDER BY at_, query) AS place FROM f ANTI JOIN own USING (question_id, query) QUALIFY place <= 3""",
    "eval_flags": f"{RUNS} SELECT question_id, array_to_string(flags, ',') AS flags, evidence_chars FROM r3",
    "eval_flag_counts": f"""{RUNS} SELECT category, count(*) AS questions, {', '.join(f"count(*) FILTER ({has_sql(f)}) AS {f.lower().replace('-', '_')}" for f in evaluation.FLAGS)}, count(*) FILTER (len(flags) = 0) AS clean FROM r3 GROUP BY ROLLUP (category)""",
    "eval_worst": f"""{RUNS}, s AS (SELECT question_id, round((CASE WHEN {has_sql('NONE')} THEN 1000 WHEN {has_sql('THIN')} THEN 400 ELSE 0 END + CASE WHEN {has_sql('TITLE-MISMATCH')} THEN 350 ELSE 0 END + CASE WHEN {has_sql('NO-SPEC-FOR-MECHANISM')} THEN 300 ELSE 0 END + CASE WHEN {has_sql('ESSAY-ONLY')} THEN 250 ELSE 0 END
  + CASE WHEN spec AND len(titles) > 0 AND kinds[1] <> 'spec' AND list_contains(kinds, 'spec') THEN 80 ELSE 0 END + CASE WHEN len(titles) > 0 AND len(list_filter(titles, lambda x: list_has_any({words_sql('x')}, distinctive))) = 0 THEN 60 ELSE 0 END
  + CASE WHEN {has_sql('NONE')} THEN 0 ELSE greatest(0, 1500 - evidence_chars) / 50 END)::DOUBLE, 6) AS severity, evidence_chars FROM r3) SELECT * FROM s ORDER BY severity DESC, evidence_chars, question_id LIMIT 10""",
    "eval_depths": f"{HEAD}, {runs_sql(1, '1')}, {runs_sql(3, '3')} SELECT question_id, a.evidence_chars AS quick_chars, len(a.flags) AS quick_flags, b.evidence_chars AS deep_chars, len(b.flags) AS deep_flags FROM r1 a JOIN r3 b USING (question_id)",
    "eval_rubric": f"{RUBRIC} SELECT *, failed = 0 AS passed FROM res",
    "eval_rubric_totals": f"{RUBRIC} SELECT count(*) FILTER (failed = 0 AND NOT guard) AS builders_passed, count(*) FILTER (failed = 0 AND guard) AS guards_passed, count(*) AS cases, bool_and(failed = 0 OR NOT guard) AS ok FROM res",
    "term_lint": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for p, label in LINT.items()) + "], lambda x: x IS NOT NULL), ',') AS labels FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in LINT),
}
