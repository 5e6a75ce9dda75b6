"""Queries of the archive sources: catalogue files that Spark writes from the part table, and pages as mail archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evidence, retrieval
from lodestone.plans.evidence import C12, _candidates
from lodestone.plans.live import shared_folder
from lodestone.plans.retrieval import content_sql
from lodestone.sources import archives as ops
from lodestone.sources.tables import questions, table

#: Where no word goes on, in any language: \b and \s mean other characters to Java than to RE2, which knows ASCII letters only.
FRONT, BACK, SPACE = r"(?i)(?:^|[^\p{L}\p{Nd}_])", r"(?:[^\p{L}\p{Nd}_]|$)", r"[\x20\x09-\x0D]+"
PHRASES = [(rf"{FRONT}tion{BACK}", "ending"), (rf"{FRONT}ble{BACK}", "able words")]
HEADS = [(rf"{FRONT}the{SPACE}of{BACK}", "the of"), (rf"{FRONT}was{SPACE}", "was")]


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a catalogue, written as text files and read as sections."""
    path = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    p = F.col("p_partkey")
    section = F.element_at(F.array(F.lit("apps"), F.lit("blocks"), F.lit("orgs"), F.lit("other")), (p % 4 + 1).cast("int"))
    entry = F.concat(F.col("p_name"), F.lit("\nURL: https://example.org/"), section, F.lit("/part-"), p.cast("string"), F.lit("\nCategory: "), F.col("p_brand"), F.lit("\nTags: "), F.col("p_type"), F.lit(", x\nLast updated: 2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("\nDescription: "), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("\n"))
    table(spark, d, "part").select(entry.alias("value")).write.option("lineSep", "\n### ").text(path)
    return ops.catalogue_sections(spark, path)


def catalogue_entries(spark: SparkSession, d: str) -> DataFrame:
    return ops.catalogue_entries(_catalogue(spark, d)).select("section", "id", "name", "category", "summary", F.array_join("tags", "|").alias("tags"), "last_updated")


def unquoted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose advertisement is taken for a quoted reply."""
    html = F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="quote">'))
    return table(spark, d, "pages").select("page_id", F.md5(ops.without_quotes(html)).alias("digest"))


def term_names(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region's suppliers as an item's terms."""
    items = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("item_id")).agg(F.array_sort(F.collect_set("c_nationkey")).alias("ids"))
    terms = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "Uncategorized").otherwise(F.col("n_name")).alias("name"))
    return ops.term_names(items, terms).select("item_id", F.array_join("names", ",").alias("names"))


def question_expansions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.expanded(questions(spark, d), PHRASES, HEADS)


def question_skips(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reply_skips(questions(spark, d))


def evidence_angles(spark: SparkSession, d: str) -> DataFrame:
    return evidence.angles(_candidates(spark, d), 7).select("question_id", "theme", "place")


def evidence_broad(spark: SparkSession, d: str) -> DataFrame:
    return evidence.broad_pick(_candidates(spark, d).withColumn("on_subject", F.col("rank") <= 2), 7, 6)


QUERIES = {f.__name__: f for f in (catalogue_entries, unquoted_pages, term_names, question_expansions, question_skips, evidence_angles, evidence_broad)}
SECTION = "CASE p_partkey % 4 WHEN 0 THEN 'apps' WHEN 1 THEN 'blocks' WHEN 2 THEN 'orgs' END"
KEY = "trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
ADDED = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') AND NOT contains(lower(text), '{x}') THEN '{x}' END" for p, x in PHRASES)
HEAD = f"coalesce({', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{x}' END" for p, x in HEADS)}, CASE WHEN len({content_sql('text')}) >= 3 THEN list_filter({content_sql('text')}, lambda w: length(w) > 3)[1] END)"
ORACLE_SQL = {
    "question_expansions": f"SELECT item_id AS question_id, unnest(list_distinct(list_filter([{ADDED}, {HEAD}], lambda x: x IS NOT NULL))) AS query FROM benchmark",
    "question_skips": f"""WITH k AS (SELECT item_id AS question_id, {KEY} AS key FROM benchmark), n AS (SELECT *, len(list_filter(string_split(key, ' '), lambda w: w <> '')) AS n FROM k)
SELECT question_id, regexp_matches(key, '^(thanks|thank you|hello|hi|ok|okay|great|merci|danke|gracias)( .{{0,12}})?$') AS courtesy, n = 1 AS bare, n <= 3 AS short FROM n""",
    "catalogue_entries": f"SELECT {SECTION} AS section, 'part-' || p_partkey AS id, p_name AS name, p_brand AS category, 'size ' || p_size AS summary, p_type || '|x' AS tags, ('2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0'))::DATE AS last_updated FROM part",
    "unquoted_pages": "SELECT page_id, md5(regexp_replace(html, '(?s)<div class=\"ad\">.*?</div>', '', 'g')) AS digest FROM pages",
    "term_names": "SELECT c_mktsegment AS item_id, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 > 0 GROUP BY ALL",
    "evidence_angles": f"{C12}, f AS (SELECT question_id, source AS theme, min(rank) AS rank FROM c GROUP BY ALL) SELECT question_id, theme, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM f QUALIFY place <= 4",
}
