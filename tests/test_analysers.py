from pyspark.sql import functions as F

from lodestone.functions import analysers as a
from lodestone.operators import term_index as ti


def terms(spark, text, analyser=a.COLLECTIONS["archive"]):
    return spark.range(1).select(analyser.terms(F.lit(text).cast("string")).alias("x")).first().x


def test_ids_stay_whole(spark):
    assert terms(spark, "BRC-100s and BRC62, xBRC-7 OP_CHECK_SIG op_x; brc-9th") == ["brc-100", "brc-62", "xbrc", "7", "op_check_sig", "op_x", "brc", "9th"]
    assert terms(spark, "A 1 b Ü the of 42") == ["1", "42"] and terms(spark, None) is None and terms(spark, "") == []


def test_stop_words_by_collection(spark):
    text = "latest news about apps"
    assert terms(spark, text, a.COLLECTIONS["news"]) == ["about", "apps"] and terms(spark, text, a.COLLECTIONS["catalogue"]) == ["latest", "news", "about"]
    rows = spark.createDataFrame([("news", text), ("catalogue", text), ("other", text), (None, text)], "c string, text string")
    got = [r.x for r in rows.select(a.by_collection(F.col("c"))(F.col("text")).alias("x")).collect()]
    assert got == [["about", "apps"], ["latest", "news", "about"], ["latest", "news", "about", "apps"], ["latest", "news", "about", "apps"]]


def test_an_index_by_these_rules_finds_the_id_and_not_its_parts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "BRC-100 wallets"), (2, "select failed 10038 brc 100"), (3, "the brc-100s")], "doc_id long, text string")
    own = a.COLLECTIONS["archive"]
    index = ti.build(docs, ("text",), f"{tmp_path}/i", 4, own.terms)
    asked = spark.createDataFrame([(1, "What is BRC100?")], "question_id long, question string").select("question_id", F.explode(own.terms(F.col("question"))).alias("term"))
    assert {r.doc_id for r in ti.search(index, asked, {"text": 1.0}).collect()} == {1, 3}
