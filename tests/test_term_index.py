import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, term_index as ti

TEXTS = ["Merkle trees and proofs", "proofs of Weather in Norwich", None, "", "merkle merkle merkle", "Norwich is a city of weather", "the of and"]
BOOSTS = {"title": 2.0, "text": 1.0}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, ["Merkle", "Other", None][k % 3], t, "x") for k, t in enumerate(TEXTS)], "doc_id long, title string, text string, term string")


@pytest.fixture
def index(docs, tmp_path):
    return ti.build(docs, ("title", "text"), f"{tmp_path}/index", 8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_scores_equal_those_without_an_index(spark, docs, index):
    asked = spark.createDataFrame([(1, "merkle proofs"), (2, "weather in Norwich"), (3, "the of"), (4, "gibberish"), (5, None)], "question_id long, question string")
    terms = retrieval.query_terms(asked)
    known = docs.na.fill("")
    for boosts in (BOOSTS, {"text": 1.0}):
        for share in (1.0, 0.3):
            want = rows(retrieval.bm25(terms, known, boosts, share))
            assert rows(ti.search(index, terms, boosts, share)) == want and want
    assert ti.search(index, terms.filter("question_id = 4"), BOOSTS).count() == 0
    with pytest.raises(ValueError, match="no field"):
        ti.search(index, terms, {"body": 1.0})


def test_document_frequency_by_field(index):
    text, both = ({r.term: r.df for r in ti.term_frequency(index, f).collect()} for f in (("text",), ("title", "text")))
    assert text["merkle"] == 2 and both["merkle"] == 4 and text["norwich"] == 2 and both["other"] == 2 and "" not in both and "other" not in text


def test_only_the_terms_buckets_are_read(spark, index):
    one = spark.createDataFrame([(1, "merkle")], "question_id long, term string")
    plan = ti.search(index, one, {"text": 1.0})._jdf.queryExecution().toString()
    bucket = spark.range(1).select(ti.bucket_of(F.lit("merkle"), 8)).first()[0]
    assert f"PartitionFilters: [isnotnull(bucket" in plan or f"(bucket#" in plan
    assert f"= {bucket})" in plan and "CartesianProduct" not in plan


def test_empty_table(spark, docs, tmp_path):
    none = ti.build(docs.limit(0), ("title", "text"), f"{tmp_path}/none")
    assert ti.search(none, spark.createDataFrame([(1, "merkle")], "question_id long, term string"), BOOSTS).count() == 0
    assert ti.term_frequency(none, ("text",)).count() == 0


def test_second_hop_asks_for_what_the_first_names(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "Signing", "Signing uses Paymail or Handcash and Signing"), (2, "Paymail guide", "Paymail resolves names"), (3, "Handcash notes", "Handcash holds coins"), (4, "Other", "nothing here"), (5, "Handcash again", "Handcash Handcash")],
        "doc_id long, title string, text string",
    )
    index = ti.build(docs, ("title", "text"), f"{tmp_path}/hops")
    first = spark.createDataFrame([(7, 1, 1), (8, 1, 4)], "question_id long, rank long, doc_id long")
    covered = spark.createDataFrame([(7, "how does signing work"), (8, "what else")], "question_id long, text string")
    names = ti.named_ids(first, docs, covered, "[A-Z][a-z]{6,}")
    assert rows(names) == [(7, 1, "Paymail"), (7, 2, "Handcash")]
    assert rows(ti.second_hop(index, first, names, {"text": 1.0})) == [(7, 1, 1, 1), (7, 2, 1, 2), (7, 2, 2, 5), (7, 2, 3, 3), (8, 1, 1, 4)]
    assert rows(ti.second_hop(index, first, names.limit(0), {"text": 1.0})) == [(7, 1, 1, 1), (8, 1, 1, 4)]


def test_scores_are_added_up_by_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "SEGMENT", 4)
    monkeypatch.setattr(ti, "QUERIES", 2)
    texts = ["alpha beta", "beta gamma gamma", "alpha alpha delta", "delta", "", None, "gamma beta alpha", "beta gamma gamma"]
    some = [(100 - k, "Beta" if k % 3 else None, texts[k % 8]) for k in range(30)]
    docs = spark.createDataFrame(some, "doc_id long, title string, text string").coalesce(2)
    index = ti.build(docs, ("title", "text"), f"{tmp_path}/segments", 8)
    posted = index.table("postings")
    assert posted.filter("bucket >= 0").count() <= 4 * 2 * 5  # a row a segment and term, not one a document and term
    assert posted.filter("bucket >= 0 and size(at) > 1").count() > 5
    asked = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma"), (2, 1, "delta beta"), (None, 1, "beta"), (3, 1, "alpha gamma delta")], "question_id long, pos int, query string")
    terms = asked.select("question_id", "pos", F.explode(F.split("query", " ")).alias("term"), F.col("pos").cast("double").alias("weight"))
    keys = ("question_id", "pos")
    every = retrieval.bm25(terms, docs.na.fill(""), BOOSTS, keys=keys)
    key = lambda df: sorted(map(tuple, df.select(*keys, "doc_id", "score").collect()), key=repr)
    assert key(ti.search(index, terms, BOOSTS, keys=keys)) == key(every)
    for k in (1, 3, 100):
        assert key(ti.best(index, terms, BOOSTS, k, keys)) == key(retrieval.top(every, k, keys))
    plan = ti.search(index, terms, BOOSTS, keys=keys, most=3)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("question_id")]  # no table of all pairs is dealt out


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (1, "alpha gamma gamma"), (None, "beta"), (None, "beta delta"), (3, "")], "doc_id long, text string")
    index = ti.build(docs, ("text",), f"{tmp_path}/repeated", 8)
    assert index.table("stats").first()[:] == (4, [9]) and rows(ti.term_frequency(index, ("text",))) == [("alpha", 2), ("beta", 2), ("delta", 1), ("gamma", 1)]
    terms = spark.createDataFrame([(1, "beta"), (1, "alpha")], "question_id long, term string")
    found = {r.doc_id for r in ti.best(index, terms, {"text": 1.0}, 5).collect()}
    assert found == {1, 2, None}
