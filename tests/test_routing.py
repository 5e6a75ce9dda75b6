from pyspark.sql import functions as F

from lodestone.operators import retrieval, routing
from lodestone.plans import routing as plans

Q = "question_id long, question string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_generic_stems_go_and_an_unseen_one_dominates(spark):
    docs = spark.createDataFrame([("scheme block chain",)] * 9 + [("scheme whale",)], "text string")
    asked = spark.createDataFrame([(1, "ponzi scheme"), (2, "block"), (3, "whale scheme"), (4, "ponzi whale"), (5, None), (6, "")], Q)
    got = rows(routing.subject_lexicon(asked, docs, least_docs=3, share=0.5))
    assert got == [(1, "ponzi", 0, True), (2, "block", 9, False), (3, "whale", 1, True), (4, "ponzi", 0, True), (4, "whale", 1, True)]
    # with a high bar for generic stems, the unseen one alone decides
    assert rows(routing.subject_lexicon(asked.filter("question_id = 1"), docs, least_docs=8, share=2.0)) == [(1, "ponzi", 0, True)]


def test_routes(spark):
    cases = {"any news today": True, "who made the news": False, "the work of apps": True, "the apps": False, "work of 2024": True, "": False, None: False}
    df = spark.createDataFrame([(t,) for t in cases], "q string")
    got = {r.q: r.news for r in df.select("q", routing.asks_for_news(F.col("q"), plans.VETOES, plans.STRONG, plans.NAMED, plans.ACTIVITY, plans.YEAR).alias("news")).collect()}
    assert got == cases
    one = spark.sql("SELECT 'blocks in apps for x' AS q")
    found = one.select(routing.catalogue_kinds(F.col("q"), {"a": "apps", "b": "blocks", "c": "orgs"}, "a"), routing.catalogue_kinds(F.col("q"), {"c": "orgs"}, "a"), routing.sole_category(F.col("q"), {"a": "apps", "c": "orgs"}), routing.sole_category(F.col("q"), {"a": "apps", "b": "blocks"})).first()
    assert tuple(found) == (["a", "b"], ["a"], "a", None)


def test_locators_without_index_are_null(spark):
    loc = spark.createDataFrame([(1, "spec://7"), (2, "spec://8"), (3, "repo://r/a/b.ts"), (4, "repo://none/a"), (5, "http://x.example"), (6, None), (7, "spec://7/x"), (8, "spec://007")], "doc_id long, locator string")
    numbers, names = spark.createDataFrame([(7, "seven.md"), (7, "z.md"), (None, "no.md")], "number long, path string"), spark.createDataFrame([("r", "o/r")], "name string, full_name string")
    got = rows(routing.located(loc, numbers, names, "https://s/", "https://c/"))
    assert got == [(1, "https://s/seven.md"), (2, None), (3, "https://c/o/r/a/b.ts"), (4, None), (5, "http://x.example"), (6, None), (7, None), (8, "https://s/seven.md")]


def test_evidence_is_appended_in_order(spark):
    ev = lambda *r: spark.createDataFrame(r, "question_id long, pos long, doc_id long")
    modes = spark.createDataFrame([(1, "answer"), (2, "none"), (3, "none")], "question_id long, mode string")
    got = rows(routing.appended(ev((1, 1, 10), (1, 2, 11)), modes, ev((1, 1, 20)), [ev((2, 1, 30)), ev((1, 1, 40))]))
    assert got[:5] == [(1, "answer", 1, 0, 20), (1, "answer", 2, 1, 10), (1, "answer", 3, 1, 11), (1, "answer", 4, 3, 40), (2, "reference", 1, 2, 30)]
    assert got[5:] == [(3, "none", None, None, None)]


def test_samples_differ_from_the_last(spark):
    pool = spark.createDataFrame([(i,) for i in [*range(30), 5, None]], "item long")
    sessions = spark.createDataFrame([(1,), (2,), (2,), (None,)], "session long")
    first = retrieval.seeded_sample(pool, sessions, 4, 3)
    again = retrieval.seeded_sample(pool, sessions, 4, 3, last=first.filter("session = 1"))
    a, b = ({s: {r.item for r in df.collect() if r.session == s} for s in (1, 2)} for df in (first, again))
    assert all(len(x) == 4 for x in [*a.values(), *b.values()]) and a[1] != b[1] and a[2] == b[2]
    assert first.count() == 8
    few = retrieval.seeded_sample(pool.filter("item < 3"), sessions, 4, 3, last=first)
    assert few.count() == 6 and retrieval.seeded_sample(pool.limit(0), sessions, 4, 3).count() == 0
