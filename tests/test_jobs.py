from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import attribution, conversations, corpus_build, evaluation, evidence, retrieval, snapshots
from lodestone.streaming import live


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, t.page_text(lit('<p>A &amp; B</p><script>x("</p>")</script><b>c</b> <x>d</x><br>e &#233;&#8364;'))) == "A & B c <x>d</x> e é€"
    assert one(spark, t.canonical_url(lit("http://WWW.Example.org/a/b//?utm_source=x&q=1&fbclid=2#top"))) == "https://example.org/a/b?q=1"
    assert one(spark, t.canonical_url(lit("https://example.org"))) == "https://example.org/" and one(spark, t.canonical_url(lit("mailto:x"))) == "mailto:x"
    long = "First sentence is rather long and ends here. Version 1. 5 is out and then more words follow until the end of it all"
    assert one(spark, t.clipped(lit(long), 60)) == "First sentence is rather long and ends here."
    assert one(spark, t.clipped(lit("x" * 100), 60)) == "x" * 60 and one(spark, t.clipped(lit("short"), 60)) == "short"
    assert one(spark, t.unquoted(lit("keep\n> quoted\nalso\n-----\nfooter"))) == "keep\nalso"
    assert one(spark, t.repaired(lit("donâ€™t"))) == "don’t"
    assert one(spark, t.normal_question(lit("  What's  THIS? "))) == "whats this"
    assert one(spark, t.subject_terms(lit("Scaling blocks, scaled block sizes"))) == ["scal", "block", "siz"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five six? Seven"), (2, "word " * 30), (3, "x" * 50), (4, ""), (5, None)], "doc_id long, text string")
    got = {}
    for r in corpus_build.chunks(docs, 20).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == ["One two. Three four!", "Five six? Seven"]
    assert all(len(c) <= 20 for cs in got.values() for c in cs) and "".join(got[3]) == "x" * 50 and 4 not in got and 5 not in got
    assert " ".join(got[2]) == ("word " * 30).strip()


def test_robots_and_feeds(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x/y"), (2, "https://a.org/x/z"), (3, "https://a.org/q"), (4, "https://a.org/w/1")], "page_id long, url string")
    rules = [("disallow", "/x"), ("allow", "/x/y"), ("disallow", "/q"), ("allow", "/q")]
    assert {r.page_id: r.allowed for r in corpus_build.robots_verdict(pages, rules, "/w").collect()} == {1: True, 2: False, 3: True, 4: False}
    feed = spark.createDataFrame([(1, '<item><title>T</title><link>http://www.a.org/p/</link><category domain="post_tag">x</category><category>News</category></item>')], "page_id long, xml string")
    r = corpus_build.feed_items(feed).first()
    assert (r.title, r.url, r.tags) == ("T", "https://a.org/p", ["x"])
    matter = spark.createDataFrame([(1, "---\ntitle: A\nthemes: [x, y, x]\n---\nBody"), (2, "Body")], "doc_id long, text string")
    a, b = corpus_build.front_matter(matter).orderBy("doc_id").collect()
    assert (a.title, a.themes, a.prose) == ("A", ["x", "y"], "Body") and b.title is None and b.prose == "Body"


def test_same_stories_equal_all_pairs(spark):
    import random

    r = random.Random(1)
    words = [f"word{k}" for k in range(14)]
    titles = [" ".join(r.sample(words, r.randint(2, 7))) for _ in range(120)]
    got = {(x.a, x.b) for x in corpus_build.same_stories(spark.createDataFrame([(x,) for x in titles * 2], "title string")).collect()}
    keys = sorted({" ".join(sorted(x.split())) for x in titles})
    want = set()
    for a in keys:
        for b in keys:
            x, y = set(a.split()), set(b.split())
            s = len(x & y)
            if a < b and s >= 2 and (s / len(x | y) >= 0.6 or s >= 3 and s / min(len(x), len(y)) >= 0.8):
                want.add((a, b))
    assert got == want


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "fees", "miner fees pay for security of blocks"), (2, "spv", "simplified payment verification needs headers"), (3, "other", "nothing of note here")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "How does payment verification work?"), (2, "miner fees"), (3, "zzzz qqqq")], "question_id long, question string")
    scored = retrieval.bm25(retrieval.query_terms(asked), docs, {"title": 2.0, "text": 1.0})
    best = {r.question_id: r.doc_id for r in retrieval.top(scored, 1).collect()}
    assert best == {1: 2, 2: 1}
    age = lambda d: one(spark, retrieval.age_months(F.lit(d).cast("date"), F.lit("2025-10-14").cast("date")))
    assert [age(d) for d in ("2025-10-14", "2025-09-14", "2025-09-15", "2025-04-14", "2025-03-14", "2024-04-14", "2024-03-14")] == [0, 1, 0, 6, 7, 18, 19] and age(None) == 120
    fresh = lambda m: one(spark, retrieval.freshness(F.lit(m)))
    assert [fresh(m) for m in (6, 7, 18, 19)] == ["current", "ageing", "ageing", "dated"]
    assert [one(spark, retrieval.recency_weight(F.lit(m))) for m in (0, 12, 24)] == [1.0, 0.5, 0.25]
    vocabulary = spark.createDataFrame([("miner",), ("miners",), ("mine",), ("mimer",), ("minning",)], "word string")
    terms = spark.createDataFrame([("miner",), ("min",)], "term string")
    assert {(r.term, r.word) for r in retrieval.prefix_expansions(terms, vocabulary).collect()} == {("miner", "miners"), ("min", "miner"), ("min", "miners"), ("min", "mine"), ("min", "minning")}
    assert {r.word for r in retrieval.fuzzy_expansions(terms, vocabulary).collect()} == {"miners", "mine", "mimer"}


def test_snapshot_merge(spark):
    item = lambda pos, i, url, date, modified=None, tags=(): (pos, i, url, f"t{pos}", date, modified, list(tags), "An excerpt")
    schema = f"pos long, {snapshots.ITEM}"
    old = spark.createDataFrame([item(0, "a", "https://x.org/a", "2024-01-01", tags=["k"]), item(1, "b", "https://x.org/b", "2024-02-01"), item(2, "c", "https://x.org/c", "2024-03-01")], schema)
    new = spark.createDataFrame([item(0, "a", "https://x.org/a", "2024-01-01", "2024-05-01"), item(1, "b2", "https://x.org/b", "2024-02-01"), item(2, "d", "https://x.org/d", "2024-04-01")], schema)
    merged = snapshots.merged(old, new)
    got = {r.id: r for r in merged.collect()}
    assert set(got) == {"a", "b2", "c", "d"} and got["a"].tags == ["k"] and got["a"].modified == "2024-05-01"
    again = snapshots.merged(merged.withColumn("pos", F.lit(0)).drop("incoming"), new)
    assert {(r.id, r.title) for r in again.collect()} == {(r.id, r.title) for r in merged.collect()}
    kept = lambda first, last, whole: {r.id for r in snapshots.covered_deletes(merged, new, first, last, whole).collect()}
    assert kept("2024-01-01", "2024-12-31", True) == {"a", "b2", "d"}
    assert kept("2024-04-01", "2024-12-31", True) == kept("2024-01-01", "2024-12-31", False) == {"a", "b2", "c", "d"}
    seen = spark.createDataFrame([("a", "2023-01-01"), ("c", "not a day"), ("d", "2099-01-01"), ("gone", "2020-01-01")], "id string, first_seen string")
    first = {r.id: str(r.first_seen) for r in snapshots.first_seen(merged, seen, "2024-06-01").collect()}
    assert first == {"a": "2023-01-01", "b2": "2024-06-01", "c": "2024-06-01", "d": "2024-06-01"}


def test_snapshot_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "http://www.x.org/a/", " t ", "2024-01-01", "", ["k"], "e"), ("", "u", "t", "d", None, [], "e")], snapshots.ITEM)
    good = snapshots.required(rows)
    assert [(r.id, r.url, r.title, r.modified) for r in good.collect()] == [("a", "https://x.org/a", "t", None)]
    path = snapshots.write_snapshot(good, str(tmp_path / "s"), "1")
    assert spark.read.parquet(path).count() == 1
    try:
        snapshots.write_snapshot(good.limit(0), str(tmp_path / "s"), "2")
        raise AssertionError("an empty snapshot was written")
    except ValueError:
        pass
    assert snapshots.read_snapshot(spark, None).count() == 0
    (tmp_path / "c.json").write_text('{"pin": {"commit": "x"}, "documents": [{"id": "a", "url": "u"}, {"id": "b"}]}')
    assert [r.id for r in snapshots.read_snapshot(spark, str(tmp_path / "c.json")).collect()] == ["a", "b"]


def test_conversations(spark):
    rows = [(1, 0, "user", "What is A?"), (1, 1, "assistant", "Cafe naïve [1]"), (1, 2, "user", "what is a"), (1, 3, "assistant", " "), (1, 4, "user", "And B?"), (2, 0, "robot", "x"), (2, 1, "user", None), (1, 0, "user", "Z")]
    m = conversations.valid_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert m.count() == 5
    assert [r.text for r in conversations.cleaned(m).orderBy("turn").collect()] == ["What is A?", "Cafe naïve", "what is a", "And B?"]
    assert [(r.conv_id, r.turn) for r in conversations.asked_before(m).collect()] == [(1, 2)]
    assert {r.turn: r.prior for r in conversations.with_prior_question(m).collect()} == {0: None, 2: "What is A?", 4: "what is a"}
    assert {r.turn for r in conversations.context_window(m, 10, 12).collect()} == {2, 3}
    found = conversations.search_threads(m, spark.createDataFrame([(1, "café NAIVE"), (2, "cafe missing")], "query_id long, query string")).collect()
    assert [(r.query_id, r.conv_id, r.turn) for r in found] == [(1, 1, 1)]
    assert conversations.export(m).first().markdown.startswith("# What is A?\n\n## User\n\nWhat is A?\n\n## Assistant")
    replies = spark.createDataFrame([(1, 'x {"verdict": "pass"} y'), (2, '{"verdict":"revise","rewrite":" "}'), (3, "none"), (4, '{"verdict":"pass"}{"verdict":"pass"}'), (5, None)], "reply_id long, reply string")
    assert {r.reply_id: (r.verdict, r.reason) for r in conversations.reply_check(replies).collect() if r.reply_id < 5} == {1: ("pass", None), 2: (None, "no rewrite"), 3: (None, "no object"), 4: (None, "more than one object")}


def test_attribution(spark):
    answers = spark.createDataFrame([(1, "merkle trees prove inclusion cheaply"), (2, "unrelated words entirely"), (3, "alone")], "answer_id long, answer string")
    cites = spark.createDataFrame([(1, 1, "merkle trees prove things"), (1, 2, "gold price news"), (2, 1, "nothing shared"), (2, 2, "neither this"), (3, 1, "single one")], "answer_id long, n long, source string")
    got = {(r.answer_id, r.n): (r.usage, r.kept) for r in attribution.usage(cites, answers).collect()}
    assert got == {(1, 1): (7, True), (1, 2): (0, False), (2, 1): (0, True), (2, 2): (0, True), (3, 1): (0, True)}
    urls = spark.createDataFrame([(1, "https://www.a.b.org/x"), (2, "https://b.org"), (3, "https://q.co.uk/")], "page_id long, url string")
    assert {r.page_id: r.label for r in attribution.source_label(urls, {"b.org": "B", "a.b.org": "A"}).collect()} == {1: "A", 2: "B", 3: "co"}


def test_evidence(spark):
    rows = [(1, k, k, f"title {k // 2}", f"excerpt words number {k // 2} alpha beta", "essay", f"th{k % 2}", "s", False) for k in range(1, 9)] + [(1, 9, 9, "last", "primary source text", "primary", "th1", "s", False)]
    c = spark.createDataFrame(rows, "question_id long, doc_id long, rank long, title string, excerpt string, tier string, theme string, series string, on_subject boolean")
    assert [r.doc_id for r in evidence.deduplicated(c).orderBy("place").collect()] == [1, 9] or [r.doc_id for r in evidence.deduplicated(c, 0.99).orderBy("place").collect()] == [1, 2, 4, 6, 8, 9]
    assert [r.doc_id for r in evidence.diversified(c).orderBy("place").collect()] == [1, 2, 9]
    assert {r.doc_id for r in evidence.slots(c, {"essay": 2, "primary": 1}).collect()} == {1, 2, 9}
    pairs = spark.createDataFrame([(1, "One two. Three four five.", "One two! Six.")], "key long, a string, b string")
    assert evidence.merged_prose(pairs).first().prose == "One two. Three four five. Six."


def test_evaluation(spark):
    runs = spark.createDataFrame([(1, "merkle proof", "c", True, [], [], 0), (2, "merkle proof", "c", True, ["About merkle"], ["essay"], 9000), (3, "merkle proof", "d", False, ["Other"], ["spec"], 10)], "question_id long, question string, category string, expects_spec boolean, titles array<string>, kinds array<string>, evidence_chars long")
    f = evaluation.flagged(runs)
    assert {r.question_id: r.flags for r in f.collect()} == {1: ["NONE", "THIN", "NO-SPEC-FOR-MECHANISM"], 2: ["NO-SPEC-FOR-MECHANISM", "ESSAY-ONLY"], 3: ["THIN", "TITLE-MISMATCH"]}
    assert [r.question_id for r in evaluation.worst(f).collect()] == [1, 3, 2]
    cases = spark.createDataFrame([(1, "Merkle trees", ["merkle"], ["gold"], 5, True), (2, "gold", ["merkle"], ["gold"], 50, False)], "question_id long, answer string, must_mention array<string>, must_not_mention array<string>, min_chars int, guard boolean")
    r = evaluation.rubric(cases)
    assert {x.question_id: x.failed for x in r.collect()} == {1: 0, 2: 3} and evaluation.rubric_totals(r).first().ok


def test_live(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=10 * k), ["up", "down"][k % 3 == 0], ["mcp", None][k % 4 == 0]) for k in range(60)]
    ratings = spark.createDataFrame(rows, "ts timestamp, rating string, mode string")
    ratings.write.parquet(str(tmp_path / "events.parquet"))
    batch = {tuple(r) for r in live.tallies(ratings, "1 minute").collect()}
    stream = live.event_stream(spark, str(tmp_path / "events.parquet"))
    assert {tuple(r) for r in live.drained(live.tallies(stream, "1 minute"), "update", ["window_start", "mode"], str(tmp_path)).collect()} == batch
    assert {r.mode: r.up + r.down for r in live.totals(ratings).collect()} == {"mcp": 45, None: 60}
    answers = spark.createDataFrame([("k", start + timedelta(hours=h), h) for h in (0, 3, 6, 8, 11, 12, 20)] + [("q", start, 99)], "key string, ts timestamp, change_id long")
    assert {r.change_id for r in live.first_within_ttl(answers).collect()} == {0, 6, 12, 20, 99}
    steps = spark.createDataFrame([(1, s, start + timedelta(hours=k)) for k, s in enumerate(["paid", "quoted", "paid", "paid", "delivered"])], "key long, status string, ts timestamp")
    steps.write.parquet(str(tmp_path / "steps.parquet"))
    r = live.drained(live.purchase_states(live.event_stream(spark, str(tmp_path / "steps.parquet"))), "update", ["key"], str(tmp_path)).first()
    assert (r.status, r.rejected) == ("delivered", 2)
    assert one(spark, live.price(F.lit(10), 50.0)) == 22223
