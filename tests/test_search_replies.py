import random

from lodestone.operators import conversations as c
from lodestone.operators import evaluation, tiers

FOLD = str.maketrans({"é": "e", "ü": "u", "ã": "a", "ś": "s", "ṃ": "m", "ß": "s"})


def slow_search(messages, queries):
    out = set()
    for q, query in queries:
        terms = {w for w in (query or "").lower().translate(FOLD).split()}
        for conv in {m[0] for m in messages}:
            own = sorted(m for m in messages if m[0] == conv)
            fold = [(turn, text, (text or "").lower().translate(FOLD)) for _, turn, text in own]
            if terms and all(any(w in f for _, _, f in fold) for w in terms):
                turn, text, f = next(x for x in fold if any(w in x[2] for w in terms))
                at = min(f.find(w) for w in terms if w in f)
                out.add((q, conv, turn, text[max(at - 52, 0) :][:104]))
    return out


def test_search_equals_looking_through_all(spark):
    r = random.Random(3)
    words = ["café", "naïve"[:2], "Über", "straße", "paśṃ", "ab", "a", "xyz", "abcab", "😀z", "the"]
    messages = [(k % 9, k, None if k == 5 else " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(60)]
    queries = [(k, " ".join(r.choice(["caf", "afe", "uber", "sTra", "pasm", "b", "ca", "xyz", "zzz", "😀", "e u", "café CAFE"]) for _ in range(r.randint(0, 3)))) for k in range(40)] + [(90, None), (91, " "), (92, "abcabc")]
    found = c.search_threads(spark.createDataFrame(messages, "conv_id long, turn long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
    got = {tuple(x) for x in found.collect()}
    assert got == slow_search(messages, queries) and len(got) > 30
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_objects_know_strings_and_nesting():
    assert c.objects('x {"a": "} { \\" {"} y {"b": {"c": 1}}') == ['{"a": "} { \\" {"}', '{"b": {"c": 1}}']
    assert c.objects('say "x" then {"a":1}') == ['{"a":1}'] and c.objects('a brace { that stays open, {"a":1}') == []
    assert c.objects('{"a": "never ends}') == c.objects("}{") == c.objects("") == []
    assert c.objects('{"a":"\\\\"}') == ['{"a":"\\\\"}']


def test_replies_with_braces_in_strings(spark):
    replies = [(1, '{"verdict":"pass","rewrite":"a { b"}'), (2, '{"verdict":"pass","more":{"x":1}}'), (3, '{"verdict":"pass"} {"verdict":"pass"}'), (4, '{"verdict": "pass"'), (5, '{"verdict": 3 4}'), (6, None)]
    got = {r.reply_id: (r.verdict, r.rewrite, r.reason) for r in c.reply_check(spark.createDataFrame(replies, "reply_id long, reply string")).collect()}
    assert got == {1: ("pass", "a { b", None), 2: ("pass", None, None), 3: (None, None, "more than one object"), 4: (None, None, "no object"), 5: (None, None, "no verdict"), 6: (None, None, "no object")}


def test_rewrites_need_an_anchor_and_citations_a_place(spark):
    reply = lambda rewrite, used="null": f'{{"verdict":"revise","rewrite":"{rewrite}","used":{used}}}'
    rows = [
        (1, reply("banana smoothie recipe"), "What is SPV?", None, 3),
        (2, reply("Digital Asset Recovery (DAR) framework", "[3,1,3,0,4]"), "What is DAR?", None, 3),
        (3, reply("compare the alert key with access rules"), "Is that comparable?", "What was the alert key for?", 0),
        (4, reply("SPV " * 200), "What is SPV?", None, 3),
        (5, reply("SPV proofs"), None, None, 3),
        (6, '{"verdict":"pass","used":[]}', "What is SPV?", None, 3),
    ]
    got = {r.reply_id: (r.rewrite, r.used, r.reason) for r in c.anchored_replies(spark.createDataFrame(rows, "reply_id long, reply string, question string, context string, n_citations int")).collect()}
    assert [got[k][2] for k in range(1, 7)] == ["no anchor", None, None, "rewrite too long", "no anchor", None]
    assert got[2][1] == [3, 1] and got[3][1] is None and got[6][:2] == (None, []) and got[1][0] is None


def test_severity_of_unled_specifications_and_unshared_words(spark):
    runs = [(1, "merkle proof size", True, ["Merkle notes", "proof"], ["essay", "spec"], 9000), (2, "merkle proof size", True, ["Merkle notes"], ["spec"], 9000), (3, "merkle is big", False, ["so big"], ["spec"], 9000)]
    frame = spark.createDataFrame([(i, q, "c", s, t, k, n) for i, q, s, t, k, n in runs], "question_id long, question string, category string, expects_spec boolean, titles array<string>, kinds array<string>, evidence_chars long")
    assert {r.question_id: r.severity for r in evaluation.worst(evaluation.flagged(frame)).collect()} == {1: 80.0, 2: 0.0, 3: 60.0}


def test_sources_in_order(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-02' AS ts UNION ALL SELECT NULL").write.parquet(f"{tmp_path}/a")
    spark.sql("SELECT timestamp_ntz'2024-01-01' AS ts").write.parquet(f"{tmp_path}/b")
    rows = tiers.in_order(tiers.read_each(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b", "c": f"{tmp_path}/c"}, "ts timestamp_ntz")).collect()
    assert [(r.subject, r.ts and r.ts.day) for r in rows] == [("b", 1), ("a", 2), ("a", None)]


def test_cuts_after_any_sentence_mark_and_entities(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as t

    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(tiers.clean_cut(F.lit("What is that? And then more"), 16)) == "What is that?"
    assert one(tiers.clean_cut(F.lit("Stop it now! a. b then more"), 18, "…")) == "Stop it now! a."
    assert one(tiers.clean_cut(F.lit("one two three four five"), 16, "…")) == "one two three…" and one(tiers.clean_cut(F.lit("short"), 16, "…")) == "short"
    assert one(t.decoded(F.lit("&#xe9;&#XE9;&#233; &AMP;lt; &Nbsp;x &#0000065; &#1114112;&#xD800;&#x110000;|&#36;&#92;&bogus;"))) == "éé" + "é &lt;  x A |$\\&bogus;"
    assert one(t.decoded(F.lit(None).cast("string"))) is None and one(t.decoded(F.lit("a & b"))) == "a & b"
