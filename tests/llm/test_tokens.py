import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import word_bpe
from lodestone.llm.common import new_path
from lodestone.llm.token_counts import count_tokens, missing, read_cache

TEXTS = ["", None, " \t\n", "One two, three. Don't!", "a<|endoftext|>b <|startoftext|>", "Straße İstanbul ΣΊΣΥΦΟΣ ﬁ ½ x y　z", "été ́x", "one  two,\nthree. don't!", "日本語 🙂🙂 123 4.5", "word " * 5000, "x" * 20000, "A.. b,, c.,", "Éaux. ÉAUX, éaux"]


def library(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library_and_the_cache_is_reused(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 7), (None, "no id", 7), (99, TEXTS[9], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = new_path(spark, "cache")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, cache).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), (n := len(library(t))), n > 2048) for i, t, _ in rows)
    assert got == want
    kept = read_cache(spark, cache).count()
    assert kept == read_cache(spark, cache).select("digest").distinct().count()
    again = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, cache).collect())
    assert again == want and read_cache(spark, cache).count() == kept
    assert count_tokens(docs.limit(0), cache).count() == 0


def test_ids_equal_the_library():
    import pyarrow as pa

    ids, at = word_bpe.text_ids(pa.array([t or "" for t in TEXTS]), word_bpe.default_path())
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in TEXTS]


def test_missing_texts_are_shuffled_once(spark):
    rows = [(1, "a b", "p"), (1, "a b", "p"), (2, "a b", "p"), (None, "c", "q"), (None, "c", "q"), (3, "d", "r"), (4, "d", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    keyed = docs.selectExpr("doc_id", "sha2(text, 256) AS digest")
    known = keyed.filter("doc_id = 3").select("digest")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = missing(docs.select("doc_id", "text"), keyed, known)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("Exchange")  # nothing is dealt out anew behind the join
        assert sorted(r.text for r in found.collect()) == ["a b", "c"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_are_encoded_together():
    import pyarrow as pa

    words = word_bpe.WordTokens(word_bpe.default_path())

    class Counted:
        calls = 0

        def encode(self, *a, was=words.tokenizer, **k):
            Counted.calls += 1
            return was.encode(*a, **k)

    words.tokenizer = Counted()
    odd = [f"x{k}-y!!" for k in range(500)] + ["<|endoftext|>", "a<|startoftext|>b", "don't", "\x00", "ﬁ½", "́x"]
    plain = [w for k in range(500) for w in (f"wo{'abcdefghij'[k % 10] * (k % 7)}", f"Wo{chr(224 + k % 20)}.", f"É{chr(97 + k % 26)},")]
    some = sorted({*odd, *plain})
    whole = Tokenizer.from_file(word_bpe.default_path())
    want = [whole.encode(w, add_special_tokens=False).ids for w in some]
    for _ in range(2):  # the second time from what is kept
        ids, at = words.of(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert Counted.calls < 20
    ids, at = words.of(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]
