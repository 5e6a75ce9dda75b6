import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from lodestone.llm import spelling_variants as sv


def runs(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def slow_counts(docs, damage=199):
    found = Counter()
    for i, text in docs:
        for w in runs(text):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return found


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(words, times=5):
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= times * words[w] else None for w in words}
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return rows


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_letter_runs():
    texts = ["Abé× c,ÀB1xĀy", "", "€", "zz", "éABC"]
    values, at = sv.letter_runs(pa.array(["no", *texts]).slice(1))
    assert [[v.decode() for v in values[a:b].to_pylist()] for a, b in zip(at, at[1:])] == [runs(t) for t in texts]
    assert sv.letter_runs(pa.array([], pa.string()))[1].tolist() == [0]


def test_counts_with_damage(spark):
    r = random.Random(1)
    docs = [(r.choice([None, 1, 2, 77, -5]), " ".join("".join(r.choice("abABé") for _ in range(r.randint(1, 8))) for _ in range(60))) for _ in range(80)] + [(3, None), (4, ""), (4, ""), (5, "x" * 40_000)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int")
    for damage in (199, 3):
        want = {w: n for w, n in slow_counts(docs, damage).items() if len(w) >= 3 and n >= 2}
        assert {r.word: r.n for r in sv.word_counts(frame, 3, 2, damage).collect()} == want
    assert sv.word_counts(frame.limit(0)).count() == 0


def test_all_neighbours_and_forms(spark):
    r = random.Random(2)
    words = {}
    while len(words) < 400:
        words["".join(r.choice("aabéz") for _ in range(r.randint(1, 6)))] = r.choice([5, 5, 6, 25, 30, 130, 700, 4000])
    for _ in range(60):  # long ones, whose nodes are numbered from a table, and their neighbours
        w = "".join(r.choice("abÿ") for _ in range(r.randint(8, 30)))
        k = r.randrange(len(w))
        words |= {w: r.choice([5, 30]), w[:k] + w[k + 1 :]: r.choice([5, 30, 200]), w[:k] + "c" + w[k + 1 :]: 5, w[:k] + "d" + w[k:]: 6, w[:k] + w[k] + w[k:]: 5}
    words |= {"q" * 3000: 5, "q" * 2999: 5, "q" * 1500 + "r" + "q" * 1499: 30}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    links = [(x.word, x.other) for x in sv.neighbours(frame).collect()]
    assert len(links) == len(set(links)) and set(links) == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert rows_of(sv.group_variants(frame)) == slow_variants(words)


def test_a_long_chain_of_forms(spark):
    words = {"abcdef" + "x" * k: 5 ** (k + 1) for k in range(12)}
    got = rows_of(sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == slow_variants(words) and {r[2] for r in got} == {"abcdef" + "x" * 11}


def test_query(spark, tmp_path):
    r = random.Random(4)
    base = ["kitten", "mitten", "sitting", "colour", "coloré", "Colorés", "abc", "government"]
    docs = [(i, " ".join(r.choice(base) for _ in range(300))) for i in range(60)] + [(60, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {w: n for w, n in slow_counts(docs).items() if len(w) >= 6 and n >= 5}
    assert rows_of(sv.op12_trie_pair_variants(spark, str(tmp_path))) == slow_variants(want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sv.variants(none).count() == 0
