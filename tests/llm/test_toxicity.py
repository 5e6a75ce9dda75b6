import itertools
import math
import random

from lodestone.llm.toxicity import BEST, CharModel, EDGE, decode, keep_clean, lattice, score, train, trigrams


def model():
    words = {"the": 500, "idiot": 40, "moron": 40, "stupid": 40, "loser": 40, "world": 60, "hello": 60, "good": 60, "dog": 60, "little": 40}
    counts = {}
    for w, n in words.items():
        for g in trigrams(w):
            counts[g] = counts.get(g, 0) + n
    return CharModel(counts)


def slow(word, m, spaced=False):
    found = {}
    for ways in itertools.product(*lattice(word, spaced)):
        at, p, read = EDGE * 2, 0.0, ""
        for text, cost in ways:
            p += cost
            for c in text:
                p += m.logp(at + (EDGE if c == " " else c))
                at = EDGE * 2 if c == " " else at[1] + c
            read += text
        p += m.logp(at + EDGE)
        found[read] = max(found.get(read, -math.inf), p)
    return sorted(found, key=lambda r: (-round(found[r], 9), r)), found


def test_viterbi_equals_the_whole_lattice():
    m = model()
    for word in ("1d10t", "m0r0nnnn", "s.t.u.p.i.d", "5tup1d", "looooser", "g00d", "x", "|!ttle"):
        ranked, _ = slow(word, m)
        assert decode(word, m)[0] == ranked[0].strip()
    ranked, _ = slow("thedog", m, True)
    assert decode("thedog", m, True)[0] == ranked[0].strip()


def test_hidden_words_are_restored():
    m = model()
    for hidden, word in (("1d10t", "idiot"), ("m0r0nnnn", "moron"), ("s.t.u.p.i.d", "stupid"), ("5tup1d", "stupid"), ("looooser", "loser"), ("i-d-i-o-t", "idiot")):
        assert word in decode(hidden, m)[:BEST]


def test_training_and_scores(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aeiounrstl") for _ in range(r.randint(2, 7))) for _ in range(300)]
    bad = ["idiot", "moron", "stupid"]
    hide = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w.replace("o", "ooooo").replace("u", "uuuu")]
    rows, labels = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(hide if i > 100 else hide[:1])(r.choice(bad)))
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, "x", 0.5), (1002, "a" * 30000 + " 1" * 5000 + " a b" * 3000, 0.5), (5, rows[5][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (1003, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    m = train(docs, known)
    got = score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    held = [(x.predicted, labels[x.doc_id][1]) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = keep_clean(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(not x.predicted for x in got)
    none = train(docs, known.limit(0))
    assert {x.score for x in score(docs, none).collect()} == {0.5}
    assert score(docs.limit(0), m).count() == 0
