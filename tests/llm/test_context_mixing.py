import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lodestone.llm import context_mixing as cm


def test_code_is_a_prefix_code():
    tree = cm.Tree.of(np.array([random.Random(1).randrange(1, 10**9) for _ in range(900)]), 7, 3)
    paths = [format(int(c), f"0{cm.CODE_BITS}b")[:n] for c, n in zip(tree.code, tree.length)]
    assert len(set(paths)) == 902 and abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-9 and max(tree.length) <= cm.CODE_BITS
    # of the two ways at every node the predictions are each other's negative, so their probabilities add up to one
    by_node = defaultdict(set)
    for p, a in zip(paths, tree.start):
        for d in range(len(p)):
            by_node[p[:d]].add((p[d], float(tree.plain[a + d])))
    assert all(len(ways) == 2 and abs(sum(x for _, x in ways)) < 1e-4 for ways in by_node.values())


def in_a_byte(n):
    """Exact up to 4, then the nearest half of a doubling."""
    return n if n < 4 else min(120, round(4 + 2 * math.log2(n / 4)))


def about(n):
    b = in_a_byte(n)
    return b if b < 4 else 4 * 2 ** ((b - 4) / 2)


def test_counts_along_paths():
    r, tree = random.Random(4), cm.Tree.of(np.array([50, 30, 20, 9, 5, 3, 1, 1]), 4, 2)
    seen = Counter((r.randrange(5), r.randrange(10)) for _ in range(200))
    seen.update({(9, 0): 3, (9, 1): 0, (9, 2): 0, (9, 3): 0, (8, 4): 0, (7, 1): 60, (7, 9): 0, **{(6, s): 0 for s in range(4)}})
    contexts = {k: np.uint64(r.getrandbits(42) << cm.CODE_BITS) for k in range(10)}
    rows = sorted((int(contexts[c] | tree.code[s]), n, c, s) for (c, s), n in seen.items())
    keys, n = np.array([x[0] for x in rows], np.uint64), np.array([x[1] for x in rows], float)
    length = tree.length[[x[3] for x in rows]]
    got, deep = cm.along_paths(keys, n, length)
    path = lambda s: format(int(tree.code[s]), f"0{cm.CODE_BITS}b")[: tree.length[s]]
    for row, (_, _, c, s) in zip(got, rows):
        p = path(s)
        for d in range(len(p)):
            other = p[:d] + ("1" if p[d] == "0" else "0")
            assert row[d] == in_a_byte(sum(m for (k, t), m in seen.items() if k == c and path(t).startswith(other)))
        assert not row[len(p) :].any()
    assert deep.tolist() == [max([0, *(np.flatnonzero(row) + 1)]) for row in got]
    read = np.split(cm.unplaned_paths(cm.path_planes(got, deep, cm.quantised(n)), length), np.cumsum(length + 1)[:-1])
    assert all(x.tolist() == [*row[:k], in_a_byte(own)] for x, row, k, own in zip(read, got.tolist(), length, n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def slow_scores(rows, hot):
    """ln of each text in the tree, and its words behind the escape, by plain loops over exact counts."""
    train = [split(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    top = sorted(count, key=lambda w: (-count[w], w))[:hot]
    tree = cm.Tree.of(np.array([count[w] for w in top]), sum(count[w] for w in count if w not in top), len(train))
    number = {w: k for k, w in enumerate(top)}
    symbol = lambda w: len(top) + 1 if w is None else number.get(w, len(top))
    path = [format(int(c), f"0{cm.CODE_BITS}b")[:n] for c, n in zip(tree.code, tree.length)]
    below = defaultdict(Counter)
    for t in train:
        for k, w in enumerate([*t, None]):
            p = path[symbol(w)]
            for d in range(len(p) + 1):
                for context in (("1", *t[max(0, k - 1) : k]), ("2", *t[max(0, k - 2) : k])):
                    below[context][p[:d]] += 1
    start, out = cm.start_weights(), []
    for _, text in rows:
        t, w, ln = split(text), start.copy(), 0.0
        tokens = [*t, None]
        for b in range(0, len(tokens), cm.BLOCK):
            g = np.zeros_like(w)
            for k in range(b, min(b + cm.BLOCK, len(tokens))):
                s = symbol(tokens[k])
                p = path[s]
                for d in range(len(p)):
                    xs, gate = [float(tree.plain[tree.start[s] + d])], []
                    for context in (("1", *t[max(0, k - 1) : k]), ("2", *t[max(0, k - 2) : k])):
                        n = below[context]
                        beside = [about(n[p[:j]] - n[p[: j + 1]]) for j in range(len(p))] + [about(n[p])]
                        on, at = sum(beside[d + 1 :]), sum(beside[d:])
                        xs.append(math.log((on + cm.ADDED) / (at - on + cm.ADDED)))
                        gate.append(0 if at < 1 else 1 if at < 2 else 2 if at < 4 else 3)
                    row = gate[0] * cm.LEVELS + gate[1]
                    z = max(-30, min(30, float(np.dot(w[row], xs))))
                    ln -= math.log1p(math.exp(-z))
                    g[row] += np.array(xs) / (1 + math.exp(z))
            w = w + np.clip(cm.RATE * g, -cm.MOST_STEP, cm.MOST_STEP)
        out.append((ln, [x for x in t if x not in number]))
    return out, count, len(train)


def test_scores(spark, monkeypatch):
    hot = 40
    monkeypatch.setattr(cm, "HOT_WORDS", hot)
    monkeypatch.setattr(cm, "RANGE_TOKENS", 700)
    r = random.Random(3)
    stems = ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(stems) for _ in range(r.choice([3, 40, 200]))), 1.0) for i in range(40)]
    rows += [(100, None, 1.0), (101, " \n", 1.0), (None, "Été a a", 1.0), (7, rows[7][1], 1.0), (102, "z" * 30000 + " q" * 3000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = cm.score_texts(docs).collect()
    plain, c, ends = slow_scores([x[:2] for x in rows], hot)
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda own: sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[w] for w in own), ends])
    want = Counter((i, held(i), len(split(t)) + 1, sum(c[w] > 0 for w in split(t)) + 1, n, round(base(split(t)), 6)) for i, t, _ in rows)
    assert want == Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got)
    # the tree's part is what plain loops give; behind the escape each word has one probability
    counts = spark.createDataFrame([(w, k) for w, k in c.items() if w not in sorted(c, key=lambda w: (-c[w], w))[:hot]], "word string, c long")
    spelling = cm.fit_spelling(counts)
    words = sorted({w for _, rare in plain for w in rare})
    ln = dict(zip(words, spelling.logs(words).tolist()))
    left = sorted((-1 if i is None else i, (tree + sum(ln[w] for w in rare)) / math.log(10)) for (i, _, _), (tree, rare) in zip(rows, plain))
    for (i, a), b in zip(left, sorted((-1 if x.doc_id is None else x.doc_id, x.score) for x in got)):
        assert i == b[0] and abs(a - b[1]) < 1e-5 * abs(a) + 1e-4, (i, a, b)
    assert cm.score_texts(docs.limit(0)).count() == 0


def test_spelling_is_a_probability_and_its_counts_are_exact(spark):
    r = random.Random(2)
    c = Counter("".join(r.choice("aei") for _ in range(r.randint(1, 3))) for _ in range(300))
    m = cm.fit_spelling(spark.createDataFrame(list(c.items()), "word string, c long"))
    # zeros and ones of each place, by hand
    table = np.zeros((1 << cm.SPELL_BITS, 2))
    for w, k in c.items():
        _, bits, places = m.places([w])
        for p in places:
            np.add.at(table, (p, bits), k)
    assert (cm.quantised(table).astype(int) @ [128, 1] == m.table).all()
    words = ["", *(a for a in "aei"), *(a + b for a in "aei" for b in "aei"), *(a + b + d for a in "aei" for b in "aei" for d in "aei")]
    total = np.exp(m.logs(words)).sum()
    assert 0.8 < total < 1
    # repeated partitions, same weights
    again = cm.fit_spelling(spark.createDataFrame(list(c.items())[::-1], "word string, c long").repartition(5))
    assert np.allclose(again.weights, m.weights)


def test_a_model_of_the_whole_corpus_beats_single_words(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeinrst") for _ in range(5)) for _ in range(300)]
    follow = {w: r.sample(words, 3) for w in words}
    rows = []
    for i in range(120):
        text = [r.choice(words)]
        while len(text) < 150:
            text.append(r.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    got = [x for x in cm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert len(got) > 5 and all(x.score > 0.7 * x.base_score for x in got)


def test_words_are_hashed_from_their_bytes_wherever_a_slice_begins():
    words = ["zero", "a", "ab", "é日", "x" * 40, "ba", "last"]
    hashes = lambda x: cm.Unit(x, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)).hashes()
    whole = hashes(pa.array(words))
    assert len(set(whole.tolist())) == len(words)
    assert hashes(pa.array(words).slice(2, 4)).tolist() == whole[2:6].tolist()
    assert cm.raw_bytes(pa.array(words).slice(2, 2)).tobytes() == "abé日".encode() and len(cm.raw_bytes(pa.array([], pa.string()))) == 0
    assert len(hashes(pa.array([], pa.string()))) == 0


def test_scores_are_the_same_whatever_texts_go_on_together(monkeypatch):
    r = np.random.default_rng(1)
    tree = cm.Tree.of(np.array([50, 30, 20, 5]), 7, 9)
    size = np.array([1, 90, 0, 33, 64, 200, 2])
    at = np.concatenate([[0], np.cumsum(size)])
    s = cm.Symbols(r.integers(0, 6, at[-1]), at, np.ones(at[-1], bool), ())
    first = [k * at[-1] * 8 + np.arange(at[-1]) * 8 for k in (0, 1)]
    x, levels = r.normal(size=at[-1] * 16).astype(np.float32), r.integers(0, cm.LEVELS, at[-1] * 16).astype(np.uint8)
    together = cm.text_scores(s, tree, x, levels, first)
    assert together[2] == 0 and (together[size > 0] < 0).all()
    for texts, chunk in ((1, 60_000), (2, 40), (3, 1)):
        monkeypatch.setattr(cm, "TEXTS", texts)
        monkeypatch.setattr(cm, "CHUNK", chunk)
        assert np.allclose(cm.text_scores(s, tree, x, levels, first), together, rtol=1e-6)
