import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit as fa


def slow_fails(docs):
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        out.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy})
    return out


def slow_audit(docs, labels, fails):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows, lost = {}, {}
    for part in {s or "" for _, _, s in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                earlier = {k for k in own if fails[k][f] and k not in left}
                left -= gone
                alone = [k for k in own if [g for g in "ABCDE" if fails[k][g]] == [f]]
                rows[part, order, step] = [len(left), len(gone), len(earlier), len(alone), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
                lost[part, f] = lost.get((part, f), 0) + len(gone)
    return {key: (*r, lost[key[0], key[1][key[2] - 1]]) for key, r in rows.items()}


def sample():
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "Bb", "c%d", "DDD", f"w{k}", "x#"][: r.randint(1, 6)]) for k in range(r.choice([3, 49, 50, 60, 90]))) for _ in range(40)]
    texts += [None, "", " \t\n ", " ", "A" * 5000, *texts[:10], *texts[:10]]
    docs = [(r.choice([k, k, k, None, 7]), t, r.choice(["s", "t", None, ""])) for k, t in enumerate(texts)]
    docs += [docs[0], docs[0]]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, mask int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[f] for f in fa.FIGURES) for r in df.collect()}


def test_every_figure(spark):
    docs, labels = sample()
    got = found(fa.audit(*frames(spark, docs, labels)))
    assert got == slow_audit(docs, labels, slow_fails(docs)) and len(got) == 3 * 600


def test_other_filters_and_many_parts(spark):
    docs = [(k, "x" * (k % 9), f"s{k % 150}") for k in range(900)]
    frame, labels = frames(spark, docs, [(1, 1, 1)])
    got = found(fa.audit(frame, labels, {"S": F.length("text") < 3, "L": F.when(F.length("text") > 1, F.length("text") > 5)}))
    assert len(got) == 150 * 6 * 3
    assert all(sum(got[p, o, s][1] for s in (1, 2, 3)) == sum(got[p, "SLE", s][1] for s in (1, 2, 3)) for p, o, _ in got)
    with pytest.raises(ValueError, match="six"):
        fa.audit(frame, labels, {c: F.lit(True) for c in "ABCDFG"})


def test_steps_are_the_first_failing_filter():
    orders, _, steps = fa.removal_steps(4)
    for k, order in enumerate(orders):
        for mask in range(16):
            first = next((s for s, f in enumerate(order, 1) if mask >> f & 1), np.inf)
            assert steps[mask, k] == first


def test_empty_tables(spark):
    docs, labels = frames(spark, [(1, "x", None)], [(1, 1, 0)])
    assert fa.audit(docs.limit(0), labels).count() == 0
    assert found(fa.audit(docs, labels.limit(0)))["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
