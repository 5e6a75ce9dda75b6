import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import packing
from lodestone.llm.packing import pack, sum_of_squares
from tests.llm.test_tokens import TEXTS, library


def slow(lengths, capacity):
    """Every place tried, the whole sum of squares computed for each."""
    gaps, where = [], []
    for s in lengths:
        counts = defaultdict(int)
        for g in gaps:
            counts[g] += 0 < g < capacity
        def total(g):
            c = counts.copy()
            c[g] -= g < capacity
            c[g - s] += g > s
            return sum(x * x for k, x in c.items() if 0 < k < capacity)
        best = min([(total(g), g) for g in sorted(set(gaps)) if g >= s and 0 < g] + [(total(capacity), capacity)], key=lambda x: x[0])
        gap = best[1]
        if gap == capacity:
            gaps.append(capacity - s)
            where.append(len(gaps) - 1)
        else:
            k = max(i for i, g in enumerate(gaps) if g == gap)
            gaps[k] -= s
            where.append(k)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_places_have_the_smallest_sum_of_squares(seed):
    r = random.Random(seed)
    capacity = r.choice([8, 13, 30])
    lengths = [r.randint(1, capacity) for _ in range(60)]
    where, offset = sum_of_squares(np.array(lengths), capacity)
    filled = defaultdict(int)
    for b, o, s in zip(where, offset, lengths):
        assert o == filled[b]
        filled[b] += s
    assert max(filled.values()) <= capacity
    assert sorted(capacity - x for x in filled.values()) == slow(lengths, capacity)


def test_pack_keeps_every_token(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS * 3)] + [(0, "again", 1), (0, "again", 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, offset int"), capacity=64, group_pieces=40).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array([*library(t), 1], "<u4")
        want += [(i, n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 3
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # equal rows, with and without an id, part into groups like any other
    same = pack(spark.createDataFrame([(1, "a b")] * 100 + [(None, "a b")] * 100, "doc_id long, text string"), capacity=64, group_pieces=10).collect()
    groups = Counter(r.sequence_id >> 32 for r in same)
    assert len(same) == 200 and len(groups) > 10 and max(groups.values()) < 40


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "cut_pieces", lambda docs, *a, was=packing.cut_pieces: (seen.append(spark.conf.get(name)), was(docs, *a))[1])
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(5)], "doc_id long, text string")
    assert packing.pack(docs).count() == 5
    assert len(seen) == 1 and int(seen[0]) <= 1_000 and spark.conf.get(name) == before
