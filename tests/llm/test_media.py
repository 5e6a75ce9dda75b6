import hashlib
import random
import zlib

import pytest

from lodestone.llm.common import written
from lodestone.llm.media_chunks import CUT_BITS, GEAR, LEAST, MOST, chunks, gear_cuts, manifests, media_column, media_of, padded, rebuilt, store_media
from tests.llm.test_tokens import TEXTS


def slow_cuts(data):
    h, cuts, last = 0, [], 0
    for k, b in enumerate(data):
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        n = k + 1 - last
        if k + 1 < len(data) and (n >= LEAST and h & ((1 << CUT_BITS) - 1) == 0 or n == MOST):
            cuts.append(k + 1)
            last = k + 1
    return [*cuts, len(data)] if data else []


@pytest.mark.parametrize("seed", range(6))
def test_cuts_equal_the_rolling_hash(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"abcdef") if seed % 2 else r.randrange(256) for _ in range(r.choice([0, 1, 900, 70_000, 150_000])))
    data += b"z" * (100_000 if seed > 3 else 0)
    assert gear_cuts(data) == slow_cuts(data)
    media = media_of(padded(data))
    assert b"".join(chunks(media)) == media


def sample():
    r = random.Random(2)
    common = "".join(r.choice("abcdefghij ") for _ in range(40_000))
    return [*TEXTS, common, common + "more", "less" + common, common[:20_000] + "x" + common[20_000:], common + common]


def test_read_back(spark):
    texts = sample()
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(None, "n", "m"), (50, texts[-1], "m"), (50, texts[-1], "m"), (50, "other", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media_sha256 string")
    got = media_column(docs).collect()
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media_of(p)), hashlib.sha256(media_of(p)).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media_column(docs.limit(0)).count() == 0


def test_chunks_are_stored_once(spark):
    docs = spark.createDataFrame(list(enumerate(sample())), "doc_id long, text string")
    listed = written(manifests(docs), "manifests")
    store = store_media(docs, listed)
    shared = [r.digest for r in store.filter("kind = 'shared'").collect()]
    assert shared and len(shared) == len(set(shared))
    assert rebuilt(store).count() == listed.select("media_sha256").distinct().count()
