import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import byte_bpe
from tests.llm.test_tokens import TEXTS

PATH = byte_bpe.default_path()
ODD = ["a  b", "x　 y", "café été, × ÷,a", "don't we'll I'M it's's", "\x1c \x1f x", "é é", "١٢ 3½", "<|endoftext|> x", " \n" * 400, "x" * 60_000, "ab" * 3000]


def library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    alphabets = ["abcdefgh ", "  \t\n 　\x85  ab", "éàüß ×÷x,", "'st re ve'll I'm", "日本語 русский ٣4", "0123456789 .,!?", "thereinonst ", "aaaaa"]
    return [t or "" for t in TEXTS] + ODD + [" " * k for k in range(30)] + ["".join(r.choice(a) for _ in range(r.randint(0, 70))) for a in alphabets for _ in range(250)]


@pytest.mark.parametrize("name", [byte_bpe.NAME, "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(name):
    all_texts, path = texts(), public_tokenizers.path(name)
    ids, at = byte_bpe.encode_texts(pa.array(all_texts), path)
    want = library(name)
    for t, a, b in zip(all_texts, at, at[1:]):
        assert ids[a:b].tolist() == want.encode_ordinary(t), repr(t)
    assert byte_bpe.decode_ids(ids.astype("int64"), at, path) == [t.encode() for t in all_texts]


def test_slices_of_an_array_and_none():
    part = pa.array(["left out", "a b", "", "c, d", "left out"]).slice(1, 3)
    ids, at = byte_bpe.encode_texts(part, PATH)
    want = library(byte_bpe.NAME)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [want.encode_ordinary(t) for t in part.to_pylist()]
    for empty in (pa.array([], pa.string()), pa.array(["", ""])):
        ids, at = byte_bpe.encode_texts(empty, PATH)
        assert not len(ids) and at.tolist() == [0] * (len(empty) + 1)


def test_the_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 5, 5000):
        keys = [b"key %d" % k for k in range(n)]
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.slot(k) for k in keys) == list(range(n))


def test_merges_take_the_leftmost_of_equal_ranks():
    enc = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    want = library(byte_bpe.NAME)
    r = random.Random(7)
    for _ in range(2000):
        piece = "".join(r.choice("aabé") for _ in range(r.randint(1, 40)))
        ids = enc.merge(piece.encode())
        # the library gives a whole token where there is one; merges needn't arrive there
        assert enc.lookup(piece.encode()) >= 0 or ids == want.encode_ordinary(piece)


def test_rows(spark):
    want = library(byte_bpe.NAME)
    rows = [(i, t, 7) for i, t in enumerate([*TEXTS, *ODD])] + [(None, "x", 1), (0, "x", 1), (0, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in found) == sorted((repr(i), want.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, [1 << 20])], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(broken.filter("doc_id = 1")).first().decoded) == b""
    with pytest.raises(Exception, match="vocabulary lacks"):
        byte_bpe.decode(broken).collect()


def test_query(spark, tmp_path):
    want, sha = library(byte_bpe.NAME), lambda x: hashlib.sha256(x).hexdigest()
    docs = [(1, "Hello, world"), (2, None), (3, " été\n\n x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in byte_bpe.op11_perfect_hash_bytes(spark, str(tmp_path)).collect()}
    assert got == {(i, len(x := want.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in docs}
