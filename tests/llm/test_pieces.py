import hashlib
import random

import pyarrow as pa
import sentencepiece

from lodestone.llm.piece_bpe import default_path, encode_decode, encode_texts
from tests.llm.test_tokens import TEXTS

MORE = [*(" " * k for k in range(1, 40)), *(f"{' ' * k}a{' ' * k}b {' ' * k}" for k in range(1, 20)), "a▁b", "▁", "▁▁ ▁x", "a  b \n c\n\n d　x\x00y", "<s></s><unk><0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the " * 3000 + "\n", "ab" * 5000]


def texts():
    r = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "thereinonst ", "éàüß ", "a ▁\n\t.", "AaTtHhEe '-,.", "日本語中文 русский"]
    return [t or "" for t in TEXTS] + MORE + ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in alphabets for _ in range(400)]


def test_ids_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    all_texts = texts()
    ids, at = encode_texts(pa.array(all_texts), default_path())
    for t, a, b in zip(all_texts, at, at[1:]):
        assert ids[a:b].tolist() == library.encode(t), repr(t)


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, *MORE])] + [(None, "x", 1), (0, "x", 1), (0, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(x := library.encode(t or "")), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for i, t, _ in rows]
    assert sorted(map(repr, (tuple(r) for r in encode_decode(docs).collect()))) == sorted(map(repr, want))
    assert encode_decode(docs.limit(0)).count() == 0
