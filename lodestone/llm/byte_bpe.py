"""Byte-level BPE: whole pre-tokens through a minimal perfect hash of the vocabulary, the rest by a heap over linked bytes.

The pattern's matches never go on where white space follows another character, or anything but a letter follows a letter.
Texts are cut there into chunks without being copied, and each distinct chunk of a slice is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, documents, kept, slices, whole_text

NAME = "byte_bpe_50k.tiktoken"
#: Bytes of chunks kept for reuse in one Python worker; beyond that the store starts anew. No result depends on it.
KEPT_BYTES = 24 << 20
#: Ids that a task decodes at a time (a row at least).
SOME_IDS = 1 << 19
#: Keys of one bucket of the perfect hash, in the mean.
BUCKET = 4
WORD = (1 << 64) - 1
_visible, _letter, _ascii = np.zeros(256, bool), np.zeros(256, bool), np.arange(256) < 128
_visible[0x21:0x80] = True
_letter[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes of the letters U+00C0 to U+00FF; two of these characters are signs.
_latin = np.zeros(256, bool)
_latin[0x80:0xC0] = True
_latin[[0x97, 0xB7]] = False


def default_path() -> str:
    return public_tokenizers.path(NAME)


class PerfectHash:
    """A minimal perfect hash: n keys have the slots 0 to n - 1, one each. Buckets of keys, the largest first, get the first
    displacement that moves all their keys to free slots. A key that isn't one of the n gets some slot too."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // BUCKET))
        of: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh3_128_intdigest(k)
            of[(h >> 64) % self.buckets].append((h & WORD, h >> 64 | 1))
        free, shifts = np.ones(n, bool), [0] * self.buckets
        for b in sorted(range(self.buckets), key=lambda b: -len(of[b])):
            if not of[b]:
                break
            base, step = np.array(of[b], np.uint64).T
            some, begin = 64 if len(base) > 1 else 4096, 0
            while True:
                slots = self.places(base, step, np.arange(begin, begin + some, dtype=np.uint64)[:, None])
                fit = free[slots].all(1)
                for k in np.flatnonzero(fit).tolist() if len(base) > 1 else [int(fit.argmax())] * bool(fit.any()):
                    if len(set(slots[k].tolist())) == len(base):
                        break
                else:
                    begin += some
                    if begin > 1000 * n + some:
                        raise ValueError("two keys with one hash")
                    continue
                break
            free[slots[k]] = False
            shifts[b] = begin + k
        self.shift = shifts

    def places(self, base: np.ndarray, step: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return ((base + shift * step >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """A hash's upper half tells the bucket; the lower is a place on a ring of 64 bits, from where the displacement goes on."""
        h = xxhash.xxh3_128_intdigest(key)
        far = h >> 64
        return (((h + self.shift[far % self.buckets] * (far | 1) & WORD) >> 32) * self.n) >> 32


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.hash = PerfectHash([t for t, _ in ranks])
        self.token: list[bytes] = [b""] * len(ranks)
        self.rank = [0] * len(ranks)
        self.bytes_of: dict[int, bytes] = {}
        self.longest = max(len(t) for t, _ in ranks)
        for t, r in ranks:
            s = self.hash.slot(t)
            self.token[s], self.rank[s], self.bytes_of[r] = t, r, t
        self.of_byte = [self.lookup(bytes([x])) for x in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("the vocabulary lacks a byte")
        known = {t: r for t, r in ranks}
        #: What two neighbouring tokens make, by both ranks: every way in which a token is cut into two tokens.
        self.pairs = {known[t[:k]] << 32 | known[t[k:]]: r for t, r in ranks for k in range(1, len(t)) if t[:k] in known and t[k:] in known}
        size = np.zeros(max(self.bytes_of) + 1, np.int64)
        size[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.pool = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), np.uint8)
        self.matches = regex.compile(pattern).findall
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0

    def lookup(self, piece: bytes) -> int:
        """The rank of a piece of the vocabulary, else -1."""
        if len(piece) > self.longest:
            return -1
        s = self.hash.slot(piece)
        return self.rank[s] if self.token[s] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that isn't in the vocabulary: its bytes are linked, and a heap holds the pairs of neighbours by
        the rank of what they make, of equal ranks the leftmost. A pair whose ends have changed meanwhile is passed over."""
        n, pairs = len(piece), self.pairs.get
        ids = list(map(self.of_byte.__getitem__, piece))
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | a for a, (x, y) in enumerate(zip(ids, ids[1:])) if (r := pairs(x << 32 | y)) is not None]
        heapify(heap)
        while heap:
            e = heappop(heap)
            r, a = e >> 32, e & 0xFFFFFFFF
            # a token that was merged into its left neighbour is -1, so it makes no pair
            if (b := right[a]) == n or pairs(ids[a] << 32 | ids[b]) != r:
                continue
            ids[a], ids[b], right[a] = r, -1, (c := right[b])
            if c < n:
                left[c] = a
                if (made := pairs(r << 32 | ids[c])) is not None:
                    heappush(heap, made << 32 | a)
            if (c := left[a]) >= 0 and (made := pairs(ids[c] << 32 | r)) is not None:
                heappush(heap, made << 32 | c)
        return [i for i in ids if i >= 0]

    def chunk(self, raw: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of some text."""
        if raw.isalpha() or raw[:1] == b" " and raw[1:].isalpha():
            pieces = [raw]  # ASCII letters, perhaps after a space, are one match
        else:
            pieces = [match.encode() for match in self.matches(raw.decode())]
        ids: list[int] = []
        for piece in pieces:
            if (r := self.lookup(piece)) >= 0:
                ids.append(r)
            else:
                ids += self.merge(piece)
        return pack(f"<{len(ids)}I", *ids)

    def of(self, chunks: list[bytes]) -> list[bytes]:
        out = []
        for raw in chunks:
            found = self.chunks.get(raw)
            if found is None:
                found = self.chunk(raw)
                if len(raw) <= 64:
                    if self.held > KEPT_BYTES:
                        self.chunks.clear()
                        self.held = 0
                    self.chunks[raw] = found
                    self.held += len(raw) + len(found)
            out.append(found)
        return out


def encoder(path: str, pattern: str) -> ByteEncoder:
    """One per Python worker, kept between tasks that name it."""
    name = f"{path}\n{pattern}"
    if name not in kept:
        kept[name] = ByteEncoder(path, pattern)
    return kept[name]


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' bytes, cut (without a copy) before each space that follows a character other than white space, and before
    each ASCII character other than a letter that follows a letter; and where each text's chunks begin. Which characters
    that aren't ASCII are white space or letters is asked of U+00C0 to U+00FF only; after others there is no cut."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    letter, visible = _letter[data], _visible[data]
    latin = data[:-1] == 0xC3
    visible[1:] |= latin
    letter[1:] |= latin & _latin[data[1:]]
    begins = letter[:-1] & _ascii[data[1:]] & ~letter[1:] | visible[:-1] & (data[1:] == 0x20)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = begins
    cut[at - at[0]] = True
    cuts = np.flatnonzero(cut)
    own = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    return own, np.searchsorted(cuts, at - at[0])


def encode_texts(texts: pa.Array, path: str, pattern: str = public_tokenizers.PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and where each text's ids begin."""
    values, at = chunks(texts)
    codes, distinct = coded(values)
    ids = encoder(path, pattern).of(distinct.to_pylist())
    size = np.array([len(x) >> 2 for x in ids], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(size[codes])])
    pool = np.frombuffer(b"".join(ids), "<u4")
    return pool[np.repeat(first[codes] - ends[:-1], size[codes]) + np.arange(ends[-1])], ends[at]


def decode_ids(ids: np.ndarray, at: np.ndarray, path: str, pattern: str = public_tokenizers.PATTERN) -> list[bytes]:
    """The bytes of each run of ids; at: where the runs begin (one more entry than runs)."""
    enc = encoder(path, pattern)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(enc.first) - 1):
        raise ValueError("an id that the vocabulary lacks")
    size = enc.first[ids + 1] - enc.first[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = enc.pool[np.repeat(enc.first[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    return [raw[i:j] for i, j in zip(ends[at].tolist(), ends[at][1:].tolist())]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs (doc_id, text; other columns are ignored).

    A null text is empty and has no ids, repeated rows give repeated rows, an empty table none; no ties arise, as of equal
    ranks the leftmost pair merges. No shuffle: each task encodes its own rows in slices of bounded size.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=2 << 20, keeps=f"{path}\n{pattern}"):
            ids, at = encode_texts(b.column("text"), path, pattern)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, decoded (binary: ids needn't end where a character does) for each row of encoded (doc_id, ids; null: none)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = whole.column("ids").offsets.to_numpy().astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff((ends[1:] - ends[0]) // SOME_IDS)) + 1).tolist(), whole.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                b = whole.slice(i, j - i)
                raw = decode_ids(b.column("ids").flatten().to_numpy().astype(np.int64), ends[i : j + 1] - ends[i], path, pattern)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids")
    return encoded.select(F.col("doc_id").cast("long"), ids).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op11_perfect_hash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(documents(spark, sf_dir)))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
