"""SentencePiece merge-type encoding by backtracking, without running the merges over the text.

A text's ids are the only sequence of pieces that spells it and whose neighbours are all compatible: two pieces are
compatible if merging their joined characters anew ends at just these two. Candidates at a place are the pieces that an
Aho-Corasick pass found there, longest first; places from which no compatible way on exists are marked in a bit field.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, documents, slices, whole_text

NAME = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts and pairs kept for reuse in one Python worker; beyond that the stores start anew. No result depends on it.
KEPT_PARTS, KEPT_PAIRS = 500_000, 1_000_000
_open: dict[str, PieceEncoder] = {}


def default_path() -> str:
    return public_tokenizers.path(NAME)


class PieceEncoder:
    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.single = {p for p in self.ids if len(p) == 1}
        self.reachable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, list[int]] = {}
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            self.found.add_word(p, len(p))
        self.found.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for pieces and pairs of them: the best score first, of equals the leftmost."""
        part: list[str | None] = list(text)
        right = [*range(1, len(part)), -1]
        left = list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := right[a]) >= 0 and (joined := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[joined], a, joined))

        for k in range(len(part) - 1):
            offer(k)
        while heap:
            _, a, joined = heapq.heappop(heap)
            if part[a] is None or right[a] < 0 or part[a] + part[right[a]] != joined:
                continue
            b = right[a]
            part[a], part[b], right[a] = joined, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a])
            offer(a)
        return [p for p in part if p is not None]

    def whole(self, piece: str) -> bool:
        """Merging the piece's own characters ends at the piece."""
        ok = self.reachable.get(piece)
        if ok is None:
            ok = self.reachable[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return ok

    def compatible(self, a: str, b: str) -> bool:
        if a[-1] + b[0] not in self.neighbours:
            return True  # no piece spans the place between them
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def backtrack(self, part: str) -> list[int]:
        """Ids of a part whose characters all are pieces."""
        n = len(part)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, size in self.found.iter(part):
            at[end - size + 1].append(part[end - size + 1 : end + 1])
        for found in at:
            found.reverse()  # an end further right comes later: now the longest comes first
        failed = bytearray(n // 8 + 1)
        chosen: list[str] = []
        tried = [0]
        pos = 0
        while pos < n:
            for k in range(tried[-1], len(at[pos])):
                piece = at[pos][k]
                end = pos + len(piece)
                if failed[end >> 3] >> (end & 7) & 1 or not self.whole(piece) or chosen and not self.compatible(chosen[-1], piece):
                    continue
                tried[-1] = k + 1
                chosen.append(piece)
                tried.append(0)
                pos = end
                break
            else:  # no way on from here after this last piece: take that back
                if not chosen:
                    raise ValueError(f"no encoding of {part!r}")
                failed[pos >> 3] |= 1 << (pos & 7)
                tried.pop()
                pos -= len(chosen.pop())
        return [self.ids[p] for p in chosen]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text in which spaces already are ▁. It is first cut where no piece can span."""
        out: list[int] = []
        begin = 0
        for k in range(1, len(part) + 1):
            if k < len(part) and part[k - 1 : k + 1] in self.neighbours:
                continue
            own = part[begin:k]
            begin = k
            ids = self.parts.get(own)
            if ids is None:
                if len(self.parts) > KEPT_PARTS:
                    self.parts.clear()
                ids = self.backtrack(own) if len(own) > 1 or own in self.single else [self.byte_ids[x] for x in own.encode()]
                self.parts[own] = ids
            out += ids
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _open:
        _open[path] = PieceEncoder(path)
    return _open[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and where each text's ids begin.

    Each word with the spaces before it is encoded on its own, as no piece holds a ▁ after another character. Words are
    cut at single spaces; where spaces follow one another (or end a text), the empty cuts go to the next word.
    """
    enc = encoder(path)
    lists = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
    values = lists.flatten()
    cuts = lists.offsets.to_numpy().astype(np.int64)
    cuts = cuts - cuts[0]
    empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
    codes, distinct = coded(values)
    per_word = [enc.encode_part(SPACE + w) for w in distinct.to_pylist()]
    extra: dict[str, int] = {}  # words after more than one space, by themselves
    if empty.any():
        for d, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if not empty[a:b].any():
                continue
            if b - a == 1:  # an empty text has no ids, not even of the space before its first word
                codes[a] = extra.setdefault("", len(per_word) + len(extra))
                continue
            run = 0
            for k in range(a, b):
                if empty[k] and k < b - 1:
                    run += 1
                    codes[k] = extra.setdefault("", len(per_word) + len(extra))
                elif run:
                    whole = SPACE * (run + 1) + values[k].as_py()
                    codes[k], run = extra.setdefault(whole, len(per_word) + len(extra)), 0
    per_word += [enc.encode_part(w) for w in extra]
    size = np.array([len(x) for x in per_word], np.int64)
    pool = np.fromiter((i for x in per_word for i in x), np.int32, int(size.sum()))
    first = np.concatenate([[0], np.cumsum(size)])
    count = size[codes]
    ends = np.concatenate([[0], np.cumsum(count)])
    return pool[np.repeat(first[codes] - ends[:-1], count) + np.arange(ends[-1])], ends[cuts]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs (doc_id, text; other columns are ignored).

    A null text is empty and has no ids, repeated rows give repeated rows, an empty table none. No shuffle: each task
    encodes its own rows in slices of bounded size.
    """
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        library = encoder(path).library
        for b in slices(batches):
            ids, at = encode_texts(b.column("text"), path)
            own = [ids[i:j].tolist() for i, j in zip(at, at[1:])]
            decimal = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pc.cast(pa.array(ids), pa.string())), ",").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at)), pa.array([sha(x.encode()) for x in decimal]), pa.array([sha(library.decode(x).encode()) if x else sha(b"") for x in own])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def op6_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
