"""Language-model scores by online logistic context mixing.

A text is its lower-cased words, then an end sign. Each is a path of binary decisions: the usual words (HOT_WORDS, a fixed
number), the end sign and an escape are the leaves of one prefix code; behind the escape a word is spelled, byte by byte.
Every decision of the code's tree is predicted from three hashed contexts: none, the word before, the two words before.
Their counts are those of all training texts, kept exactly: each unit of texts sends its distinct (context, path) keys, in
sorted blobs by range of the hash, to the task that adds up that range, and gets the counts along each path back. So what is
gathered grows with the corpus, and no task or broadcast holds it whole. The three predictions are mixed in the logistic
domain by weights that a gate picks (how well known the contexts are), and along each text these weights are refined, block
by block, by what they predicted. Spelled bytes are mixed from three byte contexts by weights trained online on the corpus.
The two probabilities of every decision add up to one, so the product is a probability of the text.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, discarded, documents, id_remainder, listed, raw_bytes, shuffles_dropped, slices, split_words, sums, whole_text, written

#: Leaves of the code's tree that are words: the most frequent ones, by count and word. Bounded, so broadcast.
HOT_WORDS = 65_536
#: The longest path; a key is the upper bits of a context's hash, so many more than the corpus' tokens need that one context
#: in 2^SPARE_BITS at most shares its counts with another (as long as CODE_BITS and they fit into 64), and below them the path.
CODE_BITS, SPARE_BITS = 22, 9
CODE_MASK = np.uint64((1 << CODE_BITS) - 1)
#: Units are scored in so many rounds, which bounds what is shuffled at a time.
ROUNDS = 4
#: Text of a unit, and the tokens for each range of keys: they bound a task's memory and change no result.
UNIT_BYTES, RANGE_TOKENS = 2 << 20, 1_200_000
#: Tokens of a text between two refinements of its weights; the size of a step, and the most that one changes a weight.
BLOCK, RATE, MOST_STEP = 32, 0.01, 0.25
#: Tokens whose decisions are laid out at a time; this changes no result.
CHUNK = 60_000
#: Texts that go on together, and keys whose predictions are laid out at a time; no result changes.
TEXTS, SOME_KEYS = 64, 5_000
#: Added to both counts of a decision in a context of words, and of bytes.
ADDED, SPELL_ADDED = 0.08, 0.2
#: How often a decision's node was seen in a context: never, once, two or three times, more often.
LEVELS = 4
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FIRST = np.uint64(0x2545F4914F6CDD1D)  # stands for the word before the first

END, SYMBOLS = 256, 257  # of spelling: the byte space ends a word
SPELL_ORDERS = (1, 2, 4)
#: Places of the spelling table. Counts of contexts that fall on one place are added up, none is left out.
SPELL_BITS = 22
SPELL_GATES = 6
#: Words spelled at a time, and bytes of words whose result a worker keeps.
SOME_WORDS, KEPT_BYTES = 4_000, 12 << 20


def start_weights() -> np.ndarray:
    """What each text begins with, by the levels of the word before and of the two words before: the more often a longer
    context was seen, the more it counts, and the less the shorter ones."""
    w = np.zeros((LEVELS, LEVELS, 3), np.float32)
    for one in range(LEVELS):
        for two in range(LEVELS):
            long, mid = (0.0, 0.45, 0.6, 0.7)[two], (0.0, 0.2, 0.35, 0.55)[one]
            w[one, two] = 1 - 0.6 * max(long, mid), mid * (1 - 0.5 * long), long
    return w.reshape(LEVELS * LEVELS, 3)


def by_half_doublings(n: np.ndarray) -> np.ndarray:
    return np.where(n < 4, n, np.minimum(120, np.rint(4 + 2 * np.log2(np.maximum(n, 4) / 4)))).astype(np.uint8)


#: What by_half_doublings gives for small counts.
QUANTISED = by_half_doublings(np.arange(1 << 12))


def quantised(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 4, then by half doublings."""
    out = QUANTISED[np.minimum(n, len(QUANTISED) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(QUANTISED))
    out[large] = by_half_doublings(n[large])
    return out


COUNT = np.where(np.arange(128) < 4, np.arange(128), 4 * 2 ** ((np.arange(128) - 4) / 2))
LN_COUNT = np.log(COUNT + ADDED).astype(np.float32)
#: By the two counts of a place of the spelling table (zeros times 128 and ones): the prediction, and what the gate sees.
_N0, _N1 = np.repeat(COUNT, 128), np.tile(COUNT, 128)
SPELL_INPUT = np.log((_N1 + SPELL_ADDED) / (_N0 + SPELL_ADDED)).astype(np.float32)
SPELL_WITHOUT = np.stack([np.log((_N1 + SPELL_ADDED) / (np.maximum(_N0 - 1, 0) + SPELL_ADDED)), np.log((np.maximum(_N1 - 1, 0) + SPELL_ADDED) / (_N0 + SPELL_ADDED))]).astype(np.float32)
SPELL_LEVEL = np.searchsorted([0.5, 20, 200], _N0 + _N1, side="right").astype(np.uint8)


def paths(frequency: np.ndarray) -> list[list[tuple[int, float, float]]]:
    """Huffman's code: for each symbol its bits from the root, each with the frequency on the path and beside it."""
    heap = [(float(n), s) for s, n in enumerate(frequency)]
    total = dict(enumerate(float(n) for n in frequency))
    heapq.heapify(heap)
    up: dict[int, tuple[int, int, int]] = {}
    for node in range(len(frequency), 2 * len(frequency) - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (node, 0, y), (node, 1, x)
        total[node] = a + b
        heapq.heappush(heap, (a + b, node))
    out = []
    for s in range(len(frequency)):
        path, at = [], s
        while at in up:
            node, bit, other = up[at]
            path.append((bit, total[at], total[other]))
            at = node
        out.append(path[::-1])
    return out


@dataclass
class Tree:
    """The code of usual words, the escape (the last but one symbol) and the end sign (the last)."""

    code: np.ndarray  # path of each symbol, from the left of CODE_BITS
    length: np.ndarray
    plain: np.ndarray  # predictions of the context of no word, path by path
    start: np.ndarray  # where each symbol's begin

    @staticmethod
    def of(counts: np.ndarray, escapes: int, ends: int) -> Tree:
        n = np.array([*counts, escapes, ends], np.float64) + 0.5
        floor = n.sum() / (1 << 20)
        while True:
            found = paths(np.maximum(n, floor))
            if max(map(len, found)) <= CODE_BITS:
                break
            floor *= 2
        length = np.array([len(p) for p in found])
        code = np.array([sum(bit << (CODE_BITS - 1 - d) for d, (bit, _, _) in enumerate(p)) for p in found], np.uint64)
        plain = np.array([np.log(on / beside) for p in found for _, on, beside in p], np.float32)
        return Tree(code, length, plain, np.concatenate([[0], np.cumsum(length)]))

    def lengths_by_code(self) -> np.ndarray:
        out = np.zeros(1 << CODE_BITS, np.uint8)
        out[self.code.astype(np.int64)] = self.length
        return out


# --- units of texts


UNITS = "unit long, doc_id array<long>, held array<boolean>, size array<long>, at array<int>, words array<string>, codes binary"


def text_units(rows: DataFrame) -> DataFrame:
    """Texts (doc_id, held_out, text) as units of about UNIT_BYTES, written: the distinct words of a unit, and the texts as
    their numbers. Every later step reads these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in slices(batches, max_bytes=UNIT_BYTES):
            values, at = split_words(pc.ascii_lower(b.column("text")))
            codes, distinct = coded(values)
            size = sums(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1, at) + 1
            lists = [b.column("doc_id"), b.column("held_out"), pa.array(size, pa.int64()), pa.array(at, pa.int32()), distinct.cast(pa.string())]
            row = [pa.array([(TaskContext.get().partitionId() << 32) + k]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([planes(codes.astype(np.uint32))])]
            yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in UNITS.split(", ")])
            k += 1

    return written(rows.mapInArrow(run, UNITS), "units")


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unplaned(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Unit:
    """A row of text_units, read."""

    words: pa.Array
    codes: np.ndarray
    at: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(row: pa.RecordBatch | pa.Table) -> Unit:
        """From one row."""
        get = lambda name: row.column(name).combine_chunks() if isinstance(row, pa.Table) else row.column(name)
        words, at, held = (get(c).flatten() for c in ("words", "at", "held"))
        return Unit(words, unplaned(get("codes")[0].as_py(), np.uint32).astype(np.int64), at.to_numpy().astype(np.int64), held.to_numpy(zero_copy_only=False))

    def hashes(self) -> np.ndarray:
        """Of each word: its bytes as a polynomial's coefficients, mixed."""
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(size):
            return np.zeros(0, np.uint64)
        raw, first = raw_bytes(self.words), np.cumsum(size) - size
        power = np.cumprod(np.full(int(size.max()), MIX2, np.uint64))
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[np.arange(len(raw)) - np.repeat(first, size)]
        return mixed(np.add.reduceat(terms, first))

    def numbers(self, hot: pa.Array) -> np.ndarray:
        """The place of each word among the hot ones, -1 for others."""
        return pc.fill_null(pc.index_in(self.words, value_set=hot), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        """How often each word stands in the unit's training texts."""
        return np.bincount(self.codes[np.repeat(~self.held, np.diff(self.at))], minlength=len(self.words))


def read_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Unit]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column("unit")[k].as_py(), Unit.of(b.slice(k, 1))


def word_counts(units: DataFrame) -> DataFrame:
    """word, c over the training texts, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in read_units(batches):
            n = unit.word_counts()
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([unit.words.take(pa.array(seen)), pa.array(n[seen])], ["word", "n"])

    return written(units.select("unit", "words", "codes", "at", "held").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")


# --- counts of contexts of words


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MIX2
    h ^= h >> np.uint64(29)
    h *= MIX1
    return h


@dataclass
class Symbols:
    """The tokens of a unit's texts with their end signs, as symbols of the tree, and the contexts of each."""

    symbol: np.ndarray
    at: np.ndarray
    trained: np.ndarray
    contexts: tuple[np.ndarray, np.ndarray]  # of the word before, and of the two words before

    @staticmethod
    def of(unit: Unit, tree: Tree, numbers: np.ndarray, hashes: np.ndarray) -> Symbols:
        escape = len(tree.code) - 2
        word = np.insert(unit.codes, unit.at[1:], len(unit.words))
        at = unit.at + np.arange(len(unit.at))
        symbol = np.append(np.where(numbers < 0, escape, numbers), escape + 1)[word]
        h = np.append(hashes, FIRST)[word]
        into = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
        one = np.concatenate([[FIRST], h[:-1]])
        one[into == 0] = FIRST
        two = np.concatenate([[FIRST, FIRST], h[:-2]])[: len(h)]
        two[into < 2] = FIRST
        return Symbols(symbol, at, np.repeat(~unit.held, np.diff(at)), (mixed(one), mixed(one * MIX1 + mixed(two + MIX2))))

    def keys(self, order: int, tree: Tree, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of one context, sorted, and where the key of each token stands."""
        return np.unique((self.contexts[order] & mask) | tree.code[self.symbol], return_inverse=True)


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of the keys' upper bits each (sorted) key falls into, as the cuts between them."""
    part = ((keys >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
    return np.searchsorted(part, np.arange(n + 1).astype(np.uint64))


def along_paths(keys: np.ndarray, n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted and distinct, n: how often each was seen (0 too). A row for each: how often its context went another way at each
    decision of the path, quantised; and at how many of the first decisions it ever did."""
    out, deep = np.zeros((len(keys), CODE_BITS), np.uint8), np.zeros(len(keys), np.uint8)
    left, node = np.arange(len(keys)), None
    for d in range(CODE_BITS + 1):
        # all keys below a node of depth d follow each other; left: those whose node has other keys below it too
        part = keys[left] >> np.uint64(CODE_BITS - d)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, len(left)))
        seen = np.repeat(np.add.reduceat(n[left], first), size)
        if d:
            beside = quantised(node - seen)
            out[left, d - 1] = beside
            deep[left[beside > 0]] = d
        on = np.repeat(size > 1, size) & (seen > 0) & (length[left] > d)
        left, node = left[on], seen[on]
        if not len(left):
            break
    return out, deep


REQUEST = "part int, unit long, keys binary, n binary"


@dataclass
class Shared:
    """What every task gets; all of bounded size."""

    tree: Tree
    hot: pa.Array  # words
    counts: np.ndarray  # of the hot words
    spelling: Spelling
    mask: np.uint64  # the bits of a context's hash that its keys have
    parts: int  # ranges of keys
    name: str


def requests(units: DataFrame, shared, order: int) -> DataFrame:
    """For each unit and range of one context's keys: the keys, and how often each stands in the unit's training texts. With
    the first context go, in ranges of their own, the words that aren't leaves of the tree, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for name, unit in read_units(batches):
            h, numbers = unit.hashes(), unit.numbers(m.hot)
            s = Symbols.of(unit, m.tree, numbers, h)
            keys, where = s.keys(order, m.tree, m.mask)
            asked = [(keys, np.bincount(where[s.trained], minlength=len(keys)))]
            if order == 0:
                rare = numbers < 0
                words, where = np.unique(h[rare], return_inverse=True)
                asked.append((words, np.bincount(where, weights=unit.word_counts()[rare], minlength=len(words))))
            out = []
            for k, (keys, n) in enumerate(asked):
                cuts = ranges(keys, m.parts)
                out += [(k * m.parts + p, name, planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "unit", "keys", "n"])

    return units.select("unit", "words", "codes", "at", "held").mapInArrow(run, REQUEST)


def replies(asked: DataFrame, shared) -> DataFrame:
    """part, unit, data: the counts of all training texts for each request's keys, in order."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = [np.cumsum(unplaned(k, np.uint64)) for k in table.column("keys").to_pylist()]
        n = np.concatenate([unplaned(x, np.uint32) for x in table.column("n").to_pylist()])
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=n, minlength=len(distinct))
        if part >= shared.value.parts:
            data = [planes(total[where[a:b]].astype(np.uint64)) for a, b in zip(ends, ends[1:])]
        else:
            length = lengths(shared)[(distinct & CODE_MASK).astype(np.int64)]
            rows, deep = along_paths(distinct, total, length)
            seen = quantised(total)
            data = [path_planes(rows[own], deep[own], seen[own]) for own in (where[a:b] for a, b in zip(ends, ends[1:]))]
        return pa.table({"part": pa.array([part] * len(data), pa.int32()), "unit": table.column("unit"), "data": pa.array(data, pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "part int, unit long, data binary")


def path_planes(rows: np.ndarray, deep: np.ndarray, seen: np.ndarray) -> bytes:
    """The rows of along_paths, depth by depth, each as far as it holds anything, and how often each key was seen."""
    out, there = [deep.tobytes(), seen.tobytes()], np.flatnonzero(deep)
    for d in range(int(deep.max())):
        out.append(rows[there, d].tobytes())
        there = there[deep.take(there) > d + 1]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unplaned_paths(data: bytes, length: np.ndarray) -> np.ndarray:
    """For each key's path the counts beside it and, at the end, of the key itself; one path after another."""
    raw, m = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), len(length)
    ends = np.cumsum(length + 1)
    out, last = np.zeros(ends[-1], np.uint8), ends - 1
    deep, at = raw[:m], 2 * m
    there = np.flatnonzero(deep)
    place = (last - length)[there]
    deep = deep[there]
    for d in range(int(raw[:m].max())):
        out[place + d] = raw[at : at + len(place)]
        at += len(place)
        more = deep > d + 1
        place, deep = place[more], deep[more]
    out[last] = raw[m : 2 * m]
    return out


_kept: dict = {}


def lengths(shared) -> np.ndarray:
    """Path lengths by path; a worker keeps them."""
    name = shared.value.name
    if _kept.get("lengths_of") != name:
        _kept.update(lengths_of=name, lengths=shared.value.tree.lengths_by_code())
    return _kept["lengths"]


def predictions(raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the counts along the paths of some keys: each decision's prediction for the way the path goes, and its level; after
    each path one more place, as in raw."""
    x, levels = np.empty(len(raw), np.float32), np.empty(len(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum(length + 1)])
    for k in range(0, len(length), SOME_KEYS):
        at = ends[k : k + SOME_KEYS + 1]
        own = raw[at[0] : at[-1]].astype(np.int64)
        n = COUNT.take(own)
        total = np.cumsum(n)
        below = np.maximum(np.repeat(total[at[1:] - at[0] - 1], np.diff(at)) - total, 0).astype(np.float32)  # on the path after this decision
        np.subtract(np.log(below + np.float32(ADDED)), LN_COUNT.take(own), out=x[at[0] : at[-1]])
        below += n
        levels[at[0] : at[-1]] = (below > 0.5).view(np.uint8) + (below > 1.5).view(np.uint8) + (below > 3.5).view(np.uint8)
    return x, levels


# --- spelling


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words (a space ends each), where each begins, and for each byte its hashed contexts: what stands before it
    in the word, up to so many bytes."""
    symbols = np.frombuffer(" ".join([*words, ""]).encode(), np.uint8).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(symbols == 32) + 1])  # no word holds a space
    into = np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at))
    before = np.zeros(len(symbols), np.uint64)
    contexts = []
    for k in range(1, max(SPELL_ORDERS) + 1):
        before[k:] |= np.where(into[k:] >= k, symbols[:-k] + 1, 0).astype(np.uint64) << np.uint64(9 * (k - 1))
        if k in SPELL_ORDERS:
            contexts.append(mixed(before + np.uint64(k << 60)))
    return symbols, at, np.stack(contexts)


@dataclass
class Spelling:
    """Bytes by Huffman's code; the quantised counts of each place of the table, zeros times 128 and ones; weights by gate."""

    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    table: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(frequency: np.ndarray) -> Spelling:
        found = paths(frequency + 1.0)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in found])])
        names: dict[tuple, int] = {}
        nodes = [names.setdefault(tuple(b for b, _, _ in p[:d]), len(names)) for p in found for d in range(len(p))]
        bits = [b for p in found for b, _, _ in p]
        return Spelling(starts, np.array(nodes, np.uint64), np.array(bits, np.uint8), np.zeros(1 << SPELL_BITS, np.int16), np.full((SPELL_GATES, len(SPELL_ORDERS)), 0.4))

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Where each word's decisions begin, their bits, and their places in the table for each context."""
        symbols, at, contexts = spelled(words)
        n = np.diff(self.starts)[symbols]
        ends = np.concatenate([[0], np.cumsum(n)])
        path = np.repeat(self.starts[symbols] - ends[:-1], n) + np.arange(ends[-1])
        node = self.nodes.take(path) * MIX2
        h = [(mixed(np.repeat(c, n) + node) >> np.uint64(64 - SPELL_BITS)).view(np.int64) for c in contexts]
        return ends[at], self.bits.take(path), h

    def inputs(self, places: list[np.ndarray], bits: np.ndarray, leave_out: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """Predictions for the bit that follows, by context, and the gates. leave_out: without the decision itself."""
        cells = [self.table.take(p).astype(np.int64) for p in places]
        sign = np.where(bits == 1, np.float32(1), np.float32(-1))
        x = [sign * (SPELL_WITHOUT[bits, cell] if leave_out else SPELL_INPUT.take(cell)) for cell in cells]
        return x, np.minimum(SPELL_LEVEL.take(cells[2]), 2) * 2 + (SPELL_LEVEL.take(cells[1]) > 2)

    def logs(self, words: list[str]) -> np.ndarray:
        """ln of each word's probability."""
        out = [np.zeros(0)]
        for k in range(0, len(words), SOME_WORDS):
            at, bits, places = self.places(words[k : k + SOME_WORDS])
            x, gate = self.inputs(places, bits)
            out.append(-np.add.reduceat(np.log(1 + np.exp(-np.clip(dot(x, gate, self.weights), -20, 20))), at[:-1], dtype=np.float64))
        return np.concatenate(out)


def dot(x: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    gate = gate.astype(np.int64)
    return sum(v * weights[:, k].astype(np.float32).take(gate) for k, v in enumerate(x))


def some_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    for b in slices(batches, "word", 1 << 18):
        for k in range(0, b.num_rows, SOME_WORDS):
            yield listed(b.column("word").slice(k, SOME_WORDS)), b.column("c").slice(k, SOME_WORDS).to_numpy(zero_copy_only=False)


def fit_spelling(rare: DataFrame) -> Spelling:
    """From the words (word, c) behind the escape. Tasks add up the table's places, which are bounded; Spark adds up the tasks.
    Weights are trained online over the words of fixed buckets and averaged, so they don't depend on the cluster."""

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS, np.int64)
        for words, c in some_words(batches):
            symbols, at, _ = spelled(words)
            total += np.bincount(symbols, weights=np.repeat(c, np.diff(at)), minlength=SYMBOLS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(total)], ["symbol", "n"])

    frequency = np.zeros(SYMBOLS)
    for r in rare.mapInArrow(count_bytes, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        frequency[r.symbol] = r.n
    model = Spelling.of(frequency)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << SPELL_BITS))
        for words, c in some_words(batches):
            at, bits, places = model.places(words)
            weight = np.repeat(c, np.diff(at)).astype(float)
            for bit in (0, 1):
                for p in places:
                    np.add.at(total[bit], p[bits == bit], weight[bits == bit])
        seen = np.flatnonzero(total.any(0))
        for k in range(0, len(seen), 50_000):
            own = seen[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[0, own].astype(np.int64)), pa.array(total[1, own].astype(np.int64))], ["place", "n0", "n1"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("place").cast(pa.int32()), pa.array(quantised(b.column("n0").to_numpy())), pa.array(quantised(b.column("n1").to_numpy()))], ["place", "n0", "n1"]).cast(pa.schema([("place", pa.int32()), ("n0", pa.int16()), ("n1", pa.int16())]))

    cells = rare.mapInArrow(count, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = cells.mapInArrow(packed, "place int, n0 short, n1 short").toArrow()  # at most one row a place
    model.table[found.column("place").to_numpy()] = found.column("n0").to_numpy() * 128 + found.column("n1").to_numpy()
    shared = rare.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def train(table: pa.Table) -> pa.Table:
        m, n = shared.value, 0
        weights, memory = m.weights.copy(), np.zeros_like(m.weights)
        for words, c in some_words(iter(table.sort_by("word").to_batches())):
            at, bits, places = m.places(words)
            x, gate = m.inputs(places, bits, leave_out=True)
            weight = np.repeat(np.minimum(c, 8), np.diff(at)).astype(float)
            error = weight / (1 + np.exp(np.clip(dot(x, gate, weights), -20, 20)))
            g = np.column_stack([np.bincount(gate, weights=error * v, minlength=SPELL_GATES) for v in x]) / (np.bincount(gate, weights=weight, minlength=SPELL_GATES)[:, None] + 1e-9)
            memory += g * g
            weights += 0.3 * g / np.sqrt(memory + 1e-8)
            n += len(words)
        return pa.table({"n": pa.array([n], pa.int64()), "weights": pa.array([weights.ravel().tolist()], pa.list_(pa.float64()))})

    buckets = max(1, rare.count() // 50_000)
    trained = rare.groupBy(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket")).applyInArrow(train, "n long, weights array<double>")
    # two sums a weight: their number is fixed
    each = trained.select("n", F.posexplode("weights").alias("k", "w")).groupBy("k").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).collect()
    for r in each:
        model.weights.ravel()[r.k] = r.w
    shared.destroy()
    return model


def spelled_logs(shared, words: list[str]) -> np.ndarray:
    """As Spelling.logs; a worker keeps what it has computed for this model."""
    model, name = shared.value.spelling, shared.value.name
    if _kept.get("logs_of") != name or _kept["bytes"] > KEPT_BYTES:
        _kept.update(logs_of=name, logs={}, bytes=0)
    known = _kept["logs"]
    new = [w for w in words if w not in known]
    known.update(zip(new, model.logs(new).tolist()))
    _kept["bytes"] += sum(map(len, new))
    return np.fromiter((known[w] for w in words), float, len(words))


# --- scores


def text_scores(s: Symbols, tree: Tree, x: np.ndarray, levels: np.ndarray, first: list[np.ndarray]) -> np.ndarray:
    """ln of each text's probability in the tree. x, levels: predictions, first: where those of each token begin, for both contexts.

    Texts of about one length go on block by block together. A block's decisions are mixed by each text's weights; after it
    the weights follow the gradient of what the block cost."""
    size, total = np.diff(s.at), np.zeros(len(s.at) - 1)
    by = np.argsort(size, kind="stable")
    for k in range(0, len(by), TEXTS):
        own = by[k : k + TEXTS]
        total[own] = _together(s, own, size[own], tree, x, levels, first)
    return total


def _together(s: Symbols, texts: np.ndarray, size: np.ndarray, tree: Tree, x: np.ndarray, levels: np.ndarray, first: list[np.ndarray]) -> np.ndarray:
    gates = LEVELS * LEVELS
    total, weights = np.zeros(len(texts)), np.tile(start_weights().T, (len(texts), 1, 1))  # text, context, gate
    text = np.repeat(np.arange(len(texts)), size)
    into = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    where, step = np.repeat(s.at[texts], size) + into, into // BLOCK
    order = np.argsort(step, kind="stable")
    ends = np.cumsum(np.bincount(step)).tolist()
    k = 0
    while k < len(ends):
        lo, last = (ends[k - 1] if k else 0), k + 1
        while last < len(ends) and ends[last] - lo <= CHUNK:
            last += 1
        token = order[lo : ends[last - 1]]
        place = where.take(token)
        symbol = s.symbol.take(place)
        each = tree.length.take(symbol)
        to = np.concatenate([[0], np.cumsum(each)])
        all_of, start = np.arange(to[-1]), to[:-1]
        i, j = (np.repeat(at.take(place) - start, each) + all_of for at in first)
        a, b, c = tree.plain.take(np.repeat(tree.start.take(symbol) - start, each) + all_of), x.take(i), x.take(j)
        gate = levels.take(i) * np.uint8(LEVELS) + levels.take(j)
        for e in ends[k:last]:
            own = text[token[lo - ends[k - 1] if k else lo : e - (ends[k - 1] if k else 0)]]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) + (lo - (ends[k - 1] if k else 0))
            left, cut = text[token[cut]], np.append(to[cut], to[e - (ends[k - 1] if k else 0)])
            part = slice(int(cut[0]), int(cut[-1]))
            row = np.repeat(np.arange(len(left)) * gates, np.diff(cut)) + gate[part]
            w = weights[left]
            v = (a[part], b[part], c[part])
            z = sum(v[m] * w[:, m].ravel().take(row) for m in range(3))
            cost = np.exp(-np.clip(z, -30, 30, out=z), out=z)
            both = 1 + cost
            total[left] -= np.add.reduceat(np.log(both), cut[:-1] - cut[0], dtype=np.float64)
            error = np.divide(cost, both, out=both)
            for m in range(3):
                g = np.bincount(row, weights=error * v[m], minlength=len(left) * gates).reshape(-1, gates)
                w[:, m] += np.clip(RATE * g, -MOST_STEP, MOST_STEP)
            weights[left] = w
            lo = e
        k = last
    return total


SCORED = "doc_id long, held_out boolean, n_tokens long, seen long, base double, ln double, size long"


def score_units(units: DataFrame, told: DataFrame, shared) -> DataFrame:
    """told: order, part, unit, data."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        unit = Unit.of(left)
        h, number = unit.hashes(), unit.numbers(m.hot)
        s = Symbols.of(unit, m.tree, number, h)
        got = dict(zip(zip(right.column("order").to_pylist(), right.column("part").to_pylist()), right.column("data").to_pylist()))
        raw, ends, first = [], [np.zeros(1, np.int64)], []
        for order in (0, 1):
            keys, where = s.keys(order, m.tree, m.mask)
            length, cuts = lengths(shared)[(keys & CODE_MASK).astype(np.int64)].astype(np.int64), ranges(keys, m.parts).tolist()
            raw += [unplaned_paths(got[order, p], length[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            ends.append(ends[-1][-1] + np.cumsum(length + 1))
            first.append(np.append(ends[-2][-1], ends[-1])[where])
        x, levels = predictions(np.concatenate(raw), np.diff(np.concatenate(ends)) - 1)
        ln = text_scores(s, m.tree, x, levels, first)
        rare = np.flatnonzero(number < 0)
        c, spelling = np.zeros(len(unit.words), np.int64), np.zeros(len(unit.words))
        c[number >= 0] = m.counts[number[number >= 0]]
        if len(rare):
            _, where = np.unique(h[rare], return_inverse=True)
            c[rare] = np.concatenate([unplaned(got[k], np.uint64) for k in sorted(k for k in got if k[1] >= m.parts)]).astype(np.int64)[where]
            spelling[rare] = spelled_logs(shared, listed(unit.words.take(pa.array(rare))))
        own = c[unit.codes]
        columns = [left.column("doc_id").combine_chunks().flatten(), pa.array(unit.held), pa.array(np.diff(unit.at) + 1), pa.array(sums((own > 0).astype(np.int64), unit.at)), pa.array(sums(np.log10(own + 1.0), unit.at)), pa.array(ln + sums(spelling[unit.codes], unit.at)), left.column("size").combine_chunks().flatten()]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return units.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(run, SCORED)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs (doc_id, text;
    other columns are ignored).

    Rows whose crc32(doc_id) mod 7 is 2 are held out; all others, also those without an id, are learned from. A null text is
    the end sign alone, repeated rows give repeated rows and count as often, an empty table gives none. Words of equal count
    become leaves of the tree in their own order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(id_remainder(7) == 2, F.lit(False)).alias("held_out"), whole_text().alias("text"))
    with shuffles_dropped(spark):
        units = text_units(rows)
        counts = word_counts(units)
        size = units.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.element_at("at", -1).cast("long")), F.lit(0)).alias("tokens")).first()
        sized = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        hot = counts.orderBy(F.desc("c"), "word").limit(HOT_WORDS).collect()
        hot_counts = np.array([r.c for r in hot], np.int64)
        # the last of the hot words cuts the table in two, whatever ties it has
        rare = written(counts.filter((F.col("c") < hot[-1].c) | (F.col("c") == hot[-1].c) & (F.col("word") > hot[-1].word) if hot else F.lit(False)), "rare-words")
        tree, tokens = Tree.of(hot_counts, sized.n - int(hot_counts.sum()), size.ends), size.tokens + size.ends
        bits = min(64 - CODE_BITS, max(32, int(tokens).bit_length() + SPARE_BITS))
        parts = max(1, min(1 << 20, tokens // RANGE_TOKENS))
        shared = spark.sparkContext.broadcast(Shared(tree, pa.array([r.word for r in hot], pa.string()), hot_counts, fit_spelling(rare), np.uint64(((1 << bits) - 1) << (64 - bits)), parts, uuid.uuid4().hex))
        discarded(counts, rare)
        told = [written(replies(requests(units, shared, k), shared), "replies") for k in (0, 1)]
        both = told[0].select(F.lit(0).alias("order"), "*").unionByName(told[1].select(F.lit(1).alias("order"), "*"))
        turn = lambda k: F.pmod(F.xxhash64("unit"), F.lit(ROUNDS)) == k
        scored = [written(score_units(units.filter(turn(k)), both.filter(turn(k)), shared), "scored") for k in range(ROUNDS)]
        discarded(units, *told)
        shared.destroy()
    scored = reduce(DataFrame.unionByName, scored)
    n, v = sized.n + size.ends, sized.v + (size.ends > 0)
    base = F.col("base") + F.lit(float(np.log10(size.ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + int(size.ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("ln") / F.lit(float(np.log(10)))).alias("score"), (-F.col("ln") / F.lit(float(np.log(2))) / F.col("size")).alias("bits_per_byte"),
    )


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
