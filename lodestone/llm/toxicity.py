"""Toxicity of texts that hide their words: a noisy-channel decoder restores them, a linear model scores what is restored."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, documents, id_remainder, slices, split_words, sums, whole_text

#: Letters that the character model knows: a to z and the letters of Latin-1. The model's size is bounded by their cube.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xDF, 0x100) if c != 0xF7}
EDGE = "^"
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
SEPARATORS = frozenset(".-_*~'·,/")
#: Log costs of the channel: a letter written as another sign, a letter repeated, a separator put in, a space left out.
COST_LEET, COST_REPEAT, COST_SEPARATOR, COST_BOUNDARY = -0.7, -1.2, -0.3, -2.5
#: Decodings that are kept and scored for each hidden word, and the lattice steps that count as one hidden word: 32 letters with
#: any number of separators and repetitions between them.
BEST, LONGEST = 8, 64
#: One step of the lattice: a run of separators and other signs that stand for nothing, or of one letter or telling sign.
_STEP = re.compile(rf"[^{''.join(sorted(LETTERS))}{re.escape(''.join(LEET))}]+|(.)\1*")
#: Consecutive single letters that count as a word written with spaces.
SPACED = 4
#: Labelled rows of each class that the classifier is fitted on at most (the smallest hashes of the id).
SAMPLE_ROWS = 10_000
#: What the classifier asks of a feature: toxic texts that hold it, and its log odds. All such features are kept; the labelled
#: sample bounds their number.
LEAST_DOCS, LEAST_WEIGHT = 3, 2.0

_sign = re.escape("".join(LEET)) + re.escape("".join(sorted(SEPARATORS)))
#: A letter together with a sign inside the word, or three times the same letter. RE2 has no back references.
_INSIDE = rf"\p{{L}}[{_sign}]+\p{{L}}|^[{re.escape(''.join(LEET))}]+\p{{L}}|\p{{L}}[0134578@$!|+€]+"
_TRIPLE = "|".join(f"{c}{{3}}" for c in sorted(LETTERS))
HIDDEN = f"{_INSIDE}|{_TRIPLE}"
#: Twice the same letter: hidden where the character model finds another reading likelier than the word.
DOUBLED = "|".join(f"{c}{{2}}" for c in sorted(LETTERS))
#: These never hide a word: links, plain numbers with units; and, without the punctuation around them, whole addresses
#: (at most 64 characters before the @, as mail has it).
PLAIN = r"://|^www\.|^[0-9.,:+-]*\p{L}{0,2}$"
ADDRESS = r"^[\p{L}0-9._%+-]{1,64}@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}$"
#: Runs of one letter.
_RUN = re.compile(r"((.)\2+)")


@dataclass
class CharModel:
    """Letter trigrams, smoothed by shorter ones."""

    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.one, self.two, self.left = Counter(), Counter(), Counter()
        for gram, n in self.counts.items():
            self.one[gram[2]] += n
            self.two[gram[1:]] += n
            self.left[gram[:2]] += n
        self.total = sum(self.one.values())
        self.middle = Counter()
        for gram, n in self.two.items():
            self.middle[gram[0]] += n
        self.known: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        p = self.known.get(gram)
        if p is None:
            p1 = (self.one[gram[2]] + 0.5) / (self.total + 0.5 * (len(LETTERS) + 1))
            p2 = (self.two[gram[1:]] + 2 * p1) / (self.middle[gram[1]] + 2)
            p = self.known[gram] = log((self.counts.get(gram, 0) + 2 * p2) / (self.left[gram[:2]] + 2))
        return p


def trigrams(word: str) -> list[str]:
    padded = f"{EDGE}{EDGE}{word}{EDGE}"
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def lattice(word: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each step what it may stand for, and the cost. Spaced: a word may end after any letter."""
    out = []
    for m in _STEP.finditer(word):
        c, n = m[1], len(m[0])
        ways = [] if c else [("", COST_SEPARATOR)]
        for letter, cost in [(c, 0.0)] * (c in LETTERS) + [(x, COST_LEET * n) for x in LEET.get(c, "")]:
            ways.append((letter * min(n, 2), cost if n <= 2 else cost + COST_REPEAT))
            if n > 1:
                ways.append((letter, cost + COST_REPEAT))
        if spaced:
            ways += [(f"{x} ", cost + COST_BOUNDARY) for x, cost in ways if x]
        out.append(ways)
    return out


def stretches(word: str) -> list[str]:
    """The word in overlapping pieces of at most LONGEST steps, so that each half of that many steps is whole in one."""
    marks = [m.start() for k, m in enumerate(_STEP.finditer(word)) if k % (LONGEST // 2) == 0] or [0]
    return [word[a:b] for a, b in zip(marks, [*marks[2:], len(word)])]


def decode(word: str, model: CharModel, spaced: bool = False) -> list[str]:
    """The best readings of a hidden word under channel and character model, the most likely first (list Viterbi over the
    last two letters). Ties go by the reading."""
    states: dict[str, list[tuple[float, str]]] = {EDGE * 2: [(0.0, "")]}
    logp = model.logp
    for ways in lattice(word, spaced):
        new: dict[str, list[tuple[float, str]]] = {}
        met = set()
        for last, paths in states.items():
            for text, cost in ways:
                at, p = last, cost
                for c in text:
                    p += logp(at + (EDGE if c == " " else c))
                    at = EDGE * 2 if c == " " else at[1] + c
                longer = [(q + p, read + text) for q, read in paths]
                if at in new:
                    new[at] += longer
                    met.add(at)
                else:
                    new[at] = longer  # in order as it was
        for at in met:
            new[at] = sorted(set(new[at]), key=lambda x: (-x[0], x[1]))[:BEST]
        states = new
    ends = [(q + model.logp(at + EDGE), read) for at, paths in states.items() for q, read in paths]
    return [read.strip() for _, read in sorted(ends, key=lambda x: (-x[0], x[1]))[:BEST]]


def readings(word: str, model: CharModel) -> list[str]:
    """As decode; what has more characters than one hidden word has steps is taken as several words too, and only so where it
    has more steps, in overlapping stretches."""
    if len(word) <= LONGEST:
        return decode(word, model)
    parts = stretches(word)
    whole = decode(word, model) if len(parts) == 1 else []
    return list(dict.fromkeys(whole + [w for part in parts for read in decode(part, model, spaced=True) for w in read.split()]))


def likelier(word: str, model: CharModel) -> list[str]:
    """The readings that the model finds likelier than the word itself. For a word of known letters, one of them doubled once,
    the only other reading is without it, and only the trigrams at that place differ."""
    doubled = _RUN.findall(word)
    if len(doubled) == 1 and len(doubled[0][0]) == 2 and len(word) <= LONGEST and LETTERS.issuperset(word):
        padded = f"{EDGE}{EDGE}{word}{EDGE}"
        c, k = doubled[0][1], padded.index(doubled[0][0])
        before, a = padded[k - 1], padded[k + 2]
        kept = model.logp(before + c + c) + model.logp(c + c + a)
        single = model.logp(before + c + a) + COST_REPEAT
        once = word[: k - 2] + word[k - 1 :]
        return [once] if (single, word) > (kept, once) else []
    found = readings(word, model)
    return found[: found.index(word)] if word in found else found


def stripped(word: str) -> str:
    return word.strip(".,;:?\"()[]{}'“”«»…")


class Restored:
    """The words of some texts as a reader would take them: for each distinct word its readings, one of them the word
    itself unless it was hidden; further words that were written with spaces, by text."""

    def __init__(self, texts: pa.Array, model: CharModel, memo: dict[str, list[str]]):
        values, self.offsets = split_words(pc.utf8_lower(texts))
        self.codes, distinct = coded(values)
        words = distinct.to_pylist()
        self.readings: list[list[str]] = [[stripped(w)] for w in words]
        self.bare = bare = pa.array([r[0] for r in self.readings], pa.string())
        self.decoded: list[int] = []
        plain = pc.or_(pc.match_substring_regex(distinct, PLAIN), pc.match_substring_regex(bare, ADDRESS))
        hidden = pc.and_(pc.match_substring_regex(distinct, HIDDEN), pc.invert(plain)).to_numpy(zero_copy_only=False)
        doubled = pc.and_(pc.match_substring_regex(bare, DOUBLED), pc.invert(plain)).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(hidden | doubled).tolist():
            self.decoded.append(k)
            if words[k] not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[words[k]] = readings(words[k].rstrip(".,;:?"), model) if hidden[k] else likelier(self.readings[k][0], model)
            self.readings[k] = self.readings[k] + memo[words[k]]
        self.spaced: list[tuple[int, list[str]]] = []
        letter = np.array([len(w) == 1 and (w in LETTERS or w in LEET) for w in words], bool)
        if letter.any():
            single = np.concatenate([[0], letter[self.codes].view(np.int8), [0]])
            starts, ends = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
            for a, b in zip(starts[ends - starts >= SPACED].tolist(), ends[ends - starts >= SPACED].tolist()):
                d = int(np.searchsorted(self.offsets, a, side="right")) - 1
                while a < b:  # cut where the next text begins
                    e = min(b, int(self.offsets[d + 1]))
                    joined = "".join(words[c] for c in self.codes[a:e].tolist())
                    for part in stretches(joined):
                        if len(part) >= SPACED and sum(c in LETTERS for c in part) >= 2:
                            self.spaced.append((d, [w for read in decode(part, model, spaced=True) for w in read.split()]))
                    a, d = e, d + 1


def features(word: str) -> list[str]:
    """The word, and its beginnings: words of one stem share them."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    linear: list[float]

    def heaviest(self, words: pa.Array) -> np.ndarray:
        """The largest weight among the features of each word, at least 0."""
        names, weights = pa.array(list(self.weights), pa.string()), np.array([*self.weights.values(), 0.0])
        best, n = np.zeros(max(1, len(words))), pc.utf8_length(words)
        stems = [pc.if_else(pc.greater(n, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "*", ""), None) for k in (4, 5)]
        for of in (words, *stems):
            best[: len(words)] = np.maximum(best[: len(words)], weights[pc.fill_null(pc.index_in(of, names), -1).to_numpy(zero_copy_only=False)])
        return best

    def evidence(self, texts: pa.Array, memo: dict[str, list[str]]) -> np.ndarray:
        """For each text: the largest weight of a word, the log of the number of telling words, and of all words."""
        found, get = Restored(texts, self.chars, memo), self.weights.get
        best = self.heaviest(found.bare)
        for k in found.decoded:
            best[k] = max((get(f, 0.0) for r in found.readings[k] for f in features(r)), default=0.0)
        own, at = best[found.codes], found.offsets
        n = len(texts)
        top = np.zeros(n)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            top[full] = np.maximum.reduceat(own, at[full])
        hits = sums((own > 0).astype(np.int64), at)
        for d, reads in found.spaced:
            w = max((get(f, 0.0) for r in reads for f in features(r)), default=0.0)
            top[d], hits[d] = max(top[d], w), hits[d] + (w > 0)
        return np.column_stack([np.ones(n), top, np.log1p(hits), np.log1p(np.diff(at))])

    def score(self, texts: pa.Array, memo: dict[str, list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts, memo) @ np.array(self.linear), -30, 30)))


def char_model(docs: DataFrame) -> CharModel:
    """Letter trigrams of all words of all texts. Tasks count their own; only sums by trigram are shuffled, and their number is bounded."""
    allowed = re.compile(f"[{''.join(sorted(LETTERS))}]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        words: Counter[str] = Counter()
        for b in slices(batches):
            values, _ = split_words(pc.utf8_lower(b.column("text")))
            codes, distinct = coded(values)
            for w, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                words[w] += n
            if len(words) > 200_000:
                spill(words, total)
        spill(words, total)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    def spill(words: Counter[str], total: Counter[str]) -> None:
        for w, n in words.items():
            w = stripped(w)
            if allowed.fullmatch(w):
                for g in trigrams(w):
                    total[g] += n
        words.clear()

    counted = docs.select(whole_text().alias("text")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r.gram: r.n for r in counted.collect()})


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method on the weighted log loss with a small ridge (not on the constant)."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0/1, rows with nulls are left out; of repeated ids the largest counts).

    Only labels whose crc32(doc_id) mod 5 is 1 to 4 are used: 1 to 3 for the words' weights, 4 for the linear model. At
    most sample_rows rows of each class are taken, by the hash of their id; the weights of classes keep the score a
    probability over all labelled rows. Without any label the score is one half.
    """
    chars = char_model(docs)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().filter(id_remainder(5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    one = lambda t: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = one(0).unionByName(one(1)).withColumn("fold", id_remainder(5))
    # at most two times sample_rows rows of three numbers: bounded, so broadcast
    marked = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, memo = {0: Counter(), 1: Counter()}, {}
        for b in slices(batches):
            restored = Restored(b.column("text"), chars, memo)
            of = [[f for r in reads for f in features(r)] for reads in restored.readings]
            spaced = defaultdict(set)
            for d, reads in restored.spaced:
                spaced[d].update(f for r in reads for f in features(r))
            for d, (toxic, i, j) in enumerate(zip(b.column("toxic").to_pylist(), restored.offsets.tolist(), restored.offsets[1:].tolist())):
                own = {f for c in np.unique(restored.codes[i:j]).tolist() for f in of[c]}
                found[toxic].update(own | spaced.get(d, set()))
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[t][f] for f in names], pa.int64()) for t in (0, 1))], ["feature", "clean", "toxic"])

    shown = marked.filter("fold < 4")
    n = {r.toxic: r.n for r in sample.filter("fold < 4").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = n.get(1, 0) + 1, n.get(0, 0) + 1
    telling = (
        shown.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= LEAST_DOCS).withColumn("weight", F.log((F.col("toxic") + 0.5) / a) - F.log((F.col("clean") + 0.5) / b))
        .filter(F.col("weight") >= LEAST_WEIGHT)
    )
    model = Model(chars, {r.feature: r.weight for r in telling.collect() if r.feature}, [0.0] * 4)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for b in slices(batches):
            x = model.evidence(b.column("text"), memo)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, k]) for k in range(1, 4))], ["toxic", "x1", "x2", "x3"])

    rows = marked.filter("fold = 4").mapInArrow(evidence, "toxic int, x1 double, x2 double, x3 double").collect()
    if rows:
        y = np.array([r.toxic for r in rows], float)
        each = {t: size.get(t, 0) / max(1, min(size.get(t, 0), sample_rows)) for t in (0, 1)}
        model.linear = fit_logistic(np.array([[1, r.x1, r.x2, r.x3] for r in rows]), y, np.where(y == 1, each[1], each[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; other columns are ignored). A null text is
    scored as an empty one, a null id isn't held out, repeated rows give repeated rows, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(b.column("text"), memo))], ["doc_id", "held_out", "score"])

    held = F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select(F.col("doc_id").cast("long"), held, whole_text().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs with a score under one half, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for b in slices(batches, text):
            yield b.filter(pa.array(model.score(pc.fill_null(b.column(text), ""), memo) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
