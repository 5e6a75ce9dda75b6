"""Groups of spelling variants: words one inserted, deleted or replaced character apart, and the form each stands for.

The prefixes of all words are nodes of a trie, their suffixes nodes of a trie of the reversed words, and every node has a
number. A word is entered under the pair (node of what comes before a place, node of what comes after): with the character
at the place skipped, and with nothing skipped. Two words that skip the same pair differ by a replacement; one that skips
the pair at which another is cut is longer by an insertion. The joins are on two integers, and nothing is lost.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, documents, slices, whole_text, written

#: Letters of a run: a to z in both cases and the characters U+00C0 to U+00FF, which UTF-8 writes as byte C3 and another.
LATIN_LEAD = 0xC3
#: Characters that a word may hold: a-z and the 64 of Latin-1.
ALPHABET = 26 + 64
#: Down to this depth nodes are numbered as those of the complete trie over the alphabet, which a long still holds.
COMPLETE = 9
#: Distinct words that a task counts before it gives them on.
SOME_WORDS = 200_000

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), LATIN_LEAD]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of letters, A-Z in lower case, as bytes in order; and where each text's runs begin."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(at), np.int64)
    inside = _letter[data]
    inside[1:] |= data[:-1] == LATIN_LEAD
    cuts = np.unique(np.concatenate([at, np.flatnonzero(inside[1:] != inside[:-1]) + 1]))
    parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(_lower[data])])
    runs = inside[cuts[:-1]]
    return parts.filter(pa.array(runs)), np.searchsorted(cuts[:-1][runs], at)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int | None = 199) -> DataFrame:
    """word, n: words of at least least_length code points that occur least_count times or more.

    With damage, a run whose crc32 with its document's id is divisible by it loses one code point (see the contract). Each
    task counts the distinct words of its slices first, so a frequent word is a row a task and not one an occurrence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in slices(batches):
            values, at = letter_runs(b.column("text"))
            codes, distinct = coded(values)
            runs = distinct.to_pylist()
            length = pc.utf8_length(distinct.cast(pa.large_string())).to_numpy(zero_copy_only=False)
            full = np.bincount(codes, minlength=len(runs))
            if damage and len(runs):
                texts = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(at))
                long_enough = length[codes] >= least_length
                pair, times = np.unique(texts[long_enough] * len(runs) + codes[long_enough], return_counts=True)
                begin = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("doc_id").to_pylist()]
                of, word = np.divmod(pair, len(runs))
                h = np.fromiter((zlib.crc32(runs[w], begin[d]) for d, w in zip(of.tolist(), word.tolist())), np.int64, len(pair))
                for k in np.flatnonzero(h % damage == 0).tolist():
                    w, run = int(word[k]), runs[word[k]].decode()
                    cut = int(h[k]) % len(run)
                    full[w] -= times[k]
                    if len(run) > least_length:
                        found[(run[:cut] + run[cut + 1 :]).encode()] += int(times[k])
            for w in np.flatnonzero((full > 0) & (length >= least_length)).tolist():
                found[runs[w]] += int(full[w])
            if len(found) > SOME_WORDS:
                yield batch(found)
                found.clear()
        yield batch(found)

    def batch(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letter_number(c: str) -> int:
    """1 to ALPHABET."""
    return ord(c) - 96 if c <= "z" else ord(c) - 0xC0 + 27


def node_numbers(word: str, deep: list[int]) -> list[int]:
    """The numbers of the nodes on a word's way from the root; deep: of those below COMPLETE."""
    out = [0]
    for c in word[:COMPLETE]:
        out.append(out[-1] * (ALPHABET + 1) + letter_number(c))
    return out + deep


def deep_nodes(words: DataFrame) -> DataFrame:
    """word, heads, tails: the numbers of the nodes below COMPLETE on both ways of each word longer than that, negative ones.

    A node is known by the digest of its way (so that a long word costs as many rows as it has characters), and its number
    is its place in a written table, so that work done again meets the same numbers."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", 1 << 18):
            rows = []
            for word in b.column("word").to_pylist():
                for side, way in ((0, word), (1, word[::-1])):
                    h = hashlib.blake2b(way[:COMPLETE].encode(), digest_size=16)
                    for depth in range(COMPLETE, len(way)):
                        h.update(way[depth].encode())
                        rows.append((word, side, depth, h.digest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["word", "side", "depth", "way"])

    each = words.select("word").filter(F.length("word") > COMPLETE).mapInArrow(ways, "word string, side int, depth int, way binary")
    nodes = written(each.select("side", "way").distinct().withColumn("node", -1 - F.monotonically_increasing_id()), "trie-nodes")
    own = each.join(nodes, ["side", "way"]).groupBy("word")  # a word's nodes: as many as its characters
    lists = {s: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("depth", "node")))) for k, s in enumerate(("heads", "tails"))}
    return own.agg(*(x.alias(s) for s, x in lists.items())).select("word", F.col("heads.node").alias("heads"), F.col("tails.node").alias("tails"))


def trie_pairs(words: DataFrame) -> DataFrame:
    """word, head, tail, skips (a character stands between the two; else the word is cut there), first (of equal characters in a row)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", 1 << 18):
            index, head, tail, skips, first = [], [], [], [], []
            for k, (word, a, z) in enumerate(zip(b.column("word").to_pylist(), b.column("heads").to_pylist(), b.column("tails").to_pylist())):
                p, s, n = node_numbers(word, a), node_numbers(word[::-1], z)[::-1], len(word)
                index += [k] * (2 * n + 1)
                head += p[:-1] + p
                tail += s[1:] + s
                skips += [True] * n + [False] * (n + 1)
                first += [i == 0 or word[i] != word[i - 1] for i in range(n)] + [True] * (n + 1)
            yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(index, pa.int32())), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(skips, pa.bool_()), pa.array(first, pa.bool_())], ["word", "head", "tail", "skips", "first"])

    none = F.array().cast("array<long>")
    short = words.filter(F.length("word") <= COMPLETE).select("word", none.alias("heads"), none.alias("tails"))
    return short.unionByName(deep_nodes(words)).mapInArrow(pairs, "word string, head long, tail long, skips boolean, first boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """word, other: each ordered pair of different words (column word, distinct, letters of the alphabet above) that differ by
    exactly one inserted, deleted or replaced character.

    A skipped pair fixes all but one character, so at most as many words as the alphabet has letters share one; a cut pair
    is one word's. A word that loses one of several equal characters in a row is entered for the first of them only, so no
    link comes twice. Deep nodes are told by digests, so the distance is checked at last."""
    pairs = written(trie_pairs(words), "trie-pairs")
    skipping, cut = pairs.filter("skips"), pairs.filter("not skips").select("head", "tail", F.col("word").alias("other"))
    replaced = skipping.join(skipping.select("head", "tail", F.col("word").alias("other")), ["head", "tail"]).filter(F.col("word") != F.col("other"))
    shorter = skipping.filter("first").join(cut, ["head", "tail"])
    links = replaced.select("word", "other").unionByName(shorter.select("word", "other")).unionByName(shorter.select(F.col("other").alias("word"), F.col("word").alias("other")))
    return links.filter(F.levenshtein("word", "other") == 1)


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of words (word, distinct; n, positive).

    form: the near word of the largest n (ties: the smallest in code-point order), if that is at least `times` the word's
    own; root: where following forms ends. As n grows by `times` with each step, ways are short: a few rounds of doubling.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    links = neighbours(words)
    known = links.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    form = (-F.col("best.minus") >= times * F.col("n")) & F.col("best").isNotNull()
    all_words = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.minus")).alias("form_n"))
    all_words = written(all_words, "forms")
    most = all_words.agg(F.max("n")).first()[0] or 1
    way = all_words.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log(most, times))).bit_length()):  # steps double in each round
        further = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = written(way.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return all_words.join(way, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int | None = 199, times: int = 5) -> DataFrame:
    """group_variants() of the words of docs (doc_id, text; other columns are ignored).

    A null text has no words, a null id counts as an empty one, repeated rows count each, ties of n go to the smallest word,
    an empty table gives no rows. Words may be as long as a text: they cost rows in proportion."""
    return group_variants(written(word_counts(docs, least_length, least_count, damage), "words"), times)


def op12_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(0, 256) AS r(i)),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END FOR c IN string_split(id || w, '')])),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM r, crc WHERE length(w) > 5),
k AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
v AS (SELECT word, n FROM k WHERE length(word) >= 6 AND n >= 5),
s AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT x.word, y.word AS other, y.n AS other_n FROM s x JOIN s y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.a || s.z = v.word
  UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.a || s.z = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM e GROUP BY ALL),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f AS e ON e.word = g.root WHERE e.form IS NULL
"""
