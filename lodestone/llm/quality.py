"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import coded, documents, owner, slices, split_words, sums, whole_text

#: Rows of the sample on which each rule's cost and selectivity are estimated.
SAMPLE_ROWS = 400


class Texts:
    """Some whole texts, and what the rules ask of them; each figure is computed once, when first asked for."""

    def __init__(self, texts: pa.Array, words: pa.Array | None = None, offsets: np.ndarray | None = None):
        self.texts, self._got = texts, {}
        self.words, self.offsets = split_words(texts) if words is None else (words, offsets)
        self.n_words = np.diff(self.offsets)

    def only(self, keep: np.ndarray) -> Texts:
        """Some of the texts, with all that is known of them; nothing is split again."""
        if keep.all():
            return self
        mask = pa.array(keep)
        words = self.words.filter(pa.array(np.repeat(keep, self.n_words)))
        some = Texts(self.texts.filter(mask), words, np.concatenate([[0], np.cumsum(self.n_words[keep])]))
        some._got = {k: tuple(x[keep] for x in v) if isinstance(v, tuple) else v[keep] for k, v in self._got.items()}
        return some

    def afresh(self) -> Texts:
        return Texts(self.texts, self.words, self.offsets)

    def get(self, name: str) -> np.ndarray:
        if name not in self._got:
            self._got[name] = getattr(self, "_" + name)()
        return self._got[name]

    def _word_chars(self) -> np.ndarray:
        return sums(pc.utf8_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64), self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return pc.count_substring_regex(self.texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of lines that hold a word, and of those that equal an earlier one."""
        lists = pc.split_pattern(self.texts, "\n")
        at = lists.offsets.to_numpy().astype(np.int64)
        lines, at = lists.flatten(), at - at[0]
        codes, distinct = coded(lines)
        full = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes]
        key = owner(at)[full] * max(1, len(distinct)) + codes[full]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(key), np.int64)
        again[first] = 0
        n = len(self.texts)
        return np.bincount(owner(at)[full], minlength=n), np.bincount(owner(at)[full], weights=again, minlength=n).astype(np.int64)

    def _n_lines(self) -> np.ndarray:
        return self.get("lines")[0]

    def _n_dup_lines(self) -> np.ndarray:
        return self.get("lines")[1]

    def _n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that the text holds twice or more."""
        codes, distinct = coded(self.words)
        doc = owner(self.offsets)
        inside = np.zeros(len(codes), bool)
        if len(codes) > 2:
            start = np.flatnonzero(doc[:-2] == doc[2:])
            if len(distinct) < 1 << 21:
                two, most = (codes[start] << 21) | codes[start + 1], 1 << 21
            else:  # as many numbers as there are pairs, so that a third word fits beside them
                two, most = np.unique(codes[start] * len(distinct) + codes[start + 1], return_inverse=True)[1], len(distinct)
            key = two * most + codes[start + 2]
            order = np.lexsort((key, doc[start]))
            same = (key[order][1:] == key[order][:-1]) & (doc[start][order][1:] == doc[start][order][:-1])
            again = np.zeros(len(start), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            for k in range(3):
                inside[start[again] + k] = True
        return sums(inside.astype(np.int64), self.offsets)

    def _common(self) -> np.ndarray:
        """Words whose first character is a letter."""
        return sums(pc.match_substring_regex(self.words, r"^[\"'(\[]*\p{L}").to_numpy(zero_copy_only=False).astype(np.int64), self.offsets)

    def _long_words(self) -> np.ndarray:
        return sums((pc.utf8_length(self.words).to_numpy(zero_copy_only=False) > 60).astype(np.int64), self.offsets)


#: Rule name to what it rejects. The verdict is kept only if none rejects, so the order changes the cost and not the result.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "too_few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.get("n_repeat_words") > 50 * t.n_words,
    "word_length": lambda t: (t.get("word_chars") < 2 * t.n_words) | (t.get("word_chars") > 25 * t.n_words),
    "symbols": lambda t: 10 * t.get("n_symbols") > 4 * t.n_words,
    "repeated_lines": lambda t: (t.get("n_lines") >= 4) & (10 * t.get("n_dup_lines") > 6 * t.get("n_lines")),
    "few_letters": lambda t: 10 * t.get("common") < 5 * t.n_words,
    "long_words": lambda t: 20 * t.get("long_words") > t.n_words,
}


def rule_order(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on a sample (the first rows that Spark reads, so that no more are read): first the
    one that rejects most for its cost, then the one that does so among the texts that are left, and so on. A cost is all
    that a rule asks for beyond the texts' words. The texts are judged in a task; the driver gets a number and the seconds
    for each. Ties and an empty sample go by name. The order never changes a verdict."""
    names = sorted(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Texts(b.column("text"))
            verdict, seconds = np.zeros(b.num_rows, np.int64), []
            for k, name in enumerate(names):
                own, began = t.afresh(), time.perf_counter()
                verdict |= rules[name](own).astype(np.int64) << k
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([pa.array(verdict), pa.array([[s / b.num_rows for s in seconds]] * b.num_rows, pa.list_(pa.float64()))], ["verdict", "seconds"])

    rows = docs.select(whole_text().alias("text")).limit(sample_rows).mapInArrow(measure, "verdict long, seconds array<double>").collect()
    if not rows:
        return names
    return best_order(names, np.array([r.verdict for r in rows]), np.sum([r.seconds for r in rows], axis=0))


def best_order(names: list[str], verdicts: np.ndarray, seconds: np.ndarray) -> list[str]:
    """verdicts: for each text the rules that reject it, as bits; seconds: what each rule cost."""
    out, left = [], dict(enumerate(names))
    while left:
        k = min(left, key=lambda k: (-np.count_nonzero(verdicts >> k & 1) / max(seconds[k], 1e-9), left[k]))
        out.append(left.pop(k))
        verdicts = verdicts[verdicts >> k & 1 == 0]
    return out


def judge(t: Texts, order: list[str], rules: dict = RULES) -> np.ndarray:
    """True where no rule rejects. Each rule sees only the texts that all rules before it left."""
    n = len(t.texts)
    left = np.arange(n)
    for name in order:
        if not len(left):
            break
        keep = ~rules[name](t)
        left, t = left[keep], t.only(keep)
    kept = np.zeros(n, bool)
    kept[left] = True
    return kept


BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for each row of docs (doc_id, text; other columns are ignored).

    A null text has no words and fails, repeated rows are judged each, an empty table gives no rows. Needs no shuffle."""
    order = rule_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Texts(b.column("text"))
            failed = (t.n_words < 50) | (100 * t.get("n_repeat_words") > 50 * t.n_words)
            kept = ~failed
            kept[kept] = judge(t.only(kept), [n for n in order if n not in ("too_few_words", "repeated_windows")])
            columns = [t.n_words, *(t.get(n) for n in BASE), failed, kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", *BASE, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that every rule keeps, all columns as they are."""
    order, schema = rule_order(docs), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(judge(Texts(pc.fill_null(b.column("text"), "")), order)))

    return docs.mapInArrow(run, schema)


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (
  SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len([x FOR x IN w IF regexp_matches(x, '^["''(\[]*\p{L}')]) AS common, len([x FOR x IN w IF length(x) > 60]) AS long_words
  FROM w LEFT JOIN again USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_symbols > 4 * n_words
    OR (n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines) OR 10 * common < 5 * n_words OR 20 * long_words > n_words) AS kept
FROM b
"""
