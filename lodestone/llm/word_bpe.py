"""Token ids of whole texts under word_bpe_49k, exactly as its library gives them, at the price of the distinct words.

That tokenizer splits at white space before it merges, its normaliser works on single characters (and white space), and
no special string holds white space. The ids of a text are therefore the ids of its words, one after another. A word of
Latin letters with at most one full stop or comma at its end also falls apart there, and its case doesn't count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm.common import coded, kept, listed, split_words

NAME = "word_bpe_49k.json"
#: Words kept for reuse in one Python worker; beyond that the store starts anew. It bounds memory and changes no result.
KEPT_WORDS = 700_000
#: Words whose ids are fetched at a time.
SOME_WORDS = 65_536
#: Words that are encoded in one call.
TOGETHER = 512
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def default_path() -> str:
    return public_tokenizers.path(NAME)


def version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordTokens:
    """Words to ids. What is kept for reuse are Arrow words and numpy ids, without an object a word."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.plain, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each encoded for itself, and how many each has."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, as one text."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        # otherwise a word that the rule above doesn't fit
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self.each(words)

    def by_parts(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        parts = [encode(listed(words.slice(k, TOGETHER))) for k in range(0, len(words), TOGETHER)]
        return np.concatenate([np.zeros(0, "<u4"), *(ids for ids, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def learned(self, words: pa.Array) -> np.ndarray:
        """Where each of these distinct plain words stands among those kept."""
        if len(self.plain) > KEPT_WORDS:
            self.forget()
        place = pc.index_in(words, value_set=self.plain)
        new = pc.is_null(place)
        missing = words.filter(new)
        if len(missing):
            ids, n = self.by_parts(missing, self.joined)
            place = place.to_numpy(zero_copy_only=False).copy()
            place[new.to_numpy(zero_copy_only=False)] = len(self.plain) + np.arange(len(missing))
            self.plain, self.ids = pa.concat_arrays([self.plain, missing]), np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            return place.astype(np.int64)
        return place.to_numpy(zero_copy_only=False).astype(np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and where each word's begin (one more entry than words)."""
        simple = pc.match_substring_regex(words, SIMPLE)
        own = words.filter(simple)
        codes, stems = coded(pc.utf8_lower(pc.utf8_rtrim(own, ".,")))
        place = self.learned(stems)[codes]
        odd, of_odd = self.by_parts(words.filter(pc.invert(simple)), self.each)
        simple, of_stem = simple.to_numpy(zero_copy_only=False), self.at[place + 1] - self.at[place]
        marked = {m: pc.ends_with(own, m).to_numpy(zero_copy_only=False) for m in self.marks}
        size = np.empty(len(words), np.int64)
        size[simple] = of_stem + sum(len(ids) * marked[m] for m, ids in self.marks.items())
        size[~simple] = of_odd
        at = np.concatenate([[0], np.cumsum(size)])
        out, first = np.empty(at[-1], "<u4"), at[:-1][simple]
        out[runs(first, of_stem)] = self.ids[runs(self.at[place], of_stem)]
        for m, ids in self.marks.items():
            for k, i in enumerate(ids):
                out[(first + of_stem)[marked[m]] + k] = i
        out[runs(at[:-1][~simple], of_odd)] = odd
        return out, at


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each first on, one run after another."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def tokens(path: str) -> WordTokens:
    """One per Python worker, kept between tasks that name the path."""
    if path not in kept:
        kept[path] = WordTokens(path)
    return kept[path]


def text_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and where each text's ids begin."""
    values, offsets = split_words(texts)
    codes, vocabulary = coded(values)
    pool, first = tokens(path).of(vocabulary)
    count = np.diff(first)[codes]
    ends = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(ends[-1], "<u4")
    for k in range(0, len(codes), SOME_WORDS):
        own = slice(k, k + SOME_WORDS)
        i, j = ends[k], ends[min(k + SOME_WORDS, len(codes))]
        ids[i:j] = pool[np.repeat(first[codes[own]] - ends[:-1][own], count[own]) + np.arange(i, j)]
    return ids, ends[offsets]


def text_counts(texts: pa.Array, path: str) -> np.ndarray:
    """The number of ids of each text."""
    values, offsets = split_words(texts)
    codes, vocabulary = coded(values)
    _, first = tokens(path).of(vocabulary)
    total = np.concatenate([[0], np.cumsum(np.diff(first)[codes])])
    return total[offsets[1:]] - total[offsets[:-1]]
