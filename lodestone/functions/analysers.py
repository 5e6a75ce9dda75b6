"""Token rules by collection: what stays whole, what it becomes, and which words say nothing there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as t

WORD = r"[\p{L}\p{N}]+"
#: Ids that stay whole, in lower case, and what they become (None: as they are): standards by number, plural or not, and opcodes.
IDS = ((r"brc-?([0-9]+)s?(?![\p{L}\p{N}])", "brc-$1"), (r"op_[a-z0-9_]+", None))


@dataclass(frozen=True)
class Analyser:
    """whole: (pattern, replacement), tried at each place before a plain word, in order. stop: words that go beside function words.
    Patterns are in lower case, as texts are when they are read."""

    whole: tuple[tuple[str, str | None], ...] = IDS
    stop: frozenset[str] = frozenset()

    def pattern(self) -> str:
        return "|".join([*(f"(?:{p})" for p, _ in self.whole), WORD])

    def terms(self, text: Column) -> Column:
        """The terms of a text in order; null for null."""
        found = F.regexp_extract_all(F.lower(text), F.lit(self.pattern()), F.lit(0))
        rewritten = [(p, r) for p, r in self.whole if r is not None]
        if rewritten:
            found = F.transform(found, lambda w: _rewritten(w, rewritten))
        none = sorted(set(t.STOP_WORDS) | self.stop)
        return F.filter(found, lambda w: ~w.isin(*none) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))


def _rewritten(word: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, put in rules:
        word = F.regexp_replace(word, f"^(?:{pattern})$", put)
    return word


#: Words of a question about news that say nothing about its subject, and kinds of listings in a catalogue.
NEWS = frozenset("news latest recent recently update updates report reports reported article articles today week month year".split())
KINDS = frozenset("app apps application applications tool tools library libraries service services company companies listing listings".split())
COLLECTIONS = {"archive": Analyser(), "news": Analyser(stop=NEWS), "catalogue": Analyser(stop=KINDS)}


def by_collection(collection: Column, analysers: dict[str, Analyser] | None = None, otherwise: str = "archive") -> Callable[[Column], Column]:
    """The terms of a text by the rules of its row's collection; unknown and null collections have those of `otherwise`."""
    known = COLLECTIONS if analysers is None else analysers

    def terms(text: Column) -> Column:
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for name, analyser in known.items():
            if name != otherwise:
                out = out.when(collection == name, analyser.terms(text))
        return out.otherwise(known[otherwise].terms(text))

    return terms
