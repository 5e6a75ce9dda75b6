"""Evidence rows that say the same: keys of pairs, titles, series and clusters, and the collapse of copies with an alias map."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t

#: Kinds that are two forms of one text, and the locators that name it: scheme://essay/group/slug and folder/group--slug.md.
PAIRED = ("principle", "essay")
LOCATORS = (r"(?i)^[a-z]+://(?:essay)/([^/]+)/(.+)$", r"(?i)^[^/]+/([a-z]+)--(.+)\.md$")
#: Two wordings are different if neither the share of the smaller one's words nor the Jaccard index reaches these.
CONTAINED, ALIKE = 0.82, 0.72
HIT = "id string, kind string, locator string, title string, date string, excerpt string, themes array<string>"


def pair_key(item_id: Column, locator: Column, kinds: tuple[str, ...] = PAIRED) -> Column:
    """group:slug of an id kind:group:slug of one of the kinds, else of a locator; null where neither has one. Slugs may be percent-encoded."""
    forms = [(F.trim(item_id), rf"(?i)^(?:{'|'.join(kinds)}):([^:]+):(.+)$"), *((locator, p) for p in LOCATORS)]
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    key = lambda x, p: F.when(x.rlike(p), F.lower(F.concat(F.regexp_extract(x, p, 1), F.lit(":"), plain(F.regexp_extract(x, p, 2)))))
    return F.coalesce(*(key(x, p) for x, p in forms))


def title_key(title: Column) -> Column:
    """Lower case, apostrophes gone, all else that is no letter or digit one space; null for nothing."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "['’]", ""), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(plain, F.lit(""))


def series_key(title: Column, stop: tuple[str, ...] = ()) -> Column:
    """The first two stems of a title's head (before a dash or colon), without function words, `stop` and short words: titles
    of one series share it. Null where no word is left."""
    head = F.split(title, r"\s+[—–-]\s+|:\s+")[0]
    stems = F.filter(F.transform(t.content_words(head), t.stem), lambda w: (F.length(w) > 2) & ~w.isin(*stop, *map(_plain_stem, stop)))
    return F.nullif(F.array_join(F.slice(stems, 1, 2), "-"), F.lit(""))


def _plain_stem(word: str) -> str:
    return word[:-1] if len(word) > 4 and word.endswith("s") else word


def cluster_key(item_id: Column, kind: Column, themes: Column, title: Column, primary: str = "primary", stop: tuple[str, ...] = ()) -> Column:
    """What a row is about: the primary record, else its first theme, else its title's series, else its title, else itself."""
    theme = F.nullif(F.lower(F.trim(F.get(themes, F.lit(0)))), F.lit(""))
    own = lambda name, x: F.concat(F.lit(name), x)
    in_primary = (F.lower(kind) == primary) | F.exists(F.coalesce(themes, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) == primary)
    return F.when(F.coalesce(in_primary, F.lit(False)), primary).otherwise(F.coalesce(own("theme:", theme), own("series:", series_key(title, stop)), own("title:", title_key(title)), own("id:", item_id)))


def listed(values) -> list:
    return [] if values is None else list(values)


class Kept:
    """A row that stays, with what it took over from others."""

    def __init__(self, row):
        self.row, self.text, self.locator, self.title, self.date = row, (row.excerpt or "").strip(), row.locator, row.title, row.date
        self.themes, self.kind, self.aliases = listed(row.themes), row.kind, []

    def take(self, row) -> None:
        other = (row.excerpt or "").strip()
        if len(other) > len(self.text):
            self.locator = row.locator or self.locator
        self.text = joined_prose(self.text, other)
        self.title, self.date, self.kind = self.title or row.title, self.date or row.date, self.kind or row.kind
        self.themes += [x for x in listed(row.themes) if x not in self.themes]
        self.aliases += [x for x in (row.id, row.locator) if x and x != self.row.id and x not in self.aliases]


def sentence_key(sentence: str) -> str:
    return re.sub(r"\s+", " ", sentence.lower()).rstrip(".!?,;:").strip()


def joined_prose(a: str, b: str) -> str:
    """The longer text, and those sentences of the other that it doesn't say."""
    longer, other = (a, b) if len(a) >= len(b) else (b, a)
    if not other or other in longer:
        return longer
    said, low, fresh = {sentence_key(s) for s in re.split(r"(?<=[.!?])\s+", longer)}, longer.lower(), []
    for s in re.split(r"(?<=[.!?])\s+", other):
        if (key := sentence_key(s)) and key not in said and s.lower() not in low:
            said.add(key)
            fresh.append(s.strip())
    return " ".join([longer, *fresh])


def worded_apart(a: str, b: str) -> bool:
    """Words of four letters or more tell; a text without any is apart from none."""
    x, y = ({w for w in re.findall(r"[^\W_]+", s.lower()) if len(w) >= 4} for s in (a, b))
    if not x or not y:
        return False
    both = len(x & y)
    return both < CONTAINED * min(len(x), len(y)) and both < ALIKE * len(x | y)


def collapsed(hits: DataFrame) -> DataFrame:
    """question_id, place, id, kind, locator, title, date, excerpt, themes, aliases: hits (question_id, rank, HIT) without copies.

    In rank order (ties by id), a hit goes into the kept one with its pair key; else, if it is of a paired kind or has such
    a key, into the kept one of those with its title, unless their days differ or their wording does. The kept row keeps
    its place and id; it takes over the sentences that it lacks, the richer text's locator, what it has no value for, and the
    ids and locators of what went into it as aliases. A null text is empty; hits of one question (a top-k) are walked in
    one task; no hits give no rows.
    """
    rows = hits.select("question_id", "rank", "id", "kind", "locator", "title", "date", "excerpt", "themes", pair_key(F.col("id"), F.col("locator")).alias("pair"), title_key(F.col("title")).alias("title_key"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype(object).where(rows.notna(), None)
        kept: list[Kept] = []
        pairs: dict[str, Kept] = {}
        titles: dict[str, Kept] = {}
        for r in rows.sort_values(["rank", "id"]).itertuples():
            paired = r.pair is not None or (r.kind or "").lower() in PAIRED
            twin = pairs.get(r.pair) if r.pair else None
            if twin is None and paired and r.title_key in titles:
                first = titles[r.title_key]
                days = {str(d)[:10] for d in (first.date, r.date) if d}
                if len(days) < 2 and not worded_apart(first.text, r.excerpt or ""):
                    twin = first
            if twin is None:
                twin = Kept(r)
                kept.append(twin)
                if paired and r.title_key:
                    titles.setdefault(r.title_key, twin)
            else:
                twin.take(r)
            if r.pair:
                pairs.setdefault(r.pair, twin)
        found = [(k.row.question_id, n, k.row.id, k.kind, k.locator, k.title, k.date, k.text, k.themes, k.aliases) for n, k in enumerate(kept, 1)]
        return pd.DataFrame(found, columns=["question_id", "place", "id", "kind", "locator", "title", "date", "excerpt", "themes", "aliases"])

    return rows.groupBy("question_id").applyInPandas(walk, f"question_id long, place long, {HIT}, aliases array<string>")


def alias_map(kept: DataFrame) -> DataFrame:
    """question_id, alias, id: where to look for a row that went into another."""
    return kept.select("question_id", F.explode("aliases").alias("alias"), "id")
