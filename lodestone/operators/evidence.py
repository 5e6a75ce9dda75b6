"""Packing ranked candidates into evidence: gates, duplicates, caps, budgets and numbering, for all questions at once.

Candidates are rows (question_id, rank, doc_id, title, excerpt, kind, theme, url ...). Where a choice depends on what was
kept before, the rows of one question (few, as they come after a top-k) are walked in rank order by applyInPandas.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

TIERS = ("primary", "spec", "essay")


def light_match(a: Column, b: Column) -> Column:
    """Two stems of one word: equal, or the shorter (four letters at least) begins the longer, by at most three letters, or
    eight where it has six letters."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    gap = F.length(long) - F.length(short)
    return (a == b) | ((F.length(short) >= 4) & F.startswith(long, short) & ((gap <= 3) | ((F.length(short) >= 6) & (gap <= 8))))


def relevance(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, doc_id, in_title, qualifies: a candidate needs a subject term of its question in its title; primaries may
    have it in their excerpt."""
    q = questions.select("question_id", t.subject_terms(F.col("question")).alias("subject"))
    rows = candidates.join(q, "question_id").select("question_id", "doc_id", "tier", "subject", t.subject_terms(F.col("title")).alias("tt"), t.subject_terms(F.col("excerpt")).alias("et"))
    has = lambda hay: F.exists("subject", lambda s: F.exists(hay, lambda x: light_match(s, x)))
    marked = rows.withColumn("in_title", has("tt")).withColumn("in_body", has("et"))
    return marked.select("question_id", "doc_id", "in_title", (F.col("in_title") | ((F.col("tier") == "primary") & F.col("in_body"))).alias("qualifies"))


def slots(candidates: DataFrame, budget: dict[str, int]) -> DataFrame:
    """The best rows of each tier, as many as its budget."""
    limit = F.create_map(*(F.lit(x) for kv in budget.items() for x in kv))
    place = F.row_number().over(Window.partitionBy("question_id", "tier").orderBy("rank"))
    return candidates.withColumn("place", place.cast("long")).filter(F.col("place") <= F.coalesce(F.try_element_at(limit, F.col("tier")), F.lit(0)))


def text_budget(candidates: DataFrame, chars: int, excerpt: int) -> DataFrame:
    """Excerpts cut to `excerpt` characters; rows as long as their running total fits."""
    cut = F.when(F.length("excerpt") > excerpt, F.concat(F.substring("excerpt", 1, excerpt - 1), F.lit("…"))).otherwise(F.col("excerpt"))
    rows = candidates.withColumn("excerpt", cut)
    used = F.sum(F.length("excerpt")).over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used.cast("long")).filter(F.col("used") <= chars)


def numbered(candidates: DataFrame) -> DataFrame:
    """question_id, doc_id, n: one number for each url, in the order of its best rank."""
    best = F.min("rank").over(Window.partitionBy("question_id", "url"))
    return candidates.withColumn("best", best).withColumn("n", F.dense_rank().over(Window.partitionBy("question_id").orderBy("best")).cast("long")).select("question_id", "doc_id", "n")


def capped_citations(candidates: DataFrame, cap: int = 5, primaries_first: bool = True) -> DataFrame:
    """At most cap rows: primaries keep their slots, and come first or last."""
    own = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("tier") != "primary", "rank"))
    kept = candidates.withColumn("c", own).filter(F.col("c") <= cap)
    side = F.col("tier") != "primary" if primaries_first else F.col("tier") == "primary"
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(side, "rank")).cast("long")).select("question_id", "doc_id", "tier", "n")


def merged_collectors(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists in turns, a document once, where it first stands."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    fresh = both.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("rank", "side"))).filter("r = 1")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "side")).cast("long")).select("question_id", "doc_id", "place", "side")


def claims_with_hits(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """claim_id, refs: locators of the hits that a supporting or contradicting claim names; claims left without any are gone.
    claims: claim_id, status, support (ids). hits: hit_id, locator."""
    rows = claims.filter(F.col("status").isin("supports", "contradicts")).select("claim_id", F.posexplode("support").alias("pos", "hit_id"))
    found = rows.join(hits, "hit_id").select("claim_id", "pos", F.coalesce("locator", F.col("hit_id").cast("string")).alias("ref"))
    return found.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), ",").alias("refs"))


def second_hop(texts: DataFrame, known: DataFrame, pattern: str, most: int = 3) -> DataFrame:
    """question_id, query: ids that first-hop texts name and that are not covered yet, at most three a question."""
    rows = texts.select("question_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "query"))
    first = rows.groupBy("question_id", "query").agg(F.min(F.struct("rank", "pos")).alias("at")).join(known, ["question_id", "query"], "left_anti")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "query")).cast("long")).filter(F.col("place") <= most).select("question_id", "query", "place")


KEPT = "question_id long, doc_id long, rank long, place long"


def deduplicated(candidates: DataFrame, share: float = 0.6) -> DataFrame:
    """Candidates in rank order without those whose title or wording a kept one has already: the same title, or a Jaccard
    index of excerpt words of at least `share`."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept, titles, seen = [], set(), []
        for r in rows.sort_values(["rank", "doc_id"]).itertuples():
            bag = set(r.bag)
            if r.title_key in titles or any(len(bag & s) >= share * len(bag | s) for s in seen if bag or s):
                continue
            titles.add(r.title_key)
            seen.append(bag)
            kept.append((r.question_id, r.doc_id, r.rank, len(kept) + 1))
        return pd.DataFrame(kept, columns=["question_id", "doc_id", "rank", "place"])

    rows = candidates.select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), t.normal_question(F.col("title")).alias("title_key"), t.subject_terms(F.col("excerpt")).alias("bag"))
    return rows.groupBy("question_id").applyInPandas(walk, KEPT)


def diversified(candidates: DataFrame, per_theme: int = 2, per_series: int = 2) -> DataFrame:
    """At most two rows of a theme and two of a series for each question; primaries are exempt and use up no cap, rows on the
    question's subject are exempt but do."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept, themes, series = [], {}, {}
        for r in rows.sort_values(["rank", "doc_id"]).itertuples():
            if r.tier != "primary":
                full = themes.get(r.theme, 0) >= per_theme or series.get(r.series, 0) >= per_series
                if full and not r.on_subject:
                    continue
                themes[r.theme] = themes.get(r.theme, 0) + 1
                series[r.series] = series.get(r.series, 0) + 1
            kept.append((r.question_id, r.doc_id, r.rank, len(kept) + 1))
        return pd.DataFrame(kept, columns=["question_id", "doc_id", "rank", "place"])

    return candidates.select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), "tier", "theme", "series", "on_subject").groupBy("question_id").applyInPandas(walk, KEPT)


def same_story_suppressed(candidates: DataFrame, k: int = 4) -> DataFrame:
    """Scored items (question_id, doc_id, title, score, age) in order of score; a later one on a kept one's story takes its
    place only if it is newer; then ordered by score again, at most k."""

    def same(a: set, b: set) -> bool:
        shared = len(a & b)
        return shared >= 2 and (shared / len(a | b) >= 0.6 or shared >= 3 and shared / min(len(a), len(b)) >= 0.8)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values(["score", "age", "doc_id"], ascending=[False, True, True]).itertuples():
            twin = next((k for k, x in enumerate(kept) if same(set(x.bag), set(r.bag))), None)
            if twin is None:
                kept.append(r)
            elif r.age < kept[twin].age:
                kept[twin] = r
        kept = sorted(kept, key=lambda r: (-r.score, r.age, r.doc_id))[:k]
        return pd.DataFrame([(r.question_id, r.doc_id, 0, n + 1) for n, r in enumerate(kept)], columns=["question_id", "doc_id", "rank", "place"])

    bag = F.array_distinct(F.filter(t.words(F.col("title")), lambda w: F.length(w) > 3))
    return candidates.select("question_id", "doc_id", "score", "age", bag.alias("bag")).groupBy("question_id").applyInPandas(walk, KEPT).drop("rank")


def merged_prose(pairs: DataFrame) -> DataFrame:
    """key, prose of pairs (key, a, b): the longer text, and those sentences of the other that it lacks."""
    longer = F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b"))
    other = F.when(F.length("a") >= F.length("b"), F.col("b")).otherwise(F.col("a"))
    sentences = lambda x: F.split(F.regexp_replace(x, r"([.!?])\s+", "$1\u0001"), "\u0001")
    known = F.transform(sentences(longer), t.normal_question)
    fresh = F.filter(sentences(other), lambda s: (t.normal_question(s) != "") & ~F.array_contains(known, t.normal_question(s)))
    return pairs.select("key", F.concat_ws(" ", longer, F.nullif(F.array_join(fresh, " "), F.lit(""))).alias("prose"))


def angles(candidates: DataFrame, seed: int, limit: int = 4) -> DataFrame:
    """question_id, theme, place, lead: the first row's theme of each question and on, at most `limit`; one, by the hash of
    question and seed, leads."""
    first = candidates.groupBy("question_id", "theme").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("long")).filter(F.col("place") <= limit)
    n = F.count("*").over(Window.partitionBy("question_id"))
    return placed.withColumn("lead", F.pmod(F.xxhash64("question_id", F.lit(seed)), n) + 1 == F.col("place")).select("question_id", "theme", "place", "lead")


def broad_pick(candidates: DataFrame, seed: int, limit: int) -> DataFrame:
    """question_id, doc_id, rank, place: the leading theme's first row, the first of every other theme, then by rank; rows on
    the question's subject, then primaries, take the place of later ones that are neither."""
    lead = angles(candidates, seed).filter("lead").select("question_id", F.col("theme").alias("lead_theme"))
    rows = candidates.join(lead, "question_id").select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), "theme", "tier", "on_subject", "lead_theme")

    def swap(chosen: list, rest: list, wanted, keep) -> None:
        for r in (r for r in rest if wanted(r) and r not in chosen):
            at = next((k for k in range(len(chosen) - 1, 0, -1) if not keep(chosen[k])), None)
            if at is not None:
                chosen[at] = r

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        ordered = list(group.sort_values(["rank", "doc_id"]).itertuples(index=False))
        first = next(r for r in ordered if r.theme == r.lead_theme)
        chosen, themes = [first], {first.theme}
        for r in ordered:
            if r.theme not in themes and len(chosen) < limit:
                themes.add(r.theme)
                chosen.append(r)
        chosen += [r for r in ordered if r not in chosen][: limit - len(chosen)]
        swap(chosen, ordered, lambda r: r.on_subject, lambda r: r.on_subject)
        swap(chosen, ordered, lambda r: r.tier == "primary", lambda r: r.tier == "primary")
        return pd.DataFrame([(r.question_id, r.doc_id, r.rank, n + 1) for n, r in enumerate(chosen)], columns=["question_id", "doc_id", "rank", "place"])

    return rows.groupBy("question_id").applyInPandas(walk, KEPT)
