"""Threads of messages (conv_id, turn, role, text)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions import text as t


def valid_threads(messages: DataFrame) -> DataFrame:
    """Messages with an id, a turn, a known role and a text; of repeated turns the first text; threads left empty are gone."""
    ok = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isin("system", "user", "assistant") & F.col("text").isNotNull())
    return ok.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).filter("r = 1").drop("r")


def cleaned(messages: DataFrame) -> DataFrame:
    """Without blank turns (but for a thread's last), and without [n] markers in the text."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = messages.withColumn("last", last).filter((F.trim("text") != "") | (F.col("turn") == F.col("last")))
    return rows.select("conv_id", "turn", "role", F.regexp_replace("text", r"\s?\[[0-9]+\]", "").alias("text"))


def context_window(messages: DataFrame, turns: int = 10, chars: int = 12_000) -> DataFrame:
    """conv_id, turn: the turns before each thread's last that fit, newest first: at most `turns`, and their characters
    together at most `chars`; the first that doesn't fit ends the window."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("back", F.row_number().over(w)).filter("back > 1").withColumn("used", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("back") <= turns + 1) & (F.col("used") <= chars)).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


def with_prior_question(messages: DataFrame) -> DataFrame:
    """User turns with the thread's user turn before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return messages.withColumn("prior", prior).filter("role = 'user'").select("conv_id", "turn", "prior")


def asked_before(messages: DataFrame) -> DataFrame:
    """User turns that ask what the thread has asked already, by normal form."""
    users = messages.filter("role = 'user'").withColumn("key", t.normal_question(F.col("text")))
    return users.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("turn"))).filter("r > 1").select("conv_id", "turn")


def most_asked(messages: DataFrame, k: int = 20) -> DataFrame:
    """The k questions asked most often, by normal form, and in how many threads."""
    users = messages.filter("role = 'user'").withColumn("key", t.normal_question(F.col("text")))
    return users.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("threads")).orderBy(F.desc("n"), "key").limit(k)


def export(messages: DataFrame) -> DataFrame:
    """One Markdown document for each thread: a title (the first user turn), then a heading and the text for each turn."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    title = F.substring(F.regexp_replace(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), r"\s+", " "), 1, 60)
    body = F.array_join(F.transform("rows", lambda m: F.concat(F.lit("## "), F.initcap(m["role"]), F.lit("\n\n"), m["text"])), "\n\n")
    return messages.groupBy("conv_id").agg(rows.alias("rows"), F.coalesce(title, F.lit("Untitled")).alias("title")).select("conv_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), body).alias("markdown"))


def _folding() -> tuple[str, str]:
    """Letters that decompose into a plain one and marks, and that one; then the marks themselves, which go."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000) if chr(c) not in marks}
    pairs = {c: d[0] for c, d in pairs.items() if d != c and all(unicodedata.combining(x) for x in d[1:])} | {"ß": "s"}
    return "".join([*pairs, *marks]), "".join(pairs.values())


FOLDED = _folding()


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), *FOLDED)


def grams(text: Column, size: int) -> Column:
    """The distinct parts of a text that are `size` characters long."""

    def of(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - size)
        parts = F.transform(at, lambda i: F.concat(*(F.get(chars, i + k) for k in range(size))))
        return F.when(F.size(chars) >= size, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))

    # as a lambda's variable the characters are split once, and not anew for each part
    return F.flatten(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), of))


def search_threads(messages: DataFrame, queries: DataFrame, size: int = 3) -> DataFrame:
    """query_id, conv_id, turn, snippet: threads that hold all terms of a query (query_id, query), accents and case folded;
    the first turn that holds any, with 52 characters on both sides of its first match (as the folded text counts them).

    Terms are parts of words. A term meets the messages of its rarest part of three characters (a shorter term those that
    hold it), and only what holds the whole term stays; so no message is held against every query. Messages give only the
    parts that some term has. Null texts and queries hold nothing, a query without terms finds nothing.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(folded(F.col("query")), r"\s+"), lambda x: x != ""))).alias("term"))
    short = [F.when(F.length("term") == n, F.array("term")) for n in range(1, size)]
    keys = asked.select("term").distinct().select("term", F.explode(F.coalesce(*short, grams(F.col("term"), size))).alias("gram"))
    wanted = keys.select("gram").distinct()
    rows = t.computed(messages.select("conv_id", "turn", "text", folded(F.coalesce("text", F.lit(""))).alias("fold")))
    each = F.flatten(F.array(*(grams(F.col("fold"), n) for n in range(1, size + 1))))
    held = rows.select("conv_id", "turn", F.explode(each).alias("gram")).join(wanted, "gram")
    often = held.groupBy("gram").agg(F.count("*").alias("df"))
    # a part that no message has makes its term impossible; else the rarest is looked up
    rarest = keys.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).filter("r.df > 0").select("term", "r.gram")
    met = held.join(rarest, "gram").select("conv_id", "turn", "term")
    found = met.join(rows, ["conv_id", "turn"]).withColumn("at", F.position("term", "fold")).filter("at > 0")
    found = found.withColumn("snippet", F.substr("text", F.greatest(F.col("at") - 52, F.lit(1)), F.lit(104))).select("conv_id", "turn", "term", "at", "snippet")
    number = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    by = asked.join(found, "term").groupBy("query_id", "conv_id").agg(F.count_distinct("term").alias("n"), F.min(F.struct("turn", "at", "snippet")).alias("m"))
    return by.join(number, "query_id").filter("n = terms").select("query_id", "conv_id", "m.turn", "m.snippet")


def objects(text: str) -> list[str]:
    """The balanced {...} of a text that stand in no other. Inside them, strings and what they escape are passed over; a
    brace that stays open takes in all that follows."""
    found, depth, start, quoted = [], 0, 0, False
    for m in re.finditer(r'\\.|["{}]', text, re.S):
        mark = m[0]
        if quoted:
            quoted = mark != '"'
        elif mark == '"':
            quoted = depth > 0
        elif mark == "{":
            start = start if depth else m.start()
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : m.end()])
    return found


@F.pandas_udf(ArrayType(StringType()))
def top_objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: objects(x or ""))


#: What a rewrite may be long, and how many citations a reply may name.
LONGEST_REWRITE, MOST_CITED = 500, 12
REPLY = "verdict string, rewrite string, used array<int>"


def reply_check(replies: DataFrame) -> DataFrame:
    """replies: reply_id, reply (a model's text). verdict, rewrite, reason: the one JSON object in the text, if it is balanced
    and has a known verdict; else why it is discarded."""
    found = replies.withColumn("__objects", top_objects(F.col("reply")))
    parsed = F.from_json(F.get("__objects", F.lit(0)), REPLY, {"mode": "PERMISSIVE"})
    found = found.withColumn("__n", F.size("__objects")).withColumn("__parsed", parsed)
    v, rewrite = F.col("__parsed.verdict"), F.trim(F.coalesce("__parsed.rewrite", F.lit("")))
    reason = F.when(F.col("__n") == 0, "no object").when(F.col("__n") > 1, "more than one object").when(v.isNull(), "no verdict").when(~v.isin("pass", "revise"), "unknown verdict").when((v == "revise") & (rewrite == ""), "no rewrite")
    kept = found.withColumn("reason", reason)
    return kept.select("reply_id", F.when(F.col("reason").isNull(), v).alias("verdict"), F.when(F.col("reason").isNull(), F.col("__parsed.rewrite")).alias("rewrite"), "reason")


def anchored_replies(replies: DataFrame, most: int = MOST_CITED, longest: int = LONGEST_REWRITE) -> DataFrame:
    """reply_id, rewrite, used, reason of replies (reply_id, reply, question, context, n_citations) that reply_check keeps or discards, and
    further: a rewrite may be `longest` characters long and must share a stem or an acronym with the question or its context,
    else it is made up; used are the named citations from 1 to n_citations, each once, in order, `most` at most (null: none
    named). Null questions and contexts anchor nothing."""
    checked = reply_check(replies).join(replies.select("reply_id", F.concat_ws(" ", "question", "context").alias("asked"), "n_citations", F.get(top_objects(F.col("reply")), F.lit(0)).alias("json")), "reply_id")
    acronyms = lambda x: F.regexp_extract_all(x, F.lit(r"\b[A-Z][A-Z0-9]+\b"), F.lit(0))
    shares = F.arrays_overlap(t.subject_terms(F.col("rewrite")), t.subject_terms(F.col("asked"))) | F.arrays_overlap(acronyms(F.col("rewrite")), acronyms(F.col("asked")))
    named = F.array_distinct(F.filter(F.from_json("json", REPLY)["used"], lambda n: (n >= 1) & (n <= F.col("n_citations"))))
    text = F.trim(F.coalesce("rewrite", F.lit("")))
    reason = F.coalesce("reason", F.when(F.length(text) > longest, "rewrite too long").when((text != "") & ~shares, "no anchor"))
    rows = checked.withColumn("used", F.slice(named, 1, most)).withColumn("reason", reason)
    return rows.select("reply_id", F.when(F.col("reason").isNull(), F.col("rewrite")).alias("rewrite"), F.when(F.col("reason").isNull(), F.col("used")).alias("used"), "reason")
