"""Building a clean corpus: pages and documents to rows that later jobs can trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, url (canonical), title (without entities), description, text, excerpt. Titles and descriptions are looked
    for in the head only; the description falls back to og:description."""
    head = F.substring_index("html", "</head>", 1)
    meta = lambda name: F.nullif(F.regexp_extract(head, rf'(?is)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    title = F.trim(F.regexp_replace(t.decoded(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    rows = pages.select("page_id", t.canonical_url(F.col("url")).alias("url"), title.alias("title"), t.decoded(F.coalesce(meta("description"), meta("og:description"))).alias("description"), t.page_text(F.col("html")).alias("text"))
    return t.computed(rows).withColumn("excerpt", t.clipped(F.col("text")))


def robots_verdict(pages: DataFrame, rules: list[tuple[str, str]], blocked_prefix: str = "") -> DataFrame:
    """page_id, allowed. rules: (allow or disallow, path prefix). The longest rule that begins a page's path wins, allow wins
    ties, without a rule a page is allowed; a hard-blocked prefix is never allowed. The rules are a short list: one expression,
    no join."""
    path = F.regexp_extract("url", r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    fits = F.array(*(F.when(F.startswith(path, F.lit(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(int(kind == "allow")).alias("allow"))) for kind, p in rules))
    best = F.array_max(fits)
    allowed = F.coalesce(best["allow"] == 1, F.lit(True))
    if blocked_prefix:
        allowed = allowed & ~F.startswith(path, F.lit(blocked_prefix))
    return pages.select("page_id", path.alias("path"), allowed.alias("allowed"))


def corpus_rows(pages: DataFrame, docs: DataFrame, least: int = 40) -> DataFrame:
    """The union of both sources with templated ids, quotes and footers gone, and rows of at least `least` characters."""
    items = page_items(pages).select(F.concat_ws("-", F.lit("page"), "page_id").alias("id"), F.lit("page").alias("kind"), "title", "text")
    own = docs.select(F.concat_ws("-", F.lit("doc"), "doc_id").alias("id"), F.lit("document").alias("kind"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.trim(t.unquoted(t.repaired(F.col("text")))).alias("text"))
    return items.unionByName(own).filter(F.length("text") >= least)


def chunk_list(text: Column, limit: int = 2400) -> Column:
    """Sentences packed greedily into chunks of at most limit characters; a longer sentence is cut into words first and, where
    a word is longer still, into stretches."""
    sentences = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    stretches = lambda w: F.when(F.length(w) <= limit, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(rf"(?s).{{1,{limit}}}"), F.lit(0)))
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= limit, F.array(F.trim(s))).otherwise(F.flatten(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), stretches)))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        fits = F.length(joined) <= limit
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def chunks(docs: DataFrame, limit: int = 2400) -> DataFrame:
    """doc_id, chunk (from 0), text."""
    return docs.select("doc_id", F.posexplode(chunk_list(F.col("text"), limit)).alias("chunk", "text"))


def same_stories(titles: DataFrame, jaccard: float = 0.6, contained: float = 0.8) -> DataFrame:
    """a, b: pairs of different word sets (as sorted strings, a < b) of titles that tell the same story: at least two shared
    words and a Jaccard index of at least 0.6, or three and 80 % of the shorter one.

    titles: title. Equal sets are one row, so copies make no pairs. Either rule asks for 60 % of the shorter set, so the
    shorter one need only be looked up by its rarest words: all but the last ceil(60 %) - 1 of them.
    """
    w = F.array_sort(F.array_distinct(F.filter(t.words(F.col("title")), lambda x: F.length(x) > 3)))
    sets = titles.select(w.alias("w")).filter("size(w) >= 2").distinct().withColumn("key", F.array_join("w", " "))
    each = sets.select("key", "w", F.size("w").alias("n"), F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(df, "word").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("df", "word")))
    probes = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * jaccard) + 1).select("word", F.col("key").alias("x"), F.col("w").alias("xw"), F.col("n").alias("xn"))
    held = each.select("word", F.col("key").alias("y"), F.col("w").alias("yw"), F.col("n").alias("yn"))
    pairs = probes.join(held, "word").filter((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y"))))
    shared = F.size(F.array_intersect("xw", "yw"))
    same = ((shared >= 2) & (shared / (F.col("xn") + F.col("yn") - shared) >= jaccard)) | ((shared >= 3) & (shared / F.least("xn", "yn") >= contained))
    return pairs.filter(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def feed_items(feed: DataFrame) -> DataFrame:
    """feed: page_id, xml (one <item>). title, link, categories and tags: a category element with a domain of post_tag is a tag."""
    schema = "title string, link string, category array<struct<_VALUE: string, _domain: string>>"
    item = F.from_xml("xml", schema, {"rowTag": "item"})
    of = lambda tag: F.transform(F.filter(F.col("i.category"), lambda c: (c["_domain"] == "post_tag") == tag), lambda c: c["_VALUE"])
    return feed.select("page_id", item.alias("i")).select("page_id", F.col("i.title").alias("title"), t.canonical_url(F.col("i.link")).alias("url"), of(False).alias("categories"), of(True).alias("tags"))


def front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, title, date, themes, prose from texts that begin with a --- block of key: value lines; others keep their text."""
    text = F.col("text")
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    themes = F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(key("themes"), F.lit("")), r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return docs.select("doc_id", key("title").alias("title"), key("date").alias("date"), themes.alias("themes"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "").alias("prose"))
