"""Mail archives and catalogues as tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodestone.functions import text as t

_TAG = re.compile(r"<(/?)div\b([^>]*)>", re.I)
_QUOTE = re.compile(r'class="quote(?:header)?(?:\s[^"]*)?"', re.I)


@pandas_udf(StringType())
def _without_quotes(html: pd.Series) -> pd.Series:
    """Nesting isn't regular: divisions are counted while inside a quote; one that doesn't end takes the rest along."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, at, depth = [], 0, 0
        for m in _TAG.finditer(text):
            closing, attributes = m[1], m[2]
            if depth:
                depth += -1 if closing else 1
                if depth == 0:
                    at = m.end()
            elif not closing and _QUOTE.search(attributes):
                out.append(text[at : m.start()])
                depth = 1
        return "".join(out) + ("" if depth else text[at:])

    return html.map(one)


def without_quotes(html: Column) -> Column:
    """Without quoted replies; texts that hold none never leave the JVM's side."""
    return F.when(html.rlike(r'(?i)<div\s+class="quote'), _without_quotes(F.when(html.rlike(r'(?i)<div\s+class="quote'), html))).otherwise(html)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def html_mail(pages: DataFrame, author_class: str) -> DataFrame:
    """id, title, date, text: one row for each message division of the author's class in each page (file, value)."""
    parts = F.filter(F.split("value", r'(?i)(?=<div\s+class="message)'), lambda x: x.rlike(rf'(?i)^<div\s+class="message {author_class}"'))
    rows = pages.select("file", F.explode(parts).alias("part"))
    # each bold label with what stands between it and the next tag
    label = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "<", 1))).alias("name"), F.element_at(F.split(x, "(?i)</strong>", 2), -1).alias("rest"))
    rows = rows.withColumn("labels", F.transform(F.split("part", "(?i)<strong>"), label))
    header = lambda name: F.nullif(t.decoded(F.trim(F.ltrim(F.substring_index(F.get(F.filter("labels", lambda x: (x["name"] == name) & F.startswith(x["rest"], F.lit(":"))), 0)["rest"], "<", 1), F.lit(":")))), F.lit(""))
    body = t.decoded(F.regexp_extract("part", r"(?is)<pre>(.*?)</pre>", 1))
    return rows.select(F.regexp_extract("part", r'(?i)id="([^"]+)"', 1).alias("id"), F.coalesce(header("subject"), F.lit("Untitled")).alias("title"), header("date").alias("date"), F.trim(body).alias("text")).filter("text <> ''")


#: Fields of mail headers as RFC 5322 and its kin name them, and three that archives add.
MAIL_FIELDS = "(?:resent-)?(?:from|sender|reply-to|to|cc|bcc|message-id|date)|in-reply-to|references|subject|comments|keywords|return-path|received|mime-version|(?:content|x|delivered)-[a-z-]+|sent|status|attachments"
#: What the lines below the rule before an archive's footer begin with.
FOOTER_MARKS = ("source file", "external link")


def markdown_mail(files: DataFrame, fields: str = MAIL_FIELDS, marks: tuple[str, ...] = FOOTER_MARKS) -> DataFrame:
    """file, sender, subject, date, body: headers up to the first other line (of repeated ones the first), the date from
    Date, else Sent, else the envelope line. The footer, from the first rule (---) with one of the marks somewhere below it, is
    cut. Lines are told apart one by one: empty, field, envelope, going on from the line before, title, or text."""
    text = t.decoded(F.replace(F.replace(F.replace("value", F.lit("\r"), F.lit("")), F.lit("\\>"), F.lit(">")), F.lit("<br>"), F.lit("\n")))
    rows = files.select("file", F.split(text, "\n").alias("lines"))

    def told(x: Column, i: Column) -> Column:
        name = F.lower(F.substring_index(x, ":", 1))
        kind = F.when(F.trim(x) == "", "empty").when((i == 0) & F.startswith(x, F.lit("#")), "title").when(F.contains(x, F.lit(":")) & name.rlike(f"^(?:{fields})$"), name)
        kind = kind.when(F.startswith(x, F.lit("From ")) & F.contains(F.get(F.split(x, " +"), 1), F.lit("@")), "envelope").when(x.rlike("^[ \t]") & (i > 0), "more").otherwise("text")
        return F.struct(kind.alias("kind"), x.alias("line"))

    rows = rows.withColumn("told", F.transform("lines", told))
    first = F.array_position(F.transform("told", lambda x: x["kind"]), F.lit("text")).cast("int")
    rows = rows.withColumn("n", F.when(first == 0, F.size("lines")).otherwise(first - 1))
    rows = rows.withColumn("head", F.slice("told", 1, F.col("n"))).withColumn("rest", F.slice("lines", F.col("n") + 1, F.size("lines")))
    one = lambda kind: F.get(F.filter("head", lambda x: x["kind"] == kind), 0)["line"]
    key = lambda k: F.nullif(F.trim(F.substr(one(k), F.lit(len(k) + 2))), F.lit(""))
    envelope = F.split(one("envelope"), r"[ \t]+", 3)
    title = F.nullif(F.trim(F.ltrim(one("title"), F.lit("#"))), F.lit(""))
    rules = F.transform("rest", lambda x, i: F.when(F.rtrim(x) == "---", i))
    below = F.array_max(F.transform("rest", lambda x, i: F.when(F.lower(x).rlike("|".join(marks)), i)))
    rule = F.array_min(rules)
    body = F.trim(F.array_join(F.when(rule < below, F.slice("rest", 1, rule)).otherwise(F.col("rest")), "\n"), F.lit(" \n\t"))
    return rows.select("file", F.coalesce(key("from"), F.get(envelope, 1)).alias("sender"), F.coalesce(key("subject"), title, F.lit("Untitled")).alias("subject"), F.coalesce(key("date"), key("sent"), F.nullif(F.trim(F.get(envelope, 2)), F.lit(""))).alias("date"), body.alias("body"))


def catalogue_sections(spark: SparkSession, path: str) -> DataFrame:
    """value: one row for each entry of a sectioned text file (### Name, then Key: value lines), the preamble as another."""
    return spark.read.text(path, lineSep="\n### ")


def catalogue_entries(sections: DataFrame) -> DataFrame:
    """section (apps, blocks, orgs; null where the entry names no known one), id, name, category, summary, tags, last_updated."""
    fields = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^{k}:[ \t]*([^\n]*)$", 1)), F.lit(""))
    url = fields("url")
    rows = sections.filter(~F.startswith(F.ltrim("value"), F.lit("# ")))
    section = F.regexp_extract(url, r"^https?://[^/]+/(apps|blocks|orgs)/[a-z0-9-]+/?$", 1)
    tags = F.filter(F.transform(F.split(F.coalesce(fields("tags"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    day = F.try_to_date(fields("last updated"), "yyyy-MM-dd")
    return rows.select(F.nullif(section, F.lit("")).alias("section"), F.regexp_extract(url, r"/([a-z0-9-]+)/?$", 1).alias("id"), F.trim(F.substring_index("value", "\n", 1)).alias("name"), fields("category").alias("category"), fields("description").alias("summary"), tags.alias("tags"), day.alias("last_updated"))


def declared_counts(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """section, declared, found: what the preamble says of each section beside what was parsed."""
    preamble = sections.filter(F.startswith(F.ltrim("value"), F.lit("# ")))
    says = lambda word, name: F.struct(F.lit(name).alias("section"), F.nullif(F.regexp_extract("value", rf"(?i)(\d+)\s+{word}", 1), F.lit("")).cast("long").alias("declared"))
    declared = preamble.select(F.explode(F.array(says("live apps", "apps"), says("building blocks", "blocks"), says("organisations", "orgs"))).alias("d")).select("d.*")
    return declared.join(entries.groupBy("section").agg(F.count_distinct("id").alias("found")), "section", "left").na.fill(0, ["found"])


def term_names(items: DataFrame, terms: DataFrame, most: int = 24) -> DataFrame:
    """item_id, names: the names of an item's term ids in their order, unknown ids and "Uncategorized" left out, repeated
    names once. items: item_id, ids (array). terms: id, name."""
    rows = items.select("item_id", F.posexplode("ids").alias("pos", "id")).join(terms, "id").filter((F.trim("name") != "") & (F.length("name") <= 80) & (F.lower("name") != "uncategorized"))
    first = rows.groupBy("item_id", F.lower("name").alias("key")).agg(F.min(F.struct("pos", "name")).alias("m"))
    return first.groupBy("item_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["name"]), 1, most).alias("names"))
