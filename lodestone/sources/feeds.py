"""Feeds and sitemaps as files: every record becomes a row, with the reason why it isn't an item, or null where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.snapshots import parsed

CORRUPT = "_corrupt"
PLACE = f"loc string, lastmod string, {CORRUPT} string"
RSS = f"title string, link string, pubDate string, description string, category array<struct<_VALUE: string, _domain: string>>, {CORRUPT} string"
#: Titles and excerpts come as a string or as an object with a rendered string; read as strings, objects keep their JSON.
POST = f"id string, link string, date_gmt string, date string, modified_gmt string, modified string, title string, excerpt string, _embedded struct<`wp:term`: array<array<struct<name: string, taxonomy: string>>>>, {CORRUPT} string"
#: Names kept of an item's categories and tags, and the longest of them.
MOST_CATEGORIES, MOST_TAGS, LONGEST_NAME = 12, 24, 80


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """file, and the schema's columns: one row for each element of this tag in the files; what isn't well-formed stands in _corrupt.

    Files are cut at closing tags, so that large ones are split among tasks and a broken element takes no others along (one
    that isn't closed takes the next). A closing tag inside CDATA cuts too.
    """
    pieces = spark.read.text(path, lineSep=f"</{tag}>").select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", rf"(?s)<{tag}[\s>].*$", 0).alias("element"))
    options = {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_xml(F.concat("element", F.lit(f"</{tag}>")), schema, options)
    return _whole(pieces.filter("element <> ''").select("file", record.alias("record")).select("file", "record.*"))


def json_records(spark: SparkSession, path: str, schema: str = POST) -> DataFrame:
    """file, and the schema's columns: one row for each line; lines that are no object stand in _corrupt."""
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return _whole(rows.withColumn("file", F.col("_metadata.file_path")))


def _whole(rows: DataFrame) -> DataFrame:
    """What was read of a record before its fault is forgotten."""
    return rows.select("file", *(F.when(F.col(CORRUPT).isNull(), F.col(c)).alias(c) for c in rows.columns if c not in ("file", CORRUPT)), CORRUPT)


def moment(value: Column) -> Column:
    """A timestamp; where no zone is named it is UTC."""
    raw = F.regexp_replace(F.trim(value), r"\s*(?:GMT|UTC|UT)$", " +0000")
    return parsed(F.when(raw.rlike(r"T[0-9:.]+$"), F.concat(raw, F.lit("Z"))).otherwise(raw))


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def first_reason(*reasons: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(when, F.lit(name)) for when, name in reasons), F.lit(None).cast("string"))


def curated(spark: SparkSession, path: str, required: tuple[str, ...] = ("id", "title", "text", "category"), told: str = "text") -> DataFrame:
    """file, the required columns, reason: hand-made entries, one JSON object a line. An entry needs each required key as a
    string (a number is none) and `told` as more than white space. Reasons, the first that holds: corrupt, no <key>, blank
    <told>; entries with a null reason are the ones to use. Other keys are left out, repeated entries stay."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("entry"))
    part = lambda c, kind: F.try_variant_get("entry", f"$.{c}", kind)
    missing = [(F.coalesce(F.schema_of_variant(part(c, "variant")) != "STRING", F.lit(True)), f"no {c}") for c in required]
    is_object = F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT"))
    reason = first_reason((~F.coalesce(is_object, F.lit(False)), "corrupt"), *missing, (part(told, "string").rlike(r"^\s*$"), f"blank {told}"))
    return rows.select("file", *(part(c, "string").alias(c) for c in required), reason.alias("reason"))


def sitemap_urls(index: DataFrame, entries: DataFrame) -> DataFrame:
    """sitemap, url (canonical), lastmod (timestamp), reason for each entry, and for each sitemap listed that has no entry.

    index: loc, _corrupt (elements `sitemap`); entries: sitemap (the name of the file it stands in), loc, lastmod, _corrupt
    (elements `url`). An entry's sitemap must be listed by an address that ends in its name; an address listed repeatedly
    counts once. Reasons, the first that holds: corrupt, no address, unlisted, empty sitemap.
    """
    name = F.element_at(F.split(F.regexp_replace(F.trim("loc"), r"[?#].*$", ""), "/"), -1)
    listed = index.filter(F.col(CORRUPT).isNull() & ~blank(F.col("loc"))).select(name.alias("sitemap"), F.lit(True).alias("listed")).distinct()
    rows = entries.select("sitemap", "loc", "lastmod", CORRUPT, F.lit(True).alias("held")).join(listed, "sitemap", "full")
    reason = first_reason((F.col("held").isNull(), "empty sitemap"), (F.col(CORRUPT).isNotNull(), "corrupt"), (blank(F.col("loc")), "no address"), (F.col("listed").isNull(), "unlisted"))
    return rows.select("sitemap", t.canonical_url(F.col("loc")).alias("url"), moment(F.col("lastmod")).alias("lastmod"), reason.alias("reason"))


def clean_names(names: Column, most: int) -> Column:
    """The first `most` different names (in any case) of at most LONGEST_NAME characters, in their order, without
    "Uncategorized"."""
    plain = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(t.decoded(F.coalesce(x, F.lit(""))), r"\s+", " ")))
    kept = F.filter(plain, lambda x: F.length(x).between(1, LONGEST_NAME) & (F.lower(x) != "uncategorized"))
    first = t.bound(kept, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, F.lower), F.lower(x)) == i + 1))
    return F.slice(first, 1, most)


def _items(rows: DataFrame, host: str, cutoff: str | None) -> DataFrame:
    """rows: file, _corrupt, key, link, stamp, modified, title, excerpt, categories, tags."""
    line = lambda c: F.trim(F.regexp_replace(t.html_text(F.col(c)), r"\s+", " "))
    out = t.computed(
        rows.withColumns({"url": t.canonical_url(F.col("link")), "title": line("title"), "excerpt": line("excerpt"), "date": moment(F.col("stamp")), "modified": moment(F.col("modified"))})
        .withColumns({"categories": clean_names(F.col("categories"), MOST_CATEGORIES), "tags": clean_names(F.col("tags"), MOST_TAGS)})
    )
    old = F.col("date") < F.to_timestamp(F.lit(cutoff)) if cutoff else F.lit(False)
    reason = first_reason((F.col(CORRUPT).isNotNull(), "corrupt"), (blank(F.col("key")), "no id"), (~F.coalesce(F.startswith("url", F.lit(f"https://{host}/")), F.lit(False)), "other host"), (F.col("date").isNull(), "no date"), (old, "before the cutoff"), (blank(F.col("title")), "no title"), (blank(F.col("excerpt")), "no excerpt"))
    return out.select("file", F.concat(F.lit(f"{host}-"), "key").alias("id"), "url", "title", "date", "modified", "categories", "tags", t.clipped(F.col("excerpt")).alias("excerpt"), reason.alias("reason"))


def articles(posts: DataFrame, host: str, cutoff: str | None = None) -> DataFrame:
    """file, id, url, title, date, modified, categories, tags, excerpt, reason for each record of article JSON (json_records).

    Items have a null reason; others the first that holds: corrupt, no id, other host, no date, before the cutoff, no title,
    no excerpt. Repeated records stay, an empty table gives none.
    """
    shown = lambda c: F.when(F.startswith(F.ltrim(c), F.lit("{")), F.get_json_object(c, "$.rendered")).otherwise(F.col(c))
    terms = F.flatten(F.filter(F.col("_embedded.wp:term"), lambda g: g.isNotNull()))
    named = lambda taxonomy: F.transform(F.filter(terms, lambda x: x["taxonomy"] == taxonomy), lambda x: x["name"])
    either = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.col(b))
    rows = posts.select("file", CORRUPT, F.col("id").alias("key"), "link", either("date_gmt", "date").alias("stamp"), either("modified_gmt", "modified").alias("modified"), shown("title").alias("title"), shown("excerpt").alias("excerpt"), named("category").alias("categories"), named("post_tag").alias("tags"))
    return _items(rows, host, cutoff)


def feed_articles(entries: DataFrame, host: str, cutoff: str | None = None) -> DataFrame:
    """As articles, of RSS items (xml_records of `item`); an item's id is the last part of its address' path."""
    of = lambda tag: F.transform(F.filter("category", lambda c: F.coalesce(c["_domain"] == "post_tag", F.lit(False)) == tag), lambda c: c["_VALUE"])
    path = F.regexp_extract("link", r"(?i)^\s*https?://[^/?#]+([^?#]*)", 1)
    slug = F.substring(F.element_at(F.split(F.rtrim(F.trim(path), F.lit("/")), "/"), -1), 1, 180)
    key = F.coalesce(F.nullif(slug, F.lit("")), F.lit("item"))
    rows = entries.select("file", CORRUPT, key.alias("key"), "link", F.col("pubDate").alias("stamp"), F.lit(None).cast("string").alias("modified"), "title", F.col("description").alias("excerpt"), of(False).alias("categories"), of(True).alias("tags"))
    return _items(rows, host, cutoff)
