"""Keeping a snapshot of items current: validation, upserts on two keys, bounded deletes, first-seen dates, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.graphs import row_components

#: The file that names the version which readers of a snapshot take.
PIN = "pin.json"
ITEM = "id string, url string, title string, date string, modified string, tags array<string>, excerpt string"


def required(items: DataFrame) -> DataFrame:
    """Items with all required strings, trimmed; empty optional strings are null, urls canonical, excerpts clipped."""
    trimmed = {c: F.nullif(F.trim(c), F.lit("")) for c in ("id", "url", "title", "date", "modified", "excerpt")}
    rows = items.withColumns(trimmed).withColumn("url", t.canonical_url(F.col("url"))).withColumn("excerpt", t.clipped(F.col("excerpt")))
    return t.computed(rows).dropna(subset=["id", "url", "title", "date", "excerpt"])


def parsed(value: Column) -> Column:
    """A timestamp from an ISO day or date-time, or the date of a mail; null for anything else."""
    formats = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy HH:mm:ss Z")
    plain = F.regexp_replace(value, r"^[A-Za-z]{3},\s+", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in formats))


def stamp(modified: Column, date: Column) -> Column:
    return F.coalesce(parsed(modified), parsed(date), F.timestamp_seconds(F.lit(0)))


def first_of(items: DataFrame, keys: tuple[str, ...], order: tuple[Column | str, ...]) -> DataFrame:
    """The first row for each value of the first key, then for each of the next."""
    def one(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")

    return reduce(one, keys, items)


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both item tables (with pos, the place in each) as one: of rows with one id, then of rows with one url, the later stamp
    stays; on ties incoming, else among incoming the last, among existing the first. A row without tags takes those of
    the latest row it replaces. Chains over both keys are resolved id first, then url; upserted() walks them as they came."""
    both = existing.withColumn("incoming", F.lit(0)).unionByName(incoming.withColumn("incoming", F.lit(1)))
    rows = both.withColumn("stamp", stamp(F.col("modified"), F.col("date")))
    order = (F.desc("stamp"), F.desc("incoming"), F.when(F.col("incoming") == 1, -F.col("pos")).otherwise(F.col("pos")))
    for key in ("id", "url"):
        w = Window.partitionBy(key).orderBy(*order)
        tags = F.first(F.when(F.size("tags") > 0, F.col("tags")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.withColumn("__tags", tags).withColumn("__r", F.row_number().over(w)).filter("__r = 1").withColumn("tags", F.col("__tags")).drop("__r", "__tags")
    return rows.drop("stamp", "pos")


class Walk:
    """One upsert after another over two keys: a row belongs to the item that has its id, else to the one with its url. It takes
    that item's place if its stamp is later, or as late and incoming; the item's own keys are forgotten then."""

    def __init__(self):
        self.items: list[tuple] = []
        self.ids: dict[str, int] = {}
        self.urls: dict[str, int] = {}

    def upsert(self, row: int, item_id: str, url: str, stamp: int, incoming: bool, tagged: bool) -> None:
        at = self.ids.get(item_id, self.urls.get(url))
        if at is None:
            at, tags = len(self.items), row if tagged else None
            self.items.append(())
        else:
            _, old_id, old_url, old_stamp, old_tags = self.items[at]
            if stamp < old_stamp or stamp == old_stamp and not incoming:
                return
            tags = row if tagged else old_tags
            self.ids.pop(old_id, None)
            self.urls.pop(old_url, None)
        self.items[at] = (row, item_id, url, stamp, tags)
        self.ids[item_id] = self.urls[url] = at


def upserted(existing: DataFrame, incoming: DataFrame, folder: str) -> DataFrame:
    """Both item tables (with pos, the place in each) as one, in order of arrival: existing rows by pos, then incoming ones.

    Rows that ids and urls link, over any number of steps, are one component; each is walked by itself (see Walk), its tasks
    holding keys and stamps only, of one component at a time and as many as it has items. Rows and tags are fetched
    afterwards. Ties of stamps go to incoming rows, else to what stands; pos is unique in each table; tables may be empty.
    """
    both = existing.withColumn("incoming", F.lit(False)).unionByName(incoming.withColumn("incoming", F.lit(True)))
    path = f"{folder}/upserts-{uuid.uuid4().hex}"
    both.withColumn("row", 2 * F.col("pos") + F.col("incoming").cast("long")).write.parquet(path)
    rows = both.sparkSession.read.parquet(path)
    small = rows.select("row", "pos", "id", "url", F.unix_micros(stamp(F.col("modified"), F.col("date"))).alias("stamp"), "incoming", (F.size("tags") > 0).alias("tagged"))
    linked = row_components(small, ("id", "url"), folder)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = Walk(), None
        for b in batches:
            out: list[tuple] = []
            for component, *event in zip(*(b.column(c).to_pylist() for c in ("component", "row", "id", "url", "stamp", "incoming", "tagged"))):
                if component != at:
                    out += own.items
                    own, at = Walk(), component
                own.upsert(*event)
            yield chosen(out)
        yield chosen(own.items)

    def chosen(items: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i[0] for i in items], pa.int64()), pa.array([i[4] for i in items], pa.int64())], ["row", "tags_of"])

    kept = linked.repartition("component").sortWithinPartitions("component", "incoming", "pos").mapInArrow(walk, "row long, tags_of long")
    tags = rows.select(F.col("row").alias("tags_of"), F.col("tags").alias("__tags"))
    found = rows.join(kept, "row").join(tags, "tags_of", "left")
    return found.withColumn("tags", F.coalesce("__tags", "tags")).drop("row", "tags_of", "__tags", "pos")


def covered_deletes(items: DataFrame, incoming: DataFrame, first: str, last: str, complete: bool) -> DataFrame:
    """Items without those inside the fetched days that a complete fetch did not return, by id or url."""
    if not complete:
        return items
    inside = parsed(F.col("date")).between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)))
    gone = items.filter(inside).join(incoming.select("id"), "id", "left_anti").join(incoming.select("url"), "url", "left_anti").select("id")
    return items.join(gone, "id", "left_anti")


def first_seen(current: DataFrame, previous: DataFrame, today: str) -> DataFrame:
    """id, first_seen: the earlier snapshot's day where it is valid and not in the future, else today; ids that left are gone."""
    day = F.to_date(F.lit(today))
    old = previous.select("id", F.try_to_date("first_seen", "yyyy-MM-dd").alias("old"))
    return current.select("id").join(old, "id", "left").select("id", F.when(F.col("old") <= day, F.col("old")).otherwise(day).alias("first_seen"))


def manifest(items: DataFrame) -> DataFrame:
    when = parsed(F.col("date"))
    return items.agg(F.count("*").alias("total"), F.count_if(F.size("tags") > 0).alias("tagged"), F.date_format(F.min(when), "yyyy-MM-dd").alias("oldest"), F.date_format(F.max(when), "yyyy-MM-dd").alias("newest"), F.count_distinct("title").alias("titles"))


def write_snapshot(items: DataFrame, path: str, version: str) -> str:
    """Writes a new version beside the others and refuses an empty one. The path written; publish() points readers there once
    it has returned."""
    if items.isEmpty():
        raise ValueError("an empty fetch doesn't replace a snapshot")
    target = f"{path}/version={version}"
    items.write.mode("errorifexists").parquet(target)
    return target


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Points readers of `path` to a version that is written whole: the pin is written beside the old one and takes its place
    in one rename, so a reader finds the old version or the new one, never a part. The last to publish wins. A version whose
    job hasn't ended is refused."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda name: hadoop.Path(f"{path}/{name}")
    files = place(PIN).getFileSystem(conf)
    if not files.exists(place(f"version={version}/_SUCCESS")):
        raise ValueError(f"version {version} is not written whole")
    new = f"{PIN}-{uuid.uuid4().hex}"
    out = files.create(place(new))
    out.write(bytearray(json.dumps({"version": version}), "utf-8"))
    out.close()
    # overwriting is one step here, where FileSystem.rename refuses a name that is taken
    rename = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(place(new), place(PIN), rename)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that readers of `path` are pointed to."""
    pin = spark.read.schema("version string").json(f"{path}/{PIN}").first()
    return spark.read.parquet(f"{path}/version={pin.version}")


def read_snapshot(spark: SparkSession, path: str | None, schema: str = ITEM) -> DataFrame:
    """A JSON snapshot {pin, documents}; without a path an empty table of the same columns."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"documents array<struct<{', '.join(c.replace(' ', ': ', 1) for c in schema.split(', '))}>>").json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
