"""How the filters of a cascade interact: what each removes, and what it would have, in every order of them.

A row's failures are one mask. With masks as rows of 0 (fails) and infinity, and the orders as columns of positions (each
order's inverse permutation), their min-plus product is the step at which each mask is removed in each order. Rows only
matter by part and mask, so Spark counts those, and the few counts of a part are scattered over orders and steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, whole_text

SPACE = r"[\x20\x09-\x0D]+"
#: The filter that a row fails if a smaller id has its text.
COPY = "E"


def words(text: Column) -> Column:
    """The maximal runs of what isn't white space."""
    inner = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def text_filters() -> dict[str, Column]:
    """Failure conditions by letter over the columns text and words."""
    n, capitals = F.size("words"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * n,
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """part, mask (bit k: fails the k-th filter, the last one being COPY), n, good, toxic: counts of rows.

    Of each row only its id, part, digest and mask are shuffled: once by id to its labels, once by digest, summed for each
    part and label first, so that copies of one text are as many rows as it has parts. A row is a copy if its id is above
    the smallest of its digest; rows that repeat that id, and rows without an id, aren't copies."""
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), part.alias("part"), whole_text().alias("text")).withColumn("words", words(F.col("text")))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), bits.alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    named = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", flag("good"), flag("toxic"))
    ids = named.groupBy("doc_id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))  # rows of an id lie together already
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    alike = ids.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first, nameless)
    least = alike.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = alike.join(least, "digest").withColumn("own", own)
    each = F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    parts = split.select("part", "good", "toxic", each.alias("e")).select("part", "good", "toxic", "e.mask", "e.n")
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return parts.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good"), weight("toxic"))


@lru_cache(maxsize=4)
def removal_steps(n_filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders; positions[f, order] from 1; steps[mask, order], infinite where the mask is kept."""
    orders = list(permutations(range(n_filters)))
    positions = np.argsort(np.array(orders), axis=1).T + 1  # the inverse permutations
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    cost = np.where(fails == 1, 0.0, np.inf)
    steps = np.full((1 << n_filters, len(orders)), np.inf)
    for f in range(n_filters):  # the min-plus product, a filter at a time
        np.minimum(steps, cost[:, f, None] + positions[f], out=steps)
    return orders, positions, steps


def audited(weights: np.ndarray, n_filters: int) -> dict[str, np.ndarray]:
    """Figures [part, order, step] for weights [part, mask, 3] (rows, good rows, toxic rows); at a step stands its filter."""
    orders, positions, steps = removal_steps(n_filters)
    order = np.array(orders)
    parts, n_orders = len(weights), len(orders)
    removed = np.zeros((parts, n_orders, n_filters, 3), np.int64)
    failing = np.zeros((parts, n_orders, n_filters), np.int64)
    for mask in range(1, 1 << n_filters):
        at = steps[mask].astype(np.int64) - 1
        removed[:, np.arange(n_orders), at] += weights[:, None, mask]  # each order has one step for a mask
        for f in range(n_filters):
            if mask >> f & 1:
                failing[:, np.arange(n_orders), positions[f] - 1] += weights[:, None, mask, 0]
    by_filter = np.zeros((parts, n_filters), np.int64)
    for f in range(n_filters):
        by_filter[:, f] = removed[:, np.arange(n_orders), positions[f] - 1, 0].sum(1)
    alone = weights[:, 1 << np.arange(n_filters), 0]
    return {
        "kept": weights[:, :, 0].sum(1)[:, None, None] - np.cumsum(removed[..., 0], axis=2),
        "removed": removed[..., 0],
        "redundant": failing - removed[..., 0],
        "unique_fails": alone[:, order],
        "good_lost": removed[..., 1],
        "toxic_lost": removed[..., 2],
        "shapley": by_filter[:, order],
    }


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)
#: Parts whose figures are made together.
SOME_PARTS = 64


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part (the source), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.

    docs: doc_id, text, source; other columns are ignored. labels: doc_id, quality, toxic; an id with several rows is good
    or toxic if one of them says so, null says nothing. filters: failure conditions by letter over text and words (a null
    condition doesn't fail); COPY comes after them. A null text is empty, a null source the part '', repeated rows count
    each and aren't copies of each other (ties of an id), a row without an id is no copy
    and has no labels, empty documents give no rows.
    The orders grow as the factorial of the filters, so at most six are taken.
    """
    filters = text_filters() if filters is None else filters
    letters = [*filters, COPY]
    if len(letters) > 6 or len(set(letters)) < len(letters):
        raise ValueError("at most six filters, each by a letter of its own")
    n_filters, n_orders = len(letters), factorial(len(letters))
    counts = failure_masks(docs, labels, filters)
    # a part's masks are 2 to the number of filters at most
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["".join(letters[f] for f in order) for order in removal_steps(n_filters)[0]]
        for whole in batches:
            for a in range(0, whole.num_rows, SOME_PARTS):
                b = whole.slice(a, SOME_PARTS)
                lists = b.column("masks")
                values, of = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                weights = np.zeros((b.num_rows, 1 << n_filters, 3), np.int64)
                mask = values.field("mask").to_numpy()
                for k, name in enumerate(("n", "good", "toxic")):
                    np.add.at(weights[..., k], (of, mask), values.field(name).to_numpy())
                figures = audited(weights, n_filters)
                size = b.num_rows * n_orders * n_filters
                part = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), n_orders * n_filters)))
                order = pa.array(np.repeat(names, n_filters).tolist() * b.num_rows, pa.string())
                step = pa.array(np.resize(np.arange(1, n_filters + 1, dtype=np.int32), size))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(figures[f].reshape(-1)) for f in FIGURES)], ["part", "filter_order", "step", *FIGURES])

    return parts.mapInArrow(run, SCHEMA)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY ALL),
m AS (SELECT part, doc_id, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
  (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM d),
g AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(x, bit)),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM f p, f q, f r, f s, f u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
s AS (SELECT filter_order, step, f.bit,
  (SELECT coalesce(sum(b.bit), 0) FROM f b WHERE strpos(left(filter_order, step - 1), b.x) > 0)::BIGINT AS earlier
  FROM o, range(1, 6) AS t(step), f WHERE f.x = filter_order[step]),
r AS (SELECT part, filter_order, step, s.bit,
  coalesce(sum(n) FILTER (mask & (earlier | s.bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & s.bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & s.bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = s.bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & s.bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & s.bit > 0), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
