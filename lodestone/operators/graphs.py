"""Connected components for tables whose rows belong together by several keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_components(rows: DataFrame, keys: tuple[str, ...], folder: str) -> DataFrame:
    """The rows (a column `row`, unique, long) with component: the smallest row that equal keys reach, over any of the keys.

    A row joins its keys' hubs, a hub its rows. In each round every row takes the smallest label of its hubs' rows, and then
    the label of that label, so a chain shrinks by more than half. Labels are written to the folder in each round, which cuts
    the lineage; hubs are sums over keys, so a key that very many rows share is one row a task before it is shuffled. A null key
    joins nothing.
    """
    spark, path = rows.sparkSession, f"{folder}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    links = kept(rows.select("row", F.explode(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(k).cast("string"))) for n, k in enumerate(keys)))).alias("hub")).filter("hub is not null"), "links")
    labels, turn = kept(rows.select("row", F.col("row").alias("component")), "labels-0"), 0
    while True:
        hubs = links.join(labels, "row").groupBy("hub").agg(F.min("component").alias("least"))
        near = links.join(hubs, "hub").groupBy("row").agg(F.min("least").alias("near"))
        stepped = labels.join(near, "row", "left").select("row", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        stepped = kept(stepped, f"stepped-{turn}")
        jump = stepped.select(F.col("row").alias("component"), F.col("component").alias("further"))
        turn += 1
        labels = kept(stepped.join(jump, "component").select("row", F.least("component", "further").alias("component"), "before"), f"labels-{turn}")
        if labels.filter(F.col("component") < F.col("before")).isEmpty():
            return rows.join(labels.select("row", "component"), "row")
        labels = labels.select("row", "component")
