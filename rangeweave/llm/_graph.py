"""Connected components as joins: no link, label or component list ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_tables, written


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node of each node's component, for links (a, b) between longs.

    Least labels travel along links and then along labels, so their way halves each round; every round is written, which
    cuts its lineage and lets Spark split joins at hubs.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = written(both, "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("class")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("heard"))
        near = written(labels.join(heard, "node").select("node", F.col("class").alias("before"), F.least("class", "heard").alias("class")), "labels")
        jump = near.select(F.col("node").alias("class"), F.col("class").alias("over"))
        after = written(near.join(jump, "class", "left").select("node", "before", F.least("class", F.coalesce("over", "class")).alias("class")), "labels")
        moved = after.filter("class <> before").limit(1).count()
        drop_tables(labels, near)
        labels = spark.read.schema("node long, class long").parquet(after.inputFiles()[0].rsplit("/", 1)[0]) if after.inputFiles() else after.select("node", "class")
        if not moved:
            drop_tables(edges)
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, class) of earlier links, or None, after more links (a, b); only classes that meet are gone over."""
    if labels is None:
        return components(links)
    for side in "ab":
        own = labels.select(F.col("node").alias(side), F.col("class").alias("of"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    links = written(links.filter("a <> b").distinct(), "meeting")
    if links.isEmpty():
        return labels
    up = components(links).toDF("met", "into")
    after = labels.join(up, labels["class"] == up["met"], "left").select("node", F.coalesce("into", "class").alias("class"))
    alone = up.join(labels, up["met"] == labels["node"], "left_anti").select(F.col("met").alias("node"), F.col("into").alias("class"))
    return written(after.unionByName(alone), "labels")
