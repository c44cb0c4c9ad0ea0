"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled

#: a key is a hub if it has more than one of so many parts of all rows: there are fewer hubs than that
HUBS = 1000
#: rows of one key that are never too many for a task
FEW = 1000


def with_least(rows: DataFrame, key: str, value: str, name: str, total: int) -> DataFrame:
    """``rows`` with the least ``value`` of their key, however many rows share one: no task holds the rows of a hub.

    ``total`` is the number of rows. The values of hubs, fewer than ``HUBS`` rows at every size, are broadcast; all other keys meet by a merge join.
    """
    whole = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_rows"))
    hubs = whole.where(F.col("_rows") > max(FEW, total // HUBS)).drop("_rows")
    at_hubs = rows.join(F.broadcast(hubs), key)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    return at_hubs.unionByName(others.join(whole.drop("_rows").hint("merge"), key))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) of rows ``a, b``; nodes without links to others are absent.

    Every node's larger neighbours, then its smaller ones, are linked to the smallest neighbour, in turn until no link moves. Rounds grow with the
    logarithm of the longest chain; each is written to the checkpoint folder.
    """
    edges = settled(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    total, moved = edges.count(), True
    while total and moved:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = with_least(both, "u", "v", "m", 2 * total)
        large = least.where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"), (F.col("m") < F.col("u")).alias("moved"))
        small = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        is_least = F.col("lo") == F.col("m")
        turned = small.select(F.when(is_least, F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"), (F.col("moved") | ~is_least).alias("moved"))
        edges = settled(turned.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        total, moved = edges.agg(F.count("*"), F.max("moved")).first()
    labels = edges.groupBy("hi").agg(F.min("lo").alias("label")).select(F.col("hi").alias("node"), "label")
    return labels.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
