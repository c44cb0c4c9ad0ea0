"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: a key is a hub if it has more than one of so many parts of all rows: there are fewer hubs than that
HUBS = 1000
#: rows of one key that are never too many for a task
FEW = 1000


def join_key_values(rows: DataFrame, key: str, total: int, /, **values: tuple[str, str]) -> DataFrame:
    """``rows`` with aggregates over their ``key``, however many rows share one: no task holds the rows of a hub.

    ``values`` maps new columns to ``(function, column)``, of ``min``, ``sum`` and ``count``; ``total`` is the number of
    rows. The values of hubs, fewer than ``HUBS`` rows at every size, are broadcast; all other keys meet by a merge join.
    """
    call = {"min": F.min, "sum": F.sum, "count": F.count}
    whole = rows.groupBy(key).agg(*(call[f](c).alias(n) for n, (f, c) in values.items()), F.count("*").alias("of_key"))
    hubs = whole.where(F.col("of_key") > max(FEW, total // HUBS)).drop("of_key")
    at_hubs = rows.join(F.broadcast(hubs), key)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    # both sides grow with the rows: never broadcast
    return at_hubs.unionByName(others.join(whole.drop("of_key").hint("merge"), key))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) of rows ``a, b``; nodes without links are absent.

    Alternates the two star steps: every node's larger neighbours, then its smaller ones, are linked
    to the smallest neighbour, until no link moves. Each link gives one link in each step; repeated ones are
    dropped in every other round. Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    Loops and repeated links do no harm.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    total, turn, moved = edges.count(), 0, True
    while total and moved:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = join_key_values(both, "u", 2 * total, m=("min", "v"))  # the root of a large component has all its nodes
        large = least.where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"), (F.col("m") < F.col("u")).alias("moved"))
        small = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        is_least = F.col("lo") == F.col("m")
        turned = small.select(F.when(is_least, F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"), (F.col("moved") | ~is_least).alias("moved"))
        edges = stored(turned.groupBy("hi", "lo").agg(F.max("moved").alias("moved")) if turn % 2 == 0 else turned, "links")
        turn, (total, moved) = turn + 1, edges.agg(F.count("*"), F.max("moved")).first()
    labels = edges.groupBy("hi").agg(F.min("lo").alias("label")).select(F.col("hi").alias("node"), "label")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return labels.union(roots)
