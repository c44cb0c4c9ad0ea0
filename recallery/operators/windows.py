"""Running sums and numbers over groups of any size (O-103, O-135, O-139, O-159): no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions.rounds import settled


def running_total(df: DataFrame, group: str, order: list[Column | str], value: Column | str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows up to it, in ``order`` (which must not have ties within a group).

    Rows are dealt by ranges of group and order; a range sums its own rows, and the sums of the ranges before it, a row for each
    range and group in it, are added. With a window over the group alone a large group would be one task.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    value = F.col(value) if isinstance(value, str) else value
    dealt = settled(df.withColumn("_value", value).repartitionByRange(F.col(group), *keys).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_part").agg(F.sum("_value").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum("_value").over(inside))
    # a group may be null: compared as a value
    at = starts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), "_start")
    out = summed.join(at.hint("merge"), (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col(name) + F.col("_start")).drop("_value", "_part", "_at", "_group", "_start")


def numbered(df: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the number of each row in its group, from 1."""
    return running_total(df, group, order, F.lit(1).cast("long"), name)
