"""Cutting the lineage between the rounds of an iteration; dealing out small scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key of more rows is dealt over several tasks of a join
HEAVY = 20_000


def _folder(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``); only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan whose files give fewer splits than there are cores is dealt out by ``key``; any other is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet files (to ``path``, or else into the checkpoint folder) and read back: filters on it skip files and row groups."""
    path = path or f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_join(large: DataFrame, small: DataFrame, key: str | list[str], deal: str, parts: int = 16) -> DataFrame:
    """Inner join in which each key of ``large`` with more than ``HEAVY`` rows is spread over ``parts`` tasks by ``deal``, as a key may hold a third of all rows.

    ``small`` should have few rows of such keys: they are repeated for each part. All other rows are written once. ``large`` is gone through twice.
    """
    keys = [key] if isinstance(key, str) else key
    # at most one key for HEAVY rows
    heavy = F.broadcast(settled(large.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HEAVY).select(*keys, F.lit(True).alias("_heavy"))))
    dealt = large.join(heavy, keys, "left").withColumn("_part", F.when(F.col("_heavy"), F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int")).otherwise(0)).drop("_heavy")
    each = small.join(heavy, keys, "left").withColumn("_part", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return dealt.join(each.hint("merge"), [*keys, "_part"]).drop("_part")
