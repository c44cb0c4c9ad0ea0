"""Roll-ups, quotas, usage and evaluation (O-110..O-133, O-284, O-285, O-294)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallery.functions import text as tx


def memory_stats(df: DataFrame) -> DataFrame:
    """O-110, O-111: counts, bytes, counts by priority and by quality bucket, in one row."""
    q, p = F.col("overall"), F.col("priority")
    named = {f"p_{name}": F.count_if(p == name) for name in ("critical", "high", "medium", "low", "ephemeral")}
    named |= {"high_quality": F.count_if(q >= 0.7), "medium_quality": F.count_if((q >= 0.4) & (q < 0.7)), "low_quality": F.count_if(q < 0.4), "evictable": F.count_if(q < 0.25)}
    return df.agg(F.count("*").alias("documents"), F.sum(F.octet_length("content")).alias("bytes"), *[c.alias(n) for n, c in named.items()])


def rate_limit_status(usage: DataFrame, as_of: Column) -> DataFrame:
    """O-115, O-268: per provider: tokens, requests and errors within the last hour, day, week and month (strictly after)."""
    out = []
    for name, seconds in (("hour", 3600), ("day", 86400), ("week", 7 * 86400), ("month", 30 * 86400)):
        recent = F.col("ts").cast("double") > as_of.cast("double") - seconds
        out += [F.sum(F.when(recent, F.col("tokens")).otherwise(0)).alias(f"tokens_{name}"), F.count_if(recent).alias(f"requests_{name}")]
    return usage.groupBy("provider").agg(*out, F.count_if("is_error").alias("errors"))


def quota_low(usage: DataFrame, quotas: DataFrame, as_of: Column, share: float = 0.9) -> DataFrame:
    """O-117: weekly use over quota above a share; the quota defaults to a million, and a quota of 0 is never low."""
    week = usage.where(F.col("ts").cast("double") > as_of.cast("double") - 7 * 86400).groupBy("provider").agg(F.sum("tokens").alias("used"))
    quota = F.coalesce("weekly_quota", F.lit(1_000_000))
    return week.join(quotas, "provider", "left").select("provider", "used", F.when(quota == 0, False).otherwise(F.col("used") / quota > share).alias("low"))


def daily_summary(usage: DataFrame, as_of: Column) -> DataFrame:
    """O-116: requests of the last 24 hours per provider with totals, first and last."""
    day = usage.where(F.col("ts").cast("double") > as_of.cast("double") - 86400)
    return day.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def usage_metering(events: DataFrame, weights: DataFrame) -> DataFrame:
    """O-119: requests and weighted units per category; ``weights`` (``event_type, category, units``) is a fixed mapping."""
    return events.join(F.broadcast(weights), "event_type").groupBy("category").agg(F.count("*").alias("requests"), F.sum("units").alias("units"))


def task_stats(tasks: DataFrame) -> DataFrame:
    """O-121: total, by status and by priority, as rows."""
    return tasks.select(F.explode(F.array(F.lit("total"), F.concat(F.lit("status:"), "status"), F.concat(F.lit("priority:"), "priority"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def session_stats(turns: DataFrame) -> DataFrame:
    """O-123: sessions, events, mean turns."""
    each = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max((F.col("role") == "system").cast("int")).alias("with_system"))
    return each.agg(F.count("*").alias("sessions"), F.sum("turns").alias("events"), F.avg("turns").alias("average_turns"), F.sum("with_system").alias("with_system"))


def average_sentiment(values: Column) -> Column:
    """O-124: mean of values clamped to 0..1; null where there are none."""
    clamped = F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.when(F.size(values) > 0, F.aggregate(clamped, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def themes(df: DataFrame, limit: int = 5) -> DataFrame:
    """O-128: tokens of four letters or more that occur more than once, most frequent first."""
    each = df.select(F.explode(F.split(F.lower("content"), r"[^a-z0-9]+")).alias("token")).where(F.length("token") >= 4)
    return each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(limit)


def token_f1(pairs: DataFrame) -> DataFrame:
    """O-130: exact match and token F1 of ``id, predicted, expected``, tokens as multisets.

    Tokens are counted by grouping, so the time grows with the texts and not with their square.
    """
    normal = lambda c: F.array_remove(F.split(F.lower(c), r"[^a-z0-9]+"), "")
    both = pairs.select("id", normal("predicted").alias("p"), normal("expected").alias("e"))
    count = lambda side: both.select("id", F.explode(side).alias("w"), F.lit(side).alias("side"))
    each = count("p").unionByName(count("e")).groupBy("id", "w").agg(F.least(F.count_if(F.col("side") == "p"), F.count_if(F.col("side") == "e")).alias("n"))
    common = each.groupBy("id").agg(F.sum("n").alias("common"))
    sizes = both.select("id", (F.size("p") + F.size("e")).alias("both"), (F.array_join("p", " ") == F.array_join("e", " ")).alias("exact"))
    f1 = F.when(F.col("common") > 0, 2.0 * F.col("common") / F.col("both")).otherwise(0.0)
    return sizes.join(common, "id", "left").select("id", "exact", f1.alias("f1"))


def pattern_decay(patterns: DataFrame, as_of: Column) -> DataFrame:
    """O-131: pending patterns older than 30 days lose .1 of their confidence."""
    old = (F.col("verification") == "pending") & (tx.age_days(F.col("created_at"), as_of) > 30)
    return patterns.withColumn("confidence", F.when(old, F.greatest(F.lit(0.0), F.col("confidence") - 0.1)).otherwise(F.col("confidence")))


def pattern_auto_verify(patterns: DataFrame) -> DataFrame:
    """O-132: one more use; verified from five uses and .7 on, otherwise pending again (also if verified by hand)."""
    out = patterns.withColumn("usage_count", F.col("usage_count") + 1)
    return out.withColumn("verification", F.when((F.col("usage_count") >= 5) & (F.col("confidence") >= 0.7), "auto_verified").otherwise("pending"))


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """O-294: mean, median and the element at floor(.95 n) of the sorted values (from their order, no list)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    n = F.count("*").over(Window.partitionBy(group))
    at = df.select(group, value, place.alias("place"), n.alias("n"))
    return at.groupBy(group).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(F.when(F.col("place") == F.least(F.floor(F.col("n") * 0.95) + 1, F.col("n")), F.col(value))).alias("p95"), F.count("*").alias("n")
    )
