"""Quality, decay, duplicates, eviction, consistency (O-140..O-160). Every time-dependent operator takes ``as_of``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions import text as tx

from .windows import numbered

#: Fixed values (O-146): decay base, largest age in days, least relevance, boosts of quality and importance.
PRIORITIES = {
    "critical": (1.0, 3650, 0.0, 1.0, 1.0), "high": (0.98, 365, 0.1, 0.8, 0.85), "medium": (0.95, 90, 0.2, 0.6, 0.60),
    "low": (0.85, 14, 0.3, 0.4, 0.35), "ephemeral": (0.5, 1, 0.5, 0.2, 0.10),
}
LEVEL_ACCURACY = {"belief": 1.0, "extracted": 0.8, "processed": 0.7, "raw": 0.5}


def _of(table: dict, key: Column, default: float, at: int | None = None) -> Column:
    rule = None
    for name, value in table.items():
        value = value if at is None else value[at]
        rule = F.when(key == name, F.lit(float(value))) if rule is None else rule.when(key == name, F.lit(float(value)))
    return rule.otherwise(F.lit(float(default)))


def policy(priority: Column, at: int) -> Column:
    return _of(PRIORITIES, priority, PRIORITIES["medium"][at], at)


def memory_quality(df: DataFrame, as_of: Column) -> DataFrame:
    """O-145: needs ``priority, access_count, last_access, level, verified, metadata``; adds four scores and ``overall``."""
    keys = ("kind", "namespace", "provenance", "source_path")
    complete = reduce(lambda a, b: a + b, [F.get_json_object("metadata", f"$.{k}").isNotNull().cast("double") for k in keys]) / len(keys)
    fresh = 1.0 - tx.age_days(F.col("last_access"), as_of) / policy(F.col("priority"), 1)
    scores = {
        "relevance": F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("access_count") * 0.1) * 0.6 + policy(F.col("priority"), 3) * 0.4),
        "accuracy": F.when(F.col("verified"), 1.0).otherwise(_of(LEVEL_ACCURACY, F.col("level"), 0.5)),
        "freshness": F.when(F.col("last_access").isNull(), 0.8).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fresh))),
        "completeness": complete,
    }
    out = df.withColumns(scores)
    return out.withColumn("overall", F.expr("0.40D * relevance + 0.25D * accuracy + 0.20D * freshness + 0.15D * completeness"))


def decay_memories(df: DataFrame, as_of: Column) -> DataFrame:
    """O-147: ``relevance`` times the priority's base to the power of days; only changes above .001."""
    days = tx.age_days(F.coalesce("last_access", "created_at"), as_of)
    out = df.withColumn("new_relevance", F.col("relevance") * F.pow(policy(F.col("priority"), 0), days.cast("double")))
    return out.where(F.abs(F.col("relevance") - F.col("new_relevance")) > 0.001)


def consolidate_exact(df: DataFrame, compat: bool = False) -> DataFrame:
    """O-148: of equal normalised texts with equal kind and priority the first id stays; ``compat`` compares lengths only."""
    normal = F.array_join(tx.words(F.col("content")), " ")
    key = F.octet_length(normal) if compat else F.sha2(normal, 256)
    groups = df.withColumn("key", key).groupBy("key", F.coalesce("kind", F.lit("")), F.coalesce("priority", F.lit("medium"))).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return groups.select("id", "copies")


def evict_low_quality(df: DataFrame) -> DataFrame:
    """O-149: what goes: quality under .25, except critical ones, and high ones from .1."""
    low = F.col("overall") < 0.25
    return df.where(low & F.when(F.col("priority") == "critical", False).when(F.col("priority") == "high", F.col("overall") < 0.1).otherwise(True))


def compress_large(df: DataFrame, threshold: int = 2048, mark: str = "...[compressed]") -> DataFrame:
    """O-150: texts above the threshold (bytes) are cut to threshold - 20 characters and marked."""
    large = F.octet_length("content") > threshold
    return df.where(large).withColumn("content", F.concat(F.substring("content", 1, threshold - 20), F.lit(mark)))


def importance_score(access: Column, last: Column, created: Column, priority: Column, as_of: Column) -> Column:
    """O-156."""
    recency = F.when(last.isNull(), 0.45).otherwise(1.0 / (1.0 + tx.age_days(last, as_of) / 14.0))
    age = F.when(created.isNull(), 0.70).otherwise(1.0 / (1.0 + tx.age_days(created, as_of) / 60.0))
    total = 0.35 * (1.0 - F.exp(-access / 4.0)) + 0.25 * recency + 0.20 * age + 0.20 * policy(priority, 4)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def decay_importance(importance: Column, last: Column, created: Column, rate: float, as_of: Column) -> Column:
    """O-157."""
    seconds = F.greatest(F.lit(0.0), as_of.cast("double") - F.coalesce(last, created).cast("double"))
    age = F.coalesce(seconds / 86400.0, F.lit(0.0))
    score = importance * F.pow(F.lit(rate), age / 7.0) / (1.0 + age / 20.0)
    score = F.when(last.isNotNull(), score / (1.0 + tx.age_days(last, as_of) / 30.0)).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def similarity(left: str, right: str, cosine: Column) -> Column:
    """O-153: .5 cosine, .4 word Jaccard, .1 path, for columns prefixed ``left_`` and ``right_``."""
    words = tx.jaccard(F.array_distinct(tx.tokens3(F.col(f"{left}content"))), F.array_distinct(tx.tokens3(F.col(f"{right}content"))))
    squeezed = lambda c: F.array_join(tx.words(F.col(c)), " ")
    path = F.when(F.col(f"{left}path") == F.col(f"{right}path"), 1.0).when(squeezed(f"{left}path") == squeezed(f"{right}path"), 0.95).otherwise(0.0)
    return 0.5 * cosine + 0.4 * words + 0.1 * path


def merge_documents(df: DataFrame) -> DataFrame:
    """O-155: per ``cluster`` the best document's id and a row for each distinct sentence of all, in the order ``q, from_id, at``.

    Rows, not one text: a cluster of any size stays spread.
    """
    each = df.select("cluster", "id", "quality", F.posexplode(tx.sentences(F.col("content"))).alias("at", "sentence"))
    normal = F.array_join(tx.words(F.col("sentence")), " ")
    first = each.groupBy("cluster", normal.alias("key")).agg(F.min(F.struct((-F.col("quality")).alias("q"), "id", "at", "sentence")).alias("s"))
    best = df.groupBy("cluster").agg(F.min(F.struct((-F.col("quality")).alias("q"), "id")).alias("b"))
    return first.join(best, "cluster").select("cluster", F.col("b.id").alias("id"), "s.q", F.col("s.id").alias("from_id"), "s.at", "s.sentence")


def promoted(importance: Column) -> Column:
    """O-152: a fifth more, at most 1."""
    return F.least(F.lit(1.0), importance * 1.2)


def demoted(importance: Column) -> Column:
    """O-152: a fifth less."""
    return importance * 0.8


NEGATIONS = ["not", "no", "never", "neither", "none", "doesn't", "isn't", "wasn't"]


def factual_conflicts(df: DataFrame) -> DataFrame:
    """O-140: texts with the same first ten words, some with and some without a negation (as a substring)."""
    signature = F.array_join(F.slice(tx.words(F.col("content")), 1, 10), " ")
    negative = reduce(lambda a, b: a | b, [F.lower("content").contains(w) for w in NEGATIONS])
    groups = df.select("id", signature.alias("signature"), negative.cast("int").alias("negative")).where("signature <> ''").groupBy("signature").agg(
        F.count("*").alias("members"), F.min("negative").alias("least"), F.max("negative").alias("most"), F.min("id").alias("first_id")
    )
    return groups.where("members > 1 AND least < most").select("signature", "members", "first_id", F.lit(0.8).alias("severity"))


def entity_conflicts(df: DataFrame) -> DataFrame:
    """O-141: a reference's only property is that it is referenced, so nothing can differ: always empty."""
    return df.select("id", F.lit(0.7).alias("severity")).where(F.lit(False))


def duplicate_inconsistencies(df: DataFrame) -> DataFrame:
    """O-142: equal letters and digits, yet a word Jaccard with the group's first below .7."""
    key = F.sha2(F.lower(F.regexp_replace("content", r"[^\p{L}\p{N}]", "")), 256)
    keyed = df.select("id", "content", key.alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("id", "content")).alias("f"), F.count("*").alias("members")).where("members > 1")
    both = keyed.join(first, "key").where(F.col("id") != F.col("f.id"))
    near = F.when((F.size(tx.words(F.col("content"))) == 0) & (F.size(tx.words(F.col("f.content"))) == 0), 1.0).otherwise(
        tx.jaccard(F.array_distinct(tx.words(F.col("content"))), F.array_distinct(tx.words(F.col("f.content"))))
    )
    worst = both.select("key", F.col("f.id").alias("first_id"), near.alias("near")).groupBy("key", "first_id").agg(F.min("near").alias("near"))
    return worst.where("near < 0.7").select("first_id", (1.0 - F.col("near")).alias("severity"))


def temporal_marker(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("yesterday"), "yesterday").when(t.contains("today"), "today").when(t.contains("tomorrow"), "tomorrow").when(t.contains("last week"), "last_week").when(
        t.contains("next week"), "next_week"
    )


def temporal_contradictions(df: DataFrame) -> DataFrame:
    """O-143, O-51: how many pairs of a 'yesterday' and a 'tomorrow' text each 'yesterday' text is in.

    A product of two counts: the pairs themselves are not expanded.
    """
    marked = df.select("id", temporal_marker(F.col("content")).alias("marker"))
    tomorrows = marked.where("marker = 'tomorrow'").agg(F.count("*").alias("pairs"))
    return marked.where("marker = 'yesterday'").join(F.broadcast(tomorrows)).where("pairs > 0").select("id", "pairs")  # one row


def coherence(conflict_severity: Column, issues: Column, drift_severity: Column) -> Column:
    """O-133."""
    base = F.greatest(F.lit(0.0), 1.0 - 0.15 * conflict_severity - 0.05 * issues)
    return F.greatest(F.lit(0.0), base - 0.1 * drift_severity)


def working_set_eviction(df: DataFrame, capacity: int = 100) -> DataFrame:
    """O-159: beyond the capacity rows read less than twice go first, oldest first, then the least recently read."""
    order = [(F.col("access_count") >= 2).cast("int").desc(), F.desc("last_accessed"), F.desc("created_at"), F.col("id")]
    return numbered(df, "session", order, "place").where(F.col("place") > capacity)


def newest_per_group(df: DataFrame, group: str, time: str, most: int) -> DataFrame:
    """O-160: the newest rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(time), "id")
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
