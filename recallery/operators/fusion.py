"""Fusion of ranked lists (O-90..O-104, O-138, O-139)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import bm25_documents
from .vector import cosine
from .windows import running_total

K = 60


def ranked(df: DataFrame, source: str, weight: float, limit: int, ties: str = "id") -> DataFrame:
    """O-138: the first rows of a scored list with their rank. Takes the best before ranking, so the rank's window is small."""
    top = df.orderBy(F.desc("score"), ties).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), ties))
    return top.select("id", rank.alias("rank"), F.lit(source).alias("source"), F.lit(weight).alias("weight"))


def rrf(lists: list[DataFrame], k: int = K) -> DataFrame:
    """O-90: reciprocal ranks summed with their weights; order: score, total weight, id."""
    every = reduce(DataFrame.unionByName, lists)
    fused = every.groupBy("id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.sum("weight").alias("total_weight"), F.concat_ws("+", F.array_sort(F.collect_set("source"))).alias("sources")
    )
    return fused


def top(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.desc("total_weight"), "id").limit(limit)


Hook = Callable[[DataFrame], DataFrame]


def hybrid_search(memories: DataFrame, query: str, sought: Column, limit: int, pre: Callable[[str], str] | None = None, post: Hook | None = None) -> DataFrame:
    """O-91, O-101: BM25 and cosine, twice the limit each with weight .5, fused by reciprocal rank.

    ``memories``: ``id, content, vector``. ``pre`` may change the query, ``post`` the result.
    """
    query = pre(query) if pre else query
    words = ranked(bm25_documents(memories.select("id", "content"), query), "bm25", 0.5, 2 * limit)
    near = memories.where(F.col("vector").isNotNull()).select("id", cosine(F.col("vector"), sought).alias("score")).where("score > 0")
    out = top(rrf([words, ranked(near, "vector", 0.5, 2 * limit)]), limit)
    return post(out) if post else out


def dynamic_k(n: int) -> int:
    """O-92: 60, and one more for each thousand rows beyond a thousand."""
    return K + n // 1000 if n > 1000 else K


def hybrid_search_store(lists: dict[str, DataFrame], weights: dict[str, float], n: int, limit: int) -> DataFrame:
    """O-92: three signals with their contributions kept in columns; lists have ``id, score``."""
    k = dynamic_k(n)
    every = reduce(DataFrame.unionByName, [ranked(df, name, weights[name], 5 * limit) for name, df in lists.items()])
    part = {name: F.sum(F.when(F.col("source") == name, F.col("weight") / (k + F.col("rank"))).otherwise(0.0)) for name in lists}
    fused = every.groupBy("id").agg(*[p.alias(f"{name}_score") for name, p in part.items()])
    return fused.withColumn("score", reduce(lambda a, b: a + b, [F.col(f"{name}_score") for name in lists])).orderBy(F.desc("score"), "id").limit(limit)


def gated_layers(lists: list[DataFrame], threshold: float, most: int = 20, weighted: bool = False) -> DataFrame:
    """O-96: layers fused by rank alone (weights scale scores and so change nothing, unless ``weighted``), then a threshold."""
    if not weighted:
        lists = [df.withColumn("weight", F.lit(1.0)) for df in lists]
    return top(rrf(lists).where(F.col("score") >= threshold), most)


#: Fixed values of query expansion: stop words and synonyms.
QUERY_STOP = {"when", "what", "where", "which", "who", "how", "why", "did", "does", "was", "were", "the", "and", "for", "with", "about", "into", "from", "that", "this", "your", "have", "had"}
SYNONYMS = {
    "bug": ["issue", "error", "failure", "defect"], "cache": ["caching", "memoization", "store"], "fast": ["quick", "speed", "latency"], "memory": ["context", "retrieval", "knowledge"],
    "search": ["lookup", "find", "retrieve"], "vector": ["embedding", "semantic", "dense"], "query": ["question", "request", "prompt"], "reasoning": ["multi-hop", "inference", "analysis"],
}
EXPANSIONS = 4


def normalized_query(query: str) -> str:
    """O-97: lower-case letters and digits of each word, without stop words."""
    tokens = ["".join(c for c in w if c.isalnum()).lower() for w in query.split()]
    return " ".join(t for t in tokens if t and t not in QUERY_STOP)


def query_variants(query: str, most: int = 5) -> list[tuple[str, float]]:
    """O-97: the normalised query, then it with two synonyms of each of its first words, or else with its own words again."""
    base = normalized_query(query)
    out = {base: 1.0}
    for token in base.split()[:EXPANSIONS]:
        for synonym in SYNONYMS.get(token, [])[:2]:
            out.setdefault(f"{base} {synonym}".strip(), 0.85)
    if len(out) == 1:
        for word in query.split()[:EXPANSIONS]:
            token = "".join(c for c in word if c.isalnum()).lower()
            if len(token) >= 3 and token != base:
                out.setdefault(f"{base} {token}", 0.8)
    return list(out.items())[:most]


def contextual_boost(query: str, text: Column, title: Column, importance: Column, age_days: Column, weight: float = 1.0) -> Column:
    """O-99: .12 for each query token found, .20 more in the title, importance less age."""
    tokens = [t for t in query.lower().split() if len(t) >= 3]
    found = reduce(lambda a, b: a + b, [F.when(F.lower(text).contains(t), 0.12 * weight).otherwise(0.0) + F.when(F.lower(title).contains(t), 0.20 * weight).otherwise(0.0) for t in tokens], F.lit(0.0))
    return found + importance * 0.25 - F.least(age_days / 365.0, F.lit(1.0)) * 0.15


def token_budget(df: DataFrame, group: str, order: list, tokens: str, budget: int, keep_first: bool = False) -> DataFrame:
    """O-103, O-139: rows in order while their tokens fit; the first overflow stops each group."""
    out = running_total(df, group, order, tokens, "running")
    fits = F.col("running") <= budget
    return out.where(fits | (F.col("running") == F.col(tokens)) if keep_first else fits)


def classify_context(tokens: Column, text: Column, large: list[str], medium: list[str]) -> Column:
    """O-104: how much context a query needs."""
    has = lambda names: reduce(lambda a, b: a | b, [F.lower(text).contains(n) for n in names])
    return F.when(has(large) | (tokens >= 100), "max").when(has(medium) | (tokens >= 20), "medium").otherwise("minimal")
