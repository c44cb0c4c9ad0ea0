"""Widening a result: graph signal, feedback, hierarchy, paging, near pairs, reflection (O-41, O-50, O-93, O-98, O-100, O-102, O-158, O-192).

A search is a function of a text and a number that gives ``id, score``. What comes to the driver is a handful of
words of the best row, never more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.functions.rounds import settled

from .fusion import K, normalized_query, query_variants, ranked
from .graph import belief_search

Search = Callable[[str, int], DataFrame]
#: Words that are no candidates of a further hop, and how many seeds, words and rows there are.
HOP_STOP = ["with", "that", "this", "from", "have", "were", "when", "what", "where", "which", "would", "could"]
HOP_SEEDS, HOP_WORDS, HOP_WEIGHT, RERANKED = 2, 4, 0.45, 32


def hits_with_records(records: DataFrame, hits: DataFrame) -> DataFrame:
    """O-41: hits (``id, score``) with their records, in the order of the score."""
    return records.join(hits, "id").orderBy(F.desc("score"), "id")


def entity_terms(query: str) -> list[str]:
    """O-66 of a query on the driver: distinct tokens with a digit, hyphen, underscore or capital, in lower case."""
    found = [t for t in re.findall(tx.SEARCH_TOKEN, query) if re.search(r"[0-9A-Z_-]", t)]
    return list(dict.fromkeys(t.lower() for t in found))


def kg_signal(edges: DataFrame, query: str) -> DataFrame:
    """O-93: memories behind edges that name an entity of the query, first edge first: ``id, score``, the score the negative ordinal.

    ``edges``: ``seq, source, relation_type, target, provenance``.
    """
    text, terms = F.lower(F.concat_ws(" ", "source", "relation_type", "target")), entity_terms(query)
    hit = reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))
    return edges.where(hit).groupBy(F.col("provenance").alias("id")).agg((-F.min("seq")).cast("double").alias("score"))


def feedback_search(search: Search, records: DataFrame, query: str, limit: int) -> DataFrame:
    """O-100: two hits for each of the best row's first five new words come in behind the first row: ``id, place``.

    Later words stand before earlier ones, as each is put at the second place.
    """
    base = settled(ranked(search(query, limit), "query", 1.0, limit).select("id", "rank"))
    best = records.join(F.broadcast(base.where("rank = 1").select("id")), "id")  # one row
    clean = F.transform(F.split("content", r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    new = F.slice(F.filter(clean, lambda w: (F.octet_length(w) >= 3) & ~F.lit(query.lower()).contains(w)), 1, 5)
    found = best.select(new.alias("words")).first()
    lists = [base.select("id", F.when(F.col("rank") == 1, 0).otherwise(2).alias("part"), F.col("rank").alias("nth"))]
    for i, word in enumerate(found["words"] if found else []):
        lists.append(ranked(search(word, 2), word, 1.0, 2).select("id", F.lit(1).alias("part"), (-(F.lit(10 * i) + F.col("rank"))).alias("nth")))
    first = reduce(DataFrame.unionByName, lists).groupBy("id").agg(F.min(F.struct("part", "nth")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("id", "place")  # limit and ten rows


def optimized_search(search: Search, records: DataFrame, query: str, limit: int, boost: Callable[[str, float], Column] | None = None) -> DataFrame:
    """O-98: all variants summed by weight over rank, then hops over the words of the best two, then the best: ``id, score``.

    ``boost`` gives the contextual boost (O-99) of a record for a query and a weight; without one only ranks count and hops
    add ``HOP_WEIGHT`` over the rank. ``records``: ``id, path, content``.
    """
    value = lambda q, w: boost(q, w) if boost else F.lit(0.0)
    lists = [
        ranked(search(q, max(limit, 3)), f"v{i}", w, max(limit, 3)).join(records, "id").select("id", (F.col("weight") / (K + F.col("rank")) + value(q, w)).alias("part"), F.lit(w).alias("weight"))
        for i, (q, w) in enumerate(query_variants(query))
    ]
    scored = reduce(DataFrame.unionByName, lists).groupBy("id").agg(F.sum("part").alias("score"), F.max("weight").alias("weight"))
    scored = settled(scored)  # at most five times the limit
    seeds = scored.join(records, "id").orderBy(F.desc("score"), "path").limit(HOP_SEEDS)
    words = F.transform(F.split(F.concat_ws(" ", "content", "path"), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    hop = F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(HOP_STOP)))), 1, HOP_WORDS)
    asked = normalized_query(query)
    hops = [scored]
    for row in seeds.select(hop.alias("words")).collect():  # two rows of four words
        for word in row["words"]:
            if word not in asked:
                near = ranked(search(word, 2), word, HOP_WEIGHT, 2).join(records, "id")
                hops.append(near.select("id", (value(asked, HOP_WEIGHT) if boost else F.lit(HOP_WEIGHT) / (K + F.col("rank"))).alias("score"), F.lit(HOP_WEIGHT).alias("weight")))
    total = reduce(DataFrame.unionByName, hops).groupBy("id").agg(F.sum("score").alias("score"), F.max("weight").alias("weight"))
    return total.orderBy(F.desc("score"), F.desc("weight"), "id").limit(max(limit, 1)).select("id", "score")


def hierarchical_expansion(found: DataFrame, search: Search, beliefs: DataFrame | None = None) -> DataFrame:
    """O-102: two more rows each for the domain and the topic that most of the first three have, at relevance .8, and the beliefs at .9.

    ``found``: ``id, domain, topic, score``; the result: ``id, relevance``. Of equally frequent names the smaller one counts.
    """
    best = found.orderBy(F.desc("score"), "id").limit(3)
    more = [found.select(F.col("id").cast("string").alias("id"), F.col("score").alias("relevance"))]
    for level in ("domain", "topic"):
        name = best.where(F.col(level).isNotNull()).groupBy(level).count().orderBy(F.desc("count"), level).first()
        if name:
            extra = search(name[0], 2).orderBy(F.desc("score"), "id").limit(2).join(found.select("id"), "id", "left_anti")
            more.append(extra.select(F.col("id").cast("string").alias("id"), F.lit(0.8).alias("relevance")))
    if beliefs is not None:
        more.append(beliefs.limit(1).select(F.lit("belief_graph_context").alias("id"), F.lit(0.9).alias("relevance")))
    return reduce(DataFrame.unionByName, more).groupBy("id").agg(F.max("relevance").alias("relevance"))


def page_in(edges: DataFrame, records: DataFrame, scored: DataFrame, query: str, limit: int) -> DataFrame:
    """O-192: memories behind the beliefs that a query names and those one edge further, then what a search finds, each after its siblings.

    ``edges``: ``id, source, target, relation_type, confidence, provenance``; ``records``: ``id, cluster_id``; ``scored``: ``id, score`` of all rows that the search finds. A belief
    brings up to five rows of the memory's cluster, a hit up to three, best hits first; the first place of a row counts.
    Result: ``id, place`` up to ``limit``.
    """
    near = belief_search(edges, query).select("id", "target", "confidence", "provenance").withColumn("depth", F.lit(0))
    # a belief counts once, however many of the named ones lead to it
    next_ = edges.join(near.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("id", "target", "confidence", "provenance").withColumn("depth", F.lit(1))
    stage1 = near.unionByName(next_).groupBy(F.col("provenance").alias("id")).agg(F.min(F.struct("depth", (-F.col("confidence")).alias("less"), "id")).alias("order"))
    stage1 = stage1.orderBy("order").limit(limit).withColumn("nth", F.row_number().over(Window.orderBy("order"))).select("id", "nth", F.lit(0).alias("stage"), F.lit(5).alias("siblings"))
    hits = ranked(scored, "search", 1.0, limit)
    stage2 = hits.select("id", F.col("rank").alias("nth"), F.lit(1).alias("stage"), F.lit(3).alias("siblings"))
    seeds = settled(stage1.unionByName(stage2).join(records, "id"))
    others = seeds.where("cluster_id IS NOT NULL").select("cluster_id", "stage", "nth", "siblings").join(records, "cluster_id").join(scored.select("id", "score").hint("merge"), "id")
    w = Window.partitionBy("stage", "nth").orderBy(F.desc("score"), "id")
    others = others.withColumn("of", F.row_number().over(w)).where("of <= siblings").select("id", F.struct("stage", "nth", F.lit(0).alias("own"), "of").alias("at"))
    own = seeds.select("id", F.struct("stage", "nth", F.lit(1).alias("own"), F.lit(0).alias("of")).alias("at"))
    first = others.unionByName(own).groupBy("id").agg(F.min("at").alias("at")).orderBy("at").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("id", "place")


def reflect(df: DataFrame, most: int = 8, days: int = 30, cleanup: float = 0.78) -> tuple[DataFrame, DataFrame]:
    """O-158: the worst rows among those of little importance or great age, the five themes of them, and which of them the themes cover.

    ``df``: ``id, content, importance, age_days, quality, access_count``. Gives ``id, cleanup`` and ``theme, n``.
    """
    weak = df.where((F.col("importance") < 0.65) | (F.col("age_days") >= days)).orderBy("quality", F.desc("access_count"), "id").limit(most)
    weak = settled(weak.select("id", tx.tokens3(F.col("content")).alias("words")))
    counted = weak.select(F.explode("words").alias("theme")).groupBy("theme").agg(F.count("*").alias("n")).where((F.octet_length("theme") >= 4) & (F.col("n") > 1))
    themes = counted.orderBy(F.desc("n"), "theme").limit(5)
    every = themes.agg(F.collect_list("theme").alias("themes"))  # five words
    covered = tx.jaccard(F.array_distinct("words"), F.col("themes")) >= cleanup
    return weak.crossJoin(F.broadcast(every)).select("id", covered.alias("cleanup")), themes
