"""Care of a memory collection in whole: merged entities, coherence, management under a storage limit, windows of high entropy, layers (O-51, O-73, O-96, O-133, O-144, O-151, O-170, O-243)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.functions.components import connected_components

from .curation import relink
from .fusion import gated_layers
from .lexical import working_layer_score
from .lifecycle import coherence, consolidate_exact, decay_memories, duplicate_inconsistencies, evict_low_quality, factual_conflicts, memory_quality, temporal_marker
from .windows import numbered, running_total

# merged entities


def merge_map(merges: DataFrame) -> DataFrame:
    """``old, new`` of rows ``seq, primary, secondary``: where every merged entity ends up, through chains of any length.

    All entities that merges connect become one. It keeps the id of the primary of the latest merge whose primary is never merged into another; where each of
    them is (a circle), the smallest id.
    """
    pairs = merges.where("primary <> secondary")
    labels = connected_components(pairs.select(F.col("primary").alias("a"), F.col("secondary").alias("b")))
    gone = pairs.select(F.col("secondary").alias("node")).distinct()
    last = pairs.groupBy(F.col("primary").alias("node")).agg(F.max("seq").alias("seq")).join(gone, "node", "left_anti")
    chosen = last.join(labels, "node").groupBy("label").agg(F.max(F.struct("seq", "node")).alias("of")).select("label", F.col("of.node").alias("new"))
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    survivors = least.join(chosen, "label", "left").select("label", F.coalesce("new", "least").alias("new"))
    return labels.join(survivors, "label").where("node <> new").select(F.col("node").alias("old"), "new")


def merge_entities(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-170: entities, their aliases and their edges after all merges.

    ``entities``: ``id, name, aliases, occurrences, memories, description, last_seen``; ``edges``: ``source, target`` and more. Counts are summed, the latest time
    and the entity's own description stay (or else that of the smallest id that has one), ``merged_from`` counts those merged into it. Aliases are rows ``id, alias``, as a
    third of all entities may become one: its aliases and the names and aliases of what it took in, each once. Edges between entities that became one go.
    """
    moves = merge_map(merges)
    at = entities.join(moves, entities["id"] == moves["old"], "left").withColumn("to", F.coalesce("new", "id"))
    own = F.col("id") == F.col("to")
    first = F.struct((~own).alias("other"), "id", "description")
    out = at.groupBy(F.col("to").alias("id")).agg(
        F.max(F.when(own, F.col("name"))).alias("name"), F.sum("occurrences").alias("occurrences"), F.sum("memories").alias("memories"),
        F.min(F.when(F.col("description").isNotNull(), first)).alias("_first"), F.max("last_seen").alias("last_seen"), F.count_if(~own).alias("merged_from"),
    ).select("id", "name", "occurrences", "memories", F.col("_first.description").alias("description"), "last_seen", "merged_from")
    names = at.where(~own).select(F.col("to").alias("id"), F.col("name").alias("alias"))
    aliases = at.select(F.col("to").alias("id"), F.explode("aliases").alias("alias")).unionByName(names).distinct()
    moved = relink(edges, moves)
    return out, aliases, moved.where("source <> target")


# coherence


def temporal_pairs(df: DataFrame, within: str, parts: int = 16) -> DataFrame:
    """O-51: ``first_id, second_id`` (the smaller id first) of a 'yesterday' and a 'tomorrow' text of one collection (``within``).

    Every pair is given, as that is what is asked for; the yesterdays of a collection are dealt over ``parts`` tasks, so that none makes all pairs of a large one.
    """
    marked = df.select("id", within, temporal_marker(F.col("content")).alias("marker"))
    before = marked.where("marker = 'yesterday'").select(within, F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_part"))
    after = marked.where("marker = 'tomorrow'").select(within, F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return before.join(after.hint("merge"), [within, "_part"]).select(within, F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id"))


def drift_alerts(entities: DataFrame, links: DataFrame) -> DataFrame:
    """O-144: ``id, kind, severity``: what changed against the first row of the same normalised name, and frequent entities without memories.

    ``entities``: ``id, name, seen_at, occurrences, trust, description``; ``links``: ``entity_id`` of entities with memories. The first change that applies counts: of the
    number of occurrences by 5 or more, of the trust by .15 or more, of the description to a word Jaccard under .5.
    """
    first = entities.groupBy("name").agg(F.min(F.struct("seen_at", "id", "occurrences", "trust", "description")).alias("f"))
    both = entities.join(first, "name").where(F.col("id") != F.col("f.id"))
    count, trust = F.abs(F.col("occurrences") - F.col("f.occurrences")), F.abs(F.col("trust") - F.col("f.trust"))
    words = lambda c: F.array_distinct(tx.words(F.col(c)))
    empty = (F.size(words("description")) == 0) & (F.size(words("f.description")) == 0)
    near = F.when(F.col("description").isNotNull() & F.col("f.description").isNotNull(), F.when(empty, 1.0).otherwise(tx.jaccard(words("description"), words("f.description"))))
    alert = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.least(F.lit(1.0), severity).alias("severity"))
    found = F.when(count >= 5, alert("occurrences", count / 50.0)).when(trust >= 0.15, alert("trust", trust)).when(near < 0.5, alert("description", 1.0 - near))
    changed = both.select("id", found.alias("a")).where("a IS NOT NULL").select("id", "a.kind", "a.severity")
    known = links.select(F.col("entity_id").alias("id")).distinct()
    orphans = entities.where("occurrences > 30").join(known, "id", "left_anti").select("id", F.lit("orphan").alias("kind"), F.lit(0.6).alias("severity"))
    return changed.unionByName(orphans)


def coherence_issues(memories: DataFrame, entities: DataFrame, links: DataFrame, within: str) -> DataFrame:
    """O-133: ``kind, id, severity`` of all issues: factual conflicts, inconsistent duplicates, temporal contradictions (a row for each yesterday text, ``issues`` how many), drift."""
    one = F.lit(1).cast("long").alias("issues")
    text = lambda c: F.col(c).cast("string").alias("id")
    factual = factual_conflicts(memories).select(F.lit("factual").alias("kind"), text("first_id"), "severity", one)
    repeated = duplicate_inconsistencies(memories).select(F.lit("duplicate").alias("kind"), text("first_id"), "severity", one)
    marked = memories.select("id", within, temporal_marker(F.col("content")).alias("marker"))
    later = marked.where("marker = 'tomorrow'").groupBy(within).agg(F.count("*").alias("issues"))
    times = marked.where("marker = 'yesterday'").join(later, within).select(F.lit("temporal").alias("kind"), text("id"), F.lit(0.0).alias("severity"), "issues")
    drift = drift_alerts(entities, links).select(F.lit("drift").alias("kind"), text("id"), "severity", one)
    return reduce(DataFrame.unionByName, [factual, repeated, times, drift])


def coherence_report(issues: DataFrame, least: float = 0.7) -> DataFrame:
    """O-133: one row: what each kind of issue adds up to, the score, and whether it passes."""
    total = lambda kinds, what: F.coalesce(F.sum(F.when(F.col("kind").isin(kinds), what)), F.lit(0.0))
    sums = issues.agg(total(["factual", "duplicate"], F.col("severity")).alias("conflicts"), total(["temporal"], F.col("issues").cast("double")).alias("temporal"), total(["drift"], F.col("severity")).alias("drift"))
    score = coherence(F.col("conflicts"), F.col("temporal"), F.col("drift"))
    return sums.withColumn("coherence", score).withColumn("passes", F.col("coherence") >= least)


# management


def auto_manage(df: DataFrame, as_of: Column, most_bytes: int, threshold: float = 0.25, by_ratio: bool = False) -> DataFrame:
    """O-151: ``id, action, new_relevance`` of a whole cycle: decayed, consolidated, evicted, over the limit; rows without an action are absent.

    ``df`` as for O-145 with ``kind`` and ``relevance``. Decay is an action of its own and a row may be decayed and removed. What is over the storage limit goes from the lowest quality
    on (ties: the larger id first), never critical rows, until the rest fits: running bytes over ranges of that order. ``by_ratio``: what goes instead is all
    under the threshold times how far the limit is passed.
    """
    decayed = decay_memories(df, as_of).select("id", F.lit("decay").alias("action"), "new_relevance")
    none = F.lit(None).cast("double").alias("new_relevance")
    scored = memory_quality(df, as_of)
    first = consolidate_exact(df).select("id")
    kept = scored.join(first, "id", "left_semi")
    gone = df.join(first, "id", "left_anti").select("id", F.lit("consolidate").alias("action"), none)
    low = evict_low_quality(kept).select("id")
    evicted = low.select("id", F.lit("evict").alias("action"), none)
    left = kept.join(low, "id", "left_anti").select("id", "priority", "overall", F.octet_length("content").cast("long").alias("bytes"))
    size = left.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all_bytes"))  # one row
    loose = left.where("priority <> 'critical'")
    if by_ratio:
        over = loose.join(F.broadcast(size)).where((F.col("all_bytes") > most_bytes) & (F.col("overall") < threshold * F.col("all_bytes") / most_bytes))
    else:
        running = running_total(loose.withColumns({"_all": F.lit(0), "_quality": F.round("overall", 9)}), "_all", ["_quality", F.desc("id")], "bytes", "so_far")
        over = running.join(F.broadcast(size)).where(F.col("all_bytes") - (F.col("so_far") - F.col("bytes")) > most_bytes)
    return reduce(DataFrame.unionByName, [decayed, gone, evicted, over.select("id", F.lit("limit").alias("action"), none)])


# windows of high entropy


def _window_entropies(text: str, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows in characters, their entropy over bytes, and the ends of their bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # first byte of each character
    starts = np.arange(0, max(0, len(first) - 1 - width), step)
    a, b = first[starts], first[starts + width]
    out = np.zeros(len(starts))
    for at in range(0, len(starts), 1 << 15):  # so many histograms at a time
        x, n = a[at : at + (1 << 15)], (b - a)[at : at + (1 << 15)]
        ends = np.cumsum(n)
        window = np.repeat(np.arange(len(n)), n)
        cells, counts = np.unique(window * 256 + raw[np.repeat(x - ends + n, n) + np.arange(ends[-1])], return_counts=True)
        used = np.bincount(cells >> 8, counts * np.log2(counts), len(n))
        out[at : at + (1 << 15)] = np.log2(n) - used / n
    return starts, out, a, b


def entropy_windows(df: DataFrame, threshold: float = 4.5, least: int = 20, width: int = 32, step: int = 8) -> DataFrame:
    """O-243: ``id, start, entropy, content`` of the windows of ``width`` characters, one each ``step``, whose bytes have that entropy and number.

    A window that would end with the text is left out, as is a shorter text. Histograms of many windows are made together; time grows with the length.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                starts, entropy, a, b = _window_entropies(text or "", width, step)
                raw = (text or "").encode()
                for k in np.flatnonzero((entropy >= threshold) & (b - a >= least)).tolist():
                    rows.append(i)
                    found.append((int(starts[k]), float(entropy[k]), raw[a[k] : b[k]].decode()))
            start, entropy, content = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(entropy, pa.float64()), pa.array(content, pa.string())], ["id", "start", "entropy", "content"])

    return df.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(scan, "id long, start long, entropy double, content string")


# layers

#: Weights of the layers, bonuses for an event with the phrase and with a term, scores of an entity's alias.
LAYERS = {"working": 0.3, "episodic": 0.3, "semantic": 0.4}
EVENT_PHRASE, EVENT_TERM, ALIAS = 0.3, 0.05, 0.6


def episodic_layer_score(query: str, summary: Column, events: Column) -> Column:
    """O-73: the summary as in the working layer, and of each event (array of texts) the phrase .3 and each term .05; at most 1."""
    low, terms = query.lower(), query.lower().split()
    s = F.lower(summary)
    phrase = F.when(s.contains(low), 0.5).otherwise(0.0)
    words = [F.when(s.contains(t), 0.1 + F.least(tx.occurrences(s, t) * 0.05, F.lit(0.3))).otherwise(0.0) for t in terms]
    each = lambda e: F.when(e.contains(low), EVENT_PHRASE).otherwise(0.0) + sum((F.when(e.contains(t), EVENT_TERM).otherwise(0.0) for t in terms), F.lit(0.0))
    happened = F.aggregate(F.transform(events, lambda e: F.lower(e)), F.lit(0.0), lambda total, e: total + F.coalesce(each(e), F.lit(0.0)))
    return F.least(F.lit(1.0), F.round(reduce(lambda a, b: a + b, [phrase, *words]) + happened, 9))


def semantic_layer_score(query: str, name: Column, normalized: Column, description: Column, aliases: Column) -> Column:
    """O-73: exact name 1, part of it .7; with a description .4 for the phrase and .1 for each term, without one .6 for an alias; halved."""
    low, n = query.lower(), F.lower(name)
    d = F.lower(description)
    told = F.when(d.contains(low), 0.4).otherwise(0.0) + sum((F.when(d.contains(t), 0.1).otherwise(0.0) for t in low.split()), F.lit(0.0))
    alias = F.when(F.exists(aliases, lambda a: F.lower(a).contains(low)), ALIAS).otherwise(0.0)
    score = F.when((n == low) | (F.lower(normalized) == low), 1.0).when(n.contains(low) | F.lit(low).contains(n), 0.7).when(description.isNotNull(), told).otherwise(alias)
    return F.least(F.lit(1.0), F.round(0.5 * score, 9))


def layered_search(working: DataFrame, sessions: DataFrame, entities: DataFrame, query: str, threshold: float, most: int = 20) -> DataFrame:
    """O-96: the three layers, each by its own score, fused by rank, above a threshold: ``id, score, sources``.

    ``working``: ``id, content``; ``sessions``: ``id, summary, events``; ``entities``: ``id, name, normalized_name, description, aliases``; ids are strings. Layer weights scale scores and leave ranks as
    they are, so they change nothing. Every row of a layer with a score is ranked, by ranges of the scores.
    """
    layers = {
        "working": working.select("id", F.round(working_layer_score(query, F.col("content")), 9).alias("score")),
        "episodic": sessions.select("id", episodic_layer_score(query, F.col("summary"), F.col("events")).alias("score")),
        "semantic": entities.select("id", semantic_layer_score(query, F.col("name"), F.col("normalized_name"), F.col("description"), F.col("aliases")).alias("score")),
    }
    place = lambda df: numbered(df.where("score > 0").withColumn("_all", F.lit(0)), "_all", [F.desc("score"), "id"], "rank")
    lists = [place(df).select("id", "rank", F.lit(name).alias("source"), F.lit(LAYERS[name]).alias("weight")) for name, df in layers.items()]
    return gated_layers(lists, threshold, most).select("id", "score", "sources")
