"""Answers, sessions and training pairs (O-12, O-15, O-264, O-287..O-308)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallery.functions import text as tx

#: Ordered keywords of the roles of training pairs (O-292): what asks for memories, what explains and what in the answer shows memories, how-to, reasoning.
RETRIEVE = ["revisar", "consultar", "buscar", "qué tienes", "mi memoria"]
EXPLAIN, REMEMBERED = ["explica", "analiza", "cómo", "por qué"], ["memoria", "registrado", "según"]
OPERATE, REASON = ["cómo hago", "cómo configuro", "comando", "ejecuta"], ["piensa", "analiza", "razonamiento", "paso"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def date_answer(text: Column) -> Column:
    """O-301, O-221: the first of a full date, an ISO date, month and year, a relative date, a year."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    patterns = [rf"\b(\d{{1,2}} (?:{months}),? \d{{4}}|(?:{months}) \d{{1,2}},? \d{{4}})\b", r"\b(\d{4}-\d{2}-\d{2})\b", rf"\b((?:{months}),? \d{{4}})\b", r"(?i)\b(yesterday|today|tomorrow|last week|next week)\b", r"\b((?:19|20)\d{2})\b"]
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def sentences_with(text: Column, words: list[str]) -> Column:
    """O-302: sentences with one of the words."""
    return F.filter(tx.sentences(text), lambda s: _any(F.lower(s), words))


def reason_answer(text: Column) -> Column:
    """O-303: the clause after because or since of the first sentence that has one."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\b(?:because|since) ([^.!?\n]+)", 1), F.lit(""))


def shared_facts(facts: DataFrame) -> DataFrame:
    """O-304: values that two subjects or more hold; per kind the alphabetically first and how many there are."""
    held = facts.groupBy("fact_type", "value").agg(F.countDistinct("subject").alias("subjects")).where("subjects >= 2")
    return held.groupBy("fact_type").agg(F.min("value").alias("value"), F.count("*").alias("shared"))


def threads(turns: DataFrame) -> DataFrame:
    """O-12: per conversation: messages, title (48 characters of the first), preview (120 of the last)."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.substring(F.min_by("content", "turn"), 1, 48).alias("title"), F.substring(F.max_by("content", "turn"), 1, 120).alias("preview"), F.max("turn").alias("last_turn")
    )


def compact_sessions(turns: DataFrame, limit: int = 200_000, threshold: float = 0.8, share: float = 0.2) -> DataFrame:
    """O-264: sessions that use a share of their token limit keep the newest fifth of their turns, 500 bytes each."""
    w = Window.partitionBy("session_id")
    used = F.sum(tx.estimate_tokens(F.col("content"))).over(w) / limit
    keep = F.ceil(F.count("*").over(w) * share)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    out = turns.withColumns({"used": used, "keep": keep, "place": place}).where((F.col("used") >= threshold) & (F.col("place") <= F.col("keep")))
    return out.select("session_id", "turn", "role", F.substring("content", 1, 500).alias("content"))


def session_exchanges(turns: DataFrame) -> DataFrame:
    """O-287: a user's turn and the assistant's next one as one row."""
    w = Window.partitionBy("session_id").orderBy("turn")
    both = turns.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("content").over(w)})
    return both.where("role = 'user' AND next_role = 'assistant'").select("session_id", "turn", F.concat(F.lit("User: "), "content", F.lit("\nAssistant: "), "reply").alias("content"))


def transcript_pairs(turns: DataFrame, longer_than: int = 20) -> DataFrame:
    """O-291: the i-th user message with the i-th assistant message of a session, both long enough."""
    nth = F.row_number().over(Window.partitionBy("session_id", "role").orderBy("turn"))
    each = turns.where(F.col("role").isin("user", "assistant")).withColumn("nth", nth)
    side = lambda role, name: each.where(F.col("role") == role).select("session_id", "nth", F.col("content").alias(name))
    pairs = side("user", "instruction").join(side("assistant", "response"), ["session_id", "nth"])
    return pairs.where((F.length("instruction") > longer_than) & (F.length("response") > longer_than))


def categorize_pair(instruction: Column, response: Column, own_names: list[str] = ()) -> Column:
    """O-292, O-15: the first role that applies: memory_retrieval; what explains is synthesis if the answer shows memories, else knowledge_generation; core (names of
    one's own products); operations; reasoning; otherwise knowledge_generation."""
    asked, told = F.lower(instruction), F.lower(response)
    core = _any(asked, list(own_names)) if own_names else F.lit(False)
    explained = F.when(_any(told, REMEMBERED), "synthesis").otherwise("knowledge_generation")
    rule = F.when(_any(asked, RETRIEVE), "memory_retrieval").when(_any(asked, EXPLAIN), explained).when(core, "core")
    return rule.when(_any(asked, OPERATE), "operations").when(_any(asked, REASON), "reasoning").otherwise("knowledge_generation")


def dedup_pairs(pairs: DataFrame, text: str, order: list[str]) -> DataFrame:
    """O-293: the first of each key of squeezed lower-case letters, digits and spaces; keys of ten characters or fewer go."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"[^a-z0-9\s]", ""), r"\s+", " "))
    w = Window.partitionBy("key").orderBy(*order)
    return pairs.withColumn("key", key).where(F.length("key") > 10).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "key")


def markdown_key_values(df: DataFrame) -> DataFrame:
    """O-289: ``Key: Value`` lines (key over 2, value over 15 characters) with the header above them."""
    lines = df.select("id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    header = F.when(F.col("line").rlike(r"^#+\s"), F.regexp_replace("line", r"^#+\s+", ""))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).where(F.col("line").contains(": ") & ~F.col("line").rlike(r"^#"))
    out = out.withColumns({"key": F.trim(F.substring_index("line", ": ", 1)), "value": F.trim(F.expr("substring(line, locate(': ', line) + 2)"))})
    return out.where((F.length("key") > 2) & (F.length("value") > 15)).select("id", "at", "section", "key", "value")


def chunk_lines(df: DataFrame, lines: int = 20, blank_bytes: int = 200) -> DataFrame:
    """O-207: chunks of lines, closed after 20 lines or at a blank line beyond 200 bytes; ``id, chunk, content``.

    A fold over the lines of each text, in the JVM.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        text = F.when(s["n"] == 0, line).otherwise(F.concat(s["open"], F.lit("\n"), line))
        close = (s["n"] + 1 >= lines) | ((F.trim(line) == "") & (F.octet_length(text) > blank_bytes))
        return F.when(close, F.struct(F.array_append(s["done"], text).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))).otherwise(F.struct(s["done"].alias("done"), text.alias("open"), (s["n"] + 1).alias("n")))

    folded = F.aggregate(F.split("content", "\n"), state, step, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return df.select("id", F.posexplode(folded).alias("chunk", "content"))
