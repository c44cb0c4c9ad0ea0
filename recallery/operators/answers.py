"""Scores and answers over dialogue rows (O-68, O-76, O-78, O-300..O-308), in expressions; no row leaves the executors.

Rows: ``id, path, content`` and the text columns of ``META``; ``with_meta`` adds those that a table lacks, as nulls.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import SOURCE_KINDS
from .speech import EXPLICIT_DATES, value_granularity

META = ["speaker", "event_subject", "event_action", "normalized_value", "answer_span", "resolved_date", "fact_type", "memory_kind", "evidence_kind", "kind", "category"]
#: Words that are no terms of a query, by use.
TALK_STOP = {"the", "and", "what", "when", "where", "which", "with", "from", "that", "this", "have", "about", "your", "their", "did", "does", "was", "were"}
RANK_STOP = {"when", "what", "where", "which", "with", "from", "that", "this", "have", "about", "your", "their", "did", "does", "the", "and", "for", "how", "why", "was", "were"}
ANSWER_STOP = {"when", "what", "have", "that", "with", "from", "into", "this", "your", "about", "did", "does", "the", "and", "for", "who", "why", "how", "where", "was", "were", "after", "before", "they", "them", "went"}
#: Words of reasons, opinions, prices and tiers in the dialogue score.
REASONS = ["because", "'cause", "since", "reason", "to share", "to start", "decided", "wanted"]
OPINIONS = ["think", "believe", "feel", "prefer", "ideal", "favorite"]
ADJECTIVES = ["ideal", "perfect", "best", "favorite", "great", "amazing", "wonderful", "excellent", "good", "bad", "terrible", "awful", "beautiful", "nice", "lovely", "pleasant", "important", "special", "unique", "better", "worse", "prefer", "love", "hate"]
PRICES, PRICE_MARKS = ["pricing", "price", "precios", "precio", "costo", "coste", "valor", "fee", "tarifa", "cuanto", "cuál", "cuáles"], ["$", "/mes", "/mo", "/month", "/monthly", "/year", "/annual"]
TIERS = ["starter", "pro", "enterprise", "basic", "plan", "tier", "version"]
#: Words of sentences that answer for opinion (3) and action (4).
ANSWER_WORDS = {
    "3": ["think", "believe", "feel", "guess", "suppose", "probably", "definitely", "maybe", "opinion", "view", "perspective", "seems", "appears", "likely", "certainly", "perhaps", "wonder"],
    "4": ["decided", "planning", "planned", "will", "going to", "intend", "promised", "try", "started", "beginning", "began", "going to start", "want to", "hoping to", "aiming to"],
}
OPINION_SENTENCES = ["think", "believe", "feel", "reckon", "guess", "suppose", "maybe", "probably", "certainly", "definitely", "might", "could", "would", "may"]
ACTION_SENTENCES = ["decided", "planning", "plans", "planned", "will", "would", "going to", "promised", "commit", "intend", "tried", "attempt"]
#: The fact that a query asks for, the first group with a word in it (all words of an inner list).
FACT_QUERIES = [
    ("research_topic", [["research"]]), ("identity", [["identity"]]), ("relationship_status", [["relationship"], ["single"]]), ("duration", [["how long"]]),
    ("origin_place", [["move from"], ["where did"]]), ("activities", [["activities"], ["partake"], ["destress"]]), ("books", [["book"]]), ("places", [["camped"], ["camping"]]),
    ("preferences", [["kids like"], ["what do", "like"]]), ("career_interest", [["field"], ["career"], ["pursue"], ["educat"]]),
]
LIST_FACTS = {"activities", "books", "places", "preferences"}
#: Fact types that a query's word raises in the answer by category.
RAISED = {"research_topic": ["research"], "identity": ["identity"], "relationship_status": ["relationship", "single"], "career_interest": ["field", "career", "pursue", "educat"]}
NOTHING = "Not discussed in the available memories."
_DATES = [r"(?i)\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b", r"(?i)\b[A-Za-z]+\s+\d{1,2},\s+\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"(?i)\b[A-Za-z]+\s+\d{4}\b", r"(?i)\b(?:yesterday|last\s+(?:week|month|year))\b", r"\b(?:19|20)\d{2}\b"]


def with_meta(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in META if n not in df.columns})


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _if(test: Column, n: float) -> Column:
    return F.when(test, n).otherwise(0)


def _text(name: str) -> Column:
    return F.coalesce(F.lower(name), F.lit(""))


def terms_of(query: str, stop: set[str], shortest: int = 1, plain: bool = True) -> list[str]:
    """A query's terms: lower case, cut at white space or (``plain``) at all but ASCII letters and digits."""
    lower = query.lower()
    return [t for t in (re.sub(r"[^a-z0-9]", " ", lower) if plain else lower).split() if len(t) >= shortest and t not in stop]


def _pairs(terms: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)]


def is_temporal(query: str) -> bool:
    return query.startswith("when ") or any(f" {w} " in query for w in ("when", "date", "year", "month", "day"))


def conversation_score(query: str) -> Column:
    """O-68: the score of a dialogue row for a normalised query, at least 0."""
    q, terms = query.lower(), terms_of(query, TALK_STOP, plain=False)
    content, path, speaker, action = F.lower("content"), F.lower("path"), _text("speaker"), _text("event_action")
    subject, value, span, date, kind = F.coalesce(F.lower("event_subject"), speaker), _text("normalized_value"), _text("answer_span"), _text("resolved_date"), F.coalesce("memory_kind", F.lit(""))
    temporal, evidence, category = is_temporal(q), F.col("evidence_kind"), F.coalesce("category", F.lit(""))
    facts = ["fact_atom", "entity_state", "summary_fact"]
    each = [
        _if(speaker == t, 18.0) + _if(subject == t, 18.0) + _if(action.contains(t), 14.0) + _if(value.contains(t) | span.contains(t), 12.0) + _if(path.contains(t), 8.0) + _if(content.contains(t), 4.0)
        for t in terms
    ]
    matched = _sum([_if(e > 0, 1.0) for e in each])
    score = _sum(each) + matched * matched * 2.0
    for phrase in _pairs(terms):
        score = score + F.when(_any(action, [phrase]) | _any(value, [phrase]) | _any(span, [phrase]), 18.0).when(content.contains(phrase) | path.contains(phrase), 9.0).otherwise(0.0)
    if len(q.split()) >= 2:
        score = score + _if(content.contains(q), 10.0)
    score = score + _if((speaker != "") & F.lit(q).contains(speaker), 14.0)
    told = (value != "") | (span != "")
    less = lambda s, factor: F.when(kind == "summary_fact", s * factor).otherwise(s)
    if any(p in q for p in ("in common", "both like", "both have")) or all(p in q for p in ("what do", "and", "both")):
        score = less(score + _if(kind.isin("fact_atom", "entity_state"), 35.0) + _if(told, 25.0), 0.15)
    if q.startswith("why") or any(p in q for p in (" why ", "reason", "because")):
        score = less(score + _if(_any(content, REASONS), 30.0) + _if(value != "", 20.0), 0.2)
    if any(p in q for p in ("think", "believe", "opinion", "ideal", "prefer")):
        score = less(score + _if(_any(content, OPINIONS + ADJECTIVES), 25.0) + _if(told, 15.0), 0.2)
    by_kind = lambda k: F.when((k == "temporal_event") & F.lit(temporal), 60.0).when(k.isin(facts), 12.0 if temporal else 28.0)
    score = score + F.coalesce(by_kind(evidence).when(evidence == "source_turn", 8.0), F.lit(0.0)) + F.coalesce(by_kind(kind), F.lit(0.0))
    exactness = F.when(value_granularity(date) == "full_date", 10.0).when(value_granularity(date) == "month_year", 6.0).otherwise(2.0)
    score = score + F.when(date != "", exactness + (24.0 if temporal else 6.0)).otherwise(0.0)
    score = score + F.when(category == "conversation", 18.0 if temporal else 10.0).when(category == "observation", 2.0).when(category == "session_summary", -70.0 if temporal else -28.0).otherwise(0.0)
    score = F.when((category == "session_summary") & (kind == ""), score * (0.02 if temporal else 0.15)).otherwise(score)
    if any(p in q for p in PRICES):
        number = _any(content, PRICE_MARKS) | content.rlike(r"\d")
        score = score + _if(number, 30.0) + _if(number & (value != ""), 25.0) + _sum([_if(content.contains(t) | path.contains(t), 15.0) for t in TIERS if t in q])
    return F.greatest(score, F.lit(0.0))


def rank_score(query: str, exact: Column | None = None) -> Column:
    """O-76: the integer score that re-ranks retrieved rows; subtractions stop at 0. ``exact``: provenance and namespace values."""
    q, terms = query.lower(), terms_of(query, RANK_STOP, 3)
    temporal = any(w in q for w in ("when", "date", "year"))
    content, speaker, action, date, evidence = F.lower("content"), _text("speaker"), _text("event_action"), _text("resolved_date"), F.col("evidence_kind")
    told = (_text("normalized_value") != "") | (_text("answer_span") != "")
    score = _sum([_if(content.contains(t), 3) + _if(speaker == t, 4) + _if(action.contains(t), 5) + _if(_text("normalized_value").contains(t) | _text("answer_span").contains(t), 4) for t in terms])
    score = score + _if((speaker != "") & F.lit(q).contains(speaker), 6)
    score = score + F.when(F.col("kind").isin(SOURCE_KINDS), 8).when(F.col("kind").isin("decision", "task"), 4).otherwise(0)
    raised = F.when((evidence == "temporal_event") & F.lit(temporal), 10).when(evidence.isin("fact_atom", "entity_state") & F.lit(not temporal), 8).when(evidence == "source_turn", 4).otherwise(0)
    score = F.when(evidence == "session_summary", F.greatest(score - 8, F.lit(0))).otherwise(score + raised)
    if exact is not None:
        score = score + 10 * F.size(F.filter(exact, lambda x: F.lit(q).contains(F.lower(x))))
    score = score + (_if(date != "", 8) + _if(action != "", 4) if temporal else _if(told, 8) + _if(_text("memory_kind").isin("fact_atom", "entity_state", "summary_fact"), 6))
    return F.when(F.col("category") == "session_summary", F.greatest(score - 6, F.lit(0))).otherwise(score).cast("long")


def _sentences(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(text, "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "")


def extract_answer(text: Column, category: str) -> Column:
    """O-78: a date (2), the first sentence of opinion (3) or action (4) or else the first one; null for blank texts."""
    if category == "2":
        pattern = rf"(?i){'|'.join(p.removeprefix('(?i)') for p in EXPLICIT_DATES)}"
        return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 0)))
    all_ = _sentences(text)
    first = F.try_element_at(all_, F.lit(1))
    if category not in ANSWER_WORDS:
        return first
    return F.coalesce(F.try_element_at(F.filter(all_, lambda s: _any(F.lower(s), ANSWER_WORDS[category])), F.lit(1)), first)


def telling_sentences(text: Column, words: list[str], else_words: list[str]) -> Column:
    """O-302: sentences with one of the words, else the first two with one of the others, joined."""
    all_ = _sentences(text)
    found = F.filter(all_, lambda s: _any(F.lower(s), words))
    other = F.slice(F.filter(all_, lambda s: _any(F.lower(s), else_words)), 1, 2)
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(other), ". ")


def opinion_sentences(text: Column) -> Column:
    return telling_sentences(text, OPINION_SENTENCES, ["i ", "my "])


def action_sentences(text: Column) -> Column:
    return telling_sentences(text, ACTION_SENTENCES, [" will ", " would ", " can ", " could "])


def question_category(query: Column) -> Column:
    """O-300: dates 2, opinion 3, action 4, facts 1: the first rule that holds."""
    q = F.lower(query)
    has = lambda *words: _any(q, list(words))
    date = has("when", "date") | (has("day") & has("what", "which")) | (has("year", "month") & has("what"))
    opinion = has("think", "believe", "feel", "opinion", "view", "perspective", "how does ", "how did ", "what would", "should ", "could ", "might ") | (has("what do ", "what's ") & has("like"))
    action = has("decided", "will ", "action", "plan", "intend", "going to", "what should")
    return F.when(date, 2).when(opinion, 3).when(action, 4).otherwise(1)


def has_date(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in _DATES])


def answer_score(query: str) -> Column:
    """O-307: how well a row may answer a query."""
    terms = terms_of(query, ANSWER_STOP, 3)
    if not terms:
        return F.lit(0)
    content = F.lower("content")
    told = ["speaker", "event_subject", "event_action", "normalized_value", "answer_span", "resolved_date", "fact_type", "memory_kind"]
    search = F.lower(F.concat_ws(" ", "path", "content", *told))
    score = _sum([_if(_text("speaker") == t, 4) + _if(search.contains(t), 2) + _if(content.contains(t), 2) for t in terms])
    score = score + _sum([F.when(content.contains(p), 5).when(search.contains(p), 2).otherwise(0) for p in _pairs(terms)])
    score = score + _if(has_date(search), 3) + _if(has_date(content), 6)
    c = F.col("category")
    score = F.when(c == "conversation", score + 5).when(c == "observation", score + 1).when(c == "session_summary", F.greatest(score - 4, F.lit(0))).otherwise(score)
    kind = F.coalesce("evidence_kind", "kind", "memory_kind")
    return (score + F.when(kind == "temporal_event", 18).when(kind.isin("fact_atom", "entity_state", "summary_fact"), 10).otherwise(0)).cast("long")


def sentence_score(query: str, sentence: Column) -> Column:
    terms, s = terms_of(query, ANSWER_STOP, 3), F.lower(sentence)
    return _sum([_if(s.contains(t), 3) for t in terms] + [_if(s.contains(p), 5) for p in _pairs(terms)]).cast("long")


def fact_asked(query: str) -> str | None:
    """O-305: the type of fact that a query asks for."""
    return next((fact for fact, groups in FACT_QUERIES if any(all(w in query.lower() for w in g) for g in groups)), None)


def structured_fact(df: DataFrame, query: str) -> DataFrame:
    """O-305: one row ``answer``: list facts as their distinct parts in order of the values, the others from the best row.

    A career's values give the longest one, that of the full certification first. No row where nothing is asked or known.
    """
    asked = fact_asked(query)
    value = F.coalesce("normalized_value", "answer_span")
    told = with_meta(df).where(F.lit(asked is not None) & (F.col("fact_type") == F.lit(asked)) & value.isNotNull()).withColumn("value", value)
    if asked in LIST_FACTS:
        part = told.select("value").distinct().select("value", F.posexplode(F.split("value", ",")).alias("at", "part")).withColumn("part", F.trim("part")).where("part <> ''")
        first = part.groupBy("part").agg(F.min(F.struct("value", "at")).alias("first"))
        return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))), lambda x: x["part"]), ", ").alias("answer")).where("answer <> ''")
    if asked == "career_interest":
        order = F.struct(F.col("value").contains("Psychology, counseling certification").alias("full"), F.length("value").alias("n"), "value")
    else:
        order = F.struct(answer_score(query).alias("score"), (-F.length("value")).alias("n"), "value")
    return told.agg(F.max(order).alias("best")).where("best IS NOT NULL").select(F.col("best.value").alias("answer"))


def description_answer(df: DataFrame, query: str) -> DataFrame:
    """O-306: the first three distinct values in the order of the rows' scores, as one row ``answer``; none for other queries."""
    value = F.trim(F.coalesce("normalized_value", "answer_span"))
    open_ = any(w in query.lower() for w in ("look like", "ideal", "what"))
    told = with_meta(df).where(F.lit(open_) & value.isNotNull() & (value != "")).select(value.alias("value"), (-answer_score(query)).alias("place"), "id")
    first = told.groupBy(F.lower("value").alias("key")).agg(F.min(F.struct("place", "id", "value")).alias("first")).orderBy("first").limit(3)
    v = F.transform(F.array_sort(F.collect_list("first")), lambda x: x["value"])
    out = first.agg(v.alias("v")).where("size(v) > 0")
    return out.select(F.when(F.size("v") == 1, F.get("v", F.lit(0))).when(F.size("v") == 2, F.array_join("v", ", and ")).otherwise(F.concat(F.get("v", F.lit(0)), F.lit(", "), F.get("v", F.lit(1)), F.lit(" and "), F.get("v", F.lit(2)))).alias("answer"))


def reason_answer(df: DataFrame, query: str) -> DataFrame:
    """O-303: for "why" queries the distinct clauses after 'cause, because, since, or four words after "to ", as one row ``answer``.

    Clauses come in the order of the rows' scores and of their sentences; each row gives its own ones.
    """
    s = F.col("s")
    after = lambda mark: F.trim(F.expr(f"substring(s, locate('{mark}', s) + {len(mark)})".replace("''cause", "\\'cause")))
    words = F.filter(F.split(after("to "), r"\s+"), lambda w: w != "")
    clause = (
        F.when(s.contains("'cause"), F.trim(F.expr("substring(s, locate(\"'cause\", s) + 6)"))).when(s.contains("because"), after("because")).when(s.contains("since"), after("since"))
        .when(s.contains("to ") & (F.size(words) >= 2), F.concat(F.lit("to "), F.array_join(F.slice(words, 1, 4), " ")))
    )
    ranked = with_meta(df).where(F.lit("why" in query.lower())).select("id", (-answer_score(query)).alias("place"), F.posexplode(_sentences(F.col("content"))).alias("at", "s"))
    prefix = F.trim(F.expr("substring(clause, locate(':', clause) + 1)"))
    told = ranked.withColumn("clause", clause).withColumn("clause", F.trim(F.when(F.col("clause").contains(":") & (prefix != ""), prefix).otherwise(F.col("clause")))).where("clause <> ''")
    first = told.groupBy(F.lower("clause").alias("key")).agg(F.min(F.struct("place", "id", "at", "clause")).alias("first"))
    return first.select("first.*")


def category_answer(df: DataFrame, query: str, category: str) -> DataFrame:
    """O-307: ``answer`` and its scores: the greatest by sentence, row with bonuses, and shortness."""
    text = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("normalized_value", "answer_span", "resolved_date")], F.trim("content"))
    raised = [(F.col("fact_type") == fact) & F.lit(any(w in query.lower() for w in words)) for fact, words in RAISED.items()]
    bonus = _if(F.col("category") == "conversation", 2) + _if(F.col("normalized_value").isNotNull() | F.col("answer_span").isNotNull(), 8) + _if(reduce(lambda a, b: a | b, raised), 40)
    rows = with_meta(df).withColumns({"answer": extract_answer(text, category), "base": answer_score(query) + bonus}).where("answer IS NOT NULL")
    scored = rows.select(F.struct(sentence_score(query, F.col("answer")).alias("told"), "base", (-F.length("answer")).alias("short"), "answer").alias("best"))
    return scored.agg(F.max("best").alias("best")).where("best IS NOT NULL").select("best.answer", "best.told", "best.base")


def heuristic_answer(df: DataFrame, query: str, shared: DataFrame | None = None) -> DataFrame:
    """O-308: one row ``answer, step``: the first of shared fact, description, fact, reasons, then the answer by category."""
    q = query.lower()
    number = str(df.sparkSession.range(1).select(question_category(F.lit(query))).first()[0])  # of the query alone
    steps = [("shared", shared.select("answer"), 10_000)] if shared is not None and ("both" in q or "in common" in q) else []
    steps += [("description", description_answer(df, query), 220), ("fact", structured_fact(df, query), 10_000)]
    if "why" in q:
        reasons = reason_answer(df, query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "at", "clause"))), lambda x: x["clause"]), " and ").alias("answer"))
        steps.append(("reason", reasons.where("answer <> ''").select(F.concat("answer", F.lit(".")).alias("answer")), 220))
    steps.append((f"category {number}", category_answer(df, query, number).select("answer"), 160 if number == "1" else 220))
    if number != "1":
        steps.append(("category 1", category_answer(df, query, "1").select("answer"), 160))
    steps.append(("nothing", df.sparkSession.range(1).select(F.lit(NOTHING).alias("answer")), 220))
    every = reduce(DataFrame.unionByName, [a.select(F.trim(F.substring("answer", 1, n)).alias("answer"), F.lit(name).alias("step"), F.lit(i).alias("place")) for i, (name, a, n) in enumerate(steps)])
    return every.orderBy("place").limit(1).select("answer", "step")


def best_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
