"""Lexical retrieval (O-60..O-78): narrow scores first, texts last, all queries in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.functions.rounds import settled

K1, B = 1.5, 0.75


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _term_count(tokens: Column, term: str) -> Column:
    """How many of the tokens are the term; an array function, so the tokens of a row are cut once for all terms."""
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def bm25_documents(df: DataFrame, query: str) -> DataFrame:
    """O-60: ``id, score``. A term's document frequency counts substrings, its frequency whole tokens; repeated terms count twice.

    The terms are the query's: one pass over the texts writes the counts of each document, numbers only, and the
    statistics (one row) and the scores are taken from these. No postings are shuffled.
    """
    terms = query.lower().split()
    if not terms:
        return df.select("id", F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(terms))
    lower, tokens = F.lower("content"), tx.words(F.col("content"))
    counted = df.select(
        "id", F.size(tokens).alias("dl"), *[_term_count(tokens, t).alias(f"f{i}") for i, t in enumerate(distinct)], *[lower.contains(t).cast("int").alias(f"has{i}") for i, t in enumerate(distinct)]
    )
    counted = settled(counted)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(f"has{i}").alias(f"n{i}") for i in range(len(distinct))])
    narrow = counted.select("id", "dl", *[f"f{i}" for i in range(len(distinct))])
    part = []
    for t in terms:
        i = distinct.index(t)
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5) + 1)
        f = F.col(f"f{i}")
        part.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    # statistics are one row
    return narrow.join(F.broadcast(stats)).select("id", _total(part).alias("score")).where("score > 0")


def bm25_batch(df: DataFrame, queries: DataFrame) -> DataFrame:
    """O-61 for many queries: ``query_id, id, score``, with proper document frequencies by token.

    Postings of the queries' terms only: each document's tokens are cut down to them before any shuffle.
    """
    terms = queries.select("query_id", F.explode(tx.words(F.col("query"))).alias("term"))
    asked = terms.select("term").distinct()
    docs = df.select("id", tx.words(F.col("content")).alias("tokens"))
    stats = docs.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("tokens")), F.lit(1.0)).alias("avgdl"))
    postings = docs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(asked, "term", "left_semi")
    tf = postings.groupBy("term", "id").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df_, "term").join(F.broadcast(stats)).withColumn(
        "part", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    )
    return terms.join(scored.select("term", "id", "part"), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def bm25_working(df: DataFrame, query: str) -> DataFrame:
    """O-62: without idf; frequency counts substrings, length counts bytes; rows need ``id, content, access_count``."""
    lower, dl = F.lower("content"), F.octet_length("content")
    average = df.agg(F.avg(dl).alias("avgdl"))
    part = []
    for t in query.lower().split():
        f = tx.occurrences(lower, t)
        part.append(f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.col("avgdl"))))
    return df.join(F.broadcast(average)).select("id", "access_count", _total(part).alias("score")).where("score > 0")


#: Fixed values of the heuristic score: weights of path hits and of the phrase, signals of query and content with their bonus,
#: bonuses by kind and evidence, and factors by category.
PATH_HIT, PHRASE, EXACT = 2.0, 6.0, 18.0
SIGNALS = [
    ("sunrise", "sunrise", 12.0), ("support", "support group", 12.0), ("charity", "charity race", 12.0), ("camping", "camping", 12.0), ("identity", "transgender", 10.0),
    ("relationship", "single", 10.0), ("research", "adoption agenc", 8.0), ("field", "counsel", 8.0), ("pursue", "counsel", 8.0), ("what", "what", 2.0), ("who", "who", 3.0),
    ("how", "how", 2.0), ("why", "why", 2.0), ("which", "which", 2.0),
]
FACT_KINDS, SOURCE_KINDS, TASK_KINDS = ["fact_atom", "entity_state", "temporal_event", "summary_fact"], ["repo", "file", "symbol", "url"], ["decision", "task", "fact"]
CATEGORY_FACTORS = {"session_summary": 0.2, "conversation": 1.2, "observation": 0.8}


def lexical_score(query: str, content: Column, path: Column, meta: dict[str, Column] | None = None) -> Column:
    """O-67: substring hits in content and path, the square of the matched terms, the phrase, signals, kind, evidence, exact values, category.

    ``query`` is normalised (lower case, single spaces). ``meta`` may have ``memory_kind, kind, evidence_kind,
    category, normalized_value`` and ``exact``, an array of provenance and namespace values.
    """
    query, meta = query.lower(), meta or {}
    terms = query.split()
    if not terms:
        return F.lit(0.0)
    c, p = F.lower(content), F.lower(path)
    hits = [tx.occurrences(c, t) + tx.occurrences(p, t) * PATH_HIT for t in terms]
    # a term is there if it is counted, so no text is searched for it again
    found = _total([F.when(n > 0, 1.0).otherwise(0.0) for n in hits])
    score = _total(hits) + F.pow(found, F.lit(2.0))
    bonus = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    if len(terms) > 1:
        score = score + bonus(c.contains(query), PHRASE)
    for asked, told, n in SIGNALS:
        if asked in query:
            score = score + bonus(c.contains(told), n)
    if "memory_kind" in meta:
        score = score + bonus(meta["memory_kind"].isin(FACT_KINDS), 5)
    if "kind" in meta:
        score = score + bonus(meta["kind"].isin(SOURCE_KINDS), 5)
        if len(terms) > 1:
            score = score + bonus(meta["kind"].isin(TASK_KINDS), 3)
    if "evidence_kind" in meta:
        e = meta["evidence_kind"]
        score = score + bonus(e == "source_turn", 6) + bonus(e.isin("fact_atom", "entity_state"), 8) + bonus((e == "temporal_event") & F.lit("when" in query), 10)
        score = score * F.when(e == "session_summary", 0.5).otherwise(1.0)  # a factor: the sum stands in the code once
    if "exact" in meta:
        named = F.filter(meta["exact"], lambda x: (x != "") & F.lit(query).contains(F.lower(x)))
        score = score + EXACT * F.coalesce(F.greatest(F.size(named), F.lit(0)), F.lit(0))
    if "normalized_value" in meta:
        score = score + bonus(meta["normalized_value"].isNotNull(), 2)
    if "category" in meta:
        factor = reduce(lambda r, kv: r.when(meta["category"] == kv[0], kv[1]), CATEGORY_FACTORS.items(), F.when(F.lit(False), 1.0))
        score = score * F.coalesce(factor, F.lit(1.0))
    return score


def keyword_search(df: DataFrame, query: str, limit: int) -> DataFrame:
    """O-69: best heuristic scores, ties by path; ``kind`` and the other columns of O-67 count where the table has them."""
    names = ["memory_kind", "kind", "evidence_kind", "category", "normalized_value", "exact"]
    meta = {n: F.col(n) for n in names if n in df.columns}
    scored = df.select("id", "path", lexical_score(query, F.col("content"), F.col("path"), meta).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def metadata_keyword_search(df: DataFrame, query: str) -> DataFrame:
    """O-70: exact query tokens in role and metadata (any JSON, read as text)."""
    flat = F.concat_ws(" ", "role", F.regexp_replace("metadata", r'[{}\[\]",:]', " "))
    tokens = tx.words(flat)
    return df.select("id", _total([_term_count(tokens, t).cast("double") for t in query.lower().split()]).alias("score")).where("score > 0")


#: Stop words of the keyword index.
INDEX_STOP = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "been", "with", "this"]


def index_keywords(text: Column) -> Column:
    """O-71: keywords of three characters or more, without stop words, sorted, the first hundred."""
    cleaned = F.transform(tx.words(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    kept = F.filter(cleaned, lambda w: (F.length(w) > 2) & ~w.isin(INDEX_STOP))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, 100)


def keyword_index_search(df: DataFrame, query: str) -> DataFrame:
    """O-71: number of shared keywords."""
    shared = F.size(F.array_intersect(index_keywords(F.col("content")), index_keywords(F.lit(query))))
    return df.select("id", shared.alias("score")).where("score > 0")


def symbol_search(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """O-72: exact 10, prefix 5, otherwise 1; functions and structs one more."""
    name = F.lower("name")
    score = F.when(name == query.lower(), 10).when(name.startswith(query.lower()), 5).otherwise(1) + F.when(F.col("kind").isin("Function", "Struct"), 1).otherwise(0)
    return symbols.where(name.contains(query.lower())).withColumn("score", score).orderBy(F.desc("score"), "name", "id").limit(limit)


def working_layer_score(query: str, content: Column) -> Column:
    """O-73: phrase .5; each term .1 and .05 for each occurrence up to .3; at most 1."""
    c = F.lower(content)
    terms = query.lower().split()
    part = [F.when(c.contains(t), 0.1 + F.least(tx.occurrences(c, t) * 0.05, F.lit(0.3))).otherwise(0.0) for t in terms]
    return F.least(F.lit(1.0), F.when(c.contains(query.lower()), 0.5).otherwise(0.0) + _total(part))


def document_tokens(df: DataFrame) -> DataFrame:
    """O-64 over whole documents: ``id, at, token``, distinct without regard to case, the first spelling kept.

    By grouping, as comparing each token with all others of its text takes a square of its length.
    """
    each = df.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(f"({tx.SEARCH_TOKEN})"))).alias("at", "token"))
    first = each.groupBy("id", F.lower("token").alias("key")).agg(F.min(F.struct("at", "token")).alias("first"))
    return first.select("id", "first.at", "first.token")


def document_code_tokens(df: DataFrame) -> DataFrame:
    """O-65 over whole documents: ``id, token``: parts of the distinct tokens between marks and at camel-case humps."""
    humps = F.regexp_replace("token", r"([a-z])([A-Z])", "$1 $2")
    parts = document_tokens(df).select("id", F.explode(F.split(F.lower(humps), r"[^a-z0-9]+")).alias("token"))
    return parts.where(F.length("token") > 1).distinct()


def match_score(saved: Column, found: Column) -> Column:
    """O-74: is a saved text found again: exact 1; lengths under half 0; same beginning .9 or .7; else .3."""
    ratio = F.least(F.octet_length(saved), F.octet_length(found)) / F.greatest(F.octet_length(saved), F.octet_length(found), F.lit(1))
    same = found.contains(F.substring(saved, 1, 32))
    return F.when(saved == found, 1.0).when(ratio < 0.5, 0.0).when(same & (ratio > 0.8), 0.9).when(same, 0.7).otherwise(0.3)


def character_jaccard(left: Column, right: Column) -> Column:
    """O-75: of the sets of letters and digits."""
    letters = lambda c: F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), "")), "")
    return tx.jaccard(letters(left), letters(right))


def best_relevant_sentence(df: DataFrame, query: str) -> DataFrame:
    """O-77: of each document the sentence with most query terms (3 each) and neighbouring pairs (5), longest first."""
    terms = query.lower().split()
    pairs = [f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)]
    s = F.lower("sentence")
    score = _total([s.contains(t).cast("double") * 3 for t in terms] + [s.contains(p).cast("double") * 5 for p in pairs])
    each = df.select("id", F.explode(tx.sentences(F.col("content"))).alias("sentence")).withColumn("score", score).where("score > 0")
    best = each.groupBy("id").agg(F.max(F.struct("score", F.length("sentence").alias("n"), "sentence")).alias("best"))
    return best.select("id", F.col("best.score").alias("score"), F.col("best.sentence").alias("sentence"))
