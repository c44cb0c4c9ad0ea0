"""Queries on training texts and pairs and on dates in answers (O-288, O-292, O-301), with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.operators import dialogue as dg

from .model import MEMORIES, TURNS, memories, sql, turns
from .network import PAGES, PAIRS, SOURCE, _texts
from .registry import query

#: appended to texts by their id, so that each pattern meets one of its kind
SECRETS = [' API_KEY = "AbCdEf0123456789-AbCdEf"', " tvly-dev-AbCdEf0123456789AbCd", " BSAabcdefghij0123456789", ' "password": "s3cr3t-pass"', " secret: abcdefgh12", " Bearer abcdefghijklmnopqrstuv-1"]
_PUT = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SECRETS)) + " ELSE '' END"
_CLEAN = "text || " + _PUT
for _pattern, _mark in tx.TRAINING_SECRETS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT doc_id AS id, length(t) AS size, len(regexp_extract_all(t, '_REDACTED\\]')) AS marks, md5(t) AS digest FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)")
def o288_sanitize_training_text(spark, sf):
    put = F.expr(_PUT.replace("doc_id", "id"))
    clean = memories(spark, sf).select("id", tx.redact(F.concat("content", put), tx.TRAINING_SECRETS).alias("t"))
    return clean.select("id", F.length("t").cast("long").alias("size"), F.size(F.regexp_extract_all("t", F.lit(r"_REDACTED\]"), F.lit(0))).cast("long").alias("marks"), F.md5("t").alias("digest"))


#: put before instructions and behind answers by their place
ASKED = ["consultar ", "Analiza ", "Explica cómo ", "about Acme ", "el comando ", "paso a paso ", ""]
_ASK = "CASE nth % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ASKED)) + " END"
_hits = lambda c, words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
ROLE = f"""CASE WHEN {_hits('i', dg.RETRIEVE)} THEN 'memory_retrieval' WHEN {_hits('i', dg.EXPLAIN)} THEN CASE WHEN {_hits('r', dg.REMEMBERED)} THEN 'synthesis' ELSE 'knowledge_generation' END WHEN {_hits('i', ['acme'])} THEN 'core'
 WHEN {_hits('i', dg.OPERATE)} THEN 'operations' WHEN {_hits('i', dg.REASON)} THEN 'reasoning' ELSE 'knowledge_generation' END"""


@query(sql([TURNS, *PAIRS, f"q AS (SELECT session_id, nth, {_ASK} || instruction AS i, response || CASE WHEN nth % 2 = 0 THEN ' según' ELSE '' END AS r FROM p)"], f"SELECT session_id, nth, {ROLE} AS role FROM q"))
def o292_categorize_pairs(spark, sf):
    pairs = dg.transcript_pairs(turns(spark, sf)).withColumns({"nth": F.col("nth").cast("long"), "i": F.expr(f"concat({_ASK}, instruction)"), "r": F.expr("concat(response, CASE WHEN nth % 2 = 0 THEN ' según' ELSE '' END)")})
    return pairs.select("session_id", "nth", dg.categorize_pair(F.col("i"), F.col("r"), ["acme"]).alias("role"))


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: appended to texts by their id
DATES = [" on 5 March 2024", " in May 2023", " 2024-02-03", " on June 7, 2022", " yesterday", " back in 1999", " in Mayor 2020"]
_DATE = "CASE id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(DATES)) + " ELSE '' END"
_PATTERNS = [rf"\b(\d{{1,2}} (?:{_MONTHS}),? \d{{4}}|(?:{_MONTHS}) \d{{1,2}},? \d{{4}})\b", r"\b(\d{4}-\d{2}-\d{2})\b", rf"\b((?:{_MONTHS}),? \d{{4}})\b", r"(?i)\b(yesterday|today|tomorrow|last week|next week)\b", r"\b((?:19|20)\d{2})\b"]


@query(sql([PAGES, SOURCE, f"dated AS (SELECT id, content || {_DATE} AS content FROM src)"], "SELECT id, coalesce(" + ", ".join(f"nullif(regexp_extract(content, '{p}', 1), '')" for p in _PATTERNS) + ") AS answer FROM dated"))
def o301_date_answer(spark, sf):
    return _texts(spark, sf).select("id", dg.date_answer(F.concat("content", F.expr(_DATE))).alias("answer"))
