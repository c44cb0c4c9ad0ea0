"""Queries: dialogue scores, speakers, facts and answers, and widened results (O-41, O-50, O-67, O-68, O-76, O-78, O-86, O-93, O-98..O-102, O-158, O-166, O-192, O-208..O-211, O-217, O-300..O-308)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.operators import answers as an
from recallery.operators import expansion as ex
from recallery.operators import fusion, lexical
from recallery.operators import speech as sp

from .model import BM25_DOCS, MEMORIES, QUERY, memories, sql, table
from .registry import query

#: Lines of dialogue that documents carry by their id, so that every rule meets texts of its kind.
LINES = [
    "Caroline: I am single now. I researched adoption agencies lately. We went camping yesterday.", "Melanie: I think the charity race was ideal, because it was for a good cause.",
    "James: I moved from Sweden 4 years ago and will try pottery at the beach.", "Speaker: Emma said she feels counseling and mental health matter.",
    "[David] he decided to start painting a sunrise last saturday.", "Olivia: On 7 May 2023 the support group met, since all wanted to share.",
    "Robert: I am a man. The price is $499/month for the pro plan.", "nobody speaks here, last week nothing happened", "Alice: psychology and hiking in the forest and the museum last year",
    "Mary Ann: we ran next month, and the kids like dinosaurs and nature.", "Paul: I read \"The Long Way\" and \"Becoming\" for 3 years.", "The: no name. Last friday was fine.",
]
_n = lambda i, *values: f"CASE doc_id % {len(values) if i is None else i} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"
_COLUMNS = {
    "id": "doc_id", "path": "source || '/d' || CAST(doc_id % 9 AS STRING) || ':0' || CAST(doc_id AS STRING)",
    "content": _n(None, *[v.replace("'", "''") for v in LINES]) + " || ' ' || text", "session_time": _n(None, "1:56 pm on 8 May, 2023", "12 January 2024", None, "May 30, 2023", "soon"),
    "speaker": _n(None, "Caroline", None, "James", "Emma", None, None, "Robert"), "event_subject": _n(None, None, "Melanie", None, None, None), "event_action": _n(None, None, None, "ran a charity race", None),
    "normalized_value": _n(None, "Single", None, "Pottery, Camping", None, None, "Psychology, counseling", None, "Hiking, Pottery", None), "answer_span": _n(None, None, None, None, "adoption agencies", None, None),
    "resolved_date": _n(None, None, "7 May 2023", "June 2023", "2022", None, None), "fact_type": _n(None, "relationship_status", None, "activities", "research_topic", None, "career_interest", None, "activities", None),
    "memory_kind": _n(None, "fact_atom", "entity_state", None, "temporal_event", "summary_fact", None), "evidence_kind": _n(None, None, "source_turn", "fact_atom", "temporal_event", "session_summary", "summary_fact", None, None),
    "kind": _n(None, "file", "decision", "fact", None, None, "task", None), "category": _n(None, "conversation", "observation", "session_summary", None, None),
    "project": _n(None, "charity", None, "sunrise", None), "text": "text", "source": "source",
}
TALK = "talk AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _COLUMNS.items() if k not in ("text", "source")) + " FROM documents)"
ASK = "did caroline think the charity race and sunrise were ideal"
WHEN, WHY = "when did james and emma go camping", "why did caroline like the charity race"


def talk(spark, sf):
    from recallery.functions.rounds import spread

    return spread(table(spark, sf, "documents"), "doc_id").selectExpr(*[f"{v} AS {k}" for k, v in _COLUMNS.items() if k not in ("text", "source")])


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _if(test: str, n: float) -> str:
    return f"CASE WHEN {test} THEN {n} ELSE 0 END"


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts or ["0"]) + ")"


_low = lambda c: f"coalesce(lower({c}), '')"
_hits = lambda c, t: f"((length(lower({c})) - length(replace(lower({c}), {_q(t)}, ''))) // {len(t)})"


def lexical_sql(q: str) -> str:
    terms = q.split()
    hit = _sum([_if(f"contains(lower(content), {_q(t)}) OR contains(lower(path), {_q(t)})", 1) for t in terms])
    base = _sum([f"{_hits('content', t)} + 2 * {_hits('path', t)}" for t in terms] + [f"{hit} * {hit}", _if(f"contains(lower(content), {_q(q)})", 6)])
    signals = _sum([_if(f"contains(lower(content), {_q(b)})", n) for a, b, n in lexical.SIGNALS if a in q])
    kinds = _sum([_if("memory_kind IN ('fact_atom', 'entity_state', 'temporal_event', 'summary_fact')", 5), _if("kind IN ('repo', 'file', 'symbol', 'url')", 5), _if("kind IN ('decision', 'task', 'fact')", 3)])
    evidence = _sum([_if("evidence_kind = 'source_turn'", 6), _if("evidence_kind IN ('fact_atom', 'entity_state')", 8), _if(f"evidence_kind = 'temporal_event' AND {'when' in q}", 10)])
    score = f"(({base} + {signals} + {kinds} + {evidence}) * CASE WHEN evidence_kind = 'session_summary' THEN 0.5e0 ELSE 1 END + {_if(f'contains({_q(q)}, project)', 18)} + {_if('normalized_value IS NOT NULL', 2)})"
    return f"CAST({score} * CASE category WHEN 'session_summary' THEN 0.2e0 WHEN 'conversation' THEN 1.2e0 WHEN 'observation' THEN 0.8e0 ELSE 1 END AS DOUBLE)"


@query(sql([TALK], f"SELECT id, round({lexical_sql(ASK)}, 6) AS score FROM talk"))
def o67_lexical_score(spark, sf):
    t = talk(spark, sf)
    meta = {c: F.col(c) for c in ("memory_kind", "kind", "evidence_kind", "category", "normalized_value")} | {"exact": F.array_compact(F.array("project"))}
    return t.select("id", F.round(lexical.lexical_score(ASK, F.col("content"), F.col("path"), meta), 6).alias("score"))


def conversation_sql(q: str) -> str:
    terms, temporal = an.terms_of(q, an.TALK_STOP, plain=False), an.is_temporal(q)
    c, p, sp_, act, val, span, date = "lower(content)", "lower(path)", _low("speaker"), _low("event_action"), _low("normalized_value"), _low("answer_span"), _low("resolved_date")
    subject = f"coalesce(lower(event_subject), {sp_})"
    each = [_sum([_if(f"{sp_} = {_q(t)}", 18), _if(f"{subject} = {_q(t)}", 18), _if(_has(act, [t]), 14), _if(f"{_has(val, [t])} OR {_has(span, [t])}", 12), _if(_has(p, [t]), 8), _if(_has(c, [t]), 4)]) for t in terms]
    matched = _sum([_if(f"{e} > 0", 1) for e in each])
    pairs = [f"CASE WHEN {_has(act, [x])} OR {_has(val, [x])} OR {_has(span, [x])} THEN 18 WHEN {_has(c, [x])} OR {_has(p, [x])} THEN 9 ELSE 0 END" for x in (f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False))]
    s = _sum([*each, f"{matched} * {matched} * 2", *pairs, _if(_has(c, [q]), 10), _if(f"{sp_} <> '' AND contains({_q(q)}, {sp_})", 14)])
    told, summary = f"({val} <> '' OR {span} <> '')", "coalesce(memory_kind, '') = 'summary_fact'"
    if any(x in q for x in ("in common", "both like", "both have")) or all(x in q for x in ("what do", "and", "both")):
        s = f"(({s} + {_if('memory_kind IN (' + repr('fact_atom') + ', ' + repr('entity_state') + ')', 35)} + {_if(told, 25)}) * CASE WHEN {summary} THEN 0.15e0 ELSE 1 END)"
    if q.startswith("why") or any(x in q for x in (" why ", "reason", "because")):
        s = f"(({s} + {_if(_has(c, an.REASONS), 30)} + {_if(val + ' <> ' + _q(''), 20)}) * CASE WHEN {summary} THEN 0.2e0 ELSE 1 END)"
    if any(x in q for x in ("think", "believe", "opinion", "ideal", "prefer")):
        s = f"(({s} + {_if(_has(c, an.OPINIONS + an.ADJECTIVES), 25)} + {_if(told, 15)}) * CASE WHEN {summary} THEN 0.2e0 ELSE 1 END)"
    facts = "('fact_atom', 'entity_state', 'summary_fact')"
    by = lambda k, more="": f"CASE WHEN {k} = 'temporal_event' AND {temporal} THEN 60 WHEN {k} IN {facts} THEN {12 if temporal else 28} {more} ELSE 0 END"
    s = _sum([s, by("evidence_kind", "WHEN evidence_kind = 'source_turn' THEN 8"), by("memory_kind"),
              f"CASE WHEN {date} = '' THEN 0 ELSE {24 if temporal else 6} + CASE WHEN regexp_matches({date}, '^[0-9]{{4}}$') THEN 2 WHEN len(string_split_regex(trim({date}), '\\s+')) = 2 THEN 6 ELSE 10 END END",
              f"CASE category WHEN 'conversation' THEN {18 if temporal else 10} WHEN 'observation' THEN 2 WHEN 'session_summary' THEN {-70 if temporal else -28} ELSE 0 END"])
    s = f"({s} * CASE WHEN category = 'session_summary' AND memory_kind IS NULL THEN {0.02 if temporal else 0.15}e0 ELSE 1 END)"
    if any(x in q for x in an.PRICES):
        number = f"({_has(c, an.PRICE_MARKS)} OR regexp_matches({c}, '[0-9]'))"
        s = _sum([s, _if(number, 30), _if(f"{number} AND {val} <> ''", 25), *[_if(f"{_has(c, [t])} OR {_has(p, [t])}", 15) for t in an.TIERS if t in q]])
    return f"greatest(CAST({s} AS DOUBLE), 0.0e0)"


TALKS = {"opinion": ASK, "time": WHEN, "reason": WHY, "shared": "what do caroline and emma both have in common", "price": "price of the pro plan for robert"}


@query(sql([TALK], " UNION ALL ".join(f"SELECT id, {_q(k)} AS asked, round({conversation_sql(q)}, 6) AS score FROM talk" for k, q in TALKS.items())))
def o68_conversation_score(spark, sf):
    t = talk(spark, sf)
    each = F.array(*[F.struct(F.lit(k).alias("asked"), F.round(an.conversation_score(q), 6).alias("score")) for k, q in TALKS.items()])
    return t.select("id", F.inline(each))


def rank_sql(q: str) -> str:
    terms, temporal = an.terms_of(q, an.RANK_STOP, 3), any(w in q for w in ("when", "date", "year"))
    val, span, sp_, act = _low("normalized_value"), _low("answer_span"), _low("speaker"), _low("event_action")
    s = _sum([x for t in terms for x in (_if(_has("lower(content)", [t]), 3), _if(f"{sp_} = {_q(t)}", 4), _if(_has(act, [t]), 5), _if(f"{_has(val, [t])} OR {_has(span, [t])}", 4))] + [_if(f"{sp_} <> '' AND contains({_q(q)}, {sp_})", 6)])
    s = _sum([s, "CASE WHEN kind IN ('repo', 'file', 'symbol', 'url') THEN 8 WHEN kind IN ('decision', 'task') THEN 4 ELSE 0 END"])
    raised = f"CASE WHEN evidence_kind = 'temporal_event' AND {temporal} THEN 10 WHEN evidence_kind IN ('fact_atom', 'entity_state') AND {not temporal} THEN 8 WHEN evidence_kind = 'source_turn' THEN 4 ELSE 0 END"
    s = f"(CASE WHEN evidence_kind = 'session_summary' THEN greatest({s} - 8, 0) ELSE {s} + {raised} END + {_if(f'contains({_q(q)}, project)', 10)})"
    more = [_if(f"{_low('resolved_date')} <> ''", 8), _if(f"{act} <> ''", 4)] if temporal else [_if(f"{val} <> '' OR {span} <> ''", 8), _if("memory_kind IN ('fact_atom', 'entity_state', 'summary_fact')", 6)]
    s = _sum([s, *more])
    return f"CAST(CASE WHEN category = 'session_summary' THEN greatest({s} - 6, 0) ELSE {s} END AS BIGINT)"


@query(sql([TALK], f"SELECT id, {rank_sql(ASK)} AS factual, {rank_sql(WHEN)} AS temporal FROM talk"))
def o76_document_rank(spark, sf):
    exact = F.array_compact(F.array("project"))
    return talk(spark, sf).select("id", an.rank_score(ASK, exact).alias("factual"), an.rank_score(WHEN, exact).alias("temporal"))


SENTENCES = "list_filter(list_transform(string_split_regex(content, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
FIRST = f"{SENTENCES}[1]"
_first = lambda k: f"coalesce(list_filter({SENTENCES}, lambda s: {_has('lower(s)', an.ANSWER_WORDS[k])})[1], {FIRST})"
DATED = "nullif(trim(regexp_extract(content, '(?i)\\b[0-9]{1,2}\\s+[A-Za-z]+\\s+[0-9]{4}\\b|\\b[A-Za-z]+\\s+[0-9]{1,2},\\s+[0-9]{4}\\b|\\b(?:19|20)[0-9]{2}\\b')), '')"


@query(sql([TALK], f"SELECT id, {DATED} AS date_, md5({_first('3')}) AS opinion, md5({_first('4')}) AS action, md5({FIRST}) AS fact FROM talk"))
def o78_answer_by_category(spark, sf):
    a = {k: an.extract_answer(F.col("content"), k) for k in "1234"}
    return talk(spark, sf).select("id", a["2"].alias("date_"), F.md5(a["3"]).alias("opinion"), F.md5(a["4"]).alias("action"), F.md5(a["1"]).alias("fact"))


_likely = f"regexp_matches(n, '^[A-Z][A-Za-z''-]{{1,19}}$') AND n NOT IN ({', '.join(map(_q, sp.NO_SPEAKERS))})"
NAMES = "list_filter(list_concat(list_concat(" + "regexp_extract_all(content, '(?m)^([^:\\s]+):\\s*', 1), regexp_extract_all(content, '(?m)^\\[([^\\]\\s]+)\\]', 1)), regexp_extract_all(content, '(?i)(?:Speaker|Person|Host|Guest|Interviewer|Interviewee|Moderator):\\s*([A-Z][a-zA-Z]+)', 1)), lambda n: " + _likely + ")"
PRIMARY = "list_filter(list_transform(list_filter(string_split(content, chr(10)), lambda l: contains(l, ':')), lambda l: trim(string_split(l, ':')[1])), lambda h: regexp_matches(h, '^[A-Z][A-Za-z ]*$'))[1]"


@query(sql([TALK], f"SELECT id, array_to_string({NAMES}, ',') AS speakers, {PRIMARY} AS first FROM talk"))
def o208_speakers(spark, sf):
    return talk(spark, sf).select("id", F.array_join(sp.speakers(F.col("content")), ",").alias("speakers"), sp.primary_speaker(F.col("content")).alias("first"))


ASKED = "CASE id % 4 WHEN 0 THEN 'What did she say when he left?' WHEN 1 THEN 'when did Caroline run' WHEN 2 THEN 'Why is the race near' ELSE 'tell me of Emma' END"


@query(sql([TALK, f"a AS (SELECT id, {ASKED} AS asked, {NAMES} AS n FROM talk)", f"b AS (SELECT *, list_filter(n, lambda x: lower(x) IN ({', '.join(map(_q, sp.FEMALE_NAMES))})) AS f, list_filter(n, lambda x: lower(x) IN ({', '.join(map(_q, sp.MALE_NAMES))})) AS m FROM a)",
            "c AS (SELECT *, CASE WHEN contains(lower(asked), 'she') AND len(f) = 1 THEN regexp_replace(asked, '(?i)\\bshe\\b', f[1], 'g') ELSE asked END AS one FROM b)", "d AS (SELECT id, asked, CASE WHEN contains(lower(asked), 'he') AND len(m) = 1 THEN regexp_replace(one, '(?i)\\bhe\\b', m[1], 'g') ELSE one END AS resolved FROM c)",
            "e AS (SELECT id, resolved, nullif(regexp_extract(asked, '(?i)\\b(?:who|what|where|when|why|how|did|was|were)(?:\\s+is|\\s+did|\\s+was|\\s+were)?\\s+([A-Z][a-zA-Z]+)', 1), '') AS n FROM d)"],
           f"SELECT id, resolved, CASE WHEN {_likely} THEN n END AS named FROM e"))
def o209_pronouns(spark, sf):
    t = talk(spark, sf).withColumn("asked", F.expr(ASKED))
    return t.select("id", sp.resolve_pronouns(F.col("asked"), sp.speakers(F.col("content"))).alias("resolved"), sp.speaker_of_query(F.col("asked")).alias("named"))


VALUES = "CASE id % 5 WHEN 0 THEN '  \"To the Moon\" lately. ' WHEN 1 THEN 'and HIKING these days!?' WHEN 2 THEN 'plain value;' WHEN 3 THEN 'to swim right now' ELSE '  ' END"
_strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_a = _strip(f"regexp_replace(regexp_replace({_strip('v')}, '[.,;:!?]+$', ''), '^\"+|\"+$', '', 'g')")
_b = _strip(f"regexp_replace({_a}, '(?i)( lately| recently| currently| these days| right now)$', '')")
TRIMMED = _strip(f"regexp_replace({_b}, '(?i)^(and |to )', '')")
DURATION = "coalesce(nullif(regexp_extract(content, '(?i)\\b([0-9]+)\\s+years?\\s+ago\\b', 1), '') || ' years ago', nullif(regexp_extract(content, '(?i)\\bfor\\s+([0-9]+)\\s+years?\\b', 1), '') || ' years', nullif(regexp_extract(content, '(?i)\\b([0-9]+)\\s+years?\\b', 1), '') || ' years')"


@query(sql([TALK, f"v AS (SELECT id, content, {VALUES} AS v FROM talk)", f"t AS (SELECT id, content, {TRIMMED} AS trimmed FROM v)"], f"SELECT id, trimmed, upper(substr(lower(trimmed), 1, 1)) || substr(lower(trimmed), 2) AS cased, len(list_filter(list_transform(regexp_extract_all(content, '\"([^\"]+)\"', 1), lambda x: trim(x)), lambda x: x <> '')) AS titles, {DURATION} AS duration FROM t"))
def o210_fact_values(spark, sf):
    t, c = talk(spark, sf).withColumn("v", F.expr(VALUES)), F.col("content")
    trimmed = sp.trim_fact_value(F.col("v"))
    return t.select("id", trimmed.alias("trimmed"), sp.sentence_case(trimmed).alias("cased"), F.size(sp.quoted_titles(c)).cast("long").alias("titles"), sp.duration_value(c).alias("duration"))


_present = lambda words: "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN contains(low, {_q(w)}) THEN {_q(w.capitalize())} END" for w in words) + "), '')"
_got = lambda p: f"nullif(regexp_extract(content, {_q(p)}, 1), '')"
_cased = lambda c: f"upper(substr(lower({c}), 1, 1)) || substr(lower({c}), 2)"
FACTS = [
    ("entity_state", "identity", f"coalesce({_cased(_got(sp.IDENTITY))}, CASE WHEN contains(low, 'transgender') OR contains(low, 'trans community') THEN 'Transgender woman' END)"),
    ("entity_state", "relationship_status", f"coalesce({_cased(_got(sp.STATUS))}, CASE WHEN contains(low, 'single parent') THEN 'Single' END)"),
    ("fact_atom", "research_topic", _cased("nullif(" + TRIMMED.replace(" v,", f" {_got(sp.RESEARCH)},").replace("(v,", f"({_got(sp.RESEARCH)},") + ", '')")),
    ("summary_fact", "career_interest", "CASE WHEN contains(low, 'counseling') AND contains(low, 'mental health') THEN 'Psychology, counseling certification' WHEN contains(low, 'psychology') AND contains(low, 'counsel') THEN 'Psychology, counseling' WHEN contains(low, 'mental health') THEN 'Counseling, mental health' WHEN contains(low, 'psychology') THEN 'Psychology' WHEN contains(low, 'counseling') THEN 'Counseling' END"),
    ("fact_atom", "duration", DURATION), ("fact_atom", "origin_place", _cased(_got(sp.ORIGIN))), ("summary_fact", "activities", _present(sp.ACTIVITIES)), ("summary_fact", "places", _present(sp.PLACES)),
    ("summary_fact", "preferences", _present(sp.PREFERENCES)), ("summary_fact", "books", "nullif(array_to_string(list_filter(list_transform(regexp_extract_all(content, '\"([^\"]+)\"', 1), lambda x: trim(x)), lambda x: x <> ''), ', '), '')"),
]
TOLD = f"told AS (SELECT id, path, content, lower(content) AS low, coalesce(speaker, {PRIMARY}) AS speaker, session_time FROM talk)"


@query(sql([TALK, TOLD, "f AS (" + " UNION ALL ".join(f"SELECT id, speaker, '{k}' AS memory_kind, '{t}' AS fact_type, {v} AS value, {i} AS i, path FROM told" for i, (k, t, v) in enumerate(FACTS)) + ")"],
           "SELECT id, memory_kind, fact_type, md5(value) AS value, md5(speaker || CASE WHEN fact_type IN ('identity', 'relationship_status') THEN ' is ' WHEN fact_type = 'research_topic' THEN ' researched ' WHEN fact_type = 'career_interest' THEN ' would likely pursue ' ELSE ': ' END || value || '.') AS content, path || '#derived/' || memory_kind || '/' || i AS path FROM f WHERE speaker IS NOT NULL AND value IS NOT NULL"))
def o211_derived_facts(spark, sf):
    f = sp.derived_facts(talk(spark, sf).select("id", "path", "content", "speaker"))
    return f.select("id", "memory_kind", "fact_type", F.md5("value").alias("value"), F.md5("content").alias("content"), "path")


ACTION = "CASE " + " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f'contains(low, {_q(w)})' for w in g) + ')' for g in groups)} THEN {_q(a)}" for groups, a in sp.ACTIONS) + " ELSE 'had the event' END"
EXPLICIT = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {_q(p)}), '')" for p in sp.EXPLICIT_DATES) + ")"
SESSION = "CASE session_time WHEN '1:56 pm on 8 May, 2023' THEN DATE '2023-05-08' WHEN '12 January 2024' THEN DATE '2024-01-12' WHEN 'May 30, 2023' THEN DATE '2023-05-30' END"
_day = lambda d: f"strftime({d}, '%-d %B %Y')"
RELATIVE = f"""CASE WHEN day IS NULL THEN NULL WHEN contains(low, 'yesterday') THEN {_day('day - INTERVAL 1 DAY')} WHEN contains(low, 'last year') THEN CAST(year(day) - 1 AS VARCHAR) WHEN contains(low, 'last saturday') THEN 'The sunday before ' || {_day('day')}
 WHEN contains(low, 'last friday') THEN 'The friday before ' || {_day('day')} WHEN contains(low, 'last week') THEN 'The week before ' || {_day('day')} WHEN contains(low, 'next month') THEN strftime(date_trunc('month', day) + INTERVAL 1 MONTH, '%B %Y')
 WHEN contains(low, 'last sunday') OR contains(low, 'sunday before') THEN {_day("day - to_days(CAST(CASE WHEN dayofweek(day) = 0 THEN 7 ELSE dayofweek(day) END AS INT))")} END"""


@query(sql([TALK, TOLD, f"d AS (SELECT *, {SESSION} AS day FROM told)", f"e AS (SELECT id, speaker, {ACTION} AS action, coalesce({EXPLICIT}, {RELATIVE}) AS resolved_date FROM d)"], "SELECT id, resolved_date, CASE WHEN regexp_matches(resolved_date, '^[0-9]{4}$') THEN 'year' WHEN len(string_split_regex(resolved_date, '\\s+')) = 2 THEN 'month_year' ELSE 'full_date' END AS granularity, coalesce(speaker || ' ', '') || action || ' on ' || resolved_date || '.' AS content FROM e WHERE resolved_date IS NOT NULL"))
def o211_derived_events(spark, sf):
    return sp.derived_events(talk(spark, sf)).select("id", "resolved_date", "granularity", "content")


@query(sql([TALK], "SELECT id, string_split(path, '/')[1] || '/' || upper(string_split(string_split(path, '/')[2], ':')[1]) || ':' || CAST(CAST(string_split(path, ':')[2] AS BIGINT) AS VARCHAR) || '#x' AS path, CASE WHEN id % 2 = 0 THEN 'D' || (id % 9) || ':' || id END AS dialogue_id FROM talk"))
def o217_dialogue_paths(spark, sf):
    t = talk(spark, sf)
    given = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" d"), F.col("id") % 9, F.lit(":000"), "id", F.lit(" "))).otherwise(F.lit("x:1:2"))
    return t.select("id", sp.normalize_dialogue_path(F.concat("path", F.lit("#x"))).alias("path"), sp.normalize_dialogue_id(given).alias("dialogue_id"))


@query(sql([TALK], "SELECT id, len(regexp_extract_all(content, '[\"'']([^\"'']+)[\"'']')) AS quotes, length(content) + CAST(list_sum(list_prepend(0, list_transform(generate_series(1, len(regexp_extract_all(content, '[\"'']([^\"'']+)[\"'']'))), lambda i: length('[QUOTE' || i || ': ]') - 2))) AS BIGINT) AS size FROM talk"))
def o86_embedding_text(spark, sf):
    marked = sp.marked_quotes(F.col("content"))
    return talk(spark, sf).select("id", F.regexp_count(marked, F.lit(r"\[QUOTE\d+: ")).cast("long").alias("quotes"), F.length(marked).cast("long").alias("size"))


# answers


_DATE_SIGNS = "(" + " OR ".join(f"regexp_matches(@@, {_q(p)})" for p in an._DATES) + ")"


def answer_sql(q: str) -> str:
    terms = an.terms_of(q, an.ANSWER_STOP, 3)
    search = "lower(concat_ws(' ', path, content, speaker, event_subject, event_action, normalized_value, answer_span, resolved_date, fact_type, memory_kind))"
    s = _sum([x for t in terms for x in (_if(f"{_low('speaker')} = {_q(t)}", 4), _if(f"contains({search}, {_q(t)})", 2), _if(f"contains(lower(content), {_q(t)})", 2))]
             + [f"CASE WHEN contains(lower(content), {_q(p)}) THEN 5 WHEN contains({search}, {_q(p)}) THEN 2 ELSE 0 END" for p in (f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False))]
             + [_if(_DATE_SIGNS.replace("@@", search), 3), _if(_DATE_SIGNS.replace("@@", "lower(content)"), 6)])
    s = f"CASE category WHEN 'conversation' THEN {s} + 5 WHEN 'observation' THEN {s} + 1 WHEN 'session_summary' THEN greatest({s} - 4, 0) ELSE {s} END"
    return f"CAST({s} + CASE coalesce(evidence_kind, kind, memory_kind) WHEN 'temporal_event' THEN 18 WHEN 'fact_atom' THEN 10 WHEN 'entity_state' THEN 10 WHEN 'summary_fact' THEN 10 ELSE 0 END AS BIGINT)"


def told_sql(q: str, column: str) -> str:
    terms = an.terms_of(q, an.ANSWER_STOP, 3)
    return _sum([_if(f"contains(lower({column}), {_q(t)})", 3) for t in terms] + [_if(f"contains(lower({column}), {_q(a + ' ' + b)})", 5) for a, b in zip(terms, terms[1:], strict=False)])


SOUGHT = "what activities did caroline start and what is her research"
DOING, STATUS_Q = "what activities does caroline partake in", "what is the relationship of caroline"


@query(sql([TALK], f"""SELECT 'activities' AS asked, (SELECT string_agg(part, ', ' ORDER BY value, nth) FROM (SELECT part, min(value) AS value, arg_min(nth, value || nth) AS nth FROM (SELECT DISTINCT normalized_value AS value, trim(unnest(string_split(normalized_value, ','))) AS part, generate_subscripts(string_split(normalized_value, ','), 1) AS nth
 FROM talk WHERE fact_type = 'activities') GROUP BY part)) AS answer UNION ALL SELECT 'relationship', (SELECT coalesce(normalized_value, answer_span) FROM talk WHERE fact_type = 'relationship_status' AND coalesce(normalized_value, answer_span) IS NOT NULL ORDER BY {answer_sql(STATUS_Q)} DESC, length(coalesce(normalized_value, answer_span)), coalesce(normalized_value, answer_span) DESC LIMIT 1)"""))
def o305_structured_fact(spark, sf):
    t = talk(spark, sf)
    each = [an.structured_fact(t, q).select(F.lit(name).alias("asked"), "answer") for name, q in (("activities", DOING), ("relationship", STATUS_Q))]
    return each[0].unionByName(each[1])


@query(sql([TALK, f"v AS (SELECT id, trim(coalesce(normalized_value, answer_span)) AS value, {answer_sql(SOUGHT)} AS score FROM talk)", "f AS (SELECT lower(value) AS k, min_by(value, (-score, id)) AS value, min((-score, id)) AS place FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY lower(value) ORDER BY place LIMIT 3)", "l AS (SELECT list(value ORDER BY place) AS v FROM f)"],
           "SELECT CASE len(v) WHEN 1 THEN v[1] WHEN 2 THEN v[1] || ', and ' || v[2] ELSE v[1] || ', ' || v[2] || ' and ' || v[3] END AS answer FROM l WHERE len(v) > 0"))
def o306_description_answer(spark, sf):
    return an.description_answer(talk(spark, sf), SOUGHT)


TEXT = "coalesce(nullif(trim(normalized_value), ''), nullif(trim(answer_span), ''), nullif(trim(resolved_date), ''), trim(content))"
_as = lambda c, e: e.replace("content", c)
RAISED = " OR ".join(f"(fact_type = '{f}' AND {any(w in ASK for w in words)})" for f, words in an.RAISED.items())


@query(sql([TALK, f"x AS (SELECT *, {TEXT} AS txt, {answer_sql(ASK)} + {_if('category = ' + repr('conversation'), 2)} + {_if('normalized_value IS NOT NULL OR answer_span IS NOT NULL', 8)} + {_if(RAISED, 40)} AS base FROM talk)", f"y AS (SELECT {_as('txt', _first('3'))} AS answer, base FROM x)", f"z AS (SELECT answer, {told_sql(ASK, 'answer')} AS told, base FROM y WHERE answer IS NOT NULL)"],
           "SELECT answer, CAST(told AS BIGINT) AS told, CAST(base AS BIGINT) AS base FROM z ORDER BY told DESC, base DESC, length(answer), answer DESC LIMIT 1"))
def o307_category_answer(spark, sf):
    return an.category_answer(talk(spark, sf), ASK, "3")


@query()
def o308_heuristic_answer(spark, sf):
    """The cascade itself; its steps have twins of their own, and a test holds it against hand-worked rows."""
    t = talk(spark, sf)
    each = [an.heuristic_answer(t, q).select(F.lit(name).alias("asked"), "answer", "step") for name, q in (("activities", DOING), ("opinion", ASK.replace("what", "how")))]
    return each[0].unionByName(each[1])


REASON = f"""s AS (SELECT id, place, unnest(ss) AS s, generate_subscripts(ss, 1) AS nth FROM (SELECT id, -{answer_sql(WHY)} AS place, {SENTENCES} AS ss FROM talk)),
 c AS (SELECT id, place, nth, CASE WHEN contains(s, '''cause') THEN trim(substr(s, instr(s, '''cause') + 6)) WHEN contains(s, 'because') THEN trim(substr(s, instr(s, 'because') + 7)) WHEN contains(s, 'since') THEN trim(substr(s, instr(s, 'since') + 5))
 WHEN contains(s, 'to ') AND len(list_filter(string_split_regex(trim(substr(s, instr(s, 'to ') + 3)), '\\s+'), lambda w: w <> '')) >= 2 THEN 'to ' || array_to_string(list_slice(list_filter(string_split_regex(trim(substr(s, instr(s, 'to ') + 3)), '\\s+'), lambda w: w <> ''), 1, 4), ' ') END AS clause FROM s),
 d AS (SELECT id, place, nth, trim(CASE WHEN contains(clause, ':') AND trim(substr(clause, instr(clause, ':') + 1)) <> '' THEN trim(substr(clause, instr(clause, ':') + 1)) ELSE clause END) AS clause FROM c WHERE clause IS NOT NULL)"""


@query(sql([TALK, REASON], "SELECT count(*) AS clauses, CAST(sum(length(k)) AS BIGINT) AS size FROM (SELECT lower(clause) AS k FROM d WHERE clause <> '' GROUP BY lower(clause))"))
def o303_reason_answer(spark, sf):
    r = an.reason_answer(talk(spark, sf), WHY)
    return r.agg(F.count("*").alias("clauses"), F.sum(F.length("clause")).alias("size"))


def _joined(words, others):
    s = lambda w: f"list_filter({SENTENCES}, lambda s: {_has('lower(s)', w)})"
    return f"array_to_string(CASE WHEN len({s(words)}) > 0 THEN {s(words)} ELSE list_slice({s(others)}, 1, 2) END, '. ')"


@query(sql([TALK], f"SELECT id, md5({_joined(an.OPINION_SENTENCES, ['i ', 'my '])}) AS opinions, md5({_joined(an.ACTION_SENTENCES, [' will ', ' would ', ' can ', ' could '])}) AS actions FROM talk"))
def o302_opinion_sentences(spark, sf):
    c = F.col("content")
    return talk(spark, sf).select("id", F.md5(an.opinion_sentences(c)).alias("opinions"), F.md5(an.action_sentences(c)).alias("actions"))


_a2 = f"{_has('c', ['when', 'date'])} OR ({_has('c', ['day'])} AND {_has('c', ['what', 'which'])}) OR ({_has('c', ['year', 'month'])} AND {_has('c', ['what'])})"
_a3 = f"{_has('c', ['think', 'believe', 'feel', 'opinion', 'view', 'perspective', 'how does ', 'how did ', 'what would', 'should ', 'could ', 'might '])} OR ({_has('c', ['what do ', 'what' + chr(39) + 's '])} AND {_has('c', ['like'])})"
_a4 = _has("c", ["decided", "will ", "action", "plan", "intend", "going to", "what should"])


@query(sql([TALK, "x AS (SELECT id, lower(content) AS c FROM talk)"], f"SELECT id, CASE WHEN {_a2} THEN 2 WHEN {_a3} THEN 3 WHEN {_a4} THEN 4 ELSE 1 END AS category FROM x"))
def o300_question_category(spark, sf):
    return talk(spark, sf).select("id", an.question_category(F.col("content")).alias("category"))


# widened results


EDGES = """edges AS (SELECT o_orderkey AS id, o_orderkey AS seq, 'C' || (o_custkey % 60) AS source, 'knows' AS relation_type, 'C' || (o_orderkey % 60) AS target, (o_orderkey % 10) / 10.0e0 AS confidence, o_orderkey % 300 AS provenance FROM orders)"""


def _edges(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey AS seq", "concat('C', o_custkey % 60) AS source", "'knows' AS relation_type", "concat('C', o_orderkey % 60) AS target", "(o_orderkey % 10) / 10.0D AS confidence", "o_orderkey % 300 AS provenance"
    )


TOP = lambda n, score="score": f"row_number() OVER (ORDER BY {score} DESC, id) <= {n}"
BM25 = ", ".join(BM25_DOCS)


@query(sql([EDGES], "SELECT provenance AS id, CAST(-min(seq) AS DOUBLE) AS score FROM edges WHERE contains(lower(concat_ws(' ', source, relation_type, target)), 'c17') OR contains(lower(concat_ws(' ', source, relation_type, target)), 'c4') GROUP BY provenance"))
def o93_kg_signal(spark, sf):
    return ex.kg_signal(_edges(spark, sf), "what do C17 and C4 like")


@query(
    sql([MEMORIES, EDGES, BM25, "kind AS (SELECT *, typed_kind AS kind FROM memories)", "lex AS (SELECT id, CAST(" + _sum([f"{_hits('content', t)} + 2 * {_hits('path', t)}" for t in ("of", "the")]) + " + power(" + _sum([_if(f"contains(lower(content), '{t}') OR contains(lower(path), '{t}')", 1) for t in ("of", "the")]) + ", 2) + " + _if("contains(lower(content), 'of the')", 6) + " AS DOUBLE) AS score FROM memories)",
         "kg AS (SELECT provenance AS id, CAST(-min(seq) AS DOUBLE) AS score FROM edges WHERE contains(lower(concat_ws(' ', source, relation_type, target)), 'c17') GROUP BY provenance)",
         *[f"r{i} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM {t} {w} ORDER BY score DESC, id LIMIT 50))" for i, (t, w) in enumerate((("bm25", "WHERE score > 0"), ("lex", "WHERE score > 0"), ("kg", "")))],
         "k AS (SELECT CASE WHEN count(*) > 1000 THEN 60 + count(*) // 1000 ELSE 60 END AS k FROM memories)",
         "u AS (SELECT id, 0.40e0 / (k + rank) AS a, 0.0e0 AS b, 0.0e0 AS c FROM r0, k UNION ALL SELECT id, 0, 0.35e0 / (k + rank), 0 FROM r1, k UNION ALL SELECT id, 0, 0, 0.25e0 / (k + rank) FROM r2, k)",
         "g AS (SELECT id, sum(a) AS x, sum(b) AS y, sum(c) AS z FROM u GROUP BY id)"],
        "SELECT id, round(x, 9) AS bm25_score, round(y, 9) AS lex_score, round(z, 9) AS kg_score, round(x + y + z, 9) AS score FROM g ORDER BY x + y + z DESC, id LIMIT 10")
)
def o92_hybrid_store(spark, sf):
    m = memories(spark, sf)
    lists = {
        "bm25": lexical.bm25_documents(m, QUERY), "lex": m.select("id", lexical.lexical_score("of the", F.col("content"), F.col("path")).alias("score")).where("score > 0"),
        "kg": ex.kg_signal(_edges(spark, sf), "tell me of C17"),
    }
    n = table(spark, sf, "documents").count()  # from the files' footers
    out = fusion.hybrid_search_store(lists, {"bm25": 0.40, "lex": 0.35, "kg": 0.25}, n, 10)
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


def _by_word(records):
    """A search that counts a word's occurrences: cheap and with a plain twin."""
    from recallery.functions import text as tx

    def search(text, n):
        score = sum((tx.occurrences(F.lower("content"), w) for w in text.lower().split()), F.lit(0)).cast("double")
        return records.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)

    return search


@query()
def o100_feedback_search(spark, sf):
    """Its words come from the best row, so the twin is a test on hand-made rows."""
    m = memories(spark, sf).select("id", "content")
    return ex.feedback_search(_by_word(m), m, "the thing of", 10)


@query()
def o98_optimized_search(spark, sf):
    """Variants and hops depend on the best rows; a test holds it against a plain Python version."""
    m = memories(spark, sf).select("id", "path", "content")
    return ex.optimized_search(_by_word(m), m, "search the fast cache of thing", 10).select("id", F.round("score", 9).alias("score"))


@query("SELECT q, v AS variant, CAST(w AS DOUBLE) AS weight FROM (VALUES ('fix the cache bug', 'fix cache bug', 1.0), ('fix the cache bug', 'fix cache bug caching', 0.85), ('fix the cache bug', 'fix cache bug memoization', 0.85), ('fix the cache bug', 'fix cache bug issue', 0.85), ('fix the cache bug', 'fix cache bug error', 0.85), ('what is the plan', 'is plan', 1.0), ('what is the plan', 'is plan what', 0.8), ('what is the plan', 'is plan the', 0.8), ('what is the plan', 'is plan plan', 0.8)) x(q, v, w)")
def o97_query_variants(spark, sf):
    return spark.createDataFrame([(q, v, w) for q in ("fix the cache bug", "what is the plan") for v, w in fusion.query_variants(q)], "q string, variant string, weight double")


@query(sql([MEMORIES, BM25, "t AS (SELECT id, lang AS domain, scope AS topic, score FROM bm25 JOIN memories USING (id) WHERE score > 0 ORDER BY score DESC, id LIMIT 8)", "b AS (SELECT * FROM t ORDER BY score DESC, id LIMIT 3)", "d AS (SELECT domain FROM b GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1)", "p AS (SELECT topic FROM b GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1)",
            "x AS (SELECT id FROM memories WHERE lang = (SELECT domain FROM d) ORDER BY access_count DESC, id LIMIT 2)", "y AS (SELECT id FROM memories WHERE scope = (SELECT topic FROM p) ORDER BY access_count DESC, id LIMIT 2)"],
           "SELECT CAST(id AS VARCHAR) AS id, round(score, 6) AS relevance FROM t UNION ALL SELECT CAST(id AS VARCHAR), 0.8e0 FROM (SELECT id FROM x UNION SELECT id FROM y) WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT 'belief_graph_context', 0.9e0"))
def o102_hierarchical_expansion(spark, sf):
    m = memories(spark, sf).selectExpr("id", "lang AS domain", "concat('S', id % 3) AS topic", "cast(access_count AS double) AS score")
    top = lexical.bm25_documents(memories(spark, sf), QUERY).orderBy(F.desc("score"), "id").limit(8).join(m.drop("score"), "id")
    search = lambda name, n: m.where((F.col("domain") == name) | (F.col("topic") == name)).select("id", "score").orderBy(F.desc("score"), "id").limit(n)
    return ex.hierarchical_expansion(top, search, _edges(spark, sf).where("source = 'C17'")).withColumn("relevance", F.round("relevance", 6))


PAGED = [
    EDGES, "records AS (SELECT vec_id AS id, label AS cluster_id FROM embeddings)", "found AS (SELECT vec_id AS id, CAST(vec_id % 97 AS DOUBLE) AS score FROM embeddings)",
    "near AS (SELECT id, target, confidence, provenance, 0 AS depth FROM edges WHERE contains(lower(concat_ws(' ', source, target, relation_type)), 'c17') AND source = 'C17')",
    "next AS (SELECT e.id, e.target, e.confidence, e.provenance, 1 AS depth FROM near n JOIN edges e ON e.source = n.target)",
    "s1 AS (SELECT provenance AS id, row_number() OVER (ORDER BY min((depth, -confidence, id))) AS nth, 0 AS stage, 5 AS siblings FROM (SELECT * FROM near UNION ALL SELECT * FROM next) GROUP BY provenance QUALIFY nth <= 12)",
    "s2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS nth, 1 AS stage, 3 AS siblings FROM found QUALIFY nth <= 12)",
    "seeds AS (SELECT s.*, cluster_id FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) s JOIN records r USING (id))",
    "others AS (SELECT r.id, s.stage, s.nth, 0 AS own, row_number() OVER (PARTITION BY s.stage, s.nth ORDER BY f.score DESC, r.id) AS o, s.siblings FROM seeds s JOIN records r USING (cluster_id) JOIN found f ON f.id = r.id)",
    "every AS (SELECT id, stage, nth, own, o FROM others WHERE o <= siblings UNION ALL SELECT id, stage, nth, 1, 0 FROM seeds)",
]


@query(sql(PAGED, "SELECT id, row_number() OVER (ORDER BY min((stage, nth, own, o))) AS place FROM every GROUP BY id QUALIFY place <= 12"))
def o192_page_in(spark, sf):
    v = table(spark, sf, "embeddings")
    scored = v.selectExpr("vec_id AS id", "cast(vec_id % 97 AS double) AS score")
    # only edges that go out from the entity are beliefs about it
    e = _edges(spark, sf).where("source = 'C17' OR NOT contains(lower(concat_ws(' ', source, target, relation_type)), 'c17')")
    return ex.page_in(e, v.selectExpr("vec_id AS id", "label AS cluster_id"), scored, "about c17", 12)


_W3 = "list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 3)"


@query(sql([MEMORIES, f"weak AS (SELECT id, {_W3} AS w FROM memories WHERE (id % 100) / 100.0e0 < 0.65 OR id % 50 >= 30 ORDER BY (id % 37) / 37.0e0, access_count DESC, id LIMIT 8)", "themes AS (SELECT t AS theme, count(*) AS n FROM (SELECT unnest(w) AS t FROM weak) WHERE strlen(t) >= 4 GROUP BY t HAVING count(*) > 1 ORDER BY n DESC, theme LIMIT 5)", "l AS (SELECT list(theme) AS v FROM themes)"],
           "SELECT 'theme' AS part, theme AS name, n, FALSE AS cleanup FROM themes UNION ALL SELECT 'memory', CAST(id AS VARCHAR), len(w), CASE WHEN len(w) = 0 OR len(v) = 0 THEN FALSE ELSE len(list_intersect(list_distinct(w), v)) / CAST(len(list_distinct(list_concat(w, v))) AS DOUBLE) >= 0.78 END FROM weak, l"))
def o158_reflect(spark, sf):
    m = memories(spark, sf).selectExpr("id", "content", "(id % 100) / 100.0D AS importance", "id % 50 AS age_days", "(id % 37) / 37.0D AS quality", "access_count")
    weak, themes = ex.reflect(m)
    sizes = memories(spark, sf).select("id", "content").join(F.broadcast(weak), "id")  # eight rows
    from recallery.functions import text as tx

    rows = sizes.select(F.lit("memory").alias("part"), F.col("id").cast("string").alias("name"), F.size(tx.tokens3(F.col("content"))).cast("long").alias("n"), "cleanup")
    return themes.select(F.lit("theme").alias("part"), F.col("theme").alias("name"), "n", F.lit(False).alias("cleanup")).unionByName(rows)


ENTITY_LINES = [
    "Alice works at Acme Labs. See https://acme.org/x or mail a.b@acme.org", "GPT4 and OpenSky engine in Central Park city", "Bob knows Carla Diaz; The NASA team uses Falcon9", "nothing here", "River Bay Foundation is part of Green Valley town",
]


@query()
def o166_named_entities(spark, sf):
    """Regular expressions with look-behind rules of two engines differ on free text: a test holds it against hand-worked rows."""
    from recallery.operators import graph as gr

    case = _n(None, *ENTITY_LINES).replace("doc_id", "id")
    return gr.named_entities(memories(spark, sf).selectExpr("id", f"concat({case}, ' ', content) AS content")).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))
