"""Queries on the full-text index (O-41, O-63) and their twins, with the stemmer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.operators import expansion as ex
from recallery.operators import fulltext as ft
from recallery.operators import stems

from .model import MEMORIES, memories, sql, table
from .registry import query

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
_left = lambda n: f"left(w, length(w) - {n})"
_is = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"


def _table(endings: dict[str, str], pattern: str) -> str:
    rows = []
    for end, other in sorted(endings.items(), key=lambda e: -len(e[0])):
        test = _is(_left(len(end)), pattern) + (f" AND {_is(_left(3), '[st]$')}" if end == "ion" else "")
        rows.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN {test} THEN {_left(len(end))} || '{other}' ELSE w END")
    return "CASE " + " ".join(rows) + " ELSE w END"


#: stems of the distinct tokens ``t`` of ``tok``: an initial y is Y meanwhile, # marks a word whose ed or ing went
_STEPS = [
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_left(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_left(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_is(_left(3), _M0)} THEN {_left(1)} ELSE w END WHEN ends_with(w, 'ed') AND {_is(_left(2), _VOWEL)} THEN '#' || {_left(2)}"
    f" WHEN ends_with(w, 'ing') AND {_is(_left(3), _VOWEL)} THEN '#' || {_left(3)} ELSE w END",
    f"CASE WHEN NOT starts_with(w, '#') THEN w WHEN {_is('w', '(at|bl|iz)$')} THEN substr(w, 2) || 'e' WHEN length(w) > 2 AND right(w, 1) = left(right(w, 2), 1) AND {_is('w', '[^aeioulsz]$')} THEN substr({_left(1)}, 2)"
    f" WHEN {_is('substr(w, 2)', _SHORT)} THEN substr(w, 2) || 'e' ELSE substr(w, 2) END",
    f"CASE WHEN ends_with(w, 'y') AND {_is(_left(1), _VOWEL)} THEN {_left(1)} || 'i' ELSE w END",
    _table(stems.STEP_2, _M0),
    _table(stems.STEP_3, _M0),
    _table(dict.fromkeys(stems.STEP_4, ""), _MORE),
    f"CASE WHEN ends_with(w, 'e') AND ({_is(_left(1), _MORE)} OR ({_is(_left(1), _M1)} AND NOT {_is(_left(1), _SHORT)})) THEN {_left(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {_is(_left(1), _MORE)} THEN {_left(1)} ELSE w END",
]
STEMS = [
    "st0 AS (SELECT DISTINCT t, CASE WHEN starts_with(t, 'y') THEN 'Y' || substr(t, 2) ELSE t END AS w FROM tok)",
    *[f"st{i + 1} AS (SELECT t, {step} AS w FROM st{i})" for i, step in enumerate(_STEPS)],
    f"stems AS (SELECT t, CASE WHEN length(t) BETWEEN 3 AND {stems.LONGEST} THEN replace(w, 'Y', 'y') ELSE t END AS term FROM st{len(_STEPS)})",
]


def _parts(source: str, key: str, text: str) -> str:
    """The distinct code parts of a text, of tokens that differ in case only the first one cut."""
    return (
        f"(SELECT DISTINCT {key}, part FROM (SELECT {key}, unnest(string_split_regex(lower(regexp_replace(first, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS part FROM"
        f" (SELECT {key}, lower(s) AS low, arg_min(s, nth) AS first FROM (SELECT {key}, unnest(x) AS s, generate_subscripts(x, 1) AS nth FROM (SELECT {key}, regexp_extract_all({text}, '{tx.SEARCH_TOKEN}') AS x FROM {source})) GROUP BY ALL)) WHERE length(part) > 1)"
    )


INDEX = [
    r"""tok AS (SELECT id, strip_accents(w) AS t FROM (SELECT id, unnest(string_split_regex(lower(content), '[^\p{L}\p{M}\p{N}\p{Co}]+')) AS w FROM memories) WHERE strip_accents(w) <> ''
        UNION ALL SELECT id, part FROM """ + _parts("memories", "id", "path || ' ' || content") + ")",
    *STEMS,
    "lengths AS (SELECT id, count(*) AS length FROM tok GROUP BY id)",
    "totals AS (SELECT (SELECT count(*) FROM memories) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM memories) AS average)",
    "postings AS (SELECT id, term, count(*) AS tf FROM tok JOIN stems USING (t) GROUP BY ALL)",
    # ``wanted``: prefixes
    "hits AS (SELECT prefix, id, CAST(sum(tf) AS DOUBLE) AS f FROM postings JOIN wanted ON starts_with(term, prefix) GROUP BY ALL)",
    "df AS (SELECT prefix, count(*) AS documents FROM hits GROUP BY ALL)",
    "part AS (SELECT prefix, id, CASE WHEN ln((n - documents + 0.5e0) / (documents + 0.5e0)) <= 0 THEN 0.000001e0 ELSE ln((n - documents + 0.5e0) / (documents + 0.5e0)) END * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * length / average)) AS p FROM hits JOIN df USING (prefix) JOIN lengths USING (id), totals)",
]
SOUGHT = "Tokens anti things of area-fooBar"
ASKED = "asked AS (SELECT * FROM (VALUES ('token', 2), ('anti', 2), ('thing', 2), ('of', 2), ('area', 1), ('foo', 1), ('bar', 1)) v(prefix, times)), wanted AS (SELECT prefix FROM asked)"
SCORED = "scored AS (SELECT id, sum(times * p) AS score FROM asked JOIN part USING (prefix) GROUP BY id)"


@query(sql([MEMORIES, ASKED, *INDEX, SCORED], "SELECT id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, id LIMIT 25"))
def o63_fts_prefix(spark, sf):
    found = ft.fts_search(ft.build_index(memories(spark, sf)), SOUGHT)
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(25).select("id", F.round("score", 6).alias("score"))


@query(
    sql(
        [MEMORIES, "words AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '" + tx.SEARCH_TOKEN + "'), lambda s: regexp_replace(lower(s), '[:#]', '', 'g')))) AS w FROM benchmark)",
         "terms_ AS (SELECT item_id, w FROM words WHERE regexp_matches(w, '^[a-z0-9]+$') UNION ALL SELECT item_id, part FROM " + _parts("benchmark", "item_id", "text") + ")",
         *[c.replace("FROM tok)", "FROM (SELECT w AS t FROM terms_))").replace("stems AS", "qstems AS").replace("st0", "qst0") if c.startswith("st0") else c.replace("stems AS", "qstems AS").replace("FROM st", "FROM qst").replace("st", "qst", 1) if c.startswith("st") and not c.startswith("stems") else c.replace("stems AS", "qstems AS").replace("FROM st", "FROM qst") for c in STEMS],
         "asked AS (SELECT item_id, term AS prefix, count(*) AS times FROM terms_ JOIN qstems ON t = w GROUP BY ALL)", "wanted AS (SELECT DISTINCT prefix FROM asked)", *INDEX,
         "scored AS (SELECT item_id AS query_id, id, sum(times * p) AS score FROM asked JOIN part USING (prefix) GROUP BY ALL)"],
        "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= 5",
    )
)
def o63_fts_batch(spark, sf):
    """Every benchmark item as a query."""
    asked = table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    found = ft.best_of_each(ft.fts_search_batch(ft.build_index(memories(spark, sf)), asked, 5), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(sql([MEMORIES, ASKED, *INDEX, SCORED], "SELECT id, lang, round(score, 6) AS score FROM memories JOIN scored USING (id) ORDER BY round(scored.score, 9) DESC, id LIMIT 20"))
def o41_fts_hits_with_records(spark, sf):
    m = memories(spark, sf)
    hits = ft.fts_search(ft.build_index(m), SOUGHT).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return ex.hits_with_records(m.select("id", "lang"), hits).select("id", "lang", F.round("score", 6).alias("score"))
