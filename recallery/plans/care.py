"""Queries: merged entities, coherence, management, windows of high entropy, layers (O-51, O-73, O-96, O-133, O-144, O-151, O-170, O-243), with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.operators import care
from recallery.operators import lifecycle as lc
from recallery.operators.lexical import working_layer_score

from .model import MEMORIES, WORDS, as_of, memories, sql, table
from .registry import query
from .upkeep import DAYS, QUALITY, TABLE

# merged entities: customers, a third of them merged into the one with half their number

PEOPLE = """people AS (SELECT 'c' || c_custkey AS id, c_name AS name, ['a' || (c_custkey % 5), lower(c_mktsegment)] AS aliases, c_custkey % 7 AS occurrences, c_custkey % 3 AS memories, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description,
 DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS last_seen FROM customer), ties AS (SELECT 'c' || c_custkey AS source, 'c' || (c_custkey // 4) AS target, c_nationkey AS weight FROM customer)"""
MERGED = """moves AS (SELECT 'c' || c_custkey AS old, 'c' || (c_custkey // 2) AS new FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0),
 chain AS (SELECT old, new FROM moves UNION ALL SELECT c.old, m.new FROM chain c JOIN moves m ON m.old = c.new), ends AS (SELECT old, new FROM chain WHERE new NOT IN (SELECT old FROM moves))"""


def _merged(spark, sf):
    c = table(spark, sf, "customer")
    people = c.selectExpr(
        "concat('c', c_custkey) AS id", "c_name AS name", "array(concat('a', c_custkey % 5), lower(c_mktsegment)) AS aliases", "c_custkey % 7 AS occurrences", "c_custkey % 3 AS memories",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description", "date_add(date'2024-01-01', cast(c_custkey % 300 AS int)) AS last_seen",
    )
    ties = c.selectExpr("concat('c', c_custkey) AS source", "concat('c', c_custkey div 4) AS target", "c_nationkey AS weight")
    merges = c.where("c_custkey % 3 = 0 AND c_custkey > 0").selectExpr("c_custkey AS seq", "concat('c', c_custkey div 2) AS primary", "concat('c', c_custkey) AS secondary")
    return care.merge_entities(people, ties, merges)


@query(
    sql([PEOPLE, MERGED, "placed AS (SELECT p.*, coalesce(e.new, p.id) AS target FROM people p LEFT JOIN ends e ON e.old = p.id)",
         "al AS (SELECT target, unnest(aliases) AS alias FROM placed UNION SELECT target, name FROM placed WHERE target <> id)", "ac AS (SELECT target AS id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM al GROUP BY target)",
         "g AS (SELECT target AS id, max(name) FILTER (target = id) AS name, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(memories) AS BIGINT) AS memories, arg_min(description, struct_pack(other := target <> id, id := id)) FILTER (description IS NOT NULL) AS description, CAST(max(last_seen) AS VARCHAR) AS last_seen, count(*) FILTER (target <> id) AS merged_from FROM placed GROUP BY target)"],
        "SELECT id, name, occurrences, memories, coalesce(description, '') AS description, last_seen, merged_from, aliases FROM g JOIN ac USING (id)").replace("WITH", "WITH RECURSIVE", 1)
)
def o170_merge_entities(spark, sf):
    people, aliases, _ = _merged(spark, sf)
    names = aliases.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))
    return people.join(names, "id").withColumns({"description": F.coalesce("description", F.lit("")), "last_seen": F.col("last_seen").cast("string")})


@query(sql([PEOPLE, MERGED], "SELECT * FROM (SELECT coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, weight FROM ties LEFT JOIN ends a ON a.old = source LEFT JOIN ends b ON b.old = target) WHERE source <> target").replace("WITH", "WITH RECURSIVE", 1))
def o170_merged_edges(spark, sf):
    return _merged(spark, sf)[2]


# coherence: some documents tell of yesterday or tomorrow, or deny

TOLD = f"""told AS (SELECT doc_id AS id, source AS workspace_id, text || CASE doc_id // 7 % 50 WHEN 0 THEN ' seen yesterday' WHEN 1 THEN ' due tomorrow' WHEN 2 THEN ' never' ELSE '' END AS content FROM documents),
 marked AS (SELECT id, workspace_id, CASE WHEN contains(lower(content), 'yesterday') THEN 'yesterday' WHEN contains(lower(content), 'today') THEN 'today' WHEN contains(lower(content), 'tomorrow') THEN 'tomorrow' END AS marker FROM told),
 negated AS (SELECT id, array_to_string(list_slice({WORDS}, 1, 10), ' ') AS signature, CAST({' OR '.join('contains(lower(content), ' + chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) + ')' for w in lc.NEGATIONS)} AS INT) AS negative FROM told),
 factual AS (SELECT min(id) AS id FROM negated WHERE signature <> '' GROUP BY signature HAVING count(*) > 1 AND min(negative) < max(negative)),
 keyed AS (SELECT id, list_distinct({WORDS}) AS w, lower(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key FROM told),
 firsts AS (SELECT key, min(id) AS id FROM keyed GROUP BY key HAVING count(*) > 1),
 nears AS (SELECT f.id, CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0e0 WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0e0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END AS near FROM firsts f JOIN keyed a ON a.id = f.id JOIN keyed b ON b.key = f.key AND b.id <> f.id),
 repeated AS (SELECT id, 1.0e0 - min(near) AS severity FROM nears GROUP BY id HAVING min(near) < 0.7)"""
NAMED = """named AS (SELECT event_id AS id, event_type || (user_id % 50) AS name, CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) + 25 WHEN event_id % 5 = 1 THEN CAST(floor(value) AS BIGINT) ELSE 3 END AS occurrences, CASE WHEN event_id % 3 = 0 THEN (user_id % 100) / 100.0e0 ELSE 0.5e0 END AS trust, ts AS seen_at,
 CASE WHEN event_id % 7 <> 0 THEN 'an ' || event_type || ' of user ' || CASE WHEN event_id % 2 = 0 THEN 'unknown to us so far' ELSE CAST(user_id % 9 AS VARCHAR) END END AS description FROM events),
 backed AS (SELECT event_id AS entity_id FROM events WHERE event_id % 4 <> 0),
 first_named AS (SELECT *, first_value(id) OVER w AS id0, first_value(occurrences) OVER w AS n0, first_value(trust) OVER w AS t0, first_value(description) OVER w AS d0 FROM named WINDOW w AS (PARTITION BY name ORDER BY seen_at, id)),
 split_named AS (SELECT *, list_distinct(string_split(description, ' ')) AS w, list_distinct(string_split(d0, ' ')) AS w0 FROM first_named WHERE id <> id0),
 near_named AS (SELECT *, CASE WHEN description IS NOT NULL AND d0 IS NOT NULL THEN len(list_intersect(w, w0)) / CAST(len(list_distinct(list_concat(w, w0))) AS DOUBLE) END AS near FROM split_named),
 alerts AS (SELECT id, CASE WHEN abs(occurrences - n0) >= 5 THEN 'occurrences' WHEN abs(trust - t0) >= 0.15 THEN 'trust' WHEN near < 0.5 THEN 'description' END AS kind,
  least(1.0e0, CASE WHEN abs(occurrences - n0) >= 5 THEN abs(occurrences - n0) / 50.0e0 WHEN abs(trust - t0) >= 0.15 THEN abs(trust - t0) WHEN near < 0.5 THEN 1.0e0 - near END) AS severity FROM near_named
  UNION ALL SELECT id, 'orphan', 0.6e0 FROM named WHERE occurrences > 30 AND id NOT IN (SELECT entity_id FROM backed))"""


def _told(spark, sf):
    return memories(spark, sf).selectExpr("id", "workspace_id", "concat(content, CASE id div 7 % 50 WHEN 0 THEN ' seen yesterday' WHEN 1 THEN ' due tomorrow' WHEN 2 THEN ' never' ELSE '' END) AS content")


def _named(spark, sf):
    e = table(spark, sf, "events")
    named = e.selectExpr(
        "event_id AS id", "concat(event_type, user_id % 50) AS name", "CASE WHEN event_id % 5 = 0 THEN cast(floor(value) AS bigint) + 25 WHEN event_id % 5 = 1 THEN cast(floor(value) AS bigint) ELSE 3 END AS occurrences",
        "CASE WHEN event_id % 3 = 0 THEN (user_id % 100) / 100.0D ELSE 0.5D END AS trust", "ts AS seen_at", "CASE WHEN event_id % 7 <> 0 THEN concat('an ', event_type, ' of user ', CASE WHEN event_id % 2 = 0 THEN 'unknown to us so far' ELSE string(user_id % 9) END) END AS description",
    )
    return named, e.where("event_id % 4 <> 0").selectExpr("event_id AS entity_id")


@query(sql([TOLD], "SELECT a.workspace_id, least(a.id, b.id) AS first_id, greatest(a.id, b.id) AS second_id FROM marked a JOIN marked b ON a.workspace_id = b.workspace_id AND a.marker = 'yesterday' AND b.marker = 'tomorrow'"))
def o51_temporal_pairs(spark, sf):
    return care.temporal_pairs(_told(spark, sf), "workspace_id")


@query(sql([NAMED], "SELECT id, kind, round(severity, 6) AS severity FROM alerts WHERE kind IS NOT NULL"))
def o144_entity_drift(spark, sf):
    return care.drift_alerts(*_named(spark, sf)).withColumn("severity", F.round("severity", 6))


@query(
    sql([TOLD, NAMED, "temporal AS (SELECT a.id, count(*) AS issues FROM marked a JOIN marked b ON a.workspace_id = b.workspace_id AND a.marker = 'yesterday' AND b.marker = 'tomorrow' GROUP BY a.id)",
         "s AS (SELECT (SELECT count(*) * 0.8e0 FROM factual) + (SELECT coalesce(sum(severity), 0) FROM repeated) AS conflicts, (SELECT coalesce(CAST(sum(issues) AS DOUBLE), 0) FROM temporal) AS temporal, (SELECT sum(severity) FROM alerts WHERE kind IS NOT NULL) AS drift)"],
        "SELECT round(conflicts, 4) AS conflicts, temporal, round(drift, 4) AS drift, round(greatest(0.0e0, greatest(0.0e0, 1.0e0 - 0.15e0 * conflicts - 0.05e0 * temporal) - 0.1e0 * drift), 6) AS coherence, greatest(0.0e0, greatest(0.0e0, 1.0e0 - 0.15e0 * conflicts - 0.05e0 * temporal) - 0.1e0 * drift) >= 0.7 AS passes FROM s")
)
def o133_coherence(spark, sf):
    report = care.coherence_report(care.coherence_issues(_told(spark, sf), *_named(spark, sf), "workspace_id"))
    return report.withColumns({"conflicts": F.round("conflicts", 4), "drift": F.round("drift", 4), "coherence": F.round("coherence", 6)})


# management

_CYCLE = [
    MEMORIES, QUALITY,
    f"decayed AS (SELECT id, 1.0e0 * pow({TABLE[0]}, {DAYS.format('coalesce(last_access, created_at)')}) AS r FROM memories)",
    f"d AS (SELECT *, array_to_string({WORDS}, ' ') AS key FROM scored)", "k AS (SELECT min(id) AS id FROM d GROUP BY key, lang, priority)", "kept AS (SELECT * FROM scored WHERE id IN (SELECT id FROM k))",
    "low AS (SELECT id FROM kept WHERE overall < 0.25 AND CASE priority WHEN 'critical' THEN FALSE WHEN 'high' THEN overall < 0.1 ELSE TRUE END)",
    "held AS (SELECT *, strlen(content) AS bytes FROM kept WHERE id NOT IN (SELECT id FROM low))", "size AS (SELECT sum(bytes) AS all_bytes FROM held)",
]
_ACTIONS = "SELECT id, 'decay' AS action, round(r, 6) AS relevance FROM decayed WHERE abs(1.0e0 - r) > 0.001 UNION ALL SELECT id, 'consolidate', -1 FROM memories WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'evict', -1 FROM low UNION ALL SELECT id, 'limit', -1 FROM over_"


def _cycle(spark, sf, by_ratio):
    m = memories(spark, sf).withColumns({"kind": F.col("lang"), "relevance": F.lit(1.0)})
    limit = m.count() * 1200 if by_ratio else m.count() * 1000
    return care.auto_manage(m, as_of(), limit, by_ratio=by_ratio).select("id", "action", F.coalesce(F.round("new_relevance", 6), F.lit(-1.0)).alias("relevance"))


@query(sql([*_CYCLE, "r AS (SELECT id, all_bytes - sum(bytes) OVER (ORDER BY round(overall, 9), id DESC) + bytes AS before FROM held, size WHERE priority <> 'critical')", "over_ AS (SELECT id FROM r WHERE before > (SELECT count(*) * 1000 FROM memories))"], _ACTIONS))
def o151_auto_manage(spark, sf):
    """A limit of a thousand bytes a memory: the worst go until the rest fits."""
    return _cycle(spark, sf, False)


@query(sql([*_CYCLE, "lim AS (SELECT count(*) * 1200 AS most FROM memories)", "over_ AS (SELECT id FROM held, size, lim WHERE priority <> 'critical' AND all_bytes > most AND overall < 0.25e0 * all_bytes / most)"], _ACTIONS))
def o151_auto_manage_by_ratio(spark, sf):
    return _cycle(spark, sf, True)


# windows


@query(
    sql([MEMORIES, "w AS (SELECT id, s AS start, substr(content, s + 1, 32) AS content FROM (SELECT id, content, unnest(range(0, greatest(length(content) - 32, 0), 8)) AS s FROM memories))", "h AS (SELECT *, regexp_extract_all(hex(encode(content)), '..') AS bytes FROM w)",
         "e AS (SELECT id, start, content, len(bytes) AS n, list_sum(list_transform(map_values(list_histogram(bytes)), lambda c: -(c / CAST(len(bytes) AS DOUBLE)) * log2(c / CAST(len(bytes) AS DOUBLE)))) AS entropy FROM h)"],
        "SELECT id, start, round(entropy, 6) AS entropy, content FROM e WHERE round(entropy, 9) >= 4.3 AND n >= 20")
)
def o243_entropy_windows(spark, sf):
    found = care.entropy_windows(memories(spark, sf), 4.2999999999)
    return found.select("id", "start", F.round("entropy", 6).alias("entropy"), "content")


# layers

ASKED = "red ring"
_hits = lambda c, t: f"((length(lower({c})) - length(replace(lower({c}), '{t}', ''))) // {len(t)})"
_if = lambda test, n: f"CASE WHEN {test} THEN {n}e0 ELSE 0.0e0 END"
_text = lambda c: " + ".join([_if(f"contains(lower({c}), '{ASKED}')", 0.5), *(f"CASE WHEN contains(lower({c}), '{t}') THEN 0.1e0 + least(0.05e0 * {_hits(c, t)}, 0.3e0) ELSE 0.0e0 END" for t in ASKED.split())])
LAYERS = [
    MEMORIES,
    f"l1 AS (SELECT 'm' || id AS id, round(least(1.0e0, {_text('content')}), 9) AS score FROM memories)",
    "sess AS (SELECT conv_id, min(turn) AS t0 FROM conversations GROUP BY conv_id)",
    f"ev AS (SELECT c.conv_id, sum({_if(f'contains(lower(c.text), {chr(39)}{ASKED}{chr(39)})', 0.3)} + " + " + ".join(_if(f"contains(lower(c.text), '{t}')", 0.05) for t in ASKED.split()) + ") AS happened FROM conversations c JOIN sess s ON s.conv_id = c.conv_id AND c.turn > s.t0 GROUP BY c.conv_id)",
    f"l2 AS (SELECT 's' || s.conv_id AS id, round(least(1.0e0, {_text('c.text')} + coalesce(happened, 0.0e0)), 9) AS score FROM sess s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.t0 LEFT JOIN ev ON ev.conv_id = s.conv_id)",
    "things AS (SELECT 'e' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) || ' and a RED RING' WHEN p_partkey % 3 = 1 THEN 'all that is red' END AS description, [p_brand, CASE WHEN p_partkey % 7 = 0 THEN 'The Red Ring' ELSE p_name END] AS aliases FROM part)",
    f"l3 AS (SELECT id, least(1.0e0, round(0.5e0 * CASE WHEN lower(name) = '{ASKED}' THEN 1.0e0 WHEN contains(lower(name), '{ASKED}') OR contains('{ASKED}', lower(name)) THEN 0.7e0 WHEN description IS NOT NULL THEN "
    + " + ".join([_if(f"contains(lower(description), '{ASKED}')", 0.4), *(_if(f"contains(lower(description), '{t}')", 0.1) for t in ASKED.split())])
    + f" WHEN len(list_filter(aliases, lambda a: contains(lower(a), '{ASKED}'))) > 0 THEN 0.6e0 ELSE 0.0e0 END, 9)) AS score FROM things)",
    "layers AS (SELECT 'working' AS layer, * FROM l1 WHERE score > 0 UNION ALL SELECT 'episodic', * FROM l2 WHERE score > 0 UNION ALL SELECT 'semantic', * FROM l3 WHERE score > 0)",
]


def _layers(spark, sf):
    working = memories(spark, sf).select(F.concat(F.lit("m"), "id").alias("id"), "content")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))  # the turns of a session
    sessions = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t")).select(
        F.concat(F.lit("s"), "conv_id").alias("id"), F.col("t")[0]["text"].alias("summary"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["text"]).alias("events")
    )
    things = table(spark, sf, "part").selectExpr(
        "concat('e', p_partkey) AS id", "p_name AS name", "lower(p_name) AS normalized_name", "CASE WHEN p_partkey % 3 = 0 THEN concat(lower(p_type), ' and a RED RING') WHEN p_partkey % 3 = 1 THEN 'all that is red' END AS description",
        "array(p_brand, CASE WHEN p_partkey % 7 = 0 THEN 'The Red Ring' ELSE p_name END) AS aliases",
    )
    return working, sessions, things


@query(sql(LAYERS, "SELECT layer, id, round(score, 6) AS score FROM layers"))
def o73_layer_scores(spark, sf):
    working, sessions, things = _layers(spark, sf)
    scored = [
        working.select(F.lit("working").alias("layer"), "id", working_layer_score(ASKED, F.col("content")).alias("score")),
        sessions.select(F.lit("episodic").alias("layer"), "id", care.episodic_layer_score(ASKED, F.col("summary"), F.col("events")).alias("score")),
        things.select(F.lit("semantic").alias("layer"), "id", care.semantic_layer_score(ASKED, F.col("name"), F.col("normalized_name"), F.col("description"), F.col("aliases")).alias("score")),
    ]
    return scored[0].unionByName(scored[1]).unionByName(scored[2]).where("score > 0").withColumn("score", F.round("score", 6))


@query(sql([*LAYERS, "r AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY score DESC, id) AS rank FROM layers)", "f AS (SELECT id, sum(1.0e0 / (60 + rank)) AS score, string_agg(layer, '+' ORDER BY layer) AS sources FROM r GROUP BY id)"], "SELECT id, round(score, 9) AS score, sources FROM f WHERE score >= 0.014 ORDER BY f.score DESC, id LIMIT 20"))
def o96_adaptive_gating(spark, sf):
    return care.layered_search(*_layers(spark, sf), ASKED, 0.014).withColumn("score", F.round("score", 9))
