"""Queries: entities, graphs, code-graph shapes, threat scans, dialogue, streaming operators on batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.operators import dialogue as dg
from recallery.operators import graph as gr
from recallery.operators import metrics as mt
from recallery.operators import scan as sc
from recallery.sources import store
from recallery.streaming import flows

from .model import EDGES, MEMORIES, PART_EDGES, PARTS, TURNS, USAGE, edges, memories, part_edges, parts, sql, table, turns, usage
from .registry import query

PAGES = "pages_m AS (SELECT page_id AS id, html AS content, url FROM pages)"


def _pages(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id AS id", "html AS content", "url")


ENTITIES = "ent AS (" + " UNION ALL ".join(f"SELECT DISTINCT ON (id, lower(value)) id, value, '{t}' AS entity_type, '{r}' AS relation_type FROM (SELECT id, unnest(regexp_extract_all(content, '{p}', 1)) AS value FROM src)" for t, r, p in gr.ENTITY_PATTERNS) + ")"
SOURCE = "src AS (SELECT id, content FROM pages_m UNION ALL SELECT 1000000 + doc_id, text FROM documents)"


def _texts(spark, sf):
    return _pages(spark, sf).select("id", "content").unionByName(memories(spark, sf).select((F.col("id") + 1000000).alias("id"), "content"))


@query(sql([PAGES, SOURCE, ENTITIES], "SELECT id, lower(value) AS value, entity_type, relation_type FROM ent"))
def o165_extract_entities(spark, sf):
    return gr.extract_entities(_texts(spark, sf)).select("id", F.lower("value").alias("value"), "entity_type", "relation_type")


@query(sql([PAGES, SOURCE, ENTITIES, "n AS (SELECT id, entity_type, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS name FROM ent)"], "SELECT name, entity_type, count(*) AS occurrences, count(DISTINCT id) AS memories, round(least(1.0e0, 0.3e0 + 0.3e0 * log2(1.0e0 + count(*))), 6) AS trust FROM n GROUP BY ALL"))
def o126_entity_rollup(spark, sf):
    found = gr.extract_entities(_texts(spark, sf)).withColumn("seen_at", F.col("id"))
    return gr.entity_rollup(found).select("name", "entity_type", "occurrences", "memories", F.round("trust", 6).alias("trust"))


RELATIONS = "rel AS (" + " UNION ALL ".join(f"SELECT id, regexp_extract_all(content, '(?i)\\b({gr.SIDE})\\s+{p}\\s+({gr.SIDE})', 1) AS s, regexp_extract_all(content, '(?i)\\b({gr.SIDE})\\s+{p}\\s+({gr.SIDE})', 2) AS t, '{r}' AS relation_type, {c}e0 AS confidence FROM src" for r, c, p in gr.RELATION_PATTERNS) + ")"


@query(sql(["src AS (SELECT doc_id AS id, replace(text, ' the ', ' uses ') AS content FROM documents)", RELATIONS], "SELECT relation_type, count(*) AS n, min(source) AS first_source, max(target) AS last_target FROM (SELECT relation_type, unnest(s) AS source, unnest(t) AS target FROM rel) GROUP BY ALL"))
def o167_extract_relations(spark, sf):
    # the test texts name no relations: a frequent word stands for one
    texts = memories(spark, sf).select("id", F.replace("content", F.lit(" the "), F.lit(" uses ")).alias("content"))
    return gr.extract_relations(texts).groupBy("relation_type").agg(F.count("*").alias("n"), F.min("source").alias("first_source"), F.max("target").alias("last_target"))


LINKS = "links AS (SELECT DISTINCT l_orderkey AS id, 'b' || (l_partkey % 50) AS entity FROM lineitem)"


@query(
    sql([LINKS, "n AS (SELECT id, count(*) AS n FROM links GROUP BY id)", "s AS (SELECT id, CASE WHEN n <= 1 THEN 0.0e0 WHEN n = 2 THEN 0.55e0 WHEN n = 3 THEN 0.65e0 WHEN n = 4 THEN 0.75e0 ELSE 0.85e0 END AS score FROM n)"],
        "SELECT a.entity AS source, b.entity AS target, round(least(10.0e0, sum(score)), 6) AS weight, max(score) AS cooccurrence, count(*) AS support, 1.0e0 AS confidence FROM links a JOIN links b USING (id) JOIN s USING (id) WHERE a.entity <> b.entity GROUP BY ALL")
)
def o168_cooccurrence(spark, sf):
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "concat('b', l_partkey % 50) AS entity").distinct()
    return gr.cooccurrence_edges(links).withColumn("weight", F.round("weight", 6))


@query(sql([EDGES], "SELECT target AS node, relation_type, 'out' AS direction FROM edges WHERE source = 'n3' UNION ALL SELECT source, relation_type, 'in' FROM edges WHERE target = 'n3'"))
def o172_neighbours(spark, sf):
    return gr.neighbours(edges(spark, sf), "n3")


REACH = """r AS (SELECT 'c1' AS seed, 'c1' AS node, 0 AS depth UNION SELECT 'c2', 'c2', 0 UNION SELECT r.seed, e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.node WHERE r.depth < 3)"""


@query(sql([EDGES, REACH], "SELECT seed, node, min(depth) AS depth FROM r WHERE node <> seed GROUP BY ALL").replace("WITH", "WITH RECURSIVE", 1))
def o173_reachable(spark, sf):
    seeds = spark.createDataFrame([("c1",), ("c2",)], "node string")
    return gr.reachable(edges(spark, sf), seeds, 3)


@query(sql([EDGES, "h AS (SELECT DISTINCT source AS node, 0 AS depth, source AS path FROM edges WHERE source IN ('c3', 'c4') UNION ALL SELECT e.target, h.depth + 1, h.path || '>' || e.target FROM h JOIN edges e ON e.source = h.node WHERE h.depth < 2 AND NOT contains(h.path, e.target))"], "SELECT node, depth, path FROM h WHERE depth > 0").replace("WITH", "WITH RECURSIVE", 1))
def o175_graph_hops(spark, sf):
    edges(spark, sf).createOrReplaceTempView("recallery_edges")
    return gr.graph_hops_sql(spark, "recallery_edges", ["c3", "c4"], 2)


@query(sql([EDGES, "n AS (SELECT target FROM edges WHERE source = 'c5')"], "SELECT DISTINCT source, target FROM edges WHERE source = 'c5' OR source IN (SELECT target FROM n)"))
def o180_k_hop_edges(spark, sf):
    return gr.k_hop_edges(edges(spark, sf), "c5", 2)


BOTH = f"{EDGES}, both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges)"
PATHS = "p AS (SELECT 'n1' AS node, ['n1'] AS path UNION ALL SELECT e.target, list_append(p.path, e.target) FROM p JOIN both_ways e ON e.source = p.node WHERE p.node <> 'n6' AND NOT list_contains(p.path, e.target) AND len(p.path) <= 5)"


def _both(spark, sf):
    e = edges(spark, sf).select("source", "target")
    return e.union(e.select("target", "source"))


@query(sql([BOTH, PATHS], "SELECT array_to_string(path, '>') AS path, len(path) - 1 AS edges FROM p WHERE node = 'n6'").replace("WITH", "WITH RECURSIVE", 1))
def o181_all_paths(spark, sf):
    return gr.all_paths(_both(spark, sf), "n1", "n6", 5)


@query(sql([BOTH, PATHS], "SELECT array_to_string(path, '>') AS path, len(path) - 1 AS edges FROM p WHERE node = 'n6' ORDER BY edges, path LIMIT 1").replace("WITH", "WITH RECURSIVE", 1))
def o179_shortest_path(spark, sf):
    return gr.shortest_path(_both(spark, sf), "n1", "n6", 5)


@query(sql([EDGES, "p AS (SELECT 'c7' AS node, 0.0e0 AS cost, 0 AS d UNION ALL SELECT e.target, p.cost + 1 - e.confidence, p.d + 1 FROM p JOIN edges e ON e.source = p.node WHERE p.d < 3)"], "SELECT node, round(min(cost), 6) AS cost FROM p WHERE node <> 'c7' GROUP BY node").replace("WITH", "WITH RECURSIVE", 1))
def o178_best_confidence(spark, sf):
    return gr.best_confidence(edges(spark, sf), "c7", 3).select("node", F.round("cost", 6).alias("cost"))


BELIEFS = "beliefs AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 300) AS source, o_orderstatus AS target, substr(o_orderpriority, 1, 1) AS relation_type, (o_orderkey % 90) / 100.0e0 AS confidence, 'm' || (o_orderkey % 17) AS provenance, o_orderdate AS created_at FROM orders)"


def _beliefs(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat('c', o_custkey % 300) AS source", "o_orderstatus AS target", "substring(o_orderpriority, 1, 1) AS relation_type", "(o_orderkey % 90) / 100.0D AS confidence", "concat('m', o_orderkey % 17) AS provenance", "o_orderdate AS created_at")


@query(sql([BELIEFS, "w AS (SELECT id, provenance, first_value(id) OVER w AS first_id, first_value(provenance) OVER w AS fp FROM beliefs WINDOW w AS (PARTITION BY source, target, relation_type ORDER BY created_at, id))"], "SELECT id, first_id FROM w WHERE id <> first_id AND provenance <> fp"))
def o183_contradictions(spark, sf):
    return gr.contradictions(_beliefs(spark, sf))


@query(sql([BELIEFS], "SELECT id, confidence FROM beliefs WHERE contains(lower(source || ' ' || target || ' ' || relation_type), 'c12') ORDER BY confidence DESC, id LIMIT 40"))
def o176_belief_search(spark, sf):
    return gr.belief_search(_beliefs(spark, sf), "c12 is").limit(40).select("id", "confidence")


@query(sql([BELIEFS], "SELECT id, round(CASE target WHEN 'F' THEN 0.95e0 WHEN 'O' THEN 0.8e0 ELSE 0.5e0 END + least(length(source) / 100.0e0, 0.05e0), 6) AS confidence FROM beliefs"))
def o184_belief_confidence(spark, sf):
    kind = F.when(F.col("target") == "F", "verified").when(F.col("target") == "O", "user").otherwise("other")
    return _beliefs(spark, sf).select("id", F.round(gr.belief_confidence(kind, F.length("source")), 6).alias("confidence"))


@query(sql([BELIEFS], "SELECT DISTINCT ON (m.id) m.id, b.id AS edge_id FROM (SELECT 'm' || doc_id AS id FROM documents) m JOIN beliefs b ON b.provenance = m.id ORDER BY m.id, b.created_at, b.id"))
def o42_edges_of_memories(spark, sf):
    from pyspark.sql import Window

    m = memories(spark, sf).select(F.concat(F.lit("m"), "id").alias("provenance"))
    w = Window.partitionBy("provenance").orderBy("created_at", "id")
    return _beliefs(spark, sf).join(m, "provenance").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("provenance").alias("id"), F.col("id").alias("edge_id"))


@query(sql([PARTS, PART_EDGES, "d AS (SELECT target AS node, count(*) AS in_degree FROM part_edges GROUP BY ALL), o AS (SELECT source AS node, count(*) AS out_degree FROM part_edges GROUP BY ALL)", "n AS (SELECT node FROM parts UNION ALL SELECT 's' || s_suppkey FROM supplier)"], "SELECT node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) + coalesce(in_degree, 0) AS degree FROM n LEFT JOIN d USING (node) LEFT JOIN o USING (node) WHERE degree >= 20 ORDER BY degree DESC, node LIMIT 50"))
def o113_hub_nodes(spark, sf):
    nodes = parts(spark, sf).select("node").union(table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)"))
    return gr.hub_nodes(part_edges(spark, sf), nodes, 20, 50)


@query(sql([PARTS, PART_EDGES, "d AS (SELECT target AS node, count(*) AS in_degree FROM part_edges GROUP BY ALL)"], "SELECT node, complexity, complexity * (coalesce(in_degree, 0) + 1) AS risk FROM parts LEFT JOIN d USING (node) WHERE complexity >= 10 ORDER BY risk DESC, complexity DESC, node LIMIT 50"))
def o114_hotspots(spark, sf):
    return gr.hotspots(part_edges(spark, sf), parts(spark, sf), 10.0, 50).select("node", "complexity", "risk")


@query(sql([PARTS], "SELECT node, sha256(CAST('repo|src|' || name || '|' || kind || '|' AS BLOB) || unhex(substr(lpad(hex(id), 8, '0'), 7, 2) || substr(lpad(hex(id), 8, '0'), 5, 2) || substr(lpad(hex(id), 8, '0'), 3, 2) || substr(lpad(hex(id), 8, '0'), 1, 2))) AS symbol_id FROM parts"))
def o191_symbol_id(spark, sf):
    return parts(spark, sf).select("node", gr.symbol_id(F.lit("repo"), F.lit("src"), F.col("name"), F.col("kind"), F.col("id")).alias("symbol_id"))


@query(sql(["v AS (SELECT vec_id AS id, label FROM embeddings)"], "SELECT a.id AS seed, b.id FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id < 20 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 5"))
def o52_siblings(spark, sf):
    from pyspark.sql import Window

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    seeds = v.where("id < 20").select(F.col("id").alias("seed"), "label")
    w = Window.partitionBy("seed").orderBy("id")
    return v.join(seeds, "label").where("id <> seed").withColumn("n", F.row_number().over(w)).where("n <= 5").select("seed", "id")


@query(sql([MEMORIES, "names AS (SELECT 'n' || n_nationkey AS entity, lower(n_name) AS name FROM nation)", "src AS (SELECT p_partkey AS id, p_name || ' nation_' || (p_partkey % 25) AS content FROM part)"], "SELECT entity, id FROM names JOIN src ON contains(lower(content), name) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id DESC) <= 3"))
def o45_entity_mentions(spark, sf):
    """Names are single tokens, so the substring join becomes an equi-join on tokens and an exact check."""
    from pyspark.sql import Window

    names = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity"), F.lower("n_name").alias("name"))
    src = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat(p_name, ' nation_', p_partkey % 25) AS content")
    tokens = src.select("id", "content", F.explode(F.array_distinct(tx.words(F.col("content")))).alias("token"))
    # a name may be the beginning of a longer token (nation_1 in nation_12): each token brings its beginnings
    begun = tokens.select("id", "content", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("name"))
    hits = begun.join(names, "name").where(F.lower("content").contains(F.col("name"))).select("entity", "id").distinct()
    w = Window.partitionBy("entity").orderBy(F.desc("id"))
    return hits.withColumn("n", F.row_number().over(w)).where("n <= 3").select("entity", "id")


# threat scans


def _any(column, words):
    return " OR ".join(f"contains(lower({column}), '{w}')" for w in words)


# dialogue


@query(sql([TURNS], "SELECT session_id, count(*) AS messages, substr(arg_min(content, turn), 1, 48) AS title, substr(arg_max(content, turn), 1, 120) AS preview, max(turn) AS last_turn FROM turns GROUP BY session_id"))
def o12_threads(spark, sf):
    return dg.threads(turns(spark, sf).dropDuplicates(["session_id", "turn"]))


@query(sql([TURNS, "t AS (SELECT *, sum(greatest(1, strlen(content) // 4)) OVER (PARTITION BY session_id) / 500.0e0 AS used, ceil(count(*) OVER (PARTITION BY session_id) * 0.2e0) AS keep, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place FROM turns)"], "SELECT session_id, turn, role, substr(content, 1, 500) AS content FROM t WHERE used >= 0.8 AND place <= keep"))
def o264_compact_sessions(spark, sf):
    return dg.compact_sessions(turns(spark, sf), limit=500)


@query(sql([TURNS, "t AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn))"], "SELECT session_id, turn, md5('User: ' || content || chr(10) || 'Assistant: ' || reply) AS digest FROM t WHERE role = 'user' AND nr = 'assistant'"))
def o287_session_exchanges(spark, sf):
    return dg.session_exchanges(turns(spark, sf)).select("session_id", "turn", F.md5("content").alias("digest"))


PAIRS = ["t AS (SELECT session_id, role, content, row_number() OVER (PARTITION BY session_id, role ORDER BY turn) AS nth FROM turns WHERE role IN ('user', 'assistant'))", "p AS (SELECT session_id, nth, u.content AS instruction, a.content AS response FROM t u JOIN t a USING (session_id, nth) WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.content) > 20 AND length(a.content) > 20)"]


@query(sql([TURNS, *PAIRS], "SELECT session_id, nth, md5(instruction || response) AS digest FROM p"))
def o291_transcript_pairs(spark, sf):
    return dg.transcript_pairs(turns(spark, sf)).select("session_id", F.col("nth").cast("long").alias("nth"), F.md5(F.concat("instruction", "response")).alias("digest"))




@query(sql([TURNS, "k AS (SELECT session_id, turn, trim(regexp_replace(regexp_replace(lower(content), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM turns)"], "SELECT session_id, turn FROM k WHERE length(key) > 10 QUALIFY row_number() OVER (PARTITION BY key ORDER BY CAST(session_id AS INT), turn) = 1"))
def o293_dedup_pairs(spark, sf):
    t = turns(spark, sf).withColumn("order_id", F.col("session_id").cast("int"))
    return dg.dedup_pairs(t, "content", ["order_id", "turn"]).select("session_id", "turn")




@query("WITH h AS (SELECT p_type AS fact_type, p_brand AS value, count(DISTINCT p_size % 5) AS subjects FROM part GROUP BY ALL HAVING count(DISTINCT p_size % 5) >= 2) SELECT fact_type, min(value) AS value, count(*) AS shared FROM h GROUP BY fact_type")
def o304_shared_facts(spark, sf):
    return dg.shared_facts(table(spark, sf, "part").selectExpr("p_type AS fact_type", "p_brand AS value", "p_size % 5 AS subject"))


@query(sql([MEMORIES, "l AS (SELECT id, unnest(string_split(replace(content, '. ', ': '), chr(10))) AS line FROM memories)", "k AS (SELECT id, trim(string_split(line, ': ')[1]) AS key, trim(substr(line, instr(line, ': ') + 2)) AS value FROM l WHERE contains(line, ': ') AND NOT regexp_matches(line, '^#'))"], "SELECT id, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS total FROM k WHERE length(key) > 2 AND length(value) > 15 GROUP BY id"))
def o289_markdown_key_values(spark, sf):
    m = memories(spark, sf).select("id", F.replace("content", F.lit(". "), F.lit(": ")).alias("content"))
    return dg.markdown_key_values(m).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("total"))


@query()
def o207_chunk_lines(spark, sf):
    return dg.chunk_lines(memories(spark, sf)).select("id", "chunk", F.length("content").alias("n"))


@query(sql([USAGE, "r AS (SELECT provider, value, row_number() OVER (PARTITION BY provider ORDER BY value) AS place, count(*) OVER (PARTITION BY provider) AS n FROM usage)"], "SELECT provider, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(CASE WHEN place = least(floor(n * 0.95) + 1, n) THEN value END), 6) AS p95, count(*) AS n FROM r GROUP BY provider"))
def o294_latency_summary(spark, sf):
    return mt.latency_summary(usage(spark, sf), "provider", "value").select("provider", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "n")


# streaming operators over batch tables


@query(sql([TURNS, "e AS (SELECT session_id, CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'tool_result' ELSE 'session_start' END AS event_type, content, turn FROM turns)"], "SELECT 'sessions/' || session_id || '/thread' AS path, CASE event_type WHEN 'message' THEN 'user' ELSE 'assistant' END AS role, md5('[2024-01-01T00:00:00Z] ' || CASE event_type WHEN 'message' THEN 'user' ELSE 'assistant' END || ': ' || content) AS digest FROM e WHERE event_type <> 'session_start' AND trim(content) <> ''"))
def o260_ingest_events(spark, sf):
    kind = F.when(F.col("role") == "user", "message").when(F.col("role") == "assistant", "tool_result").otherwise("session_start")
    e = turns(spark, sf).withColumns({"event_type": kind, "timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp")}).drop("role")
    return flows.ingest_events(e).select("path", "role", F.md5("content").alias("digest"))


@query(sql([USAGE], "SELECT event_id, s.subscriber FROM usage u JOIN (VALUES ('a', ['p1', 'p2'], ['error']), ('b', NULL, ['click'])) s(subscriber, agents, types) ON (s.agents IS NULL OR list_contains(s.agents, u.provider)) AND list_contains(s.types, u.event_type)"))
def o261_subscriptions(spark, sf):
    subs = spark.createDataFrame([("a", ["p1", "p2"], None, ["error"]), ("b", None, None, ["click"]), ("c", None, None, None)], "subscriber string, agents array<string>, projects array<string>, types array<string>")
    e = usage(spark, sf).select("event_id", F.col("provider").alias("agent"), F.lit("x").alias("project"), "event_type")
    return flows.subscribed(e, F.broadcast(subs)).select("event_id", "subscriber")  # a registry of three rows


@query("SELECT user_id AS agent, epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(max(ts)) >= 86400 AS stale FROM events GROUP BY user_id")
def o266_stale_agents(spark, sf):
    beats = usage(spark, sf).select(F.col("user_id").alias("agent"), "ts")
    return flows.stale_agents(beats, F.lit("2024-01-30 23:00:00").cast("timestamp"), 86400).select("agent", "stale")


ROUTED = """m AS (SELECT event_id AS message_id, 'p' || (user_id % 7) AS sender, CASE WHEN event_id % 3 = 0 THEN 'p' || (event_id % 7) END AS recipient, event_type AS topic FROM events),
 t AS (SELECT * FROM (VALUES ('click', 'p1'), ('click', 'p2'), ('error', 'p0')) x(topic, agent)), a AS (SELECT DISTINCT sender AS agent FROM m)"""


@query(sql([ROUTED], "SELECT message_id, recipient AS agent FROM m WHERE recipient IS NOT NULL UNION ALL SELECT message_id, agent FROM m JOIN t USING (topic) WHERE recipient IS NULL AND agent <> sender UNION ALL SELECT message_id, agent FROM m, a WHERE recipient IS NULL AND topic NOT IN (SELECT topic FROM t) AND agent <> sender"))
def o267_route_messages(spark, sf):
    m = table(spark, sf, "events").selectExpr("event_id AS message_id", "concat('p', user_id % 7) AS sender", "CASE WHEN event_id % 3 = 0 THEN concat('p', event_id % 7) END AS recipient", "event_type AS topic")
    topics = spark.createDataFrame([("click", "p1"), ("click", "p2"), ("error", "p0")], "topic string, agent string")
    return flows.route_messages(m, topics, m.select(F.col("sender").alias("agent")).distinct())


@query(sql([USAGE], "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM usage GROUP BY ALL"))
def ext_tumbling_windows(spark, sf):
    return flows.windowed_counts(usage(spark, sf), "1 day").withColumn("total", F.round("total", 4))


@query(sql([USAGE, "l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM usage)", "g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)"], 'SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s'))
def ext_session_windows(spark, sf):
    return flows.sessions(usage(spark, sf), "6 hours")


@query(sql([MEMORIES], "SELECT id, sha256('{\"id\":' || id || ',\"lang\":\"' || lang || '\"}') AS hash FROM memories WHERE id % 2 = 0"))
def o09_chunk_hashes(spark, sf):
    rows = memories(spark, sf).select("id", "lang")
    hashed = rows.withColumn("hash", F.sha2(F.to_json(F.struct("id", "lang")), 256))
    return hashed.join(hashed.where("id % 2 = 1").select("hash"), "hash", "left_anti").select("id", "hash")


@query(sql(["f AS (SELECT doc_id AS id, '---' || chr(10) || 'memory_type: ' || CASE WHEN doc_id % 2 = 0 THEN 'analysis' ELSE 'task' END || chr(10) || 'project: x' || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'body ' || doc_id END AS value FROM documents)"], "SELECT id, CASE WHEN id % 2 = 0 THEN 'fact' ELSE 'task' END AS kind, 'body ' || id AS content, 'x' AS project FROM f WHERE id % 5 <> 0"))
def o10_import_markdown(spark, sf):
    files = table(spark, sf, "documents").selectExpr("doc_id AS id", r"concat('---\nmemory_type: ', CASE WHEN doc_id % 2 = 0 THEN 'analysis' ELSE 'task' END, '\nproject: x\n---\n', CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('body ', doc_id) END) AS value")
    return store.import_markdown(files).select("id", "kind", "content", F.col("header")["project"].alias("project"))
