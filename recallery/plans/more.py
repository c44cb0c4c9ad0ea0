"""Queries: the remaining retrieval, graph, session and curation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.functions import time as tm
from recallery.operators import curation as cu
from recallery.operators import graph as gr
from recallery.operators import lexical, scan

from .model import BM25_DOCS, EDGES, MEMORIES, QUERY, TURNS, USAGE, VECTORS, edges, memories, sql, table, turns, usage, vectors
from .registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(sql([TURNS], "SELECT session_id, count(*) AS n FROM turns WHERE contains(content, 'the') OR role = 'system' GROUP BY ALL"))
def o27_search_sessions(spark, sf):
    return cu.search_sessions(turns(spark, sf), "the").groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND len(list_intersect([substr(o_orderpriority, 1, 1), 'k' || (o_orderkey % 5)], ['1', 'k3'])) > 0")
def o28_task_filter(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "array(substring(o_orderpriority, 1, 1), concat('k', o_orderkey % 5)) AS labels")
    return cu.task_filter(t, {"status": "O"}, ["1", "k3"]).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), 'mach')")
def o32_search_entities(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "array(c_mktsegment) AS aliases")
    return cu.search_entities(c, "#00000001").union(cu.search_entities(c, "MACH")).select("id").distinct()


@query(sql([MEMORIES, "l AS (SELECT id AS memory_id, 'e' || (id % 20) AS entity_id FROM memories)", "e AS (SELECT 'e' || n_nationkey AS entity_id, n_name AS name FROM nation)"], "SELECT name, count(*) AS memories FROM memories m JOIN l ON l.memory_id = m.id JOIN e USING (entity_id) GROUP BY name"))
def o43_memories_by_entity(spark, sf):
    links = memories(spark, sf).selectExpr("id AS memory_id", "concat('e', id % 20) AS entity_id")
    names = table(spark, sf, "nation").selectExpr("concat('e', n_nationkey) AS entity_id", "n_name AS name")
    return cu.bridge(memories(spark, sf).select("id"), links, names).groupBy("name").agg(F.count("*").alias("memories"))


@query("SELECT t.term, n_nationkey AS id FROM (SELECT unnest(['nation_1', 'nation_2', 'zz']) AS term) t JOIN nation ON contains(lower(n_name), t.term) QUALIFY row_number() OVER (PARTITION BY term ORDER BY n_nationkey DESC) <= 3")
def o46_terms_to_entities(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_nationkey AS created_at")
    return cu.terms_to_entities(n, ["nation_1", "nation_2", "zz"], 3)


@query(sql(["src AS (SELECT p_partkey AS id, p_name || '(' || p_brand || ')' AS body, 'f' || (p_partkey % 40) AS name FROM part)", "c AS (SELECT id, unnest(regexp_extract_all('f' || (id % 7) || '(x) ' || body, '(\\w+)\\(', 1)) AS callee FROM src)"], "SELECT DISTINCT c.id AS caller, s.id AS callee FROM c JOIN src s ON s.name = c.callee WHERE c.id <> s.id"))
def o48_call_edges(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat('f', p_partkey % 7, '(x) ', p_name, '(', p_brand, ')') AS body", "concat('f', p_partkey % 40) AS name")
    return cu.call_edges(s)


@query(sql([MEMORIES, "s AS (SELECT id, id // 8 AS cluster, id % 7 AS quality, unnest(list_transform(string_split_regex(content, '[.\\n!?]'), lambda s: trim(s, ' \n\t\r'))) AS sentence FROM memories)", "k AS (SELECT DISTINCT cluster, array_to_string(list_filter(string_split_regex(lower(sentence), '\\s+'), lambda w: w <> ''), ' ') AS key FROM s WHERE sentence <> '')", "b AS (SELECT DISTINCT ON (id // 8) id // 8 AS cluster, id FROM memories ORDER BY id // 8, id % 7 DESC, id)"], "SELECT cluster, any_value(b.id) AS id, count(*) AS sentences FROM k JOIN b USING (cluster) GROUP BY cluster"))
def o155_merge_documents(spark, sf):
    from recallery.operators import lifecycle as lc

    m = memories(spark, sf).select("id", F.floor(F.col("id") / 8).alias("cluster"), (F.col("id") % 7).alias("quality"), "content")
    return lc.merge_documents(m).groupBy("cluster").agg(F.min("id").alias("id"), F.count("*").alias("sentences"))


@query(sql([MEMORIES, "t AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS nth FROM (SELECT id, regexp_extract_all(content, '[A-Za-z0-9][A-Za-z0-9._:/#-]+') AS ts FROM memories))", "f AS (SELECT id, min_by(t, nth) AS t FROM t GROUP BY id, lower(t))", "p AS (SELECT DISTINCT id, unnest(string_split_regex(lower(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS p FROM f)"], "SELECT id, count(*) AS tokens, md5(string_agg(p, ' ' ORDER BY p)) AS digest FROM p WHERE length(p) > 1 GROUP BY id"))
def o65_code_tokens(spark, sf):
    t = lexical.document_code_tokens(memories(spark, sf))
    return t.groupBy("id").agg(F.count("*").alias("tokens"), F.md5(F.array_join(F.array_sort(F.collect_list("token")), " ")).alias("digest"))


@query(sql([MEMORIES, "l AS (SELECT id, list_distinct(list_filter(string_split(lower(content), ''), lambda c: regexp_matches(c, '^[\\p{L}\\p{N}]$'))) AS c FROM memories)"], "SELECT a.id, round(CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0 ELSE len(list_intersect(a.c, b.c)) / CAST(len(list_distinct(list_concat(a.c, b.c))) AS DOUBLE) END, 6) AS jaccard FROM l a JOIN l b ON b.id = a.id + 1"))
def o75_character_jaccard(spark, sf):
    m = memories(spark, sf).select("id", F.col("content").alias("c"))
    other = m.select((F.col("id") - 1).alias("id"), F.col("c").alias("d"))
    return m.join(other, "id").select("id", r6(lexical.character_jaccard(F.col("c"), F.col("d")), "jaccard"))


@query(sql([USAGE], "SELECT event_type, count(*) AS n, round(least(1.0e0, 0.3e0 + 0.3e0 * log2(1.0e0 + count(*))), 6) AS trust, round(1 - 0.7e0 * pow(0.8e0, least(count(*), 30)), 6) AS confirmed FROM usage GROUP BY event_type"))
def o185_trust_scores(spark, sf):
    g = usage(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", "n", r6(gr.trust_score(F.col("n")), "trust"), r6(cu.confirmed_trust(F.lit(0.3), F.least(F.col("n"), F.lit(30))), "confirmed"))


@query(sql(["g AS (SELECT p_brand AS name, p_type AS entity_type, count(*) AS n FROM part GROUP BY ALL)"], "SELECT name, entity_type, n AS confirmations, round(least(1.0e0, 0.5e0 + 0.1e0 * (n - 1)), 6) AS weight FROM g"))
def o186_typed_graph_upsert(spark, sf):
    return cu.typed_upsert(table(spark, sf, "part").selectExpr("p_brand AS name", "p_type AS entity_type")).withColumn("weight", F.round("weight", 6))


@query(sql(["x AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' works at ' || p_brand WHEN 1 THEN 'a works at b works at c' ELSE p_name END AS t FROM part)"], "SELECT id, trim(string_split(t, ' works at ')[1]) AS person, trim(string_split(t, ' works at ')[2]) AS place FROM x WHERE len(string_split(t, ' works at ')) = 2"))
def o187_works_at(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' works at ', p_brand) WHEN 1 THEN 'a works at b works at c' ELSE p_name END AS t")
    return p.withColumn("w", gr.works_at(F.col("t"))).where("w IS NOT NULL").select("id", "w.person", "w.place")


@query(sql([EDGES], "SELECT count(*) AS n FROM (SELECT *, ['m' || (length(target) % 4), 'm' || (length(source) % 4)] AS provenance FROM edges) WHERE NOT list_contains(provenance, 'm2')"))
def o171_remove_memory(spark, sf):
    e = edges(spark, sf).withColumn("provenance", F.expr("array(concat('m', length(target) % 4), concat('m', length(source) % 4))"))
    return cu.without_memory(e, "m2").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, date_trunc('day', ts) - INTERVAL 1 DAY AS day, 'yesterday' AS phrase FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, date_trunc('day', ts) + INTERVAL 1 DAY, 'tomorrow' FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, date_trunc('day', ts) - INTERVAL 7 DAY, 'last week' FROM events WHERE event_id % 5 = 2")
def o222_relative_dates(spark, sf):
    e = usage(spark, sf).selectExpr("event_id AS id", "ts", "CASE event_id % 5 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'tomorrow' WHEN 2 THEN 'last week' END AS phrase")
    return e.where("phrase IS NOT NULL").select("id", tm.relative_date(F.col("phrase"), F.col("ts")).cast("timestamp_ntz").alias("day"), "phrase")


@query("SELECT id, CASE WHEN regexp_matches(t, '^\\d{4}$') THEN 'year' WHEN regexp_matches(t, '^\\d{4}-\\d{2}$') THEN 'month' WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'day' ELSE 'unknown' END AS granularity FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2024-01' WHEN 2 THEN '2024-01-05' ELSE 'soon' END AS t FROM events)")
def o223_date_granularity(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", "CASE event_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2024-01' WHEN 2 THEN '2024-01-05' ELSE 'soon' END AS t")
    return e.select("id", tm.granularity(F.col("t")).alias("granularity"))


@query("SELECT event_id AS id, ts + (user_id % 5 + 1) * INTERVAL 1 HOUR AS next_run, ts + (user_id % 5 + 1) * INTERVAL 1 HOUR < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AS missed FROM events ORDER BY next_run, id LIMIT 200")
def o270_missed_jobs(spark, sf):
    jobs = table(spark, sf, "events").selectExpr("event_id AS id", "ts + make_interval(0, 0, 0, 0, cast(user_id % 5 + 1 AS int), 0, 0) AS next_run")
    return tm.missed_jobs(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 3600).orderBy("next_run", "id").limit(200)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def o271_task_queue(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").selectExpr("o_orderkey AS id", "o_orderpriority AS priority").orderBy("priority", "id").limit(100)


@query(sql([MEMORIES], "SELECT id FROM memories WHERE lang = 'en' AND len(list_intersect([level, priority], ['raw', 'high'])) > 0 AND contains(lower(content), 'thing') ORDER BY created_at DESC, id LIMIT 20"))
def o280_search_fragments(spark, sf):
    m = memories(spark, sf).where(F.lower("content").contains("thing") & (F.col("lang") == "en")).withColumn("tags", F.array("level", "priority"))
    return m.where(F.arrays_overlap("tags", F.array(F.lit("raw"), F.lit("high")))).orderBy(F.desc("created_at"), "id").limit(20).select("id")


@query(sql([MEMORIES], "SELECT id FROM memories WHERE workspace_id = 'src2' ORDER BY created_at DESC, id LIMIT 15"))
def o281_recent_fragments(spark, sf):
    return memories(spark, sf).where("workspace_id = 'src2'").orderBy(F.desc("created_at"), "id").limit(15).select("id")


@query(sql([MEMORIES], "SELECT workspace_id, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS bytes, greatest(100000 - CAST(sum(strlen(content)) AS BIGINT), 0) AS remaining, sum(strlen(content)) > 100000 AS over FROM memories GROUP BY workspace_id"))
def o284_usage_snapshot(spark, sf):
    return cu.usage_snapshot(memories(spark, sf), 100000)


@query(sql([MEMORIES, "l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM memories)"], "SELECT id, CAST(line_no - 1 AS INT) AS line_no FROM l WHERE length(line) >= 20 AND (contains(lower(line), 'thing') OR contains(lower(line), 'that')) QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) <= 5"))
def o290_keyword_lines(spark, sf):
    return cu.keyword_lines(memories(spark, sf), ["thing", "that"], 5).select("id", F.col("at").alias("line_no"))


@query(sql([USAGE], "SELECT event_type, arg_max(event_id, ts) AS newest, round(epoch(max(ts)) - epoch(TIMESTAMP '2024-01-01'), 0) AS lag, CASE WHEN epoch(max(ts)) - epoch(TIMESTAMP '2024-01-01') < 86400 THEN 'ok' ELSE 'late' END AS status FROM usage GROUP BY event_type"))
def o129_sync_lag(spark, sf):
    u = usage(spark, sf)
    lag = F.max("ts").cast("double") - F.lit("2024-01-01 00:00:00").cast("timestamp").cast("double")
    return u.groupBy("event_type").agg(F.max_by("event_id", "ts").alias("newest"), F.round(lag, 0).alias("lag"), F.when(lag < 86400, "ok").otherwise("late").alias("status"))


@query(sql([VECTORS, "r AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT id FROM vectors WHERE label = 1 ORDER BY id LIMIT 6))", "s AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM (SELECT id FROM vectors WHERE label IN (1, 2) ORDER BY id DESC LIMIT 6))", "u AS (SELECT id, 'bm25' AS source, rank FROM r UNION ALL SELECT id, 'meta', rank FROM s)"], "SELECT id, round(sum(1.0e0 / (60 + rank)), 9) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM u GROUP BY id"))
def o95_context_fusion(spark, sf):
    from recallery.operators import fusion

    v = vectors(spark, sf)
    first = fusion.ranked(v.where("label = 1").select("id", (-F.col("id")).alias("score")), "bm25", 1.0, 6)
    second = fusion.ranked(v.where("label IN (1, 2)").select("id", F.col("id").alias("score")), "meta", 1.0, 6)
    return fusion.rrf([first, second]).select("id", F.round("score", 9).alias("score"), "sources")


@query()
def o154_greedy_clusters(spark, sf):
    v = vectors(spark, sf).withColumns({"batch": F.floor(F.col("id") / 32), "quality": (F.col("id") % 9) / 9.0})
    return cu.greedy_clusters(v, 0.88)


@query()
def o190_parse_symbols(spark, sf):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self, x):\n        if x and x > 1:\n            return 1\n\n\ndef g():\n    pass\n")], "path string, content string")
    return cu.parse_symbols(files)


@query()
def o188_call_chain(spark, sf):
    """Nodes that a chain reaches, with their depth; ``o188_call_chain_edges`` gives the edges of calls."""
    seeds = spark.createDataFrame([("c10",)], "node string")
    return gr.reachable(edges(spark, sf).where("NOT startswith(target, 'file:')"), seeds, 8)
