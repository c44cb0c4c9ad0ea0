"""Queries: further rows of the inventory that compose operators of the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.functions import metadata as md
from recallery.functions import text as tx
from recallery.operators import fusion, lexical, scan
from recallery.operators import graph as gr
from recallery.operators import lifecycle as lc
from recallery.sources import store

from .model import AS_OF, BM25_DOCS, EDGES, MEMORIES, PARTS, QUERY, TURNS, USAGE, VECTORS, WORDS, as_of, edges, memories, parts, sql, table, turns, usage, vectors
from .registry import query
from .upkeep import DAYS, QUALITY


@query()
def o07_scan_files(spark, sf):
    """Files below the data folder by name; their contents are not read."""
    return store.scan_files(spark, sf, "*.parquet", ["_temporary"]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


@query("SELECT o.o_orderkey AS id, count(DISTINCT l.l_partkey) AS symbols FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY ALL")
def o14_changed_symbols(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return o.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey"), "id").groupBy("id").agg(F.countDistinct("l_partkey").alias("symbols"))


@query(sql([MEMORIES], "SELECT id, lang AS ns_project, coalesce(typed_kind, 'document') AS kind FROM memories WHERE NOT contains(path, '.')"))
def o21_normalize_metadata(spark, sf):
    m = md.normalize_metadata(memories(spark, sf))
    return m.select("id", F.get_json_object("metadata", "$.ns_project").alias("ns_project"), F.get_json_object("metadata", "$.kind").alias("kind"))


@query(sql([MEMORIES], "SELECT id FROM memories WHERE observed_at >= TIMESTAMP '2024-01-10' AND observed_at <= TIMESTAMP '2024-01-12'"))
def o23_time_window(spark, sf):
    return md.resolve_metadata(memories(spark, sf)).where(md.in_window(F.col("observed_at"), "2024-01-10", "2024-01-12")).select("id")


@query(sql([MEMORIES, VECTORS], "SELECT m.id, label, lang FROM memories m JOIN vectors v ON v.id = m.id WHERE label < 3"))
def o40_hits_with_records(spark, sf):
    hits = vectors(spark, sf).where("label < 3").select("id", "label")
    return memories(spark, sf).select("id", "lang").join(hits, "id")


@query(sql([MEMORIES, "t AS (SELECT id, unnest(regexp_extract_all(content, '[A-Za-z0-9][A-Za-z0-9._:/#-]+')) AS t FROM memories)"], "SELECT id, count(DISTINCT lower(t)) AS tokens FROM t GROUP BY id"))
def o64_search_tokens(spark, sf):
    return lexical.document_tokens(memories(spark, sf)).groupBy("id").agg(F.count("*").alias("tokens"))


@query(sql([MEMORIES, *BM25_DOCS, "k AS (SELECT id, access_count * 1.0e0 AS score FROM memories)", "a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM bm25 WHERE score > 0 ORDER BY score DESC, id LIMIT 20))", "b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM k ORDER BY score DESC, id LIMIT 20))"], "SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 0.7e0 / (60 + rank) AS s FROM a UNION ALL SELECT id, 0.3e0 / (60 + rank) FROM b) GROUP BY id"))
def o94_weighted_fusion(spark, sf):
    m = memories(spark, sf)
    lists = [fusion.ranked(lexical.bm25_documents(m, QUERY), "keyword", 0.7, 20), fusion.ranked(m.select("id", F.col("access_count").cast("double").alias("score")), "other", 0.3, 20)]
    return fusion.rrf(lists).select("id", F.round("score", 9).alias("score"))


@query(sql([USAGE], "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'error' THEN 'error' ELSE 'write' END AS route, count(*) AS calls, count(*) FILTER (k % 2 = 0) AS hits FROM usage GROUP BY ALL"))
def o120_routing_metrics(spark, sf):
    route = F.when(F.col("event_type").isin("view", "click"), "read").when(F.col("event_type") == "error", "error").otherwise("write")
    return usage(spark, sf).groupBy(route.alias("route")).agg(F.count("*").alias("calls"), F.count_if(F.col("k") % 2 == 0).alias("hits"))


@query(sql([MEMORIES], "SELECT count(*) AS items, CAST(sum(access_count) AS BIGINT) AS accesses, round(avg(access_count), 6) AS average, count(*) FILTER (access_count < 2) AS candidates FROM memories"))
def o122_working_stats(spark, sf):
    return memories(spark, sf).agg(F.count("*").alias("items"), F.sum("access_count").alias("accesses"), F.round(F.avg("access_count"), 6).alias("average"), F.count_if(F.col("access_count") < 2).alias("candidates"))


@query(sql(["g AS (SELECT p_brand AS name, split_part(p_type, ' ', 1) AS entity_type, count(*) AS n FROM part GROUP BY ALL)", "t AS (SELECT *, least(1.0e0, 0.3e0 + 0.3e0 * log2(1.0e0 + n)) AS trust FROM g)"], "SELECT entity_type, count(*) AS entities, round(avg(trust), 6) AS trust, count(*) FILTER (trust > 0.7) AS trusted FROM t GROUP BY ALL"))
def o125_entity_graph_stats(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("entity_type")).agg(F.count("*").alias("n"))
    t = g.withColumn("trust", gr.trust_score(F.col("n")))
    return t.groupBy("entity_type").agg(F.count("*").alias("entities"), F.round(F.avg("trust"), 6).alias("trust"), F.count_if(F.col("trust") > 0.7).alias("trusted"))


@query(sql([MEMORIES], "SELECT id, round(least(1.0e0, (access_count / 12.0e0) * 1.2e0), 6) AS promoted, round((access_count / 12.0e0) * 0.8e0, 6) AS demoted FROM memories"))
def o152_promote_demote(spark, sf):
    r = F.col("access_count") / 12.0
    return memories(spark, sf).select("id", F.round(lc.promoted(r), 6).alias("promoted"), F.round(lc.demoted(r), 6).alias("demoted"))


@query("SELECT trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS name, count(*) AS n FROM part GROUP BY ALL")
def o169_normalize_name(spark, sf):
    return table(spark, sf, "part").groupBy(gr.normalize_name(F.concat_ws(" & ", "p_name", "p_brand")).alias("name")).agg(F.count("*").alias("n"))


@query(sql([MEMORIES], f"SELECT id, array_to_string(list_slice(list_sort(list_distinct(list_filter(list_transform({WORDS}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 3))), 1, 50), ' ') AS keywords FROM memories"))
def o204_keywords(spark, sf):
    return memories(spark, sf).select("id", F.array_join(tx.keywords(F.col("content")), " ").alias("keywords"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-05 10:20:30' WHEN 1 THEN TIMESTAMP '2024-01-05' END AS t FROM events")
def o220_parse_time(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", "CASE event_id % 3 WHEN 0 THEN '2024-01-05T10:20:30' WHEN 1 THEN '2024-01-05' ELSE 'soon' END AS s")
    return e.select("id", tx.parse_time(F.col("s")).alias("t"))


@query(sql([MEMORIES], f"SELECT id, {DAYS.format('created_at')} AS days FROM memories"))
def o224_age_days(spark, sf):
    return memories(spark, sf).select("id", tx.age_days(F.col("created_at"), as_of()).alias("days"))


@query(sql([TURNS, f"w AS (SELECT session_id, turn, {WORDS} AS w FROM turns)"], "SELECT session_id, turn, greatest(len(w) - 1, 0) AS n, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] END AS first_pair FROM w"))
def o233_bigrams(spark, sf):
    b = turns(spark, sf).select("session_id", "turn", tx.bigrams(tx.words(F.col("content"))).alias("b"))
    return b.select("session_id", "turn", F.size("b").cast("long").alias("n"), F.try_element_at("b", F.lit(1)).alias("first_pair"))


@query(sql([USAGE], f"SELECT event_id FROM usage WHERE epoch(ts) > epoch(TIMESTAMP '{AS_OF}') - 3 * 86400"))
def o265_ttl(spark, sf):
    return usage(spark, sf).where(F.col("ts").cast("double") > as_of().cast("double") - 3 * 86400).select("event_id")


@query(sql([PARTS], "SELECT id, name, kind FROM parts WHERE (contains(lower(name), '12') OR contains(lower(kind), 'brass')) ORDER BY name, id LIMIT 100"))
def o282_code_find(spark, sf):
    hit = F.lower("name").contains("12") | F.lower("kind").contains("brass")
    return parts(spark, sf).where(hit).orderBy("name", "id").limit(100).select("id", "name", "kind")


@query(
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE WHEN 1 THEN CASE WHEN ts < date_trunc('day', ts) + INTERVAL 9 HOUR THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE date_trunc('day', ts) + INTERVAL 33 HOUR END
     WHEN 2 THEN date_trunc('month', ts) + INTERVAL 1 MONTH + INTERVAL 30 SECOND END AS next_run FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) WHERE NOT (event_id % 4 = 2 AND ts < date_trunc('month', ts) + INTERVAL 30 SECOND)"""
)
def o225_next_runs(spark, sf):
    from recallery.functions import time as tm

    schedule = F.expr("CASE event_id % 4 WHEN 0 THEN '0 */15 * * * *' WHEN 1 THEN '0 0 9 * * *' WHEN 2 THEN '30 0 0 1 * *' ELSE 'whenever' END")
    jobs = usage(spark, sf).select("event_id", F.date_trunc("second", "ts").alias("last_run"), schedule.alias("schedule"))
    early = (F.col("event_id") % 4 == 2) & (F.col("last_run") < F.date_trunc("month", "last_run") + F.expr("INTERVAL 30 SECONDS"))
    return tm.with_next_run(jobs.where(~early)).select(F.col("event_id").alias("id"), "next_run")


@query("SELECT event_id AS id, event_type AS mode, CAST(user_id AS VARCHAR) AS owner, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS level FROM events")
def o235_merge_maps(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.create_map(F.lit("mode"), "event_type").alias("a"), F.create_map(F.lit("mode"), F.lit("z"), F.lit("owner"), F.col("user_id").cast("string")).alias("b"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("level"), F.lit("x"))).alias("c"))
    merged = md.merge_maps(md.merge_maps(md.merge_maps(F.col("a"), F.col("b")), F.col("c")), F.create_map(F.lit("level"), F.lit("y")))
    return e.select(F.col("event_id").alias("id"), *[merged[k].alias(k) for k in ("mode", "owner", "level")])
