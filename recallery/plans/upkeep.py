"""Queries: lifecycle, consistency, roll-ups, windows, store changes (O-01..O-06, O-110..O-160, O-200..O-233)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallery.functions import text as tx
from recallery.operators import lifecycle as lc
from recallery.operators import metrics as mt
from recallery.operators.windows import numbered
from recallery.sources import store

from .model import AS_OF, MEMORIES, TURNS, USAGE, WORDS, as_of, memories, sql, table, turns, usage
from .registry import query

DAYS = f"greatest(0, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch({{0}})) / 86400) AS BIGINT))"
TABLE = {i: "CASE priority " + " ".join(f"WHEN '{n}' THEN {float(v[i])!r}e0" for n, v in lc.PRIORITIES.items()) + " END" for i in range(5)}
QUALITY = f"""quality AS (SELECT *, least(1.0e0, least(1.0e0, access_count * 0.1e0) * 0.6e0 + ({TABLE[3]}) * 0.4e0) AS relevance,
 CASE WHEN verified THEN 1.0e0 ELSE CASE level WHEN 'belief' THEN 1.0e0 WHEN 'extracted' THEN 0.8e0 WHEN 'processed' THEN 0.7e0 ELSE 0.5e0 END END AS accuracy,
 CASE WHEN last_access IS NULL THEN 0.8e0 ELSE greatest(0.0e0, least(1.0e0, 1.0e0 - {DAYS.format('last_access')} / ({TABLE[1]}))) END AS freshness,
 (CASE WHEN typed_kind = 'fact' THEN 1 ELSE 0 END + 2 + CASE WHEN derived THEN 1 ELSE 0 END) / 4.0e0 AS completeness FROM memories),
 scored AS (SELECT *, 0.40e0 * relevance + 0.25e0 * accuracy + 0.20e0 * freshness + 0.15e0 * completeness AS overall FROM quality)"""


def _scored(spark, sf):
    return lc.memory_quality(memories(spark, sf), as_of())


def r6(name):
    return F.round(name, 6).alias(name)


@query(sql([MEMORIES, QUALITY], "SELECT id, round(relevance, 6) AS relevance, accuracy, round(freshness, 6) AS freshness, completeness, round(overall, 6) AS overall FROM scored"))
def o145_memory_quality(spark, sf):
    return _scored(spark, sf).select("id", r6("relevance"), "accuracy", r6("freshness"), "completeness", r6("overall"))


@query(sql([MEMORIES, QUALITY], f"SELECT id, round(CAST(1.0e0 * pow({TABLE[0]}, {DAYS.format('coalesce(last_access, created_at)')}) AS DOUBLE), 6) AS new_relevance FROM memories WHERE abs(1.0e0 - pow({TABLE[0]}, {DAYS.format('coalesce(last_access, created_at)')})) > 0.001"))
def o147_decay_memories(spark, sf):
    return lc.decay_memories(memories(spark, sf).withColumn("relevance", F.lit(1.0)), as_of()).select("id", r6("new_relevance"))


@query(sql([MEMORIES], f"SELECT min(id) AS id, count(*) AS copies FROM memories GROUP BY array_to_string({WORDS}, ' '), lang"))
def o148_consolidate_exact(spark, sf):
    m = memories(spark, sf).withColumns({"kind": F.col("lang"), "priority": F.lit("medium")})
    return lc.consolidate_exact(m)


@query(sql([MEMORIES], f"SELECT min(id) AS id, count(*) AS copies FROM memories GROUP BY strlen(array_to_string({WORDS}, ' ')), lang"))
def o148_consolidate_compat(spark, sf):
    m = memories(spark, sf).withColumns({"kind": F.col("lang"), "priority": F.lit("medium")})
    return lc.consolidate_exact(m, compat=True)


@query(sql([MEMORIES, QUALITY], "SELECT id, priority FROM (SELECT id, priority, overall - 0.4 AS overall FROM scored) WHERE overall < 0.25 AND CASE priority WHEN 'critical' THEN FALSE WHEN 'high' THEN overall < 0.1 ELSE TRUE END"))
def o149_evict_low_quality(spark, sf):
    return lc.evict_low_quality(_scored(spark, sf).withColumn("overall", F.col("overall") - 0.4)).select("id", "priority")


@query(sql([MEMORIES], "SELECT id, md5(substr(content, 1, 2028) || '...[compressed]') AS digest FROM memories WHERE strlen(content) > 2048"))
def o150_compress_large(spark, sf):
    return lc.compress_large(memories(spark, sf)).select("id", F.md5("content").alias("digest"))


@query(sql([MEMORIES, QUALITY], "SELECT count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS bytes, " + ", ".join(f"count(*) FILTER (priority = '{p}') AS p_{p}" for p in lc.PRIORITIES) + ", count(*) FILTER (overall >= 0.7) AS high_quality, count(*) FILTER (overall >= 0.4 AND overall < 0.7) AS medium_quality, count(*) FILTER (overall < 0.4) AS low_quality, count(*) FILTER (overall < 0.25) AS evictable FROM scored"))
def o110_memory_stats(spark, sf):
    return mt.memory_stats(_scored(spark, sf).withColumn("overall", F.round("overall", 12)))


@query(sql([MEMORIES, QUALITY], f"""SELECT id, round(CAST(greatest(0.0e0, least(1.0e0, 0.35e0 * (1.0e0 - exp(-access_count / 4.0e0)) + 0.25e0 * CASE WHEN last_access IS NULL THEN 0.45e0 ELSE 1.0e0 / (1.0e0 + {DAYS.format('last_access')} / 14.0e0) END
 + 0.20e0 * (1.0e0 / (1.0e0 + {DAYS.format('created_at')} / 60.0e0)) + 0.20e0 * ({TABLE[4]}))) AS DOUBLE), 6) AS importance FROM memories"""))
def o156_importance(spark, sf):
    score = lc.importance_score(F.col("access_count"), F.col("last_access"), F.col("created_at"), F.col("priority"), as_of())
    return memories(spark, sf).select("id", F.round(score, 6).alias("importance"))


@query(sql([MEMORIES, f"a AS (SELECT id, last_access, greatest(0.0e0, epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(last_access, created_at))) / 86400.0e0 AS age FROM memories)"], f"SELECT id, round(CAST(0.8e0 * pow(0.95e0, age / 7.0e0) / (1.0e0 + age / 20.0e0) / CASE WHEN last_access IS NULL THEN 1.0e0 ELSE 1.0e0 + {DAYS.format('last_access')} / 30.0e0 END AS DOUBLE), 6) AS importance FROM a"))
def o157_decay_importance(spark, sf):
    score = lc.decay_importance(F.lit(0.8), F.col("last_access"), F.col("created_at"), 0.95, as_of())
    return memories(spark, sf).select("id", F.round(score, 6).alias("importance"))


@query(sql([MEMORIES, f"t AS (SELECT id, array_to_string(list_slice({WORDS}, 1, 10), ' ') AS signature, CAST({' OR '.join('contains(lower(content), ' + chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) + ')' for w in lc.NEGATIONS)} AS INT) AS negative FROM memories)"], "SELECT signature, count(*) AS members, min(id) AS first_id, 0.8e0 AS severity FROM t WHERE signature <> '' GROUP BY signature HAVING count(*) > 1 AND min(negative) < max(negative)"))
def o140_factual_conflicts(spark, sf):
    return lc.factual_conflicts(memories(spark, sf))


@query("SELECT doc_id AS id, 0.7e0 AS severity FROM documents WHERE FALSE")
def o141_entity_conflicts(spark, sf):
    return lc.entity_conflicts(memories(spark, sf))


@query(
    sql([MEMORIES, f"k AS (SELECT id, list_distinct({WORDS}) AS w, lower(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key FROM memories)",
         "f AS (SELECT key, min(id) AS first_id FROM k GROUP BY key HAVING count(*) > 1)",
         "j AS (SELECT f.first_id, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS near FROM f JOIN k a ON a.id = f.first_id JOIN k b ON b.key = f.key AND b.id <> f.first_id)"],
        "SELECT first_id, round(1.0e0 - min(near), 6) AS severity FROM j GROUP BY first_id HAVING min(near) < 0.7")
)
def o142_duplicate_inconsistencies(spark, sf):
    return lc.duplicate_inconsistencies(memories(spark, sf)).select("first_id", r6("severity"))


@query(sql([TURNS, "m AS (SELECT session_id || ':' || turn AS id, lower(content) AS t FROM turns)", "k AS (SELECT id, CASE WHEN contains(t, 'the') THEN 'yesterday' WHEN contains(t, 'and') THEN 'tomorrow' END AS marker FROM m)"], "SELECT id, (SELECT count(*) FROM k WHERE marker = 'tomorrow') AS pairs FROM k WHERE marker = 'yesterday' AND (SELECT count(*) FROM k WHERE marker = 'tomorrow') > 0"))
def o143_temporal_contradictions(spark, sf):
    # the test texts hold no such words: common ones stand for them
    t = F.lower("content")
    words = F.when(t.contains("the"), "yesterday").when(t.contains("and"), "tomorrow").otherwise("")
    return lc.temporal_contradictions(turns(spark, sf).select(F.concat_ws(":", "session_id", "turn").alias("id"), words.alias("content")))


DRIFT = "e AS (SELECT event_id AS id, event_type || (user_id % 50) AS name, CAST(floor(value) AS BIGINT) AS occurrences, (user_id % 100) / 100.0e0 AS trust, ts AS seen_at FROM events)"


@query(sql([USAGE, "w AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN k % 5 >= 2 THEN 1 ELSE 0 END DESC, ts DESC, ts DESC, event_id) AS place FROM usage)"], "SELECT provider, event_id FROM w WHERE place > 100"))
def o159_working_set_eviction(spark, sf):
    rows = usage(spark, sf).select(F.col("provider").alias("session"), F.col("event_id").alias("id"), (F.col("k") % 5).alias("access_count"), F.col("ts").alias("last_accessed"), F.col("ts").alias("created_at"))
    return lc.working_set_eviction(rows).select(F.col("session").alias("provider"), F.col("id").alias("event_id"))


@query(sql([USAGE], "SELECT provider, event_id FROM usage QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id) <= 50"))
def o160_episodic_retention(spark, sf):
    rows = usage(spark, sf).withColumnRenamed("event_id", "id")
    return lc.newest_per_group(rows, "provider", "ts", 50).select("provider", F.col("id").alias("event_id"))


WEEKS = (("hour", 3600), ("day", 86400), ("week", 7 * 86400), ("month", 30 * 86400))
AT = "2024-01-30 12:00:00"


@query(sql([USAGE], "SELECT provider, " + ", ".join(f"CAST(sum(CASE WHEN epoch(ts) > epoch(TIMESTAMP '{AT}') - {s} THEN tokens ELSE 0 END) AS BIGINT) AS tokens_{n}, count(*) FILTER (epoch(ts) > epoch(TIMESTAMP '{AT}') - {s}) AS requests_{n}" for n, s in WEEKS) + ", count(*) FILTER (is_error) AS errors FROM usage GROUP BY provider"))
def o115_rate_limit_status(spark, sf):
    return mt.rate_limit_status(usage(spark, sf), F.lit(AT).cast("timestamp"))


@query(sql([USAGE], f"SELECT provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, min(ts) AS first_at, max(ts) AS last_at FROM usage WHERE epoch(ts) > epoch(TIMESTAMP '{AT}') - 86400 GROUP BY provider"))
def o116_daily_summary(spark, sf):
    return mt.daily_summary(usage(spark, sf), F.lit(AT).cast("timestamp"))


@query(sql([USAGE, f"w AS (SELECT provider, sum(tokens) AS used FROM usage WHERE epoch(ts) > epoch(TIMESTAMP '{AT}') - 7 * 86400 GROUP BY provider)", "q AS (SELECT * FROM (VALUES ('p0', 1000), ('p1', 0), ('p2', 100000000)) t(provider, weekly_quota))"], "SELECT provider, CAST(used AS BIGINT) AS used, CASE WHEN coalesce(weekly_quota, 1000000) = 0 THEN FALSE ELSE used / coalesce(weekly_quota, 1000000) > 0.9 END AS low FROM w LEFT JOIN q USING (provider)"))
def o117_quota_low(spark, sf):
    quotas = spark.createDataFrame([("p0", 1000), ("p1", 0), ("p2", 100000000)], "provider string, weekly_quota long")
    return mt.quota_low(usage(spark, sf), quotas, F.lit(AT).cast("timestamp"))


@query(sql([USAGE], "SELECT DISTINCT provider FROM usage"))
def o118_distinct_providers(spark, sf):
    return usage(spark, sf).select("provider").distinct()


@query("SELECT c.category, count(*) AS requests, CAST(sum(units) AS BIGINT) AS units FROM events JOIN (VALUES ('view', 'read', 1), ('click', 'search', 2), ('purchase', 'write', 5), ('error', 'admin', 10)) c(event_type, category, units) USING (event_type) GROUP BY ALL")
def o119_usage_metering(spark, sf):
    weights = spark.createDataFrame([("view", "read", 1), ("click", "search", 2), ("purchase", "write", 5), ("error", "admin", 10)], "event_type string, category string, units long")
    return mt.usage_metering(table(spark, sf, "events"), weights)


@query("SELECT name, count(*) AS n FROM (SELECT unnest(['total', 'status:' || o_orderstatus, 'priority:' || o_orderpriority]) AS name FROM orders) GROUP BY ALL")
def o121_task_stats(spark, sf):
    return mt.task_stats(table(spark, sf, "orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS priority"))


@query(sql([TURNS, "s AS (SELECT session_id, count(*) AS turns, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS w FROM turns GROUP BY ALL)"], "SELECT count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS events, round(avg(turns), 6) AS average_turns, CAST(sum(w) AS BIGINT) AS with_system FROM s"))
def o123_session_stats(spark, sf):
    return mt.session_stats(turns(spark, sf)).withColumn("average_turns", F.round("average_turns", 6))


@query(sql([USAGE], "SELECT provider, round(avg(greatest(0.0e0, least(1.0e0, k / 50.0e0))), 6) AS sentiment FROM usage GROUP BY provider"))
def o124_average_sentiment(spark, sf):
    # a provider's values as an array of moderate size: per user first, as arrays of whole groups do not scale
    each = usage(spark, sf).groupBy("provider", "user_id").agg(F.collect_list(F.col("k") / 50.0).alias("v"))
    weighted = each.select("provider", (mt.average_sentiment(F.col("v")) * F.size("v")).alias("total"), F.size("v").alias("n"))
    return weighted.groupBy("provider").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("sentiment"))


@query(sql([MEMORIES], "SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(content), '[^a-z0-9]+')) AS token FROM memories) WHERE length(token) >= 4 GROUP BY token HAVING count(*) > 1 ORDER BY n DESC, token LIMIT 5"))
def o128_themes(spark, sf):
    return mt.themes(memories(spark, sf))


@query(
    sql(["p AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(d.text), '[^a-z0-9]+'), lambda w: w <> '') AS p, list_filter(string_split_regex(lower(b.text), '[^a-z0-9]+'), lambda w: w <> '') AS e FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)",
         "u AS (SELECT id, unnest(p) AS w, 1 AS a, 0 AS b FROM p UNION ALL SELECT id, unnest(e), 0, 1 FROM p)", "m AS (SELECT id, sum(n) AS common FROM (SELECT id, w, least(sum(a), sum(b)) AS n FROM u GROUP BY id, w) GROUP BY id)", "c AS (SELECT p.id, p, e, coalesce(common, 0) AS common FROM p LEFT JOIN m USING (id))"],
        "SELECT id, array_to_string(p, ' ') = array_to_string(e, ' ') AS exact, round(CASE WHEN common > 0 THEN 2.0e0 * common / (len(p) + len(e)) ELSE 0.0e0 END, 6) AS f1 FROM c")
)
def o130_token_f1(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS predicted", "doc_id % 40 AS item_id")
    b = table(spark, sf, "benchmark").selectExpr("item_id", "text AS expected")
    return mt.token_f1(d.join(b, "item_id")).select("id", "exact", r6("f1"))


PATTERNS = "patterns AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'manual' END AS verification, (o_orderkey % 100) / 100.0e0 AS confidence, o_orderkey % 10 AS usage_count, o_orderdate AS created_at FROM orders)"


def _patterns(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'manual' END AS verification", "(o_orderkey % 100) / 100.0D AS confidence", "o_orderkey % 10 AS usage_count", "cast(o_orderdate AS timestamp) AS created_at")


@query(sql([PATTERNS], f"SELECT id, round(CASE WHEN verification = 'pending' AND {DAYS.format('created_at')} > 30 THEN greatest(0.0e0, confidence - 0.1e0) ELSE confidence END, 6) AS confidence FROM patterns"))
def o131_pattern_decay(spark, sf):
    return mt.pattern_decay(_patterns(spark, sf), as_of()).select("id", r6("confidence"))


@query(sql([PATTERNS], "SELECT CASE WHEN usage_count + 1 >= 5 AND confidence >= 0.7e0 THEN 'auto_verified' ELSE 'pending' END AS verification, count(*) AS n FROM patterns GROUP BY ALL"))
def o132_pattern_auto_verify(spark, sf):
    return mt.pattern_auto_verify(_patterns(spark, sf)).groupBy("verification").agg(F.count("*").alias("n"))


@query(sql([PATTERNS], "SELECT id, confidence FROM patterns WHERE verification = 'pending' AND confidence >= 0.5 ORDER BY confidence DESC, usage_count DESC, id LIMIT 50"))
def o29_pattern_query(spark, sf):
    return _patterns(spark, sf).where("verification = 'pending' AND confidence >= 0.5D").orderBy(F.desc("confidence"), F.desc("usage_count"), "id").limit(50).select("id", "confidence")


@query(sql([USAGE], f"SELECT event_id, ts FROM usage WHERE provider = 'p3' AND ts > TIMESTAMP '{AT}' - INTERVAL 2 DAY"))
def o30_timeline_since(spark, sf):
    return usage(spark, sf).where(f"provider = 'p3' AND ts > timestamp'{AT}' - INTERVAL 2 DAYS").select("event_id", "ts").orderBy("ts", "event_id")


@query(sql([USAGE], "SELECT event_id, provider, row_number() OVER (PARTITION BY provider ORDER BY ts, event_id) AS sequence FROM usage"))
def o135_backfill_sequence(spark, sf):
    return numbered(usage(spark, sf).select("event_id", "provider", "ts"), "provider", ["ts", "event_id"], "sequence").drop("ts")


@query(sql([USAGE], "SELECT event_id, coalesce(lag(sha256(event_type || k)) OVER (PARTITION BY provider ORDER BY ts, event_id), '') AS prev, sha256(event_type || k) AS curr FROM usage"))
def o137_content_chain(spark, sf):
    w = Window.partitionBy("provider").orderBy("ts", "event_id")
    h = F.sha2(F.concat("event_type", "k"), 256)
    return usage(spark, sf).select("event_id", F.coalesce(F.lag(h).over(w), F.lit("")).alias("prev"), h.alias("curr"))


@query(
    sql([USAGE, "e AS (SELECT provider AS workspace_id, row_number() OVER (PARTITION BY provider ORDER BY ts, event_id) AS sequence, event_type AS payload, user_id AS memory_id FROM usage)",
         "RECURSIVE_PLACEHOLDER"], "")
    .replace("WITH", "WITH RECURSIVE", 1)
    .replace("RECURSIVE_PLACEHOLDER", "c AS (SELECT workspace_id, sequence, '' AS prev_hash, sha256('|' || sequence || '|' || memory_id || '|' || payload) AS curr_hash FROM e WHERE sequence = 1 UNION ALL SELECT e.workspace_id, e.sequence, c.curr_hash, sha256(c.curr_hash || '|' || e.sequence || '|' || e.memory_id || '|' || e.payload) FROM c JOIN e ON e.workspace_id = c.workspace_id AND e.sequence = c.sequence + 1)")
    + " SELECT workspace_id, sequence, curr_hash, TRUE AS valid FROM c"
)
def o136_hash_chain(spark, sf):
    w = Window.partitionBy("provider").orderBy("ts", "event_id")
    e = usage(spark, sf).select(F.col("provider").alias("workspace_id"), F.row_number().over(w).cast("long").alias("sequence"), F.col("event_type").alias("payload"), F.col("user_id").alias("memory_id"))
    return store.hash_chain_valid(store.build_hash_chain(e)).select("workspace_id", "sequence", "curr_hash", "valid")


@query(
    sql([MEMORIES, "x AS (SELECT id, created_at AS updated_at, lang AS v FROM memories UNION ALL SELECT id, created_at + INTERVAL 1 DAY, 'new' FROM memories WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, created_at, 'added' FROM memories WHERE id % 10 = 0)"],
        "SELECT id, v FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1")
)
def o03_upsert(spark, sf):
    m = memories(spark, sf)
    old = m.selectExpr("id", "created_at AS updated_at", "lang AS v")
    new = m.where("id % 3 = 0").selectExpr("id", "created_at + INTERVAL 1 DAY AS updated_at", "'new' AS v").union(m.where("id % 10 = 0").selectExpr("id + 1000000 AS id", "created_at AS updated_at", "'added' AS v"))
    return store.upsert(old, new).select("id", "v")


@query(sql([MEMORIES], "SELECT id, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS kept FROM memories"))
def o04_revise(spark, sf):
    old = memories(spark, sf).select("id", "content", F.col("created_at").alias("updated_at"), F.lit(1).alias("revision")).withColumn("revisions", F.expr("filter(array(struct(revision, updated_at AS recorded_at, content)), x -> false)"))
    new = old.where("id % 4 = 0").select("id", F.concat("content", F.lit("!")).alias("content"), F.expr("updated_at + INTERVAL 1 HOUR").alias("updated_at"))
    return store.revise(old, new).select("id", "revision", F.size("revisions").alias("kept"))


@query(sql([MEMORIES, "m AS (SELECT id, CASE WHEN id % 3 = 1 THEN id - 1 END AS parent_id FROM memories)", "g AS (SELECT id FROM m WHERE id % 9 = 0)"], "SELECT id FROM m WHERE id NOT IN (SELECT id FROM g) AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM g))"))
def o05_delete_cascade(spark, sf):
    m = memories(spark, sf).select("id", F.expr("CASE WHEN id % 3 = 1 THEN id - 1 END").alias("parent_id"))
    links = m.select(F.col("id").alias("memory_id"))
    return store.delete_cascade(m, links, m.where("id % 9 = 0"))[0].select("id")


@query(sql([MEMORIES], "SELECT workspace_id, count(*) AS n FROM memories WHERE workspace_id = 'src3' GROUP BY ALL"))
def o01_scan_workspace(spark, sf):
    return memories(spark, sf).where("workspace_id = 'src3'").groupBy("workspace_id").agg(F.count("*").alias("n"))


@query(sql([MEMORIES], "SELECT id, path FROM memories WHERE path = 'src3/23'"))
def o02_get_by_id_or_path(spark, sf):
    return store.get_by_id_or_path(memories(spark, sf).select("id", "path"), "src3/23")


@query(sql([USAGE], f"SELECT event_id FROM usage WHERE ts + k * INTERVAL 1 HOUR > TIMESTAMP '{AT}'"))
def o06_live_tokens(spark, sf):
    t = usage(spark, sf).select("event_id", F.expr("ts + make_interval(0, 0, 0, 0, k, 0, 0)").alias("expires_at"))
    return store.live_tokens(t, F.lit(AT).cast("timestamp")).select("event_id")


REDACTED = "content"
for _pattern, _mask in tx.REDACTIONS:
    REDACTED = f"regexp_replace({REDACTED}, '{_pattern}', '{_mask}', 'g')"


@query(sql([MEMORIES], f"SELECT id, md5({REDACTED}) AS digest, length({REDACTED}) AS n FROM memories"))
def o214_redact(spark, sf):
    m = memories(spark, sf).withColumn("out", tx.redact(F.col("content")))
    return m.select("id", F.md5("out").alias("digest"), F.length("out").alias("n"))


@query(sql([MEMORIES, "s AS (SELECT id, list_filter(list_transform(string_split_regex(content, '[.\\n!?]'), lambda s: trim(s, ' \n\t\r')), lambda s: s <> '') AS s FROM memories)"], "SELECT id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest FROM s"))
def o203_sentences(spark, sf):
    s = memories(spark, sf).select("id", tx.sentences(F.col("content")).alias("s"))
    return s.select("id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(sql([MEMORIES], "SELECT id, greatest(1, strlen(content) // 4) AS tokens, round(CASE WHEN strlen(content) > strlen(substr(content, 1, 400)) THEN 100.0e0 * (strlen(content) - strlen(substr(content, 1, 400))) / strlen(content) ELSE 0 END, 6) AS saved, CASE WHEN length(content) > 400 THEN 403 ELSE length(content) END AS n FROM memories"))
def o216_token_estimates(spark, sf):
    c = F.col("content")
    return memories(spark, sf).select("id", tx.estimate_tokens(c).alias("tokens"), F.round(tx.token_savings(c, F.substring(c, 1, 400)), 6).alias("saved"), F.length(tx.summary(c)).alias("n"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256('part' || chr(0) || p_name || chr(0) || p_brand) AS key FROM part")
def o215_slug_and_key(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), tx.stable_key("part", F.col("p_name"), F.col("p_brand")).alias("key"))


@query(
    sql(["c AS (SELECT p_partkey AS id, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM part)", "g AS (SELECT id, ch, count(*) / CAST(any_value(n) AS DOUBLE) AS p FROM c WHERE ch <> '' GROUP BY id, ch)"], "SELECT id, round(-sum(p * log2(p)), 6) AS entropy FROM g GROUP BY id")
)
def o230_entropy(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(tx.entropy(F.col("p_name")), 6).alias("entropy"))


@query("SELECT a.p_partkey AS id, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def o212_levenshtein(spark, sf):
    p = table(spark, sf, "part")
    b = p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("other"))
    return p.selectExpr("p_partkey AS id", "p_name").join(b, "id").select("id", F.levenshtein("p_name", "other").cast("long").alias("distance"))


@query(
    sql([MEMORIES, f"t AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 3)) AS w FROM memories)"], "SELECT a.id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0e0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END, 6) AS jaccard FROM t a JOIN t b ON b.id = a.id + 1")
)
def o213_jaccard(spark, sf):
    t = memories(spark, sf).select("id", F.array_distinct(tx.tokens3(F.col("content"))).alias("w"))
    other = t.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    return t.join(other, "id").select("id", F.round(tx.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))
