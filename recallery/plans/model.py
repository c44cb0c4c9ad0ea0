"""The engine's tables over the test data: memories, turns, usage, graph; each with its SQL twin as a CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.functions.rounds import spread

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory rows; kinds, priorities, levels and times are derived from the id."""
    start = "timestamp'2024-01-01 00:00:00'"
    return spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id AS id", "source AS workspace_id", "concat(source, '/', doc_id) AS path", "text AS content", "lang",
        f"{start} + make_interval(0, 0, 0, 0, 0, cast(doc_id AS int), 0) AS created_at",
        "element_at(array('critical', 'high', 'medium', 'low', 'ephemeral'), cast(doc_id % 5 AS int) + 1) AS priority",
        "element_at(array('raw', 'processed', 'extracted', 'belief'), cast(doc_id % 4 AS int) + 1) AS level",
        "doc_id % 13 AS access_count", "doc_id % 2 = 0 AS verified",
        f"CASE WHEN doc_id % 7 <> 0 THEN {start} + make_interval(0, 0, 0, cast(doc_id % 30 AS int), 0, 0, 0) END AS last_access",
        """concat('{', CASE WHEN doc_id % 3 = 0 THEN '"kind":"fact",' WHEN doc_id % 3 = 1 THEN '"memory_type":"decision",' ELSE '' END,
           '"namespace":{"project":"', lang, '","scope":"S', doc_id % 3, '"},"provenance":{"source_type":"Web","observed_at":"2024-01-', lpad(cast(doc_id % 28 + 1 AS string), 2, '0'), '"}',
           CASE WHEN doc_id % 11 = 0 THEN ',"source_path":"derived"' ELSE '' END, '}') AS metadata""",
    )


MEMORIES = """memories AS (SELECT doc_id AS id, source AS workspace_id, source || '/' || doc_id AS path, text AS content, lang,
 TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS created_at,
 (['critical','high','medium','low','ephemeral'])[doc_id % 5 + 1] AS priority, (['raw','processed','extracted','belief'])[doc_id % 4 + 1] AS level,
 doc_id % 13 AS access_count, doc_id % 2 = 0 AS verified,
 CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + (doc_id % 30) * INTERVAL 1 DAY END AS last_access,
 CASE doc_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' END AS typed_kind, 'S' || (doc_id % 3) AS scope,
 TIMESTAMP '2024-01-01' + (doc_id % 28) * INTERVAL 1 DAY AS observed_at, doc_id % 11 = 0 AS derived,
 '{' || CASE WHEN doc_id % 3 = 0 THEN '"kind":"fact",' WHEN doc_id % 3 = 1 THEN '"memory_type":"decision",' ELSE '' END ||
 '"namespace":{"project":"' || lang || '","scope":"S' || (doc_id % 3) || '"},"provenance":{"source_type":"Web","observed_at":"2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '"}' ||
 CASE WHEN doc_id % 11 = 0 THEN ',"source_path":"derived"' ELSE '' END || '}' AS metadata
 FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS string) AS session_id", "turn", "role", "text AS content")


TURNS = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content FROM conversations)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as use of providers."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('p', user_id % 7) AS provider", "cast(ts AS timestamp) AS ts", "cast(floor(value) AS bigint) AS tokens", "event_type = 'error' AS is_error", "event_type", "user_id", "event_id", "cast(get_json_object(props, '$.k') AS int) AS k", "value"
    )


USAGE = "usage AS (SELECT 'p' || (user_id % 7) AS provider, ts, CAST(floor(value) AS BIGINT) AS tokens, event_type = 'error' AS is_error, event_type, user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges: customer to nation, nation to region, supplier to nation."""
    c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS source", "concat('n', c_nationkey) AS target", "'lives_in' AS relation_type", "0.8D AS confidence")
    n = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS source", "concat('r', n_regionkey) AS target", "'part_of' AS relation_type", "0.9D AS confidence")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('n', s_nationkey) AS source", "concat('s', s_suppkey) AS target", "'hosts' AS relation_type", "0.6D AS confidence")
    return c.union(n).union(s)


EDGES = """edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives_in' AS relation_type, 0.8e0 AS confidence FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 0.9e0 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'hosts', 0.6e0 FROM supplier)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts of their lines."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) AS source", "concat('p', l_partkey) AS target").distinct()


PART_EDGES = "part_edges AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS node", "cast(p_size AS double) AS complexity", "p_name AS name", "p_type AS kind", "p_partkey AS id")


PARTS = "parts AS (SELECT 'p' || p_partkey AS node, CAST(p_size AS DOUBLE) AS complexity, p_name AS name, p_type AS kind, p_partkey AS id FROM part)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector", "label")


VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"
WORDS = r"list_filter(string_split_regex(lower(content), '\s+'), lambda w: w <> '')"


def sql(ctes: list[str], select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


QUERY = "the and token thing"
_PART = "ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0) + 1) * f{i} * 2.5e0 / (f{i} + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
BM25_DOCS = [
    f"counted AS (SELECT id, len({WORDS}) AS dl, " + ", ".join(f"len(list_filter({WORDS}, lambda w: w = '{t}')) AS f{i}, CAST(contains(lower(content), '{t}') AS INT) AS has{i}" for i, t in enumerate(QUERY.split())) + " FROM memories)",
    "stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"sum(has{i}) AS n{i}" for i in range(4)) + " FROM counted)",
    "bm25 AS (SELECT id, " + " + ".join(_PART.format(i=i) for i in range(4)) + " AS score FROM counted, stats)",
]
