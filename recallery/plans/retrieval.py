"""Queries: retrieval, filters, vectors, fusion (O-20..O-33, O-40..O-46, O-60..O-104)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallery.functions import metadata as md
from recallery.functions import text as tx
from recallery.operators import fusion, lexical, vector

from .model import AS_OF, BM25_DOCS, MEMORIES, QUERY, VECTORS, WORDS, as_of, memories, sql, vectors
from .registry import query

BM25 = ", ".join(BM25_DOCS)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(sql([MEMORIES, BM25], "SELECT id, round(score, 6) AS score FROM bm25 WHERE score > 0 ORDER BY bm25.score DESC, id LIMIT 10"))
def o60_bm25_documents(spark, sf):
    return rounded(lexical.bm25_documents(memories(spark, sf), QUERY).orderBy(F.desc("score"), "id").limit(10), "score")


@query(
    sql(
        [MEMORIES, "asked AS (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM benchmark)", f"docs AS (SELECT id, {WORDS} AS tokens FROM memories)",
         "stats AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0e0) AS avgdl FROM docs)", "post AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs)",
         "tf AS (SELECT term, id, count(*) AS f, any_value(dl) AS dl FROM post WHERE term IN (SELECT term FROM asked) GROUP BY ALL)", "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
         "part AS (SELECT tf.term, id, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS p FROM tf JOIN df USING (term), stats)",
         "scored AS (SELECT query_id, id, sum(p) AS score FROM asked JOIN part USING (term) WHERE term <> '' GROUP BY ALL)"],
        "SELECT query_id, id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5",
    )
)
def o61_bm25_batch(spark, sf):
    from pyspark.sql import Window

    asked = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    scored = lexical.bm25_batch(memories(spark, sf), asked).withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")
    return rounded(scored, "score")


@query(
    sql([MEMORIES, "a AS (SELECT avg(strlen(content)) AS avgdl FROM memories)", "s AS (SELECT id, access_count, " + " + ".join(
        f"((length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)}) * 2.5e0 / (((length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)}) + 1.5e0 * (0.25e0 + 0.75e0 * strlen(content) / avgdl))" for t in ("the", "thing")
    ) + " AS score FROM memories, a)"], "SELECT id, access_count, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 9) DESC, access_count DESC, id LIMIT 20")
)
def o62_bm25_working(spark, sf):
    scored = lexical.bm25_working(memories(spark, sf), "the thing")
    return rounded(scored.orderBy(F.desc(F.round("score", 9)), F.desc("access_count"), "id").limit(20), "score")


@query(sql([MEMORIES], f"SELECT id, len({WORDS}) AS words, length(array_to_string(list_sort(list_distinct(list_filter({WORDS}, lambda w: regexp_matches(w, '^[a-z]+$')))), ' ')) AS vocabulary FROM memories"))
def o200_words(spark, sf):
    plain = F.array_sort(F.array_distinct(F.filter(tx.words(F.col("content")), lambda w: w.rlike("^[a-z]+$"))))
    return memories(spark, sf).select("id", tx.word_count(F.col("content")).alias("words"), F.length(F.array_join(plain, " ")).alias("vocabulary"))


def _lex(terms, phrase):
    count = lambda c, t: f"((length(lower({c})) - length(replace(lower({c}), '{t}', ''))) // {len(t)})"
    hits = " + ".join(f"{count('content', t)} + 2 * {count('path', t)}" for t in terms)
    matched = " + ".join(f"CAST(contains(lower(content), '{t}') OR contains(lower(path), '{t}') AS INT)" for t in terms)
    return f"CAST({hits} + ({matched}) * ({matched}) + CASE WHEN contains(lower(content), '{phrase}') THEN 6 ELSE 0 END AS DOUBLE)"


@query(sql([MEMORIES], f"SELECT id, path, {_lex(['src1', 'of', 'the'], 'src1 of the')} + CASE WHEN typed_kind IS NOT NULL THEN 3 ELSE 0 END AS score FROM memories ORDER BY score DESC, path LIMIT 30"))
def o69_keyword_search(spark, sf):
    return lexical.keyword_search(md.resolve_metadata(memories(spark, sf)), "src1 of the", 30)


@query(sql([MEMORIES], f"SELECT id, len(list_filter(string_split_regex(lower(lang || ' ' || regexp_replace(metadata, '[{{}}\\[\\]\",:]', ' ', 'g')), '\\s+'), lambda w: w IN ('fact', 'web'))) * 1.0e0 AS score FROM memories"))
def o70_metadata_keywords(spark, sf):
    return lexical.metadata_keyword_search(memories(spark, sf).withColumn("role", F.col("lang")), "fact web")


@query(sql([MEMORIES], f"SELECT id, CAST(len(list_intersect(list_slice(list_sort(list_distinct(list_filter(list_transform({WORDS}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(s) for s in lexical.INDEX_STOP)})))), 1, 100), ['thing', 'that', 'area', 'anti'])) AS INT) AS score FROM memories WHERE score > 0"))
def o71_keyword_index(spark, sf):
    return lexical.keyword_index_search(memories(spark, sf), "thing that area anti")


@query(sql(["s AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'part' THEN 10 WHEN starts_with(lower(p_name), 'part') THEN 5 ELSE 1 END + CASE WHEN p_type IN ('Function', 'Struct') THEN 1 ELSE 0 END AS score FROM part WHERE contains(lower(p_name), 'part'))"], "SELECT id, name, score FROM s ORDER BY score DESC, name, id LIMIT 40"))
def o72_symbol_search(spark, sf):
    from .model import parts

    return lexical.symbol_search(parts(spark, sf), "part", 40).select("id", "name", "score")


@query("""SELECT doc_id AS id, item_id, CASE WHEN d.text = b.text THEN 1.0e0 WHEN least(strlen(b.text), strlen(d.text)) / greatest(strlen(b.text), strlen(d.text), 1) < 0.5 THEN 0.0e0
 WHEN contains(d.text, substr(b.text, 1, 32)) THEN CASE WHEN least(strlen(b.text), strlen(d.text)) / greatest(strlen(b.text), strlen(d.text), 1) > 0.8 THEN 0.9e0 ELSE 0.7e0 END ELSE 0.3e0 END AS score
 FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id""")
def o74_match_score(spark, sf):
    d = memories(spark, sf).select("id", "content", (F.col("id") % 40).alias("item_id"))
    b = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id", "text AS saved")
    return d.join(b, "item_id").select("id", "item_id", lexical.match_score(F.col("saved"), F.col("content")).alias("score"))


@query(
    sql([MEMORIES, "s AS (SELECT id, trim(unnest(string_split_regex(content, '[.\\n!?]')), ' \n\t\r') AS sentence FROM memories)",
         "x AS (SELECT id, sentence, CAST(3 * (CAST(contains(lower(sentence), 'thing') AS INT) + CAST(contains(lower(sentence), 'of') AS INT)) + 5 * CAST(contains(lower(sentence), 'thing of') AS INT) AS DOUBLE) AS score FROM s WHERE sentence <> '')"],
        "SELECT id, score, length(sentence) AS n FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, length(sentence) DESC) = 1")
)
def o77_best_sentence(spark, sf):
    return lexical.best_relevant_sentence(memories(spark, sf), "thing of").select("id", "score", F.length("sentence").alias("n"))


@query(sql([MEMORIES], """SELECT id, coalesce(typed_kind, CASE WHEN contains(path, '.') THEN 'file' ELSE 'document' END) AS kind, lang AS ns_project, scope AS ns_scope, workspace_id AS ns_workspace_id, 'Web' AS prov_source_type,
 CASE WHEN derived THEN 'derived' ELSE path END AS prov_file_path, observed_at FROM memories"""))
def o20_resolve_metadata(spark, sf):
    return md.resolve_metadata(memories(spark, sf)).select("id", "kind", "ns_project", "ns_scope", "ns_workspace_id", "prov_source_type", "prov_file_path", "observed_at")


@query(sql([MEMORIES], "SELECT id FROM memories WHERE typed_kind = 'fact' AND lower(lang) = 'en' AND level IN ('raw', 'belief') AND observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"))
def o22_matches_filters(spark, sf):
    keep = md.matches_filters(kinds=["fact"], equal={"ns_project": "EN", "prov_source_type": "web"}, levels=["raw", "belief"], observed=("2024-01-05", "2024-01-20"))
    return md.resolve_metadata(memories(spark, sf)).where(keep).select("id")


@query(sql([MEMORIES], "SELECT id FROM memories WHERE (contains(path, 'src1') OR contains(content, 'src1') OR contains(metadata, 'src1')) AND lang = 'en'"))
def o24_filter_records(spark, sf):
    return md.filter_records(memories(spark, sf), "src1", "en").select("id")


@query(sql([MEMORIES], "SELECT workspace_id, count(*) AS n FROM memories WHERE NOT derived GROUP BY ALL"))
def o25_primary_memories(spark, sf):
    return md.primary_memories(memories(spark, sf)).groupBy("workspace_id").agg(F.count("*").alias("n"))


@query(sql([MEMORIES], "SELECT id, path FROM memories ORDER BY created_at, id LIMIT 50 OFFSET 100"))
def o26_list_page(spark, sf):
    return memories(spark, sf).select("id", "path", "created_at").orderBy("created_at", "id").offset(100).limit(50).drop("created_at")


DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: a.vector[i] * b.vector[i]))"


@query(
    sql([VECTORS, "v AS (SELECT id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS norm FROM vectors)",
         f"s AS (SELECT b.id AS query_id, a.id, {DOT} / (a.norm * b.norm) AS c FROM v a JOIN v b ON b.id < 5 AND a.id <> b.id)",
         "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE c > 0)"],
        "SELECT query_id, id, rank, round(0.5 + 0.5 * c / max(c) OVER (PARTITION BY query_id), 6) AS score FROM t WHERE rank <= 10")
)
def o81_vector_search(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("sought"))
    return rounded(vector.vector_search(v, F.broadcast(asked), 10).select("query_id", "id", "rank", "score"), "score")


@query(sql([VECTORS], "SELECT a.id, round(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i]))), 6) AS distance FROM vectors a JOIN vectors b ON b.id = 0 WHERE a.label < 5 ORDER BY round(distance, 6), a.id LIMIT 15"))
def o82_knn_store(spark, sf):
    v = vectors(spark, sf)
    one = v.where("id = 0").select(F.col("vector").alias("sought"))
    near = vector.knn_store(v.crossJoin(F.broadcast(one)), F.col("sought"), 15, F.col("label") < 5)  # one row
    return near.select("id", F.round("distance", 6).alias("distance"))


@query(sql([VECTORS, "s AS (SELECT id, vector, list_max(list_transform(vector, lambda x: abs(x))) / 127.0e0 AS s FROM vectors)", "r AS (SELECT *, list_transform(vector, lambda x: x - round(x / s) * s) AS rest FROM s WHERE s > 0)", "r2 AS (SELECT *, list_max(list_transform(rest, lambda x: abs(x))) / 127.0e0 AS s2 FROM r)",
            "e AS (SELECT *, round(list_max(list_transform(rest, lambda x: abs(x - CASE WHEN s2 > 0 THEN round(x / s2) * s2 ELSE 0 END))), 9) AS max_error FROM r2)"], "SELECT id, CAST(list_sum(list_transform(vector, lambda x: round(x / s))) AS BIGINT) AS codes, CAST(list_max(list_transform(vector, lambda x: abs(round(x / s)))) AS BIGINT) AS largest, max_error AS error FROM e WHERE s > 0"))
def o83_quantize_round_trip(spark, sf):
    v = vectors(spark, sf).withColumn("back", vector.dequantize(vector.quantize(F.col("vector"))))
    worst = F.array_max(F.zip_with("vector", "back", lambda a, b: F.abs(a - b)))
    q = vector.quantize(F.col("vector"))["codes1"]
    codes = F.aggregate(q, F.lit(0), lambda a, x: a + x)
    return v.where(F.exists("vector", lambda x: x != 0)).select("id", codes.cast("long").alias("codes"), F.array_max(F.transform(q, F.abs)).cast("long").alias("largest"), F.round(worst, 9).alias("error"))


@query(
    sql([VECTORS, f"s AS (SELECT b.id AS query_id, a.id, {DOT} / (sqrt(list_sum(list_transform(a.vector, lambda x: x * x))) * sqrt(list_sum(list_transform(b.vector, lambda x: x * x)))) AS c FROM vectors a JOIN vectors b ON b.id % 50 = 1 AND a.id <> b.id)"],
        "SELECT query_id, id, round(c, 6) AS cosine FROM s WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) = 1")
)
def o84_semantic_cache(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("id % 50 = 1").select(F.col("id").alias("query_id"), F.col("vector").alias("sought"))
    return rounded(vector.semantic_cache(v, asked, 0.3), "cosine")


def _with_vectors(spark, sf):
    return memories(spark, sf).join(vectors(spark, sf), "id", "left")


HYBRID = [
    MEMORIES, BM25, VECTORS, "q AS (SELECT vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS norm FROM vectors WHERE id = 3)",
    "near AS (SELECT a.id, list_sum(list_transform(generate_series(1, 64), lambda i: a.vector[i] * b.vector[i])) / (sqrt(list_sum(list_transform(a.vector, lambda x: x * x))) * b.norm) AS score FROM vectors a, q b WHERE a.id IN (SELECT id FROM memories))",
    "l1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM bm25 WHERE score > 0 ORDER BY score DESC, id LIMIT 20))",
    "l2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM near WHERE score > 0 ORDER BY score DESC, id LIMIT 20))",
    "f AS (SELECT id, sum(0.5e0 / (60 + rank)) AS score, sum(0.5e0) AS total_weight, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT id, rank, 'bm25' AS source FROM l1 UNION ALL SELECT id, rank, 'vector' FROM l2) GROUP BY id)",
]


@query(sql(HYBRID, "SELECT id, round(score, 9) AS score, total_weight, sources FROM f ORDER BY f.score DESC, total_weight DESC, id LIMIT 10"))
def o91_hybrid_search(spark, sf):
    """The flagship: lexical and vector lists fused by reciprocal rank."""
    one = [float(x) for x in vectors(spark, sf).where("id = 3").first()["vector"]]
    found = fusion.hybrid_search(_with_vectors(spark, sf), QUERY, F.array(*[F.lit(x) for x in one]), 10)
    return found.select("id", F.round("score", 9).alias("score"), "total_weight", "sources")


def rounded9(df):
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"})


@query(
    sql([MEMORIES, "t AS (SELECT id, lang, greatest(1, strlen(content) // 4) AS tokens FROM memories)", "r AS (SELECT *, sum(tokens) OVER (PARTITION BY lang ORDER BY id) AS running FROM t)"],
        "SELECT id, lang, tokens, CAST(running AS BIGINT) AS running FROM r WHERE running <= 5000")
)
def o103_token_budget(spark, sf):
    t = memories(spark, sf).select("id", "lang", tx.estimate_tokens(F.col("content")).alias("tokens"))
    return fusion.token_budget(t, "lang", ["id"], "tokens", 5000)


@query(sql([MEMORIES], f"SELECT CASE WHEN contains(lower(content), 'architecture') OR len({WORDS}) >= 100 THEN 'max' WHEN contains(lower(content), 'thing') OR len({WORDS}) >= 20 THEN 'medium' ELSE 'minimal' END AS level, count(*) AS n FROM memories GROUP BY ALL"))
def o104_context_class(spark, sf):
    m = memories(spark, sf)
    return m.select(fusion.classify_context(tx.word_count(F.col("content")), F.col("content"), ["architecture"], ["thing"]).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query(
    sql([MEMORIES], f"""SELECT id, round(CAST(CASE WHEN contains(lower(content), 'thing') THEN 0.12e0 ELSE 0 END + CASE WHEN contains(lower(path), 'thing') THEN 0.2e0 ELSE 0 END + CASE WHEN contains(lower(content), 'src1') THEN 0.12e0 ELSE 0 END
        + CASE WHEN contains(lower(path), 'src1') THEN 0.2e0 ELSE 0 END + (access_count / 13.0e0) * 0.25e0 - least(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) / 365.0e0, 1.0e0) * 0.15e0 AS DOUBLE), 6) AS boost FROM memories WHERE created_at <= TIMESTAMP '{AS_OF}'""")
)
def o99_contextual_boost(spark, sf):
    m = memories(spark, sf).where(F.col("created_at") <= as_of())
    boost = fusion.contextual_boost("of thing src1", F.col("content"), F.col("path"), F.col("access_count") / 13.0, tx.age_days(F.col("created_at"), as_of()))
    return m.select("id", F.round(boost, 6).alias("boost"))


@query(sql([MEMORIES, "t AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS nth FROM (SELECT id, regexp_extract_all(content, '[A-Za-z0-9][A-Za-z0-9._:/#-]+') AS ts FROM memories))", "f AS (SELECT id, min_by(t, nth) AS t, min(nth) AS nth FROM t GROUP BY id, lower(t))"], "SELECT id, count(*) AS entities, md5(string_agg(t, ' ' ORDER BY nth)) AS digest FROM f WHERE regexp_matches(t, '[0-9A-Z_-]') GROUP BY id"))
def o66_query_entities(spark, sf):
    """Over whole texts, by grouping; ``tx.query_entities`` has the same rule for a query."""
    found = lexical.document_tokens(memories(spark, sf)).where(tx.names_entity(F.col("token")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ")
    return found.groupBy("id").agg(F.count("*").alias("entities"), F.md5(text).alias("digest"))
