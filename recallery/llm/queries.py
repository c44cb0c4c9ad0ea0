"""Registered queries of the training-data operators, over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chroma, fim, hard_negatives, lpf_dedup, packing, pieces, prefix_forest, quality, secrets, setsketch, token_files, toxicity
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.remove_repeats(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir), secrets.fit_forest())


def op9_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.identify(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op11_marker_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(documents(spark, sf_dir))


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pair_index_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_factorisation_quality, op2_prefix_forest, op3_suffix_array_dedup, op4_best_fit_packing, op5_subword_toxicity, op6_token_files, op7_piece_codec, op8_secret_forest, op9_chroma_alignment, op10_setsketch_near_dedup, op11_marker_fim, op12_radix_negatives, op13_pair_index_codec)
}

ORACLE_SQL: dict[str, str] = {
    "op10_setsketch_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
        x AS (SELECT doc_id, unnest(sh) AS sh FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT n.doc_id, n.n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles""",
    "op11_marker_fim": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
        h AS (SELECT doc_id, text, length(text) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
        f AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR doc_id IS NULL OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(text, 1, a) AS x, substr(text, a + 1, b - a) AS y, substr(text, b + 1) AS z FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op12_radix_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
