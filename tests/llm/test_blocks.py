"""Large candidate groups of near duplicates: meetings of blocks are bounded and lose no link."""

import random

import pytest
from pyspark.sql import functions as F

from recallery.llm import setsketch
from tests.llm.test_dedup import SCHEMA, brute_components, edited_copies, found_components, rows


def apart(seed, clusters, each, length, shared, edits):
    """Clusters that share boilerplate, mostly not linked with the first document."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    common = [word() for _ in range(shared)]
    out = []
    for k in range(clusters):
        out += [" ".join(common) + " " + t for t in edited_copies(seed * 100 + k, each, length, edits)]
    return out


def test_meetings_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    n = 640
    narrow = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("grp"), F.lit(n // 16).alias("blocks"),
        F.pmod(F.xxhash64("id"), F.lit(n // 16)).cast("int").alias("block"), F.col("id").alias("label"), F.lit(9).cast("long").alias("size"), F.lit(b"").alias("sketch"),
    )
    met = setsketch._meetings(narrow)
    assert met.groupBy("grp", "block", "party").count().agg(F.max("count")).first()[0] < 5 * 16
    pairs = met.where("guest").alias("g").join(met.where("NOT guest").alias("r"), ["grp", "block", "party"]).select("g.doc_id", F.col("r.doc_id").alias("other"))
    homes = dict(narrow.select("doc_id", "block").collect())
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in homes for b in homes if a and homes[a] != homes[b]}


@pytest.mark.parametrize("block", [1024, 8])
def test_documents_apart_from_the_first(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    texts = list(enumerate(apart(7, 12, 12, 60, 70, 14) + apart(8, 30, 3, 30, 60, 5)))
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    want = brute_components(texts, 4, 80)
    assert 10 < len({c for _, c in want.values()}) < len(texts)
    assert found_components(df, words=4) == want
