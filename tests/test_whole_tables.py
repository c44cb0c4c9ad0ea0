"""Queries without a SQL twin run over their whole tables."""

import pandas as pd

from recallery.plans import catalog


def test_greedy_clusters_of_all_vectors(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert n > 320
    assert catalog.QUERIES["o154_greedy_clusters"](spark, sf).select("id").distinct().count() == n


def test_call_chain_reaches_all(spark, tmp_path):
    tables = {
        "customer": {"c_custkey": [10], "c_nationkey": [1]},
        "nation": {"n_nationkey": [1], "n_regionkey": [0]},
        "supplier": {"s_suppkey": list(range(1500)), "s_nationkey": [1] * 1500},
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(tmp_path / f"{name}.parquet")
    found = {(r.node, r.depth) for r in catalog.QUERIES["o188_call_chain"](spark, str(tmp_path)).collect()}
    assert found == {("n1", 1), ("r0", 2), *((f"s{k}", 2) for k in range(1500))}
