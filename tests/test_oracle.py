"""Every query with a SQL twin gives the same rows as DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from recallery.plans import catalog


def normal(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
                out.append("null")
            elif isinstance(v, float):
                out.append(repr(round(float(v), 8)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(frame.columns), sorted(rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    found = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE_SQL:
        assert normal(found) == normal(duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["o61_bm25_batch", "o168_cooccurrence", "o183_contradictions", "o173_reachable"])
def test_partitions_do_not_matter(name, spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(normal(catalog.QUERIES[name](spark, sf).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
