"""Approximate nearest neighbours in a hash-prefix forest [operator 2].

Each tree is the sorted array of long hash strings of a block's vectors, a bit for each random
hyperplane. A query descends to its longest-prefix match in every tree, then all trees ascend
together, a bit at a time, and the vectors under the shorter prefix are scored as they appear. A query stops
when a vector as near as its k-th best would have been met with probability ``SURE``: near
neighbours are found deep in the trees, and where none are near the search goes on, to everything
at prefix length 0.

Inner products become angles with one more coordinate, which gives all vectors the largest length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TREES, BITS = 64, 32
SURE = 0.9
#: vectors in one forest, query vectors in one task
BLOCK, QUERIES = 16_384, 8_192


class PrefixForest:
    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 5):
        self.vectors, self.longest = vectors, longest
        n, d = vectors.shape
        self.planes = np.random.default_rng(seed).normal(size=(TREES * BITS, d + 1)).astype(np.float32)
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        strings = self._strings(np.column_stack([scaled, rest]))
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(strings, self.order, 1)
        self.flat, self.base = self.order.ravel(), np.arange(TREES, dtype=np.int64) * n
        self.short = vectors.astype(np.float32)

    def _strings(self, points: np.ndarray) -> np.ndarray:
        bits = (points.astype(np.float32) @ self.planes.T) > 0
        weights = np.left_shift(np.uint64(1), np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        return (bits.reshape(len(points), TREES, BITS) @ weights).T.copy()

    def search(self, queries: np.ndarray, k: int, sure: float = SURE) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Positions and inner products of the k best found for each query; ties to smaller positions; all with ``sure=1``."""
        at, scores = [], []
        for start in range(0, len(queries), 1024):
            part = queries[start : start + 1024]
            lengths = np.sqrt((part**2).sum(1))
            low, high = self._ranges(self._strings(np.column_stack([part / lengths[:, None], np.zeros(len(part))])))
            for q, vector in enumerate(part):
                found = self._ascend(vector.astype(np.float32), lengths[q] * self.longest, low[:, :, q], high[:, :, q], k, sure)
                exact = np.cumsum(self.vectors[found] * vector, axis=1)[:, -1] if len(found) else np.zeros(0)
                best = np.lexsort((found, -exact))[:k]
                at.append(found[best])
                scores.append(exact[best])
        return at, scores

    def _ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in each sorted array that share each prefix length (0 to all bits) with each string."""
        low = np.empty((BITS + 1, *strings.shape), np.int32)
        high = np.empty_like(low)
        for level in range(BITS + 1):
            shift = np.uint64(BITS - level)
            floor = strings >> shift << shift
            for t in range(TREES):
                low[level, t] = np.searchsorted(self.strings[t], floor[t], "left")
                high[level, t] = np.searchsorted(self.strings[t], floor[t] + (np.uint64(1) << shift), "left")
        return low, high

    def _ascend(self, vector: np.ndarray, scale: float, low: np.ndarray, high: np.ndarray, k: int, sure: float) -> np.ndarray:
        """Positions that may be among the k best: all trees go up together, adding what each level adds."""
        n = len(self.vectors)
        total = (high - low).sum(1)
        deep = np.flatnonzero(total >= k)
        level = int(deep[-1]) if len(deep) else 0  # below it no k vectors are met: the longest matches are inside
        seen = np.zeros(n, bool)
        a, b = low[level].astype(np.int64), high[level].astype(np.int64)
        begins, many = self.base + a, b - a
        found, value = [], []
        while True:
            if level == 0:
                fresh = np.flatnonzero(~seen)
            else:
                ends = np.cumsum(many)
                mark = np.zeros(n, bool)
                mark[self.flat[np.repeat(begins - ends + many, many) + np.arange(ends[-1])]] = True
                mark &= ~seen
                fresh = np.flatnonzero(mark)
            if len(fresh):
                seen[fresh] = True
                found.append(fresh)
                value.append(self.short[fresh] @ vector)
            values = np.concatenate(value) if value else np.zeros(0)
            if level == 0:
                break
            if len(values) >= k and sure < 1:
                kth = np.partition(values, len(values) - k)[len(values) - k] / scale
                same = 1 - np.arccos(np.clip(kth, -1, 1)) / np.pi
                if 1 - (1 - same**level) ** TREES >= sure:
                    break
            level -= 1
            up, down = low[level].astype(np.int64), high[level].astype(np.int64)
            begins, many = np.concatenate((self.base + up, self.base + b)), np.concatenate((a - up, down - b))
            a, b = up, down
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(places) > k:  # all that single precision may have ordered wrongly stay for double precision
            error = 2 * (len(vector) + 2) * float(np.finfo(np.float32).eps) * scale
            places = places[values >= np.partition(values, len(values) - k)[len(values) - k] - error]
        return places


def _searcher(k: int, longest: float, sure: float):
    def search(key, index, queries):
        schema = {"query_rep": pa.int64(), "members": pa.list_(pa.int64()), "score": pa.float64()}
        if not index.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in schema.items()})
        index, queries = index.sort_by("rep"), queries.sort_by("asked")
        matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        at, scores = PrefixForest(matrix(index["vector"]), longest).search(matrix(queries["sought"]), k, sure)
        rep = np.repeat(queries["asked"].to_numpy(), [len(a) for a in at])
        return pa.table({"query_rep": pa.array(rep), "members": index["members"].take(pa.array(np.concatenate(at))), "score": pa.array(np.concatenate(scores))})

    return search


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, sure: float = SURE) -> DataFrame:
    """For each row whose ``vec_id`` is divisible by ``every``: the k other rows of largest inner product.

    Returns ``query_id, rank, vec_id, score``. Rows without an id, and vectors that are null, zero or hold null
    or non-finite components take no part; vectors meet only those of their own dimension; repeated rows
    count once, and of an id's different vectors the smallest (component by component) counts. With ``sure=1`` every
    vector is read and the result is exact. An empty table gives no rows; extra columns are left behind. The
    query set grows with the table and meets every block of vectors, so work grows with the product. Equal vectors are searched once: of each only the k + 1 smallest ids can be
    in a result, so just these are kept, and queries of equal vectors share their search.
    """
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = wide.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    valid = valid.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    ordered = Window.partitionBy("vector").orderBy("vec_id")
    least = valid.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= k + 1)
    index = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("rep", F.col("members")[0])
    index = stored(index.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    queries = valid.where(F.col("vec_id") % every == 0)
    asked = stored(queries.join(index.select("vector", "rep"), "vector").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    asked_reps = asked.select("rep").distinct()
    n, longest = index.agg(F.count("*"), F.max("norm")).first()
    n_queries = asked_reps.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wide = F.size("vector").alias("wide")
    left = index.select("rep", "vector", "members", wide, deal(blocks).alias("block")).withColumn("part", all_of(parts))
    right = index.join(asked_reps, "rep", "left_semi").select(F.col("rep").alias("asked"), F.col("vector").alias("sought"), wide, deal(parts).alias("part")).withColumn("block", all_of(blocks))
    found = (
        left.groupBy("wide", "block", "part")
        .cogroup(right.groupBy("wide", "block", "part"))
        .applyInArrow(_searcher(k + 1, float(longest or 1.0), sure), "query_rep long, members array<long>, score double")
    )
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    near = found.select("query_rep", "score", F.explode("members").alias("vec_id")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(near, asked.rep == near.query_rep)
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
