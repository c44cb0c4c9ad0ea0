"""Hard-negative mining by distributed radix selection [operator 12].

Scores are integer inner products. For every anchor (its positives) and every anchor-positive window (its
negatives) the k-th best score is found digit by digit: each block of rows reports how many of its scores fall into the buckets
of the digit, from the top of the window down to where its own rows alone reach k; the sums locate the bucket of the k-th
score; the next digit splits that bucket. Rows at or above the k-th score are gathered last, and only they.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: bits of a digit
DIGIT = 10
#: rows and anchors of one task, anchors of one product of matrices
ROWS, ANCHORS, AT_ONCE = 16_384, 2_048, 128
_ASK = "array<struct<tag:long,low:long,high:long,need:long>>"


def scores(anchors: np.ndarray, rows: np.ndarray, bound: int) -> np.ndarray:
    """Integer inner products, exact: in floating point only where no sum can pass what it holds exactly."""
    if bound < 1 << 24:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


class Block:
    """Scores of some anchors against a block of rows, those that an anchor may not take put below all windows."""

    def __init__(self, anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], bound: int, same: bool):
        self.ids, self.below, self.stride = rows["id"], -bound - 1, 2 * bound + 3
        found = scores(anchors["vector"], rows["vector"], bound)
        allowed = (anchors["label"][:, None] == rows["label"][None, :]) == same
        if same:
            allowed &= anchors["id"][:, None] != rows["id"][None, :]
        self.scores = np.where(allowed, found, self.below)
        self.flat: np.ndarray | None = None

    def _first(self, anchor: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places, in each anchor's ascending scores, of the first that is ``least`` or more; all anchors' scores as one array."""
        if self.flat is None:
            self.flat = (np.sort(self.scores, 1) + np.arange(len(self.scores), dtype=np.int64)[:, None] * self.stride).ravel()
        return np.searchsorted(self.flat, least + anchor * self.stride, "left")

    def histogram(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which window, bucket (score >> shift) and number of scores, from the top bucket down to where ``need`` is met."""
        begin, end = self._first(anchor, low), self._first(anchor, high + 1)
        window, need, out = np.arange(len(anchor)), need.copy(), []
        while True:
            live = (end[window] > begin[window]) & (need[window] > 0)
            window = window[live]
            if not len(window):
                break
            top = self.flat[end[window] - 1] - anchor[window] * self.stride
            start = np.maximum(begin[window], self._first(anchor[window], np.maximum(low[window], top >> shift << shift)))
            n = end[window] - start
            out.append((window, top >> shift, n))
            end[window], need[window] = start, need[window] - n
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def gather(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which window, id and score of the rows above ``low``, and of the ``need`` smallest ids at it."""
        out = [(np.zeros(0, np.int64),) * 3]
        for w, (a, lo, hi, k) in enumerate(zip(anchor.tolist(), low.tolist(), high.tolist(), need.tolist(), strict=True)):
            mine = self.scores[a]
            at = np.flatnonzero((mine >= lo) & (mine <= hi))
            if len(at):
                least = at[mine[at] == lo]
                ids = np.sort(self.ids[least])[:k]
                above = at[mine[at] > lo]
                out.append((np.full(len(above) + len(ids), w), np.concatenate((self.ids[above], ids)), np.concatenate((mine[above], np.full(len(ids), lo)))))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    vector = table["vector"].combine_chunks()
    return {"id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "vector": vector.flatten().to_numpy().reshape(len(vector), -1)}


def _worker(bound: int, same: bool, shift: int | None):
    """One block of rows against one block of anchors with their windows: histograms, or the rows themselves."""
    names = ("bucket", "n") if shift is not None else ("row", "score")

    def work(key, rows, asked):
        out = [(np.zeros(0, np.int64),) * 4]
        if rows.num_rows and asked.num_rows:
            rows, anchors, asks = _columns(rows), _columns(asked), asked["asks"].combine_chunks()
            sizes, windows = np.diff(asks.offsets.to_numpy()), asks.flatten()
            tag, low, high, need = (windows.field(c).to_numpy() for c in ("tag", "low", "high", "need"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            step = max(1, min(AT_ONCE, (1 << 62) // (2 * bound + 3)))
            for at in range(0, len(sizes), step):
                block = Block({c: v[at : at + step] for c, v in anchors.items()}, rows, bound, same)
                mine = np.flatnonzero((owner >= at) & (owner < at + step))
                of = (owner[mine] - at, low[mine], high[mine], need[mine])
                window, one, two = block.histogram(*of, shift) if shift is not None else block.gather(*of)
                out.append((anchors["id"][owner[mine[window]]], tag[mine[window]], one, two))
        anchor, tag, one, two = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"anchor": anchor, "tag": tag, names[0]: one, names[1]: two})

    return work, f"anchor long, tag long, {names[0]} long, {names[1]} long"


class Selection:
    """Rows and anchors dealt into blocks; selects the best rows of windows of scores."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, bound: int, n_rows: int, n_anchors: int):
        self.bound, self.bits = bound, max(1, (2 * bound + 1).bit_length())
        self.row_blocks, self.anchor_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
        deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
        wide = F.size("vector").alias("wide")
        self.rows = rows.select("id", "label", "vector", wide, deal(self.row_blocks, 1).alias("row_block")).withColumn("anchor_block", self._all(self.anchor_blocks))
        self.anchors = anchors.select("id", "label", "vector", wide, deal(self.anchor_blocks, 2).alias("anchor_block"))

    @staticmethod
    def _all(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def _ask(self, windows: DataFrame, same: bool, shift: int | None) -> DataFrame:
        """Each anchor's windows, a few, go with it to every block of rows."""
        asks = windows.groupBy("anchor").agg(F.collect_list(F.struct("tag", "low", "high", "need")).cast(_ASK).alias("asks"))
        # anchors grow with the table: never broadcast
        asked = self.anchors.join(asks.hint("merge"), F.col("id") == F.col("anchor")).drop("anchor").withColumn("row_block", self._all(self.row_blocks))
        work, schema = _worker(self.bound, same, shift)
        keys = ("wide", "row_block", "anchor_block")
        return self.rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(work, schema)

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor, tag, rank, row, score``: the first ``k`` of the rows with another label (``same``: of the other rows with
        the anchor's label) whose scores lie in ``low`` to ``high`` of the rows ``anchor, tag, low, high``; all, if fewer.

        An anchor may have a few windows.
        """
        live = windows.select("anchor", "tag", "low", "high", F.col("high").alias("top"), F.lit(k).cast("long").alias("need"))
        settled = None
        down = Window.partitionBy("anchor", "tag").orderBy(F.desc("bucket"))  # at most k buckets of each block of rows
        whole = Window.partitionBy("anchor", "tag")
        for shift in range((self.bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
            counts = self._ask(live, same, shift).groupBy("anchor", "tag", "bucket").agg(F.sum("n").alias("n"))
            counts = counts.withColumn("so_far", F.sum("n").over(down)).withColumn("total", F.sum("n").over(whole)).withColumn("last", F.min("bucket").over(whole))
            state = live.join(counts.hint("merge"), ["anchor", "tag"])
            met = (F.col("so_far") >= F.col("need")) & (F.col("so_far") - F.col("n") < F.col("need"))
            few = (F.col("total") < F.col("need")) & (F.col("bucket") == F.col("last"))  # fewer rows than asked for: all of them
            low, high = F.shiftleft("bucket", shift), F.shiftleft("bucket", shift) + F.lit((1 << shift) - 1)
            state = state.where(met | few).select(
                "anchor", "tag", "top",
                F.when(few, F.col("low")).otherwise(F.greatest("low", low)).alias("low"),
                F.when(few, F.col("low")).otherwise(F.least("high", high)).alias("high"),
                F.when(few, F.col("need")).otherwise(F.col("need") - F.col("so_far") + F.col("n")).alias("need"),
                (few | (F.col("so_far") == F.col("need")) | F.lit(shift == 0)).alias("settled"),
            )
            state = stored(state, "windows")
            done = state.where("settled").drop("settled")
            settled = done if settled is None else settled.unionByName(done)
            live = state.where("NOT settled").drop("settled")
        # what is settled before the last digit takes all rows from ``low`` on, as many as ``need`` at most are there
        found = self._ask(settled.select("anchor", "tag", "low", F.col("top").alias("high"), "need"), same, None)
        order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "tag", "rank", "row", "score")


def hard_negatives(vectors: DataFrame, every: int = 50, shift_every: int = 7, n_labels: int = 10, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows whose ``vec_id`` is divisible by ``every``.

    Rows without an id, label or vector, and vectors with a null or non-finite component take no part; nor do those whose
    quantised components' squares sum to 2**62 or more, as their scores need not fit a long. Vectors meet those of their own dimension
    only, an empty vector scores 0 with others. Of an id's different rows the smallest (vector, then label) counts, so repeated rows count once.
    Where ``vec_id`` is divisible by ``shift_every`` the label becomes (label + 1) % ``n_labels``. Components are floor(``scale`` * x). An
    anchor's positives are its first ``positives`` other rows of its label, and for each the first ``negatives`` rows of another label are given for which
    100 * score lies between ``low`` and ``high`` times the positive's score (both included). Higher scores come first, ties by smaller id. An empty table gives no rows; extra columns are left behind.

    Of equal vectors with one label only the first rows can be chosen, so no more are searched. Every anchor meets every block of
    rows, so work grows with the product of both, as the definition asks.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), F.lit(2)))
    plain = plain.where(F.forall("x", lambda x: F.abs(x) < 2.0**31) & (square < 2.0**62))
    plain = plain.groupBy("id").agg(F.min(F.struct("x", "label")).alias("of"))
    label = F.when(F.col("id") % shift_every == 0, F.pmod(F.col("of.label") + 1, F.lit(n_labels))).otherwise(F.col("of.label"))
    usable = stored(plain.select("id", label.alias("label"), F.transform("of.x", lambda x: F.floor(x * scale).cast("long")).alias("vector")), "vectors")
    alike = Window.partitionBy("vector", "label").orderBy("id")
    rows = usable.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth")
    rows, anchors = stored(rows, "rows"), usable.where(F.col("id") % every == 0)
    squared = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, bound = rows.agg(F.count("*"), F.max(squared)).first()
    selection = Selection(rows, anchors, int(bound or 0), n, anchors.count())
    whole = anchors.select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("tag"), F.lit(-selection.bound).cast("long").alias("low"), F.lit(selection.bound).cast("long").alias("high"))
    chosen = stored(selection.best(whole, positives, same=True), "positives")
    # the first and last integer within the window; // 100 rounds down for negative scores too
    least = F.expr(f"-floor(-({low} * CAST(score AS DECIMAL(25, 0))) / 100)").cast("long")
    most = F.expr(f"floor(({high} * CAST(score AS DECIMAL(25, 0))) / 100)").cast("long")
    windows = chosen.select("anchor", F.col("row").alias("tag"), least.alias("low"), most.alias("high")).where(F.col("low") <= F.col("high"))
    found = selection.best(windows, negatives, same=False)
    of = chosen.select("anchor", F.col("row").alias("tag"), F.col("score").alias("positive_score"))
    return found.join(of.hint("merge"), ["anchor", "tag"]).select(
        F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
