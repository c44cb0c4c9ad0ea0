"""Toxicity by averaged subword embeddings and a linear softmax [operator 5].

The embeddings of a segment's words and character n-grams are averaged into a softmax; a few hostile words
would be lost in the average of a whole text, so texts are read in segments of ``SEGMENT`` words and are
toxic if any segment is (the probabilities of clean segments multiply). Equal segments of a text count once,
so that repetition alone never adds up. All learn jointly.

Length: the more clean segments a text has, the higher the highest of them. So the segments of the worst passage count
(``WINDOW`` of them), and from what they add up to goes what the worst of as many clean segments reaches with probability ``CHANCE``,
known from long clean documents that the fit has not seen. A clean text stays clean at any length; a hostile passage in a long one
must stand out by several words.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mix64, runs, slices, span_hashes

BITS, WIDTH = 18, 8
SEGMENT = 3
#: bounds of the sample that the model is fitted on
ROWS_PER_CLASS, LONGEST = 1500, 5000
#: passes over the sample, more of them where it is small: at least ``STEPS`` batches
EPOCHS, STEPS, BATCH, RATE = 10, 300, 32, 0.8
#: first sum of squared gradients: steps of subwords seen once stay small
START = 3e-2
THRESHOLD = 0.7
#: segments of a passage (of about the longest text of the fit), and how likely the worst segment of a clean text may reach what is subtracted
WINDOW, CHANCE = 256, 0.05
#: bounds of the sample of long clean documents, and the highest segments that each gives
LONG_ROWS, LONGEST_CLEAN, HIGHEST = 400, 200_000, 64

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_CODE = mix64(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_STEP = np.uint64(0xE7037ED1A0B428DB)


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and 3- to 5-character n-grams, their segment numbers, and each segment's text.

    Of the segments of a text with the same words only the first is given. Lower-case; whatever is no letter parts words; n-grams may hold the mark before or after a word.
    """
    lower = [(t or "").lower() for t in texts]
    codes = np.minimum(np.frombuffer(("\n".join(lower) + "\n\n").encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
    codes = np.concatenate(([10], codes)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in lower])
    letter = _LETTER[codes]
    starts, stops = runs(letter)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(ends, starts - 1, "right")
    nth = np.arange(len(starts)) - np.searchsorted(text, text)
    first = nth % SEGMENT == 0
    hashes = span_hashes(codes, starts, stops)
    opening = np.flatnonzero(first)
    owner, said = text[first], np.add.reduceat(mix64(hashes), opening)
    order = np.lexsort((said, owner))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (said[order[1:]] == said[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    segment_of_word = np.where(again, -1, np.cumsum(~again) - 1)[np.cumsum(first) - 1]
    begins = np.zeros(len(codes), np.int64)
    begins[starts] = 1
    word = np.cumsum(begins) - 1
    segments, found = [segment_of_word], [hashes]
    letter = letter & np.concatenate((segment_of_word >= 0, [True]))[word]  # no n-grams of segments that are left out
    each = np.where(letter, _CODE[codes], _CODE[0])
    gram, ok = each[:-1] * _STEP + each[1:], None
    for n in (3, 4, 5):
        gram = gram[:-1] * _STEP + each[n - 1 :]
        ok = letter[1:-1] if ok is None else ok[:-1] & ok[1:]
        at = np.flatnonzero(ok[: len(gram)])
        segments.append(segment_of_word[word[at + 1]])
        found.append(mix64(gram[at] + np.uint64(n)))
    bucket, segment = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(segments)
    kept = segment >= 0
    return bucket[kept], segment[kept], owner[~again]


def _has_words(text: str) -> bool:
    return any(c.isalpha() and c < "\U00010000" for c in text.lower())


def _small(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the smallest type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())))


class SubwordSoftmax:
    """Embeddings of subword buckets, averaged over segments, into a softmax of two classes."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = bias
        #: logits of the highest clean segments, descending, and the number of segments that they are of
        self.tail, self.n_clean = np.zeros(0), 0
        self.margin = (table @ (weights[1] - weights[0])).astype(np.float64)  # linear: project first, average after

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], seed: int = 7) -> SubwordSoftmax:
        """Rows of a text and its label; subwords are held once, by batches, in the smallest types."""
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
        weights = rng.normal(0, 0.5, (2, WIDTH))
        rows = [r for r in rows if _has_words(r[0])]
        if len({r[1] for r in rows}) < 2:
            share = float(np.mean([r[1] for r in rows])) if rows else 0.0
            return cls(table * 0, weights, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        bias, grown_b = -5.0, 1e-4
        grown, grown_w = np.full(1 << BITS, START, np.float32), np.full(WIDTH, 1e-4)
        rows = [rows[k] for k in rng.permutation(len(rows))]
        batches = []
        while rows:
            part = [(*subwords([text])[:2], known) for text, known in rows[-BATCH:]]
            del rows[-BATCH:]
            flat, back = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
            many = np.array([int(r[1].max()) + 1 for r in part])
            segment = np.concatenate([r[1] + k for r, k in zip(part, np.cumsum(many) - many, strict=True)])
            batches.append((*map(_small, (flat, back, segment, np.repeat(np.arange(len(part)), many))), np.array([r[2] for r in part])))
        epochs = max(EPOCHS, -(-STEPS // len(batches)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for k in rng.permutation(len(batches)):
                flat, back, segment, owner, label = batches[k]
                share = (1 / np.bincount(segment)[segment]).astype(np.float32)
                rows_, n = table[flat], len(owner)
                direction = weights[1] - weights[0]
                mean = np.stack([np.bincount(segment, share * rows_[back, d], n) for d in range(WIDTH)], 1)
                z = np.clip(mean @ direction + bias, -30, 30)
                total = np.bincount(owner, np.logaddexp(0, z), len(label))
                clean = np.exp(-total)
                to_total = np.where(label == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
                to_z = np.clip(to_total, -50, 50)[owner] / (1 + np.exp(-z))
                scaled = share * to_z[segment]
                pull = np.bincount(back, scaled, len(flat))
                step = pull[:, None] * direction
                grown[flat] += (step**2).mean(1)
                to_w, to_b = mean.T @ to_z / len(label), to_z.sum() / len(label)
                table[flat] -= (rate * step / np.sqrt(grown[flat])[:, None]).astype(np.float32)
                grown_w += to_w**2
                grown_b += to_b**2
                weights[1] -= rate * to_w / np.sqrt(grown_w)
                weights[0] += rate * to_w / np.sqrt(grown_w)
                bias -= rate * to_b / np.sqrt(grown_b)
        return cls(table, weights, float(bias))

    def logits(self, buckets: np.ndarray, segments: np.ndarray, n: int) -> np.ndarray:
        """Log odds of each of ``n`` segments."""
        return np.bincount(segments, self.margin[buckets], n) / np.maximum(np.bincount(segments, minlength=n), 1) + self.bias

    def background(self, n: np.ndarray) -> np.ndarray:
        """What the worst of ``n`` clean segments adds with probability ``CHANCE``: by rank among known ones, beyond them by an exponential tail."""
        if len(self.tail) < 2:
            return np.zeros(len(n))
        rank = CHANCE * self.n_clean / np.maximum(n, 1)
        inside = np.interp(rank, np.arange(1, len(self.tail) + 1), self.tail)
        some = self.tail[:11]
        beyond = self.tail[0] + (some[:-1] - some[-1]).mean() * np.log(1 / np.minimum(rank, 1))
        return np.where(rank > len(self.tail), 0.0, np.logaddexp(0, np.where(rank < 1, beyond, inside)))

    def scores(self, buckets: np.ndarray, segments: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """Probability of class 1 of each of ``n`` texts; one without words has that of a single empty segment."""
        many = np.bincount(texts, minlength=n)
        so_far = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, self.logits(buckets, segments, len(texts))))))
        begin = np.arange(len(texts))
        passage = so_far[np.minimum(begin + WINDOW, np.cumsum(many)[texts])] - so_far[begin]
        total = np.zeros(n)
        np.maximum.at(total, texts, passage)
        total = np.maximum(total - self.background(many), 0)
        total[many == 0] = np.logaddexp(0, self.bias)
        return -np.expm1(-total)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> SubwordSoftmax:
    """Fit on a bounded sample of labelled documents in one task; only the model comes to the driver."""

    def fit(batches):
        rows = [row for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(SubwordSoftmax.fit(rows))], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, label, ROWS_PER_CLASS, LONGEST).select("doc_id", "text", "label")
    # at most 2 * ROWS_PER_CLASS short texts; their steps follow each other, so they meet in one task, in the order of their ids
    found = sample.repartition(1).sortWithinPartitions("doc_id", "text", "label").mapInArrow(fit, "model binary").collect()
    model = pickle.loads(found[0].model) if found else SubwordSoftmax.fit([])
    model.tail, model.n_clean = _clean_tail(docs, labels, label, model)
    return model


def _clean_tail(docs: DataFrame, labels: DataFrame, label: str, model: SubwordSoftmax) -> tuple[np.ndarray, int]:
    """The highest segments of clean documents too long for the fit, and how many segments these documents have.

    Of at most ``LONG_ROWS`` labelled documents, not held out, of ``LONGEST`` to ``LONGEST_CLEAN`` bytes; ``HIGHEST`` numbers of each come to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def highest(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                at, segment, owner = subwords([text])
                z = np.sort(shared.value.logits(at, segment, len(owner)))[::-1]
                found.append((z[:HIGHEST].tolist(), len(z)))
            tops, sizes = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(tops, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], ["top", "n"])

    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.col("label") == 0)).select("doc_id").distinct()
    text = F.col("text").cast("string")
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length(text).between(LONGEST + 1, LONGEST_CLEAN))
    # ids first, so that only the chosen texts move; ids of long documents and of labels grow with the table: no broadcast
    chosen = long.select("doc_id").join(usable.hint("merge"), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LONG_ROWS)
    rows = long.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").mapInArrow(highest, "top array<double>, n long").toArrow()  # at most LONG_ROWS ids
    tops = [x.values.to_numpy() for x in rows["top"]]
    return np.sort(np.concatenate(tops or [np.zeros(0)]))[::-1], int(sum(rows["n"].to_pylist()))


def score_toxicity(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each whole text; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [model.scores(*subwords(texts[a:b]), b - a) for a, b in slices([len(t or "") for t in texts], 500_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels that are not held out and score all documents.

    Ids and labels are never inputs. With labels of one class only, all scores are alike. Repeated
    rows each get a row; extra columns are left behind; an empty table gives no rows. Long texts are scored whole, by their worst passage against what
    clean texts of that length hold by chance; without long clean labelled documents nothing is known of that, and nothing is subtracted.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels))


def drop_toxic(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold; one pass without a shuffle.

    Null and empty texts and rows without an id are scored like others (an empty text is clean); repeated rows share their fate; an empty table stays empty.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 500_000):
                scores = shared.value.scores(*subwords(texts[a:b]), b - a)
                yield batch.slice(a, b - a).filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
