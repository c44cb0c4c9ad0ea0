"""Quality classifier: a factorisation machine [operator 1].

Features are hashed words (weighted by the root of their counts, scaled to unit length), binned
statistics of the text's structure and its recorded length as metadata. Pairwise interactions are of low
rank, and their sum over all pairs is taken in linear time:
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mix64, optional, runs, slices, span_hashes

BITS, RANK = 17, 8
BINS = 24
#: bounds of the sample that the model is fitted on
ROWS_PER_CLASS, LONGEST = 4000, 20_000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.08, 1e-4

_CLASS = np.zeros((5, 256), bool)  # letters, capitals, digits, marks, white space
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[3, [ord(c) for c in ".,'-"]] = False
_CLASS[4, [0x20, *range(0x09, 0x0E)]] = True


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))])


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text (as first positions), their counts, and the order they are in."""
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.bincount(text[order[first]], minlength=n)


def features(texts: list[str | None], recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and where each text's features end."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    codes = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    cased = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    letters, capitals, digits, marks, blank = (_per_text(c[cased], ends) for c in _CLASS)
    size = np.maximum(np.array([len(r) for r in raw]), 1)
    starts, stops = runs(_CLASS[0][codes])
    words = span_hashes(codes, starts, stops)
    text = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(text, minlength=n)
    at, counts, n_distinct = _distinct(words, text, n)
    again = np.bincount(text[1:], (words[1:] == words[:-1]) & (text[1:] == text[:-1]), n) if len(words) > 1 else np.zeros(n)
    line_a, line_b = runs(codes != 10)
    lines = span_hashes(codes, line_a, line_b)
    line_text = np.searchsorted(ends, line_a, "right")
    n_lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    distinct_lines = np.maximum(_distinct(lines, line_text, n)[2], 1)
    top = np.zeros(n)
    np.maximum.at(top, text[at], counts)
    some = np.maximum(n_words, 1)
    statistics = [
        np.log2(size + 1) / 20, np.log2(n_words + 1) / 18, letters / some / 16, capitals / size * 1.2, digits / size * 4, marks / size * 4,
        (blank - 1) / size * 2, n_distinct / some, again / some, top / some, distinct_lines / n_lines, np.log2(some / n_lines + 1) / 10,
        np.log2(np.maximum(recorded, 0) + 1) / 20,
    ]
    binned = np.stack([np.clip((s * BINS).astype(np.int64), 0, BINS - 1) + k * BINS for k, s in enumerate(statistics)], 1)
    n_binned = binned.shape[1]
    value = np.sqrt(counts)
    length = np.sqrt(np.bincount(text[at], value**2, n))
    value = value / length[text[at]]
    number = (mix64(words[at]) % np.uint64((1 << BITS) - n_binned * BINS)).astype(np.int64) + n_binned * BINS
    owner = np.concatenate((text[at], np.repeat(np.arange(n), n_binned)))
    order = np.argsort(owner, kind="stable")
    numbers = np.concatenate((number, binned.ravel()))[order]
    values = np.concatenate((value, np.full(n * n_binned, 0.4)))[order]
    return numbers, values, np.cumsum(np.bincount(owner, minlength=n))


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log odds of each row; time and memory linear in the number of features."""
        if not len(ends):
            return np.zeros(0)
        first = np.concatenate(([0], ends[:-1]))
        part = self.factors[numbers] * values[:, None]
        sums = np.add.reduceat(part, first)
        squares = np.add.reduceat((part**2).sum(1), first)
        linear = np.add.reduceat(self.weights[numbers] * values, first)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 11) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        weights = np.zeros(1 << BITS)
        factors = rng.normal(0, 0.05, (1 << BITS, RANK))
        share = float(np.mean([r[2] for r in rows])) if rows else 0.5
        model = cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))), weights, factors)
        if len({r[2] for r in rows}) < 2:
            factors *= 0
            return model
        grown_w, grown_v = np.full(1 << BITS, 1e-6), np.full((1 << BITS, RANK), 1e-6)
        rng.shuffle(rows)
        batches = []
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            flat, back = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
            sizes = [len(r[0]) for r in part]
            batches.append((flat, back, np.repeat(np.arange(len(part)), sizes), np.concatenate([r[1] for r in part]), np.cumsum(sizes), np.array([r[2] for r in part])))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for k in rng.permutation(len(batches)):
                flat, back, owner, value, ends, label = batches[k]
                numbers = flat[back]
                p = 1 / (1 + np.exp(-np.clip(model.margins(numbers, value, ends), -30, 30)))
                pull = (p - label) / len(label)
                part = factors[numbers] * value[:, None]
                sums = np.add.reduceat(part, np.concatenate(([0], ends[:-1])))
                each = pull[owner] * value
                to_w = np.bincount(back, each, len(flat)) + DECAY * weights[flat] / len(label)
                rest = each[:, None] * (sums[owner] - part)
                to_v = np.stack([np.bincount(back, rest[:, f], len(flat)) for f in range(RANK)], 1) + DECAY * factors[flat] / len(label)
                grown_w[flat] += to_w**2
                grown_v[flat] += to_v**2
                weights[flat] -= rate * to_w / np.sqrt(grown_w[flat])
                factors[flat] -= rate * 0.5 * to_v / np.sqrt(grown_v[flat])
                model.bias -= rate * float(pull.sum())
        return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> FactorisationMachine:
    """Fit on a bounded sample of labelled documents; only feature numbers and values come to the driver."""

    def rows(batches):
        for batch in batches:
            recorded = batch.column("n_chars").fill_null(0).to_numpy()
            numbers, values, ends = features(batch.column("text").to_pylist(), recorded)
            cuts = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (numbers.astype(np.int32), values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "at", "value"])

    sample = labelled_sample(docs, labels, label, ROWS_PER_CLASS, LONGEST)
    found = sample.mapInArrow(rows, "doc_id long, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    at, value = ([x.values.to_numpy() for x in found[c]] for c in ("at", "value"))
    return FactorisationMachine.fit([(a.astype(np.int64), v.astype(np.float64), int(y)) for a, v, y in zip(at, value, found["label"].to_numpy(), strict=True)])


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each whole text; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts, recorded = batch.column(1).to_pylist(), batch.column(2).fill_null(0).to_numpy()
            out = [model.margins(*features(texts[a:b], recorded[a:b])) for a, b in slices([len(t or "") for t in texts], 500_000)]
            z = np.clip(np.concatenate(out) if out else np.zeros(0), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), optional(docs, "n_chars", "long")]
    scored = docs.select(*columns).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels that are not held out and score all documents.

    Ids, labels, languages and sources are never inputs. A null or absent ``n_chars`` counts as 0; with labels of one class only,
    scores follow its share. Repeated rows each get a row; extra columns go; long texts are scored whole, in
    time that grows with them; an empty table gives no rows.
    """
    return score_quality(docs, fit_quality(docs, labels))
