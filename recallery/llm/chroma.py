"""Chroma fingerprints of audio columns and alignment of recordings [operator 9].

Samples become pitch-class frames; sums over rectangles of these (from an integral image) feed
contrast filters, whose two-bit results are packed into one integer for each frame. Two recordings are
aligned by the offsets at which their integers agree, and the best offsets are confirmed by counting
the bits that differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stored

RATE, FRAME, HOP = 4000, 1024, 256
SMOOTH = 3
#: share of differing bits up to which two recordings are the same
ERROR = 0.2
#: share of the shorter one of two recordings that an alignment has to cover
OVERLAP = 0.5
#: parts that the places of one code are dealt to
SALTS = 64
#: Sixteen filters by rule: every kind of contrast at four pitch positions, wider in time from one to the next
FILTERS = [(kind, 3 * k, 3 if kind != 2 else 4, (4, 8, 12, 16)[(k + kind) % 4]) for kind in range(4) for k in range(4)]
LEVELS = (-0.12, 0.0, 0.12)


def _pitch_classes() -> np.ndarray:
    """Weights of the spectrum's bins for twelve pitch classes, 55 Hz to the Nyquist frequency."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((12, len(hz)))
    use = np.flatnonzero(hz >= 55)
    out[np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12, use] = 1
    return out


_CLASSES = _pitch_classes()
_WINDOW = np.hanning(FRAME)


def chroma_frames(samples: np.ndarray) -> np.ndarray:
    """Energy of the pitch classes in overlapping frames, each frame scaled to unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    windows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _WINDOW
    energy = np.abs(np.fft.rfft(windows, axis=1)) ** 2 @ _CLASSES.T
    if len(energy) >= SMOOTH:
        total = np.concatenate((np.zeros((1, 12)), np.cumsum(energy, 0)))
        energy = (total[SMOOTH:] - total[:-SMOOTH]) / SMOOTH
    length = np.sqrt((energy**2).sum(1, keepdims=True))
    return energy / np.where(length > 1e-9, length, 1)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each position at which all filters fit."""
    frames = chroma_frames(np.asarray(samples, np.float64))
    widest = max(w for *_, w in FILTERS)
    n = len(frames) - widest + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1)  # pitch classes wrap around
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return (image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]) / ((t1 - t0) * (p1 - p0))

    codes = np.zeros(n, np.uint32)
    for kind, p, high, wide in FILTERS:
        if kind == 0:  # in time
            value = area(0, wide // 2, p, p + high) - area(wide // 2, wide, p, p + high)
        elif kind == 1:  # in pitch
            value = area(0, wide, p, p + high) - area(0, wide, p + high, p + 2 * high)
        elif kind == 2:  # crossed
            value = area(0, wide // 2, p, p + 2) + area(wide // 2, wide, p + 2, p + high) - area(wide // 2, wide, p, p + 2) - area(0, wide // 2, p + 2, p + high)
        else:  # middle against edges, in time
            value = area(wide // 4, 3 * wide // 4, p, p + high) - (area(0, wide // 4, p, p + high) + area(3 * wide // 4, wide, p, p + high)) / 2
        level = np.searchsorted(LEVELS, value).astype(np.uint32)
        codes = (codes << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return codes


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``rec_id, codes`` of rows ``rec_id, pcm`` (16-bit little-endian mono samples at ``RATE``).

    Null, short or odd-sized samples give what whole frames they have, maybe no code at all.
    """

    def codes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [fingerprint(np.frombuffer(p[: len(p) // 2 * 2], "<i2")) for p in (x.as_py() or b"" for x in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.view(np.int32) for c in found], pa.list_(pa.int32()))], ["rec_id", "codes"])

    plain = recordings.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("pcm").cast("binary").alias("pcm"))
    return plain.mapInArrow(codes, "rec_id long, codes array<int>")


def _places(df: DataFrame, name: str) -> DataFrame:
    """``name, code, <name>_at``: every place of each code."""
    return df.select(F.col("rec_id").alias(name), F.posexplode("codes").alias(f"{name}_at", "code"))


def align(excerpts: DataFrame, recordings: DataFrame, error: float = ERROR, overlap: float = OVERLAP) -> DataFrame:
    """For each excerpt the recording and the offset (in frames) with the fewest differing bits.

    Both have ``rec_id, codes``. Each different integer of an excerpt, at its first place, meets all places of the
    recordings that have it; a histogram of offsets counts those that agree, and every offset of a pair that has as many as any of that pair, or at
    least half as many, is verified on all its frames: at least ``overlap`` of the excerpt's must be covered (or of the
    recording's, if that is shorter), with no more than ``error`` of the bits differing. Ties go to more votes, then the
    smaller id, then the smaller offset. Excerpts without a match have no row. Equal recordings should be
    collapsed first (``recording_classes``). Long recordings meet by their codes alone; their frames move once for each
    offset that is verified.

    Codes are dealt to ``SALTS`` parts by recording and each excerpt's place goes to the parts that have its code,
    so that a code which most recordings have lands in no single task.
    """
    salted = _places(recordings, "rec").withColumn("salt", F.pmod(F.xxhash64("rec"), F.lit(SALTS)).cast("int"))
    sought = _places(excerpts, "query").groupBy("query", "code").agg(F.min("query_at").alias("query_at"))
    parts = salted.join(sought.select("code").distinct().hint("merge"), "code", "left_semi").groupBy("code", "salt").count().groupBy("code").agg(F.collect_list("salt").alias("salt"))
    met = sought.join(parts.hint("merge"), "code").withColumn("salt", F.explode("salt")).join(salted.hint("merge"), ["code", "salt"])
    votes = met.groupBy("query", "rec", (F.col("rec_at") - F.col("query_at")).alias("offset")).agg(F.count("*").alias("votes"))
    most = Window.partitionBy("query", "rec")
    pairs = votes.withColumn("most", F.max("votes").over(most)).where(2 * F.col("votes") >= F.col("most")).drop("most")
    both = pairs.join(excerpts.select(F.col("rec_id").alias("query"), F.col("codes").alias("sought")).hint("merge"), "query").join(
        recordings.select(F.col("rec_id").alias("rec"), "codes").hint("merge"), "rec"
    )
    first, start = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    n = F.least(F.size("sought") - first, F.size("codes") - start)
    part = lambda c, at: F.slice(c, at + 1, n)
    differ = F.aggregate(F.zip_with(part("sought", first), part("codes", start), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    judged = both.where((n > 0) & (n >= overlap * F.least(F.size("sought"), F.size("codes")))).withColumns({"frames": n, "bit_errors": differ})
    judged = judged.select("query", "rec", "offset", "votes", "frames", "bit_errors").where(F.col("bit_errors") <= error * 32 * F.col("frames"))
    order = Window.partitionBy("query").orderBy(F.col("bit_errors") / F.col("frames"), F.desc("votes"), "rec", "offset")
    return judged.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def recording_classes(prints: DataFrame) -> DataFrame:
    """``rec_id, class_id, codes``: recordings of equal codes share the smallest id of any."""
    keyed = prints.where("rec_id IS NOT NULL AND size(codes) > 0").withColumn("key", F.sha2(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))), 256))
    least = keyed.groupBy("key").agg(F.min("rec_id").alias("class_id"))
    return keyed.join(least, "key").select("rec_id", "class_id", "codes")


class _Instrument:
    """Sounds each component of a vector as a note with two overtones."""

    def __init__(self, seconds_per_note: float = 0.128):
        length = int(seconds_per_note * RATE)
        t = np.arange(length) / RATE
        fade = np.minimum(1, np.minimum(np.arange(length), np.arange(length)[::-1]) / 40)
        notes = np.stack([sum(np.sin(2 * np.pi * 110 * 2 ** (k / 12) * h * t) / h for h in (1, 2, 3)) * fade for k in range(24)])
        self.notes = (notes * 9000).astype("<i2")

    def play(self, vector: list | None) -> np.ndarray:
        x = np.nan_to_num(np.array([c or 0.0 for c in vector or []], np.float64))
        return self.notes[np.floor(np.clip(np.abs(x) * 80, 0, 23)).astype(int)].ravel() if len(x) else np.zeros(0, "<i2")


def excerpt(samples: np.ndarray, rec_id: int | None, seconds: float = 3.0, noise: float = 600.0) -> np.ndarray:
    """A noisy part of a recording, from a place that depends on its id."""
    seed = int(mix64(np.array([rec_id or 0], np.int64).view(np.uint64))[0])
    room = max(0, len(samples) - int(seconds * RATE))
    start = seed % (room // HOP + 1) * HOP
    part = samples[start : start + int(seconds * RATE)].astype(np.float64)
    return np.clip(part + np.random.default_rng(seed).normal(0, noise, len(part)), -32768, 32767).astype("<i2")


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def rendered(embeddings: DataFrame) -> DataFrame:
    """Recordings made from vectors, ``rec_id, pcm`` from ``vec_id, embedding``: the tables at hand hold no audio.

    Null vectors are silent.
    """

    def render(batches):
        instrument = _Instrument()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pcm = [instrument.play(v.as_py()).tobytes() for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary())], ["rec_id", "pcm"])

    return _vectors(embeddings).mapInArrow(render, "rec_id long, pcm binary")


def rendered_fingerprints(embeddings: DataFrame, as_excerpts: bool = False) -> DataFrame:
    """What ``fingerprints(rendered(..))`` gives, of the whole recordings or of their excerpts, without moving the samples."""

    def codes(batches):
        instrument = _Instrument()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                for rec_id, vector in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    samples = instrument.play(vector.as_py())
                    found.append(fingerprint(excerpt(samples, rec_id) if as_excerpts else samples).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["rec_id", "codes"])

    return _vectors(embeddings).mapInArrow(codes, "rec_id long, codes array<int>")


def identify(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """Render recordings, and for ids divisible by ``every`` find a noisy excerpt among all of them.

    Returns, for each such recording with codes, ``query_id``, its own class, the class found (null: none),
    the offset in frames, votes, frames and differing bits. Equal recordings are one class, searched
    once. Null ids take no part; repeated rows count once; an empty table gives no rows.
    """
    usable = embeddings.where("vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    # a third of the rows may be one vector: each different one is rendered once, by its smallest id
    vectors = usable.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    prints = stored(recording_classes(stored(rendered_fingerprints(vectors), "codes")), "prints")
    owner = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").join(
        vectors.select("embedding", F.col("vec_id").alias("rec_id")), "embedding"
    )
    asked = stored(owner.join(prints.select("rec_id", "class_id"), "rec_id").select("query_id", F.col("class_id").alias("own_class")), "asked")
    classes = prints.where("rec_id = class_id").select("rec_id", "codes")
    sought = vectors.join(asked.select(F.col("own_class").alias("vec_id")).distinct(), "vec_id", "left_semi")
    excerpts = stored(rendered_fingerprints(sought, as_excerpts=True), "excerpts")
    found = align(excerpts, classes)
    return asked.join(found, asked.own_class == found["query"], "left").select(
        "query_id", "own_class", F.col("rec").alias("found_class"), "offset", "votes", "frames", "bit_errors"
    )
