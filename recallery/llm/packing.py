"""Best-fit packing of token sequences with certified bin counts [operator 4]."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .encoders import END_ID, TextEncoder

CAPACITY = 1024
#: pieces that one packing task holds; a bound on memory, not on the result
ITEMS_PER_TASK = 50_000
#: times that partitions with a gap pool their open bins
EXCHANGES = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, final boolean, saved long, gap long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Pieces of a document of ``n`` tokens; only a first piece may be shorter than the capacity."""
    at = 0
    if n > capacity and n % capacity:
        at = n % capacity
        yield 0, at
    while at < n:
        yield at, min(capacity, n - at)
        at += capacity


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode each whole text (null: empty), append the end id and cut what is longer than ``capacity``."""

    def encode(batches):
        encoder = TextEncoder(tokenizer, word_ends=False)
        for batch in batches:
            rows, columns = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    for column, value in zip(columns, (k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that dual feasible functions leave possible.

    Two families: small items count nothing and those that leave no room for them count whole
    (one function for each threshold), and rounding down to multiples of 1/k (k up to 32).
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    eps = np.arange(0, capacity // 2 + 1)
    below = np.where(eps > 0, mass[eps - 1], 0)
    value = capacity * (many[-1] - many[capacity - eps]) + mass[capacity - eps] - below
    best = int((-(-value // capacity)).max())
    for k in range(1, 33):
        whole = (k + 1) * sizes % capacity == 0
        scaled = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n_bins


def _packer(turn: int, capacity: int):
    def pack(key, table):
        part = int(key[0].as_py())
        table = table.drop_columns(["part"]).sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])
        lengths = table["length"].to_numpy()
        bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
        before = table["sequence_id"].to_numpy() if turn else None
        used = len(np.unique(before)) if turn else n_bins
        if n_bins < used or not turn:
            sequence = bins + (turn << 56) + (part << 32)
        else:  # the earlier packing is as good: keep it
            sequence, offsets, n_bins = before, table["offset"].to_numpy(), used
            bins = np.unique(sequence, return_inverse=True)[1]
        gap = n_bins - lower_bound(lengths, capacity)
        full = np.bincount(bins, weights=lengths) >= capacity
        final = full[bins] | (gap == 0)
        n = len(lengths)
        out = {c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        out |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offsets, pa.int64()), "final": pa.array(final)}
        out |= {"saved": pa.array(np.full(n, used - n_bins)), "gap": pa.array(np.full(n, gap))}
        return pa.table(out)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, exchanges: int = EXCHANGES) -> DataFrame:
    """Place each piece: ``sequence_id`` and ``offset`` join the columns of ``token_pieces``.

    Each partition packs best-fit decreasing and is certified if its count equals its lower bound.
    The others keep their full bins and pool the documents of the open ones, whole bins dealt anew over fewer
    partitions, where they are packed again; a pooled packing is taken only if it has fewer bins. A gap that is
    left after ``exchanges`` rounds stays uncertified. Ties of length go by document and piece. Repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    rows = pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    n, done, parts = pieces.count(), [], None
    for turn in range(exchanges + 1):
        fewest = max(1, -(-n // items_per_task))
        parts = fewest if parts is None else max(1, min(fewest, parts // 2))
        # a bin's pieces stay together once they are placed, so that a packing is kept or replaced as a whole
        place = F.xxhash64("sequence_id", F.lit(turn)) if turn else F.xxhash64("doc_id", "piece")
        dealt = rows.withColumn("part", F.pmod(place, F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInArrow(_packer(turn, capacity), _PACKED), f"packed{turn}")
        left = packed.where("NOT final")
        n = left.count()
        if n == 0 or parts == 1 or turn == exchanges:
            done.append(packed)
            break
        done.append(packed.where("final"))
        rows = left.drop("final", "saved", "gap")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("final", "saved", "gap")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack whole documents.

    Null texts count as empty (one end id), null ids are packed like others, extra columns are left
    behind, very long texts give many full pieces; of equal lengths the smaller document is placed first.
    """
    return pack_pieces(token_pieces(docs, tokenizer, capacity), capacity)
