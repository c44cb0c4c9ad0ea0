"""SentencePiece encoding and decoding by vectorised merge rounds [operator 7]."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .merges import MergeTable, merge_rounds

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_UNEVEN = re.compile(f"  |^ | $|{SPACE}")
#: symbols of characters that have no piece of their own
_FOREIGN = 1_000_000


class Strings:
    """A byte string for each id, joined for whole id arrays at once."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.at[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


class PieceCodec:
    """Ids and texts as the sentencepiece library gives them for a byte-pair model.

    For models with identity normalisation, a dummy prefix and byte fallback, in which no piece has
    a space mark after another character: then words (with their leading marks) merge on their own.
    ``cache_words`` bounds memory only.
    """

    def __init__(self, path: str, end_id: int = 2, cache_words: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        normal = [i for i in range(n) if i not in special]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces of this model cross word boundaries")
        self.end_id, self.limit = end_id, cache_words
        self.bytes_at = next(i for i in range(n) if pieces[i] == "<0x00>")
        self.symbol = np.arange(0x110000, dtype=np.int32) + _FOREIGN
        of: dict[str, int] = {}
        for i in normal:
            if len(pieces[i]) == 1:
                self.symbol[ord(pieces[i])] = i
            of.setdefault(pieces[i], i)
        scores = {i: model.get_score(i) for i in normal}
        level = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        left, right, rank, product = [], [], [], []
        single = {c: int(self.symbol[ord(c)]) for i in normal for c in pieces[i]}
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                a = single[p[0]] if k == 1 else of.get(p[:k])
                b = single[p[-1]] if k == len(p) - 1 else of.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(level[scores[i]]), product.append(i)
        self.table = MergeTable(*(np.array(x, np.int64) for x in (left, right)), *(np.array(x, np.int32) for x in (rank, product)))
        texts = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                texts.append(bytes([int(p[3:5], 16)]))
            elif model.is_unknown(i):
                texts.append(" ⁇ ".encode())
            else:
                texts.append(b"" if model.is_control(i) else p.replace(SPACE, " ").encode())
        self.texts, self.digits = Strings(texts), Strings([b"%d " % i for i in range(n)])
        self.known: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words (each with its leading marks), merged all together."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = merge_rounds(self.symbol[codes], lengths, self.table)
        if len(ids) and ids.max() >= _FOREIGN:  # characters without a piece become bytes
            foreign = np.flatnonzero(ids >= _FOREIGN)
            raw = [chr(c).encode() for c in (ids[foreign] - _FOREIGN).tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[foreign] = [len(r) for r in raw]
            word = np.repeat(np.arange(len(words)), counts)
            counts = np.bincount(word, weights=sizes, minlength=len(words)).astype(np.int64)
            out = np.repeat(ids, sizes)
            out[np.repeat(ids >= _FOREIGN, sizes)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.bytes_at
            ids = out
        flat, at = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *at], at, strict=False)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        known, parts = self.known, []
        for t in texts:
            if not t:
                parts.append([])
            elif _UNEVEN.search(t):
                words = _RUNS.findall(SPACE + t.replace(" ", SPACE))
                parts.append([w[1:] if w[0] == SPACE and w[1:2] != SPACE and len(w) > 1 else SPACE + w for w in words])
            else:
                parts.append(t.split(" "))
        # a key without a mark stands for the word after one mark; otherwise the first mark is extra
        missing = list(dict.fromkeys([w for p in parts for w in p if w not in known]))
        words = [w[1:] if w[0] == SPACE else SPACE + w for w in missing]
        merged = self._merge(words) if words else {}
        fresh = {k: merged[w] for k, w in zip(missing, words, strict=True)}
        room = self.limit - len(known)
        if room > 0:
            known.update([x for x in fresh.items() if len(x[0]) <= 40][:room])
        end, out = np.array([self.end_id], "<i4").tobytes(), []
        for p in parts:
            try:
                raw = b"".join([known[w] for w in p])
            except KeyError:
                raw = b"".join([known[w] if w in known else fresh[w] for w in p])
            out.append(np.frombuffer(raw + end, "<i4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space of the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        raw = self.texts.join(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by single spaces."""
        return self.digits.join(ids)[:-1]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of each whole text (null: empty), ending with the end id."""

    def encode(batches):
        codec = PieceCodec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 2_000_000):
                ids = codec.encode_batch(texts[a:b])
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return _plain(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give an empty text."""

    def decode(batches):
        codec = PieceCodec(model)
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Count and SHA-256 of each text's ids and SHA-256 of what they decode to.

    Null and empty texts have the end id alone; repeated rows each give a row; extra columns go; an
    empty table gives no rows. Long texts are read whole, a few at a time; the time of a long word grows with n log n.
    """

    def digest(batches):
        codec = PieceCodec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 2_000_000):
                rows = [
                    (len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    for ids in codec.encode_batch(texts[a:b])
                ]
                n, one, two = zip(*rows, strict=True)
                arrays = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
