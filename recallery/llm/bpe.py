"""Byte-level BPE encoding and decoding by a pair occurrence index [operator 13].

All new words of a stretch of a partition lie in one flat array of symbols. An index maps each pair to all its positions in
it, and the active pairs are applied in ascending rank: each position that still holds the pair merges, and the two
pairs that a merge makes with its neighbours enter their lists. A vocabulary whose merges only join what earlier
merges made never sends this order back, so it gives what merging word by word gives.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .encoders import byte_letters
from .merges import NONE, MergeTable
from .pieces import Strings

#: positions of a pair from which on they merge in numpy
MANY = 64
#: how byte-level vocabularies cut a text into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairIndex:
    """The merges of a vocabulary, and their use over many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges``: left, right and product of each rank, in ascending order."""
        self.merges, self.width = merges, 1 + max((max(m) for m in merges), default=0)
        made: dict[int, int] = {}
        for rank, (_, _, product) in enumerate(merges):
            made.setdefault(product, rank)
        if len(made) < len(merges) or any(made.get(part, -1) >= rank for rank, (a, b, _) in enumerate(merges) for part in (a, b)):
            raise ValueError("merges must join what earlier merges made, each into a product of its own")
        self.rank_of = {a * self.width + b: rank for rank, (a, b, _) in enumerate(merges)}
        columns = [np.array(c, np.int64) for c in zip(*merges, strict=True)] if merges else [np.zeros(0, np.int64)] * 3
        self.table = MergeTable(columns[0], columns[1], np.arange(len(merges), dtype=np.int32), columns[2].astype(np.int32))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their number in each word, words in order."""
        n, ends = len(symbols), np.cumsum(lengths)
        follows, leads = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        filled = np.asarray(lengths) > 0
        follows[ends[filled] - 1], leads[(ends - lengths)[filled]] = n, -1
        follows[n] = n
        sym, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (np.append(symbols, -1), follows, leads))
        at = np.flatnonzero(follows[:n] < n)
        rank, _ = self.table.look(symbols[at], symbols[at + 1])
        at, rank = at[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")  # positions of each pair, from the left
        at, rank = at[order].astype(np.int32), rank[order]
        cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(at)]
        # positions of each pair: those of the start as a slice, those that merges make in a list
        first = {int(rank[x]): (x, y) for x, y in zip(cuts, cuts[1:], strict=False)}
        later: dict[int, list[int]] = {}
        active, rank_of, width = list(first), self.rank_of, self.width
        heapify(active)
        flat = tuple(np.frombuffer(x, np.int32) for x in (sym, after, before))  # the same memory

        def enter(found: int, places: list[int]) -> None:
            if found in later:
                later[found] += places
            else:
                if found not in first:
                    heappush(active, found)
                later[found] = places

        while active:
            r = heappop(active)
            a, b, product = self.merges[r]
            begin, end = first.pop(r, (0, 0))
            places = at[begin:end].tolist() + later.pop(r, [])
            if a != b and len(places) >= MANY:
                for found, new in self._merge_all(np.array(places, np.int64), a, b, product, *flat):
                    enter(found, new)
                continue
            if a == b:  # of overlapping ones the leftmost merges
                places.sort()
            for i in places:
                j = after[i]
                if sym[i] != a or sym[j] != b:  # one of the two has merged since
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j], after[i], before[k] = product, -1, k, i
                if h >= 0 and (found := rank_of.get(sym[h] * width + product)) is not None:
                    enter(found, [h])
                if k < n and (found := rank_of.get(product * width + sym[k])) is not None:
                    enter(found, [i])
        merged = np.frombuffer(sym, np.int32)[:n]
        kept = merged >= 0
        word = np.repeat(np.arange(len(lengths)), lengths)[kept]
        return merged[kept], np.bincount(word, minlength=len(lengths))

    def _merge_all(self, i: np.ndarray, a: int, b: int, product: int, sym: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Merges a pair of two different symbols at many positions together (they cannot overlap); gives the new pairs' ranks and positions."""
        i = i[(sym[i] == a) & (sym[after[i]] == b)]
        j, n = after[i], len(sym) - 1
        k, h = after[j], before[i]
        sym[i], sym[j], after[i], before[k] = product, -1, k, i
        place = np.concatenate((h[h >= 0], i[k < n]))  # twice where two products meet, which does no harm
        rank, _ = self.table.look(sym[place], sym[after[place]])
        place, rank = place[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")
        place, rank = place[order].tolist(), rank[order]
        cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(place)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield int(rank[x]), place[x:y]


class ByteCodec:
    """Ids and texts as the tokenizers library gives them for a byte-level BPE file, special tokens in the text included.

    For files without normaliser, prefix space, dropout and ignored merges. The library's and this module's tables of
    letters and digits are of different Unicode versions: a character is compared in both when it is first met,
    and texts with one on which they differ are cut into words by the library. ``cache_words`` bounds memory only.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutter, special = file["model"], file["pre_tokenizer"], file["added_tokens"]
        odd = file["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if odd or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        vocab, letters = model["vocab"], byte_letters()
        self.cut, self.library = regex.compile(WORDS), Tokenizer.from_file(path).pre_tokenizer
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"]))) + ")") if special else None
        self.symbol = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.symbol[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        texts = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in special)]))
        for token, i in vocab.items():
            texts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.known: dict[str, bytes] = {}
        for t in special:
            texts[t["id"]] = t["content"].encode()
            self.known[t["content"]] = np.array([t["id"]], "<i4").tobytes()
        self.texts, self.digits = Strings(texts), Strings([b"%d," % i for i in range(len(texts))])
        self.limit, self.same, self.different = cache_words, set(), set()
        self._plain_words()

    def _plain_words(self) -> None:
        """The same cut for Latin letters alone, for the faster of the two regular expression engines, and what is not for it."""
        chars = [chr(c) for c in range(0x250)]
        for c in chars:
            self._agree(c)
        kind = lambda test: "".join(re.escape(c) for c in chars if c in self.same and test(c))
        letters, digits, spaces = kind(lambda c: unicodedata.category(c)[0] == "L"), kind(lambda c: unicodedata.category(c)[0] == "N"), kind(lambda c: regex.match(r"\s", c))
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
        self.foreign = re.compile(f"[^{kind(lambda c: True)}]")

    def _agree(self, text: str) -> bool:
        """Whether both Unicode tables class all characters of the text alike."""
        met = set(text)
        for c in met - self.same - self.different:
            probe = f"a{c}1{c}!{c}"
            alike = [span for _, span in self.library.pre_tokenize_str(probe)] == [m.span() for m in self.cut.finditer(probe)]
            (self.same if alike else self.different).add(c)
        return not met & self.different

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens on their own."""
        parts = [p for p in self.special.split(text) if p] if self.special else [text]
        out = []
        for p in parts:
            if self.special and self.special.fullmatch(p):
                out.append(p)
            elif not self.foreign.search(p):
                out += self.plain.findall(p)
            elif self._agree(p):
                out += self.cut.findall(p)
            else:
                out += [p[a:b] for _, (a, b) in self.library.pre_tokenize_str(p)]
        return out

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        symbols = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts = self.index.merge(symbols, np.array([len(r) for r in raw], np.int64))
        flat, at = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *at], at, strict=False)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        known, parts = self.known, [self.words(t) for t in texts]
        missing = list(dict.fromkeys([w for p in parts for w in p if w not in known]))
        fresh = self._merge(missing) if missing else {}
        room = self.limit - len(known)
        if room > 0:
            known.update([x for x in fresh.items() if len(x[0]) <= 40][:room])
        return [np.frombuffer(b"".join([known[w] if w in known else fresh[w] for w in p]), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.texts.join(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return self.digits.join(ids)[:-1]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_bytes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` of each whole text (null: empty)."""

    def encode(batches):
        codec = ByteCodec(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 4_000_000):
                ids = codec.encode_batch(texts[a:b])
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return _plain(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_bytes(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give an empty text."""

    def decode(batches):
        codec = ByteCodec(tokenizer)
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def byte_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Count and SHA-256 of each text's ids and SHA-256 of what they decode to.

    Null and empty texts have no ids; repeated rows each give a row, a null ``doc_id`` stays null; extra columns go; an
    empty table gives no rows. Long texts are read whole, a few at a time; a long word merges in the same index,
    its time grows with the number of its merges.
    """

    def digest(batches):
        codec = ByteCodec(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 4_000_000):
                rows = [
                    (len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    for ids in codec.encode_batch(texts[a:b])
                ]
                n, one, two = zip(*rows, strict=True)
                arrays = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
