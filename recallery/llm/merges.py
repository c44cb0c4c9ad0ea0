"""Byte-pair merges over many words at once, in flat numpy arrays."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.iinfo(np.int32).max
#: symbols of a word from which on it is merged alone, by a heap of its pairs
LONG = 2000


class MergeTable:
    """Rank and product of each mergeable pair of symbols, in an open-addressed hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, product: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        order = np.lexsort((rank, keys))
        keys, rank, product = keys[order], rank[order], product[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        keys, rank, product = keys[first], rank[first], product[first]
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.product = np.zeros(size, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            at = (slot[todo] + self.probes) & (size - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            take, where = todo[free], at[free]
            where, one = np.unique(where, return_index=True)
            take = take[one]
            self.keys[where], self.rank[where], self.product[where] = keys[take], rank[take], product[take]
            todo = np.setdiff1d(todo, take, assume_unique=True)
            self.probes += 1
        # a product is late if pairs that it is part of rank above the merge that makes it: it may only be
        # made together with merges to its left, as its own pairs may come first
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        best = np.full(int(max(left.max(initial=0), right.max(initial=0), product.max(initial=0))) + 1, NONE, np.int64)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        made = np.full(len(best), -1, np.int64)
        np.maximum.at(made, product, rank)
        self.late = best <= made
        self.pairs: dict[int, tuple[int, int]] | None = None

    def pair_dict(self) -> dict[int, tuple[int, int]]:
        """Rank and product by ``left << 32 | right``, made when a long word is first met."""
        if self.pairs is None:
            used = self.keys != np.uint64(2**64 - 1)
            self.pairs = dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.product[used].tolist(), strict=True), strict=True))
        return self.pairs

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, mask = self._slot(keys), len(self.keys) - 1
        rank = np.full(len(keys), NONE, np.int32)
        product = np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        for step in range(self.probes):
            at = (slot[todo] + step) & mask
            there = self.keys[at]
            hit = there == keys[todo]
            rank[todo[hit]], product[todo[hit]] = self.rank[at[hit]], self.product[at[hit]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
            if not len(todo):
                break
        return rank, product


def merge_long(symbols: np.ndarray, table: MergeTable) -> list[int]:
    """One long word, merged pair by pair: a heap gives the leftmost pair of the lowest rank."""
    sym, n, pairs = symbols.tolist(), len(symbols), table.pair_dict()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, product = table.look(symbols[:-1], symbols[1:])
    heap = [(r, i, sym[i], sym[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), product.tolist(), strict=True)) if r != NONE]
    heapify(heap)
    while heap:
        _, i, a, b, p = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:  # one of the two has merged since
            continue
        sym[i], sym[j], k = p, -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (found := pairs.get(sym[x] << 32 | sym[y])):
                heappush(heap, (found[0], x, sym[x], sym[y], found[1]))
    return [s for s in sym if s >= 0]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge each word until none of its pairs can merge; returns symbols and lengths, words in order.

    Every round takes, in all words at once, the word's pairs of its lowest rank from the left, those that do
    not overlap, up to the first whose product may merge on before them; it joins these and compacts the arrays. This is
    what merging one pair at a time in a single word gives. Words of ``LONG`` symbols or more merge alone.
    """
    n_words, lengths = len(lengths), np.asarray(lengths)
    long = np.flatnonzero(lengths >= LONG)
    if len(long):
        ends = np.cumsum(lengths)
        alone = {w: np.array(merge_long(symbols[ends[w] - lengths[w] : ends[w]].astype(np.int32), table), np.int32) for w in long.tolist()}
        inside = np.repeat(lengths < LONG, lengths)
        sym, counts = merge_rounds(symbols[inside], np.where(lengths < LONG, lengths, 0), table)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        out, last = [], 0
        for w, ids in alone.items():
            out += [sym[last : cuts[w]], ids]
            last = cuts[w]
            counts[w] = len(ids)
        return np.concatenate([*out, sym[last:]]), counts
    sym = symbols.astype(np.int32)
    word = np.repeat(np.arange(n_words, dtype=np.int32), lengths)
    rank = np.full(len(sym), NONE, np.int32)
    product = np.zeros(len(sym), np.int32)
    pair = np.flatnonzero(word[:-1] == word[1:]) if len(sym) else np.zeros(0, np.int64)
    rank[pair], product[pair] = table.look(sym[pair], sym[pair + 1])
    done_sym, done_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lens = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        over = least == NONE
        if over.any():
            gone = np.repeat(over, lens)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            stay = ~gone
            sym, word, rank, product = sym[stay], word[stay], rank[stay], product[stay]
            if not len(sym):
                break
            least, lens = least[~over], lens[~over]
        at = np.flatnonzero(rank == np.repeat(least, lens))
        nth, new_word = np.arange(len(at)), np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
        if not new_word.all():
            # of pairs that follow each other every second one overlaps with the one taken before it
            run = np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1)), nth, 0))
            at = at[(nth - run) % 2 == 0]
            new_word = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            late = np.cumsum(table.late[product[at]])
            before = late - table.late[product[at]]
            at = at[before == np.repeat(before[new_word], np.diff(np.append(np.flatnonzero(new_word), len(at))))]
        sym[at] = product[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol less before each later pair
        sym, word, rank, product = sym[keep], word[keep], rank[keep], product[keep]
        rank[at] = NONE
        inner = at[at > 0]
        rank[inner - 1] = np.where(word[inner - 1] == word[inner], NONE, rank[inner - 1])
        new = np.concatenate((inner - 1, at))
        new = new[new < len(sym) - 1]
        new = new[word[new] == word[new + 1]]
        rank[new], product[new] = table.look(sym[new], sym[new + 1])
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)
