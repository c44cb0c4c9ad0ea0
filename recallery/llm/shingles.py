"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix64, runs, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Distinct shingles of ``words`` successive words of each text, sorted.

    A-Z are lower-cased; words are runs of characters other than space, tab, line and page breaks.
    A text with fewer words has its whole sequence as one shingle; without words, none.
    """
    raw = [(t or "").encode() for t in texts]
    codes = np.frombuffer(b" ".join(raw).lower(), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, stops = runs(~_SPACE[codes])
    hashes = span_hashes(codes, starts, stops)
    cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        joined = mix64(joined + hashes[k : k + len(joined)] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(b - a):
                whole = mix64(whole + hashes[a + k : a + k + 1] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
            out.append(mix64(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
