"""Text to token ids, equal to the tokenizers library's for its two byte-pair vocabularies.

The library takes about a CPU second for a megabyte of text with many invented words. So ordinary
texts go through tiktoken, with ranks read from the same vocabulary file, and only unusual texts
through the library itself; batches for a vocabulary of words encode each different word once. Tests compare both on whole tables and on random strings.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

END_ID = 2
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOWER = "a-zß-öø-ÿ"
#: letters that NFC and lower-casing treat one by one, ASCII digits and marks, plain white space
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-/:-@\[-`{-~ \n\t\r]*")
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LOWER}]+|[0-9]|[!-/:-@\[-`{{-~]+")
_MARK = "\x01"
#: kinds of the UTF-8 bytes of plain texts: their letters beyond ASCII are a byte C3 and one of 80 to BF, but for the two signs at 97 and B7
_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*b" \n\t\r"]] = _WHITE
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c == 0xC3 or 0x80 <= c <= 0xBF and c not in (0x97, 0xB7)]] = _LETTER
_LOWERED = np.array([c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E else c for c in range(256)], np.uint8)


def _word_starts(text: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where a word of ``_WORDS`` starts, in lower-case plain bytes that end with two bytes of white space."""
    starts = kind != _WHITE
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero(starts & (text == ord("'")))
    quote = quote[kind[quote + 1] == _LETTER]
    one, two = text[quote + 1], text[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for length, at in ((2, quote[short]), (3, quote[long])):
        starts[at + 1] = False
        starts[at + length] |= kind[at + length] == _LETTER
    return starts


def byte_letters() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            out[chr(256 + len(out) - len(own))] = b
    return out


class TextEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``word_ends``: the vocabulary has lower-case words with an end mark and no white space.
    Such words are handed to tiktoken with a control character in the place of the end mark.
    """

    def __init__(self, path: str, word_ends: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.word_ends = Tokenizer.from_file(path), word_ends
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters, ranks = byte_letters(), {}
        for token, rank in vocab.items():
            end = word_ends and token.endswith("</w>")
            body = token[:-4] if end else token
            if all(c in letters for c in body) and body:
                key = bytes(letters[c] for c in body)
                if not word_ends or b"\x01" not in key:
                    ranks[key + b"\x01" * end] = rank
        if word_ends:
            spare = max(vocab.values()) + 1
            ranks = {k: v for k, v in ranks.items() if v < spare}
            ranks[b"\x01"] = spare  # never left over: each byte with an end mark is in the vocabulary
        pattern = r"[^\x01]+\x01" if word_ends else _SPACED
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ends_word = np.zeros(max(ranks.values()) + 1, bool)
        self.ends_word[[rank for token, rank in ranks.items() if token.endswith(b"\x01")]] = True

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of a whole text, without an end id."""
        if "<|" not in text and (not self.word_ends or _PLAIN.fullmatch(text)):
            if self.word_ends:
                words = _WORDS.findall(text.lower())
                if not words:
                    return np.zeros(0, np.uint32)
                text = _MARK.join(words) + _MARK
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) for a vocabulary of words, each with the end id appended, and the number of ids of each.

        Words are cut by kinds of bytes, and each different word of the batch is encoded once.
        """
        text = np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = _KIND[text]
        special = (text[:-1] == ord("<")) & (text[1:] == ord("|"))
        odd = np.unique(np.searchsorted(stops, np.concatenate((np.flatnonzero(kind == _ODD), np.flatnonzero(special)))))
        for k in odd.tolist():
            kind[stops[k] - len(texts[k]) : stops[k]] = _WHITE
        text = _LOWERED[text]
        starts = _word_starts(text, kind)
        kept = kind != _WHITE
        cuts = np.append(np.flatnonzero(starts[kept]), np.count_nonzero(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text[kept])]).dictionary_encode()
        mark = _MARK.encode()
        known = b"".join(w + mark for w in words.dictionary.to_pylist()).decode()
        ids = self.fast.encode_to_numpy(known, disallowed_special=()).astype(np.uint32, copy=False)
        own = [np.array(self.library.encode(texts[k].decode(), add_special_tokens=False).ids, np.uint32) for k in odd.tolist()]
        first = len(words.dictionary)  # the entries after the words: odd texts, then the end id
        entries = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(self.ends_word[ids]) + 1, len(ids) + np.cumsum([*map(len, own), 1])))
        lists = pa.ListArray.from_arrays(pa.array(entries.astype(np.int32)), pa.array(np.concatenate((ids, *own, [END_ID])).astype(np.uint32)))
        before = np.searchsorted(np.flatnonzero(starts), stops)  # words up to the end of each text
        end = first + len(odd)
        more = np.argsort(np.concatenate((2 * odd, 2 * np.arange(len(texts)) + 1)))  # an odd text before its end id
        places, added = np.concatenate((before[odd], before))[more], np.concatenate((np.arange(first, end), np.full(len(texts), end)))[more]
        order = np.insert(words.indices.to_numpy(), places, added)
        last = np.cumsum(np.diff(entries)[order])[order == end]
        return lists.take(pa.array(order)).flatten().to_numpy(), np.diff(last, prepend=0)
