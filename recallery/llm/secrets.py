"""Secret scan: candidates by pattern, false positives removed by a random forest [operator 8]."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[SECRET]"
TREES, DEPTH, LEAST = 40, 9, 3
#: bound on the labelled findings that the forest is fitted on
FINDINGS = 6000

_RUN = re.compile(r"(?<![A-Za-z0-9_+/=\-])[A-Za-z0-9_+/=\-]{16,}")
_ASSIGNS = re.compile(r"[=:]>?\s{0,3}")
#: what is assigned: up to the closing quote of its line, escapes inside it, or else up to white space
_QUOTED = re.compile(r"([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
_BARE = re.compile(r"[\"'`]?(\S{8,})")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|credential)s?\w{0,12}[\"'\]]?\s{0,3}$")
#: to the END line, whatever stands between (headers, escaped line ends); where there is none, headers and lines of a key's
#: alphabet: long ones, then maybe a short last one that fills its line
_PRIVATE = re.compile(
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\+[nrt])+(?:[A-Z][A-Za-z]*-[A-Za-z-]+: ?[^\n\\]*|[A-Za-z0-9+/]{32,}={0,2}))*(?:(?<=[A-Za-z0-9+/]{32})(?:\s|\\+[nrt])+[A-Za-z0-9+/]{1,31}={0,2}(?=\s*(?:\n|\Z|\\+n)))?)"
)
_KNOWN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|xox[abprs]-[A-Za-z0-9-]{10,}$|sk_live_[A-Za-z0-9]{16,}$|eyJ[A-Za-z0-9_-]{10,}")
#: the same forms after a separator inside a longer run
_KNOWN_INSIDE = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9_])"
    r"|(?<==)eyJ[A-Za-z0-9_-]{10,}+|(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}+(?=\.)"
)
_SECRET_WORD = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|bearer")
_HARMLESS_WORD = re.compile(r"(?i)commit|sha|md5|hash|checksum|digest|revision|uuid|guid|etag|id\b|card|order|phone|isbn|example|sample|placeholder")
_HARMLESS_PATH = re.compile(r"(?i)test|spec|fixture|example|sample|mock|doc|vendor|lock")
_PLACEHOLDER = re.compile(r"(?i)example|sample|changeme|placeholder|your|dummy|xxxx|0000|1234567|test|lorem|foobar|redacted")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_PART = re.compile(r"[^\W\d_]{3,}")
#: Plain words for dictionary coverage, beside the words of the text itself
WORDS = (
    "about after all and are back because been before being between both but can case come could data day did each end even "
    "file find first for from get give good great had has have here home how into just key know large last like line list "
    "long look made make many may more most much must name need never new next not now number off old one only open order "
    "other our out over page part people place point port project read right run same say see server set should show side "
    "small some state still such system take test text than that the their them then there these they thing this those time "
    "true two type under until use user value very want was way well were what when where which while who will with word "
    "work world would write year you your access account admin config default value directory example image index service"
).split()


def _around(a: int, b: int, inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span outside those inside it."""
    edges = [a, *(x for span in inside for x in span), b]
    return list(zip(edges[::2], edges[1::2], strict=True))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and rule of what looks like a secret, in order and without overlap.

    A value assigned to a telling name ends at its own closing quote, whatever stands inside; without quotes, at white space.
    """
    spans = [(m.start(), m.end(), "private_key") for m in _PRIVATE.finditer(text)] if "PRIVATE KEY" in text else []
    known = [m.span() for m in _KNOWN_INSIDE.finditer(text)]
    starts = [a for a, _ in known]
    within = lambda a, b: [k for k in known[bisect_left(starts, a) : bisect_left(starts, b)] if k[1] <= b]
    at, unclosed = 0, dict.fromkeys("\"'`", 0)
    while m := _ASSIGNS.search(text, at):
        at = m.start() + 1
        if not _NAMED.search(text, max(0, m.start() - 48), m.start()):
            continue
        quote = text[m.end() : m.end() + 1]
        quoted = _QUOTED.match(text, m.end()) if unclosed.get(quote, len(text)) <= m.end() else None
        if quoted:
            at = quoted.end()
            if quoted.end(2) - quoted.start(2) >= 8:
                spans.append((*quoted.span(2), "assigned"))
            continue
        if quote in unclosed and unclosed[quote] <= m.end():  # no such quote closes on this line: not looked for again
            end = text.find("\n", m.end())
            unclosed[quote] = len(text) if end < 0 else end
        if value := _BARE.match(text, m.end()):
            at = value.end()
            inside = [] if _KNOWN.match(value.group(1)) else within(*value.span(1))
            spans += [(a, b, "assigned") for a, b in _around(*value.span(1), inside) if b - a >= 8]
    spans += [(a, b, "known_form") for a, b in known]
    for m in _RUN.finditer(text):
        if _KNOWN.match(m.group()):
            spans.append((m.start(), m.end(), "known_form"))
            continue
        for a, b in _around(m.start(), m.end(), within(m.start(), m.end())):
            token = text[a:b]
            if b - a >= 16 and any(c.isdigit() for c in token) and not token.isdigit():
                spans.append((a, b, "random_run"))
    rank = {"private_key": 0, "assigned": 1, "known_form": 2, "random_run": 3}
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text) if len(spans) > 1 else 0)
    for a, b, rule in sorted(spans, key=lambda s: (rank[s[2]], s[0], -s[1])):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, rule))
    return sorted(out)


def _transitions() -> np.ndarray:
    """Log odds of letter pairs in plain words against a uniform choice."""
    counts = np.full((27, 27), 0.5)
    for w in WORDS:
        codes = [ord(c) - 96 for c in w]
        for a, b in zip([0, *codes], [*codes, 0], strict=True):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True) * 27)


_ODDS = _transitions()


def describe(value: str, before: str, after: str, path: str, own_words: set[str]) -> list[float]:
    """Features: length, character classes and transitions, dictionary coverage, path, neighbouring words."""
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    shares = [kinds.count(k) / n for k in "duls"]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    counts = np.array([value.count(c) for c in set(value)] or [1]) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in value.lower()]
    letters = [(a, b) for a, b in zip(codes, codes[1:], strict=False) if a and b]
    odds = sum(_ODDS[a, b] for a, b in letters) / max(1, len(letters))
    parts = _PART.findall(value)
    covered = sum(len(p) for p in parts if p.lower() in own_words) / n
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    repeats = sum(a == b for a, b in zip(value, value[1:], strict=False)) / n
    near = before[-40:]
    named = bool(_NAMED.search(re.sub(r"\s*[=:]>?\s*[\"'`]?$", "", near)))
    return [
        np.log2(n), *shares, changes, entropy, entropy / np.log2(n + 1), odds, covered, max(map(len, parts), default=0) / n, hexes, repeats,
        float(bool(_KNOWN.match(value))), float(bool(_UUID.match(value))), float(bool(_PLACEHOLDER.search(value))), float(n in (32, 40, 64)),
        float(named), float(bool(_SECRET_WORD.search(near))), float(bool(_HARMLESS_WORD.search(near))), float(near[-1:] in "\"'`" and near != ""),
        float(bool(re.search(r"[=:]>?\s*[\"'`]?$", near))), float(bool(_HARMLESS_PATH.search(path))), float(bool(_HARMLESS_WORD.search(after[:30]))),
        float(value.startswith("-----BEGIN")),
    ]


class Forest:
    """Random forest of binary trees: bootstrap rows, random features at each node, Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng) for _ in range(TREES)]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Nodes as rows: feature (-1: leaf), threshold, left, right, share of positives."""
        nodes: list[list[float]] = []
        todo = [(rng.integers(0, len(x), len(x)), 0, -1, 0)]
        tries = max(1, int(np.ceil(np.sqrt(x.shape[1])))) + 1
        while todo:
            rows, depth, parent, side = todo.pop()
            me, labels = len(nodes), y[rows]
            nodes.append([-1, 0, 0, 0, labels.mean()])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if depth == DEPTH or len(rows) < 2 * LEAST or labels.min() == labels.max():
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                value, ones = x[rows, f][order], np.cumsum(labels[order])
                k = np.arange(1, len(rows))
                cut = (value[1:] > value[:-1]) & (k >= LEAST) & (len(rows) - k >= LEAST)
                if cut.any():
                    a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(rows) - k)
                    impurity = np.where(cut, k * a * (1 - a) + (len(rows) - k) * b * (1 - b), np.inf)
                    at = int(impurity.argmin())
                    if impurity[at] < best[0]:
                        best = (impurity[at], f, min((value[at] + value[at + 1]) / 2, np.nextafter(value[at + 1], value[at])))
            if best[1] >= 0:
                nodes[me][:2] = best[1], best[2]
                left = x[rows, best[1]] <= best[2]
                todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
        return np.array(nodes)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                feature = nodes[at, 0].astype(np.int64)
                right = x[np.arange(len(x)), np.maximum(feature, 0)] > nodes[at, 1]
                at = np.where(feature < 0, at, nodes[at, 2 + right].astype(np.int64) if len(x) else at)
            total += nodes[at, 4]
        return total / len(self.trees)


def labelled_findings(n: int = FINDINGS, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """Findings made by rule: value, text before and after, path, and whether it is a secret.

    Real triage decisions of the same five columns can be given to ``fit_forest`` in their place.
    """
    rng = np.random.default_rng(seed)
    pick = lambda items: items[rng.integers(len(items))]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    hexes, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + "0123456789"
    names = ["token", "api_key", "secret", "password", "access_key", "AUTH_TOKEN", "client_secret", "apikey", "SECRET_KEY", "passwd"]
    words = lambda k: " ".join(pick(WORDS) for _ in range(k))
    syllable = lambda: draw("bcdfghklmnprstv", 1) + draw("aeiou", 1) + draw("nrst", int(rng.integers(0, 2)))
    invented = lambda: "".join(syllable() for _ in range(rng.integers(5, 11)))
    out = []
    for _ in range(n):
        quote = pick(['"', "'", ""])
        secret = bool(rng.integers(2))
        if secret:
            kind = rng.integers(11)
            value = [
                lambda: draw(hexes, int(pick([32, 40, 48, 64]))), lambda: draw(mixed, int(rng.integers(20, 48))), lambda: draw(mixed + "+/", int(rng.integers(24, 64))),
                lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: pick(["ghp_", "gho_"]) + draw(mixed, 36),
                lambda: "sk_live_" + draw(mixed, 24), lambda: draw(mixed + "!@#$%^&*", int(rng.integers(10, 20))),
                lambda: draw(mixed + "-_", int(rng.integers(64, 400))), lambda: ".".join(["eyJ" + draw(mixed, 30), draw(mixed + "-_", 80), draw(mixed + "-_", 43)]),
                lambda: f"-----BEGIN {pick(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n" + "\n".join(draw(mixed + "+/", 64) for _ in range(rng.integers(0, 20))),
                lambda: draw(mixed + "!#$%&()*+,-./:;<=>?@[]^_{|}~ ", int(rng.integers(10, 50))),
            ][kind]()
            bare = kind == 9 or (kind in (3, 4, 5, 8) and rng.random() < 0.5)
            before = words(3) + (" " if bare else f" {pick(names)}{pick([' = ', '=', ': ', ' := '])}{quote}")
        else:
            kind = rng.integers(10)
            value, before = [
                lambda: (draw(hexes, 40), words(2) + pick([" commit ", " revision ", " sha1: "])),
                lambda: (draw(hexes, int(pick([32, 64]))), words(2) + pick([" md5 ", " checksum: ", " sha256:", " etag "])),
                lambda: ("-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), words(2) + pick([" uuid ", " id=", " request "])),
                lambda: (pick(["your_api_key_here", "EXAMPLE" + draw(mixed, 12), "changeme123456", "xxxxxxxxxxxxxxxx1", "test_token_1234567"]), words(2) + f" {pick(names)} = {quote}"),
                lambda: (invented() + draw("0123456789", 2), words(4) + " "),
                lambda: ("_".join(pick(WORDS) for _ in range(5)) + draw("0123456789", 2), words(2) + pick([" ", " = ", " path: "])),
                lambda: ("-".join(pick(WORDS) for _ in range(4)) + "-" + draw("0123456789", 3), words(2) + " /"),
                lambda: ("-".join(draw("0123456789", 4) for _ in range(4)) + pick(["", "A"]), words(2) + pick([" card ", " order ", " phone "])),
                lambda: (pick(WORDS) + "_" + pick(WORDS) + "." + pick(WORDS), words(2) + f" {pick(names)} = "),
                lambda: (words(int(rng.integers(2, 9))) + pick(["", ".", ", " + words(3)]), words(2) + f" {pick(names)}{pick([': ', ' = '])}{quote}"),
            ][kind]()
        harmless = rng.random() < (0.1 if secret else 0.4)
        out.append((value, before, quote + " " + words(3), "tests/example" if harmless else "src/main", int(secret)))
    return out


def fit_forest(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    rows = labelled_findings() if findings is None else findings[:FINDINGS]
    x = [describe(v, b, a, p, set(WORDS) | {w.lower() for w in _PART.findall(b + a)}) for v, b, a, p, _ in rows]
    return Forest(np.array(x), np.array([r[4] for r in rows]))


def judge(forest: Forest, text: str, path: str) -> list[tuple[int, int, str, float]]:
    """Candidates of a text with the probability that each is a secret."""
    spans = candidates(text)
    if not spans:
        return []
    own, last = set(WORDS), 0
    for a, b, _ in [*spans, (len(text), len(text), "")]:
        own.update(w.lower() for w in _PART.findall(text, last, a))
        last = b
    chance = lambda found: forest.probabilities(np.array([describe(text[a:b], text[max(0, a - 60) : a], text[b : b + 60], path, own) for a, b, _ in found])).tolist()
    judged = [(*span, p) for span, p in zip(spans, chance(spans), strict=True)]
    inner: list[tuple[int, int, str]] = []
    for a, b, rule, p in judged:
        if rule == "assigned" and p < 0.5 and len(text[a:b].split()) > 1:  # quoted prose, perhaps with a secret in it
            inner += [(a + x, a + y, r) for x, y, r in candidates(text[a:b])]
    if inner:
        judged = sorted([*judged, *((*span, p) for span, p in zip(inner, chance(inner), strict=True) if p >= 0.5)])
    return judged


def scan_secrets(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """A row for each candidate: ``doc_id, start, length, rule, score, secret, value_sha256``.

    Starts and lengths count characters of the whole text. Null and empty texts have none; repeated
    rows are each scanned; long texts take time in proportion; an empty table gives no rows and extra columns are left behind.
    ``path`` names the column that tells where a text is from (null, or no such column: unknown).
    """
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = {"start": pa.int64(), "length": pa.int64(), "rule": pa.string(), "score": pa.float64(), "value_sha256": pa.string()}

    def scan(batches):
        for batch in batches:
            at, found = [], []
            for i, (text, where) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b, rule, p in judge(shared.value, text or "", where or ""):
                    at.append(i)
                    found.append((a, b - a, rule, p, hashlib.sha256((text[a:b]).encode()).hexdigest()))
            columns = zip(*found, strict=True) if found else [[]] * len(schema)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, schema.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], ["doc_id", *schema])

    where = F.col(path) if path in docs.columns else F.lit(None)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.cast("string").alias("path"))
    found = plain.mapInArrow(scan, "doc_id long, start long, length long, rule string, score double, value_sha256 string")
    return found.withColumn("secret", F.col("score") >= 0.5)


def mask_secrets(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """The same rows and columns with the confirmed secrets of ``text`` replaced by a mask; edge cases as in ``scan_secrets``."""
    shared, schema, names = docs.sparkSession.sparkContext.broadcast(forest), docs.schema, docs.columns

    def mask(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            paths = batch.column(names.index(path)).to_pylist() if path in names else [None] * len(texts)
            for i, (text, where) in enumerate(zip(texts, paths, strict=True)):
                last, parts = 0, []
                for a, b, _, p in judge(shared.value, text or "", where or ""):
                    if p >= 0.5:
                        parts += [text[last:a], MASK]
                        last = b
                if parts:
                    texts[i] = "".join([*parts, text[last:]])
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(mask, schema)
