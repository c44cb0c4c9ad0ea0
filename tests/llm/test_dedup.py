"""Near duplicates and passage removal against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from recallery.llm import components, lpf_dedup, queries, setsketch
from recallery.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, block string, grp long"


def rows(texts):
    return [(i, t, "en", "clash", 1) for i, t in texts]


def brute_components(docs, words, percent):
    sets = {}
    for i, t in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent, postings = {i: i for i in sets}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for e in sets[i] for j in postings.get(e, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for e in sets[i]:
            postings.setdefault(e, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def brute_repeats(docs, n=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def edited_copies(seed, n, length, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = word()
        out.append(" ".join(copy))
    return out


def found_components(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df, **options).collect()}


def test_op10_on_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op10_setsketch_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_around_the_threshold(spark, monkeypatch, block):
    """A group of copies whose pairs lie on both sides of the threshold, whole and cut into blocks."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    texts = list(enumerate(edited_copies(1, 60, 120, 9) + edited_copies(2, 30, 40, 3) + edited_copies(3, 5, 200, 0)))
    random.Random(5).shuffle(texts)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    for words in (4, 5):
        assert found_components(df, words=words) == brute_components(texts, words, 80)


def test_near_duplicate_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "É two three four five"), (7, "é two three four five"), (8, "x " * 30000), (9, "x x x x x x")]
    df = spark.createDataFrame([*rows(texts), (None, "one two", "en", "b", 2), *rows([(4, "one two")])], SCHEMA)
    out = setsketch.near_duplicates(df, words=4).collect()
    assert len(out) == 11
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6][1:] == (6, True) and got[7][1:] == (7, True)
    assert got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert got[None] == (1, None, True)
    assert setsketch.near_duplicates(df.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 800).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a, b])
    assert (np.maximum(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(both)).all()
    near = np.concatenate([a[:720], b[:80]])
    sizes = np.array([800, 800])
    other = np.stack([setsketch.registers(near), setsketch.registers(b)])
    assert setsketch.plausible(setsketch.registers(a), 800, other, sizes, 0.8).tolist() == [True, False]


def test_components_of_chains_and_loops(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 8), (2, 1), (None, 1)], "a long, b long")
    assert {r.node: r.label for r in components.connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components.connected_components(links.limit(0)).collect() == []


def test_components_and_key_values_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 20)
    monkeypatch.setattr(components, "HUBS", 10)
    rng = random.Random(3)
    stars = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(190, 300)] + [(900, 901)]
    chain, loose = [(i, i + 1) for i in range(150)], [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    for links in (stars, chain, loose):
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len(parent) and {r.node: r.label for r in found} == {x: find(x) for x in parent}
    rows = spark.createDataFrame([(k, v) for k, n in ((1, 300), (2, 5), (3, 1)) for v in range(n)], "k long, v long")
    out = components.join_key_values(rows, "k", 306, least=("min", "v"), total=("sum", "v"), n=("count", "v")).distinct().collect()
    assert len(out) == 306 and {(r.k, r.least, r.total, r.n) for r in out} == {(1, 0, 44850, 300), (2, 0, 10, 5), (3, 0, 0, 1)}


def test_shingles_of_long_and_joined_texts():
    one = shingle_sets(["a b c d e"], 4)[0]
    again = shingle_sets(["zzz", "a b c d e", ""], 4)
    assert (again[1] == one).all() and len(one) == 2 and len(again[2]) == 0


def test_op3_on_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op3_suffix_array_dedup(spark, sf).collect()} == brute_repeats(docs)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_with_frequent_passages(spark, monkeypatch, hot):
    """Passages in many neighbourhoods, also with every minimizer dealt as if it were frequent."""
    monkeypatch.setattr(lpf_dedup, "HOT", hot)
    rng = random.Random(3)
    junk = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passage, notice = junk(140), junk(50)
    texts = [(i, junk(rng.randint(0, 80)) + rng.choice([passage, notice, passage[20:], ""]) + junk(rng.randint(0, 60))) for i in range(60)]
    texts += [(60, "ab" * 400), (61, "ab" * 300), (62, texts[3][1]), (63, None), (64, ""), (65, "x" * 49), (66, "x" * 49)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert {r[0]: tuple(r[1:]) for r in lpf_dedup.remove_repeats(df).collect()} == brute_repeats(texts)


def test_repeats_edge_cases(spark):
    text = "the very same passage of more than fifty bytes, again and again"
    df = spark.createDataFrame([*rows([(5, text), (5, text), (3, text)]), (None, text, "en", "x", 1)], SCHEMA)
    out = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in lpf_dedup.remove_repeats(df).collect())
    assert out == [(3, 0), (5, len(text)), (5, len(text)), (99, len(text))]
    cut = lpf_dedup.cut_repeats(df)
    assert cut.columns == df.columns and cut.count() == 4
    assert lpf_dedup.remove_repeats(df.limit(0)).collect() == []


def test_one_hash_clash_is_no_match():
    codes = np.frombuffer(b"a" * 60 + b"b" * 60, np.uint8)
    assert lpf_dedup.previous_factors(codes, np.array([60, 60]), np.array([1, 2])).tolist() == []
    same = np.frombuffer(b"a" * 120, np.uint8)
    assert sorted(lpf_dedup.previous_factors(same, np.array([60, 60]), np.array([1, 2])).tolist()) == list(range(60, 71))


def brute_factors(codes, lengths, docs, n=50):
    raw, at, places = codes.tobytes(), 0, []
    for length, doc in zip(lengths, docs, strict=True):
        places += [(p, doc) for p in range(at, at + length - n + 1)]
        at += length
    same = lambda p, q: next((k for k in range(n) if raw[p + k] != raw[q + k]), n)
    return {p: max((same(p, q) for q, e in places if e < d), default=0) for p, d in places}


def test_longest_previous_factors_of_stretches():
    rng = random.Random(8)
    for alphabet in (b"a", b"ab", b"abcdefgh"):
        for _ in range(8):
            base = bytes(rng.choice(alphabet) for _ in range(150))
            parts = []
            for _ in range(rng.randint(1, 6)):
                k, at = rng.randint(50, 90), rng.randint(0, 60)
                parts.append(base[at : at + k] if rng.random() < 0.6 else bytes(rng.choice(alphabet) for _ in range(k)))
            codes, lengths = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
            docs = np.array([rng.randint(0, 4) for _ in parts])
            want = brute_factors(codes, lengths, docs)
            starts, found = lpf_dedup.longest_previous_factors(codes, lengths, docs)
            assert dict(zip(starts.tolist(), found.tolist(), strict=True)) == want
            assert sorted(lpf_dedup.previous_factors(codes, lengths, docs).tolist()) == sorted(p for p, f in want.items() if f >= 50)


def test_stretches_of_equal_fingerprints_are_compared():
    codes = np.frombuffer(b"a" * 60 + b"a" * 60 + b"b" * 60 + b"a" * 59, np.uint8)
    at = np.array([60, 120, 180])
    assert lpf_dedup._equal(codes, np.zeros(3, int), np.full(3, 60), at, np.array([60, 60, 59])).tolist() == [True, False, False]


def test_repeats_in_many_blocks_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(lpf_dedup, "BLOCK_BYTES", 20_000)
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    long = junk(200_000)
    texts = [(1, long), (2, junk(300) + long[1000:150_000]), (3, long[-70:]), *((i, long[i * 100 : i * 100 + 120]) for i in range(4, 60))]
    df = spark.createDataFrame([(i, t, 7, "b", "r") for i, t in texts], "doc_id long, text string, `_` int, `rest` string, `a.b` string")
    assert {r[0]: tuple(r[1:]) for r in lpf_dedup.remove_repeats(df).collect()} == brute_repeats(texts)
    cut = lpf_dedup.cut_repeats(df)
    assert cut.columns == df.columns
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {v[3] for v in brute_repeats(texts).values()}
    assert {(r["_"], r["rest"], r["a.b"]) for r in cut.collect()} == {(7, "b", "r")}


def test_repeats_without_ids_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "the very same passage of more than fifty bytes, without ids")] * 3 + [(None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in lpf_dedup.remove_repeats(df).collect()) == [0, 0, 0, 0]
