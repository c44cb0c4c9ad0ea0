"""Fill-in-middle, hard negatives and the pair occurrence index against plain Python, DuckDB and the library."""

import hashlib
import math
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest

from recallery.llm import bpe, fim, hard_negatives, queries

from .test_tokens import texts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# fill-in-middle


def cut_by_hand(doc_id, text):
    text = text or ""
    n, d = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, a, b - a, sha(out), sha(text)


def test_markers_by_hand(spark):
    rng = random.Random(5)
    parts = ["a", "\x01", "\x02", "\x02d", "\x02e", "\x02\x01", "<P", "P>", "<", "S>", ">", "é", "日本", "👍", "\n", "\r\n", " ", "$0", "\\", "\x00", "é", "<P>"]
    rows = [(i, "".join(rng.choice(parts[: -1 if i % 5 else None]) for _ in range(rng.randrange(25)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (None, "no id"), (7, "again"), (7, "again"), (2002, "long \x01\x02 " * 200_000), (2003, "<M>"), (2004, "x")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, units string, n int")
    found = sorted((tuple(r) for r in fim.fim_digests(table).collect()), key=str)
    assert found == sorted(((i, *cut_by_hand(i, t)) for i, t in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fim.fim_digests(table.limit(0)).collect() == []
    whole = fim.fill_in_middle(table).where("form <> 'plain'").collect()
    assert all(len(r.output) == r.n + 9 for r in whole)


def test_markers_stay_in_sql_functions(spark, sf):
    plan = queries.op11_marker_fim(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_replace") == 1, "units are made once"


@pytest.mark.parametrize("name", ["op11_marker_fim", "op12_radix_negatives"])
def test_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in found.columns]
    rows = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    assert rows and sorted((tuple(r) for r in found.collect()), key=str) == rows


# hard negatives


def mined_by_hand(rows, every=50):
    usable = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if sum(math.floor(256 * c) ** 2 for c in x) >= 2**62:
            continue
        usable[i] = min(usable.get(i, (x, label)), (x, label))
    data = {i: (tuple(math.floor(256 * c) for c in x), (label + 1) % 10 if i % 7 == 0 else label) for i, (x, label) in usable.items()}
    out = []
    for a, (x, label) in data.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (y, _) in data.items() if i != a and len(y) == len(x)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))  # noqa: B023, E731
        for p in best([i for i in score if data[i][1] == label])[:5]:
            window = [i for i in score if data[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(best(window)[:3])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "x", 1.5) for i, x, label in rows], "vec_id long, embedding array<double>, label int, score string, anchor double")


@pytest.mark.parametrize(("size", "spread"), [(3.0, 0), (0.02, 1), (5e3, 2), (1e6, 3)])
def test_negatives_by_hand(spark, monkeypatch, size, spread):
    """Scores of a few to sixty bits, many ties, small blocks, a vector that a third of all rows share."""
    monkeypatch.setattr(hard_negatives, "ROWS", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rng = random.Random(spread)
    rows = []
    for i in range(600):
        x = [round(rng.gauss(0.3, 1), rng.choice((0, 1, 6))) * size for _ in range(6)]
        rows.append((i, [size, 0.0, 2 * size, -size, size, size] if i % 3 == 1 else x, rng.randrange(4)))
    if spread == 1:
        rows += [(700, None, 1), (750, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (751, [float("nan")] * 6, 2), (752, [float("inf")] * 6, 2), (800, [1e300] * 6, 0), (None, [1.0] * 6, 1), (850, [1.0] * 6, None)]
        rows += [(900, [1.0, 2.0], 3), (901, [1.0, 2.1], 3), (902, [1.0, 1.5], 4), (950, [], 3), (951, [], 3), (952, [], 4), (1000, [0.0] * 6, 1), rows[50], (100, [-9.0] * 6, 1)]
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect())
    assert found == mined_by_hand(rows) and found
    if spread == 1:
        assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0)).collect() == []


def test_histogram_reaches_down_to_the_need():
    rng = np.random.default_rng(0)
    rows = {"id": np.arange(300), "label": np.ones(300, np.int64), "vector": rng.integers(-9, 9, (300, 3))}
    anchors = {"id": np.array([7]), "label": np.array([0]), "vector": np.array([[1, 2, -3]])}
    block, score = hard_negatives.Block(anchors, rows, 3000, same=False), rows["vector"] @ np.array([1, 2, -3])
    for low, high, need, shift in ((-40, 20, 5, 3), (0, 0, 9, 0), (-3000, 3000, 400, 4), (50, 60, 1, 2), (90, 80, 1, 2)):
        window, bucket, n = block.histogram(np.array([0]), np.array([low]), np.array([high]), np.array([need]), shift)
        inside = [s >> shift for s in score.tolist() if low <= s <= high]
        assert dict(zip(bucket.tolist(), n.tolist(), strict=True)) == {b: inside.count(b) for b in bucket.tolist()}
        assert n.sum() == len(inside) if len(inside) <= need else (n.sum() >= need and n[:-1].sum() < need)


# pair occurrence index


def test_byte_ids_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    codec, library = bpe.ByteCodec(BYTES, cache_words=1000), Tokenizer.from_file(BYTES)
    rng = random.Random(9)
    odd = ["".join(chr(rng.choice((0x558, 0x88F, 0x1D6A6, 0x41, 0x20, 0x661, 0xA0, 0x3000, 0x345, 0x1F600, 0xFFFD, 0xE000))) for _ in range(12)) for _ in range(300)]
    every = texts(spark, sf) + odd + [" <|endoftext|>  <|endoftext|>x", "<|endoftext|", "aaaa aaaaaaa " * 50, "abababab" * 999, "the" * 20_000]
    for at in range(0, len(every), 400):
        part = every[at : at + 400]
        for t, ids in zip(part, codec.encode_batch(part), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want, repr(t[:80])
            assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == t
            assert codec.decimal(ids).decode() == ",".join(map(str, want))
    broken = [200, 50256, 447, 15, 0, 254]
    assert codec.decode(np.array(broken)) == library.decode(broken, skip_special_tokens=False)


def test_pair_index_by_hand():
    """Random vocabularies against merging one pair at a time; vocabularies out of order are refused."""
    rng = random.Random(2)
    for _ in range(60):
        merges, known = [], [0, 1, 2]
        for product in range(3, 3 + rng.randrange(12)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in [m[:2] for m in merges]:
                merges.append((*pair, product))
                known.append(product)
        rank = {m[:2]: (k, m[2]) for k, m in enumerate(merges)}
        words = [[rng.randrange(3) for _ in range(rng.randrange(14))] for _ in range(30)]
        symbols, counts = bpe.PairIndex(merges).merge(np.array(sum(words, []), np.int64), np.array([len(w) for w in words]))
        out, at = symbols.tolist(), 0
        for word, n in zip(words, counts.tolist(), strict=True):
            word = list(word)
            while True:
                ranks = [(rank[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rank]
                if not ranks:
                    break
                _, i = min(ranks)
                word[i : i + 2] = [rank[word[i], word[i + 1]][1]]
            assert out[at : at + n] == word
            at += n
        assert at == len(out)
    with pytest.raises(ValueError, match="earlier"):
        bpe.PairIndex([(3, 0, 4), (0, 1, 3)])


def test_byte_codec_edge_cases(spark):
    rows = [(3, None), (1, ""), (None, "null id"), (2, "word " * 3000), (2, "again"), (2, "again"), (5, "ñ" * 400_000)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    began = time.perf_counter()
    found = bpe.byte_digests(table, BYTES).collect()
    assert time.perf_counter() - began < 60
    assert sorted(((r.doc_id, r.decoded_sha256) for r in found), key=str) == sorted(((i, sha(t or "")) for i, t in rows), key=str)
    assert {(r.n_tokens, r.ids_sha256) for r in found if r.doc_id in (1, 3)} == {(0, sha(""))}
    assert bpe.byte_digests(table.limit(0), BYTES).collect() == []
    back = bpe.decode_bytes(bpe.encode_bytes(table, BYTES), BYTES).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
