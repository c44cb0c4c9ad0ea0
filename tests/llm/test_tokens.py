"""Tokenizers, packing and token files against the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from recallery.llm import merges, packing, pieces, queries, token_files
from recallery.llm.encoders import TextEncoder
from recallery.llm.merges import MergeTable, merge_rounds

PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "'s", "'S", "'", "''", "'ll", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "日本", "1", "23", "!!", " ", "İ", "Σ", "ς", "\x1c", "\x00", "ﬁ", "👍", "word", "\r\n", "▁", "▁▁▁", "ཀ", ".'d", "isn't"]


def texts(spark, sf):
    rng = random.Random(1)
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "x" * 3000, " " * 300]


@pytest.mark.parametrize(("name", "ends"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_library(spark, sf, name, ends):
    from tokenizers import Tokenizer

    encoder, library = TextEncoder(public_tokenizers.path(name), ends), Tokenizer.from_file(public_tokenizers.path(name))
    for t in texts(spark, sf):
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = pieces.PieceCodec(path, cache_words=1000), sentencepiece.SentencePieceProcessor(model_file=path)
    every = texts(spark, sf)
    for at in range(0, len(every), 400):
        part = every[at : at + 400]
        for t, ids in zip(part, codec.encode_batch(part), strict=True):
            want = [*library.encode(t), 2]
            assert ids.tolist() == want, repr(t[:80])
            assert codec.decode(ids) == library.decode(want)
            assert codec.decimal(ids).decode() == " ".join(map(str, want))


def test_merge_rounds_take_the_leftmost_of_equal_ranks():
    table = MergeTable(np.array([1, 3]), np.array([1, 1]), np.array([0, 1], np.int32), np.array([3, 4], np.int32))
    ids, counts = merge_rounds(np.array([1, 1, 1, 1, 1, 2]), np.array([3, 2, 1]), table)
    assert counts.tolist() == [1, 1, 1] and ids.tolist() == [4, 3, 2]


def edge_rows(spark):
    schema = "doc_id long, text string, n_tokens string, sequence_id double"
    return spark.createDataFrame([(3, None, "x", 0.5), (1, "", "x", 0.5), (None, "null id", "x", 0.5), (2, "word " * 3000, "x", 0.5), (2, "again", "x", 0.5), (9007199254740993, "large id", "x", 0.5)], schema)


def test_token_files_edge_cases(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_files.tokens_round_trip(edge_rows(spark), path).collect()
    assert len(rows) == 6
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 2, 3, 9007199254740993]
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    assert ordered[0].doc_id is None and ordered[-1].doc_id == 9007199254740993
    assert [r.ids_crc32 for r in rows if r.doc_id == 1] == [zlib.crc32(np.array([2], "<u4").tobytes())]
    assert token_files.tokens_round_trip(edge_rows(spark).limit(0), path).collect() == []


def test_starts_are_places_in_the_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(5, t) for t in ("b b b", "a", "c c", "a", None, "d d d d d")] + [(None, "x y"), (None, "x")] + [(k, "word " * (k % 7)) for k in range(40)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path("word_bpe_49k.json"))
    import pyarrow.parquet as pq

    ids, crcs = [], {}
    for file in sorted((tmp_path / "tokens").glob("*.parquet")):
        for doc in pq.read_table(file)["ids"].to_pylist():
            crcs[len(ids)] = zlib.crc32(np.array(doc, "<u4").tobytes())
            ids += doc
    assert {r.start: r.ids_crc32 for r in token_files.token_index(spark, path).collect()} == crcs


def test_token_files_layout(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    file = sorted((tmp_path / "tokens").glob("*.parquet"))[0]
    columns = {pq.ParquetFile(file).metadata.row_group(0).column(k).path_in_schema: pq.ParquetFile(file).metadata.row_group(0).column(k) for k in range(3)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    some = token_files.read_tokens(spark, path, 20, 29)
    assert sorted(r.doc_id for r in some.select("doc_id").collect()) == list(range(20, 30))
    assert "ids" not in some.select("doc_id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]


def placed(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_on_table(spark, sf):
    rows = queries.op4_best_fit_packing(spark, sf).collect()
    total = sum(r.length for r in rows)
    assert placed(rows) >= -(-total // 1024)
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == sum(x.length for x in by.get(r.doc_id, []))
        by.setdefault(r.doc_id, []).append(r)
    assert all(x.length == 1024 for pieces_ in by.values() for x in pieces_[1:])


def test_packing_edge_cases(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(edge_rows(spark), path).collect()
    assert sum(r.doc_id == 2 for r in rows) > 2 and placed(rows) >= 1
    assert [(r.start, r.length) for r in rows if r.doc_id == 3] == [(0, 1)]
    assert packing.pack_documents(edge_rows(spark).limit(0), path).collect() == []


def test_cut():
    assert list(packing.cut(2500, 1024)) == [(0, 452), (452, 1024), (1476, 1024)]
    assert list(packing.cut(2048, 1024)) == [(0, 1024), (1024, 1024)]
    assert list(packing.cut(1, 1024)) == [(0, 1)]


def test_bounds_hold_and_certify():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 1024, rng.integers(1, 200))
        assert packing.lower_bound(sizes) <= packing.best_fit_decreasing(sizes)[2]
    assert packing.lower_bound(np.array([600] * 10)) == 10
    assert packing.lower_bound(np.array([342] * 9)) == 5  # only two of them fit in a bin
    assert packing.lower_bound(np.array([], np.int64)) == 0


def test_exchanges_over_many_partitions_leave_no_holes(spark):
    rng = np.random.default_rng(9)
    lengths = [*([1000] * 400), *([500] * 40), *rng.integers(300, 700, 2000).tolist()]
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(df, items_per_task=100, exchanges=4).collect()
    assert len(rows) == len(lengths) and placed(rows) >= -(-sum(lengths) // 1024)


def test_exchange_never_takes_more_bins(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(200, 700, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = placed(packing.pack_pieces(df, items_per_task=200, exchanges=0).collect())
    pooled = packing.pack_pieces(df, items_per_task=200, exchanges=3).collect()
    assert len(pooled) == 3000 and placed(pooled) <= alone


def long_words():
    rng = random.Random(6)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    return [word(4000, "etaoinshrdlu"), "x" * 5000, "ab" * 2500, word(3000, "日本語のabc"), "▁" * 4000, f"{word(2500, 'etaoin')} a {word(2000, 'aab')} b", *(word(60, "aab") for _ in range(50))]


@pytest.mark.parametrize("long", [2000, 10**9])
def test_long_words_equal_the_library(monkeypatch, long):
    """By the heap, and by rounds that take many pairs of a word at once."""
    import sentencepiece

    monkeypatch.setattr(merges, "LONG", long)
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for w, ids in zip(long_words(), codec.encode_batch(long_words()), strict=True):
        assert ids.tolist() == [*library.encode(w), 2]


def test_a_word_of_60000_letters_takes_no_square_of_time():
    codec, rng = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(1)
    codec.encode_batch(["x" * 3000])
    took = []
    for n in (15_000, 60_000):
        word, began = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(n)), time.process_time()
        codec.encode_batch([word])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_op7_on_table(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op7_piece_codec(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = [*library.encode(texts[r.doc_id]), 2]
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_piece_digests_edge_cases(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.piece_digests(edge_rows(spark), path).collect()
    assert len(rows) == 6 and [r.n_tokens for r in rows if r.doc_id in (1, 3)] == [1, 1]
    assert sum(r.doc_id is None for r in rows) == 1 and max(r.n_tokens for r in rows) > 3000
    assert pieces.piece_digests(edge_rows(spark).limit(0), path).collect() == []


def test_op6_on_table(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found, start = {r.doc_id: r for r in queries.op6_token_files(spark, sf).collect()}, 0
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[doc_id].start, found[doc_id].n_tokens, found[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4_ids_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op4_best_fit_packing(spark, sf).collect()
    for r in found:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in found) == sum(map(len, ids.values()))


def test_words_of_a_batch_equal_the_library_and_are_encoded_once(spark, sf, monkeypatch):
    encoder = TextEncoder(public_tokenizers.path("word_bpe_49k.json"), True)
    rng, parts = random.Random(2), ["a", "B", " ", "\n", "é", "É", "Þ", "ß", "'s", "'S", "'", "''", "'ll", "'re", "'r", "ve", "l", "1", "23", "!!", "\"'", "st", "."]
    every = texts(spark, sf) + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["'", "'l", "", "×", "日", "<|", ""]
    ids, counts = encoder.encode_words([t.encode() for t in every])
    for t, found in zip(every, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert found.tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 2], repr(t[:80])
    encoded = []
    plain = encoder.fast.encode_to_numpy
    monkeypatch.setattr(encoder.fast, "encode_to_numpy", lambda text, **how: encoded.append(text) or plain(text, **how))
    ids, counts = encoder.encode_words([b"Thousands of words, of words " * 500, b"of thousands"])
    assert len(ids) == counts.sum() and sum(map(len, encoded)) < 50
