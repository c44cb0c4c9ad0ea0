"""Removal of repeated passages by longest-previous-factor arrays [operator 3].

A byte goes if some string of ``SPAN`` bytes that covers it also starts in a document with a smaller
id. That is where the longest-previous-factor array over the documents in order of their ids,
counting only matches in earlier documents, has values of ``SPAN`` or more.

One suffix array of everything cannot be held, so strings are dealt by content. The string at
each position goes by its minimizer, the least hash among the ``GRAM``-byte grams inside: equal strings have equal
minimizers, and successive positions mostly share theirs, so they travel as one stretch of text.

1. Each block of documents tells which minimizers it has and in how many documents.
2. A minimizer met in one document only cannot repeat; the others are returned to their blocks.
3. Blocks send the stretches of those minimizers, each different one once: a later document of the
   block with the same stretch loses it at once.
4. Where a minimizer's stretches meet, their positions are put in suffix order with the common
   prefixes of neighbours; the previous and next places of smaller documents there give the longest previous factor.
5. Blocks cut what was found out of their texts.

Minimizers of more than ``HOT`` documents (a notice in a third of all texts, with as many
different neighbourhoods) are dealt by whole ``SPAN``-byte strings instead. Blocks and buckets are as many as
the bytes of the input need, so that each holds about ``BLOCK_BYTES`` at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import mix64, powers, runs, slices

SPAN, GRAM, HOT = 50, 20, 4096
#: bytes of text in one block
BLOCK_BYTES = 8_000_000
_CHUNK = 1_000_000
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def _sums(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_TABLE[codes] * powers(len(codes))[0], out=sums[1:])
    return sums


def _grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` bytes that start at each position."""
    n = len(sums) - size
    return (sums[size:] - sums[:n]) * powers(n)[1] if n > 0 else np.zeros(0, np.uint64)


def _stretches(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, minimizer, text number and fingerprint of each stretch of ``codes``.

    ``ends``: where the texts that are joined in ``codes`` end.
    """
    none = np.zeros(0, np.int64)
    n = len(codes) - SPAN + 1
    if n <= 0:
        return none, none, none.view(np.uint64), none, none.view(np.uint64)
    sums = _sums(codes)
    least, width, want = _grams(sums, GRAM), 1, SPAN - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: width - want], least[want - width :])
    valid = np.ones(n, bool)
    for shift in range(1, SPAN):  # the last starts of each text would reach into the next
        at = ends - shift
        valid[at[(at >= 0) & (at < n)]] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    text = np.searchsorted(ends, first, "right")
    length = (last - first + SPAN).astype(np.uint64)
    print_ = mix64((sums[last + SPAN] - sums[first]) * powers(n)[1][first] + length * np.uint64(0xA24BAED4963EE407))
    return first, last, least[first], text, print_


def _prints(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of pieces that follow each other in ``codes``."""
    out = np.empty(len(starts), np.uint64)
    for a, b in slices(lengths.tolist(), _CHUNK):
        at = starts[a:b] - starts[a]
        sums = _sums(codes[starts[a] : starts[b - 1] + lengths[b - 1]])
        out[a:b] = mix64((sums[at + lengths[a:b]] - sums[at]) * powers(len(sums))[1][at] + lengths[a:b].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


def _texts(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The block's rows in a fixed order, their ids, and their bytes; rows without an id are last."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    return table, ids, [(t or "").encode() for t in table["text"].to_pylist()]


def _chunks(raw: list[bytes]):
    for a, b in slices([len(r) for r in raw], _CHUNK):
        codes = np.frombuffer(b"".join(raw[a:b]), np.uint8)
        yield a, codes, np.cumsum([len(r) for r in raw[a:b]])


def _numbered(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


def _packed(keys: np.ndarray) -> bytes:
    """48-bit keys in ascending order: the high 16 bits first (they compress away), then the low 32."""
    return (keys >> np.uint64(32)).astype("<u2").tobytes() + keys.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u2", n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(data, "<u4", n, 2 * n)


def _short(keys: np.ndarray) -> np.ndarray:
    """48 bits of each minimizer: enough to tell which are shared; a rare false meeting costs work, not truth."""
    return mix64(keys) >> np.uint64(16)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _tell(buckets: int):
    def tell(key, table):
        _, ids, raw = _texts(table)
        number, keys, owners = _numbered(ids), [], []
        for a, codes, ends in _chunks(raw):
            _, _, key_, text, _ = _stretches(codes, ends)
            keys.append(key_)
            owners.append(number[text + a])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, many = np.unique(_short(keys[new]), return_counts=True)
        order, cuts = _by_bucket((keys % np.uint64(buckets)).astype(np.int64), buckets)
        keys, many = keys[order], many[order].astype("<u4")
        rows = [(k, int(key[0].as_py()), _packed(keys[a:b]), many[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return _table(rows, _TOLD)

    return tell


_TOLD = {"bucket": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "many": pa.binary()}
_SHARED = {"block": pa.int32(), "keys": pa.binary(), "hot": pa.binary()}
_SENT = {"bucket": pa.int32(), "block": pa.int32(), "data": pa.binary(), "lengths": pa.binary(), "docs": pa.binary(), "rows": pa.binary(), "starts": pa.binary(), "gone": pa.binary()}
_FOUND = {"block": pa.int32(), "gone": pa.binary()}


def _table(rows: list[tuple], schema: dict) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table({name: pa.array(list(c), t) for (name, t), c in zip(schema.items(), columns, strict=True)})


def _ddl(schema: dict) -> str:
    return ", ".join(f"{n} {'int' if t == pa.int32() else 'binary'}" for n, t in schema.items())


def _share(key, table):
    """Which minimizers of the bucket have been met in two documents or more, for each block."""
    keys = [_unpacked(x) for x in table["keys"].to_pylist()]
    many = np.concatenate([np.frombuffer(x, "<u4") for x in table["many"].to_pylist()]).astype(np.int64)
    block = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    total = np.add.reduceat(many[order], first)
    counts = np.empty(len(flat), np.int64)
    counts[order] = np.repeat(total, np.diff(np.append(first, len(flat))))
    rows = []
    for k, b in enumerate(table["block"].to_pylist()):
        own = block == k if len(keys) < 2 else slice(*np.searchsorted(block, [k, k + 1]))
        keys_, counts_ = flat[own], counts[own]
        rows.append((b, _packed(keys_[(counts_ > 1) & (counts_ <= HOT)]), _packed(keys_[counts_ > HOT])))
    return _table([r for r in rows if r[1] or r[2]], _SHARED)


def _pieces(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return codes[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _equal(codes: np.ndarray, a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Which pieces of ``codes`` are the same, byte by byte."""
    same = a_lengths == b_lengths
    at = np.flatnonzero(same)
    for i, j in slices(b_lengths[at].tolist(), _CHUNK):
        x = at[i:j]
        differ = _pieces(codes, a[x], b_lengths[x]) != _pieces(codes, b[x], b_lengths[x])
        same[x] = np.add.reduceat(differ, np.cumsum(b_lengths[x]) - b_lengths[x], dtype=np.int64) == 0
    return same


def _later(codes: np.ndarray, place: np.ndarray, lengths: np.ndarray, docs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which stretches of ``codes`` a smaller document has as a whole: found by fingerprint, compared byte by byte."""
    if not len(prints):
        return np.zeros(0, bool)
    order = np.lexsort((docs, prints))
    new = np.flatnonzero(np.concatenate(([True], prints[order][1:] != prints[order][:-1])))
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(new, len(order))))
    later = docs > docs[first]
    asked = np.flatnonzero(later)
    later[asked[~_equal(codes, place[first[asked]], lengths[first[asked]], place[asked], lengths[asked])]] = False
    return later


def _send(buckets: int):
    def send(key, table, shared):
        if not table.num_rows:
            return _table([], _SENT)
        join = lambda name: np.unique(np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x) for x in shared[name].to_pylist())]))
        cool, hot = join("keys"), join("hot")
        _, ids, raw = _texts(table)
        out, parts, at = [], [], 0
        for a, codes, ends in _chunks(raw):
            first, last, keys, text, prints = _stretches(codes, ends)
            begins = np.concatenate(([0], ends))
            short = _short(keys)
            is_hot = np.isin(short, hot)
            keep = np.flatnonzero(is_hot | np.isin(short, cool))
            first, last, keys, text, prints, is_hot = (x[keep] for x in (first, last, keys, text, prints, is_hot))
            if is_hot.any():  # each string of its own
                many = np.where(is_hot, last - first + 1, 1)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                each = np.repeat(is_hot, many)
                first = np.repeat(first, many) + np.where(each, step, 0)
                last = np.where(each, first, np.repeat(last, many))
                text = np.repeat(text, many)
                own = mix64(_grams(_sums(codes), SPAN)[first] + np.uint64(SPAN * 3))
                keys, prints = np.where(each, own, np.repeat(keys, many)), np.where(each, own, np.repeat(prints, many))
            out.append((first + at, last - first + SPAN, keys, text + a, first - begins[text], prints))
            parts.append(codes)
            at += len(codes)
        place, lengths, keys, rows, starts, prints = (np.concatenate(x) for x in zip(*out, strict=True))
        codes = np.concatenate(parts)
        docs = ids[rows]
        # of equal stretches only those of the first document ask; the others' are gone
        later = _later(codes, place, lengths, docs, prints)
        gone = np.stack([rows[later], starts[later], (starts + lengths)[later]]).astype("<i8")
        asks = np.flatnonzero(~later)
        order, cuts = _by_bucket((mix64(keys[asks]) % np.uint64(buckets)).astype(np.int64), buckets)
        asks = asks[order]
        block = int(key[0].as_py())
        sent = [(block % buckets, block, b"", b"", b"", b"", b"", gone.tobytes())]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                x = asks[a:b]
                sent.append((k, block, _pieces(codes, place[x], lengths[x]).tobytes(), lengths[x].astype("<u4").tobytes(), docs[x].astype("<i8").tobytes(), rows[x].astype("<u4").tobytes(), starts[x].astype("<u4").tobytes(), b""))
        return _table(sent, _SENT)

    return send


def suffix_order(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at ``starts``, by their first SPAN bytes, then by ``owner``.

    Also the common prefix of each with the one before it, at most SPAN. All suffixes must have SPAN bytes. The first
    round sorts by eight bytes; each further one refines the groups that are still equal by the next few
    bytes, as many as fit into a key behind the group's place; suffixes alone in their group are done.
    """
    n = len(starts)
    common = np.zeros(n, np.int64)
    if not n:
        return np.zeros(0, np.int64), common
    words = np.ndarray((len(codes) - 7,), ">u8", np.ascontiguousarray(codes).data, strides=(1,))
    step = 5 if n < 1 << 24 else 4
    low = np.uint64((1 << 8 * step) - 1)

    def split(place: np.ndarray, at: int) -> None:
        """Common prefixes at places where a group falls apart: up to the first byte that differs from ``at`` on."""
        differ = words[starts[order[place]] + at].astype(np.uint64) ^ words[starts[order[place - 1]] + at].astype(np.uint64)
        common[place] = at + sum((differ < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))

    first = words[starts].astype(np.uint64)
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    split(np.flatnonzero(new)[1:], 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    for at in (*range(8, SPAN - step, step), SPAN - step, None):
        grouped = rank[order[slots]]
        same = np.concatenate(([False], grouped[1:] == grouped[:-1]))
        open_ = same | np.append(same[1:], False)
        slots, same, grouped = slots[open_], same[open_], grouped[open_]
        if not len(slots):
            break
        inside = order[slots]
        if at is None:
            by = np.argsort((grouped.astype(np.uint64) << np.uint64(32)) | owner[inside].astype(np.uint64))
            order[slots] = inside[by]
            common[slots[same]] = SPAN
            break
        key = (grouped.astype(np.uint64) << np.uint64(8 * step)) | (words[starts[inside] + (at + step - 8)].astype(np.uint64) & low)
        by = np.argsort(key)
        key = key[by]
        order[slots] = inside[by]
        apart = np.concatenate(([True], key[1:] != key[:-1]))
        split(slots[apart & same], at + step - 8)
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(apart, np.arange(len(slots)), 0))]
    return order, common


def _nearest_smaller(values: np.ndarray, common: np.ndarray, floor: int) -> np.ndarray:
    """For each place the least of ``common`` on the way back to the previous smaller value; 0 if under ``floor``.

    Places point to the one before and, while that is not smaller, take over where it points to.
    """
    n = len(values)
    at, least = np.arange(-1, n - 1), common.copy()
    todo = np.arange(n)
    while len(todo := todo[(at[todo] >= 0) & (least[todo] >= floor)]):
        todo = todo[values[at[todo]] >= values[todo]]
        before = at[todo]
        least[todo] = np.minimum(least[todo], least[before])
        at[todo] = at[before]
    least[(at < 0) | (least < floor)] = 0
    return least


def longest_previous_factors(codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts (positions in ``codes`` with SPAN bytes left) and their longest previous factors, at most SPAN.

    ``codes`` joins stretches of these lengths and documents; the factor is the longest string that begins
    at the start and also begins at one of a smaller document. Factors under ``floor`` are given as 0.
    """
    ends, counts = np.cumsum(lengths), lengths - SPAN + 1
    starts = np.repeat(ends - lengths - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    number = np.unique(docs, return_inverse=True)[1]
    owner = np.repeat(number, counts)
    order, common = suffix_order(codes, starts, owner)
    owner = owner[order]
    back = _nearest_smaller(owner, common, floor)
    ahead = _nearest_smaller(owner[::-1], np.append(common[1:], 0)[::-1], floor)[::-1]
    factors = np.empty(len(starts), np.int64)
    factors[order] = np.maximum(back, ahead)
    return starts, factors


def previous_factors(codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts whose SPAN bytes also start in a smaller document."""
    starts, factors = longest_previous_factors(codes, lengths, docs, SPAN)
    return starts[factors >= SPAN]


def _factors(key, table):
    """Intervals to remove, by block, from the stretches that meet in a bucket."""
    get = lambda name, t: np.concatenate([np.frombuffer(x, t) for x in table[name].to_pylist()])
    codes, lengths = get("data", np.uint8), get("lengths", "<u4").astype(np.int64)
    docs, rows, starts = get("docs", "<i8"), get("rows", "<u4").astype(np.int64), get("starts", "<u4").astype(np.int64)
    block = np.repeat(table["block"].to_numpy(), [len(x) // 4 for x in table["lengths"].to_pylist()])
    out = [(b, g) for b, g in zip(table["block"].to_pylist(), table["gone"].to_pylist(), strict=True) if g]
    if len(lengths):
        ends = np.cumsum(lengths)
        later = _later(codes, ends - lengths, lengths, docs, _prints(codes, ends - lengths, lengths))
        rest = np.flatnonzero(~later)
        some = _pieces(codes, (ends - lengths)[rest], lengths[rest])
        hit = np.zeros(len(some) + 1, bool)
        hit[previous_factors(some, lengths[rest], docs[rest])] = True
        # starts of one stretch never run on into the next: its last SPAN - 1 bytes start nothing
        first, stop = runs(hit)
        ends = np.cumsum(lengths[rest])
        of = np.searchsorted(ends, first, "right")
        begin = first - (ends - lengths[rest])[of] + starts[rest[of]]
        of = rest[of]
        gone = np.stack([np.append(rows[of], rows[later]), np.append(begin, starts[later]), np.append(begin + (stop - first) + SPAN - 1, (starts + lengths)[later])])
        whose = np.append(block[of], block[later])
        for b in np.unique(whose).tolist():
            out.append((b, gone[:, whose == b].astype("<i8").tobytes()))
    return _table(out, _FOUND)


def _cut(with_text: bool):
    def cut(key, table, found):
        table, _, raw = _texts(table)
        ends = np.cumsum([0] + [len(r) for r in raw])
        change = np.zeros(ends[-1] + 1, np.int64)
        for g in found["gone"].to_pylist():
            rows, a, b = np.frombuffer(g, "<i8").reshape(3, -1)
            np.add.at(change, ends[rows] + a, 1)
            np.add.at(change, ends[rows] + b, -1)
        removed = np.cumsum(change)[:-1] > 0
        codes = np.frombuffer(b"".join(raw), np.uint8)
        n_removed, n_spans, kept = [], [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            gone = removed[a:b]
            n_removed.append(int(gone.sum()))
            n_spans.append(len(runs(gone)[0]))
            kept.append(codes[a:b][~gone].tobytes() if n_removed[-1] else raw[len(kept)])
        out = {"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(ends)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())}
        if with_text:
            # a cut may leave part of a character: such bytes go too
            out |= {"text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), "rest": table["rest"]}
            return pa.table(out)
        return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return cut


def _blocked(docs: DataFrame, rest: list[str]) -> tuple[DataFrame, int]:
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if rest:
        columns.append(F.struct(*(docs[c] for c in rest)).alias("rest"))
    plain = docs.select(*columns)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
    width = max(1, -(-(total or 0) // BLOCK_BYTES))
    # rows without an id never remove each other's text and may be many: dealt by their text
    by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return plain.withColumn("block", F.pmod(by, F.lit(width)).cast("int")), width


def _removed(plain: DataFrame, width: int, with_text: bool) -> DataFrame:
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")])
    schema = schema.add("text", StringType()).add(plain.schema["rest"]) if with_text else schema.add("kept_sha256", StringType())
    blocks = plain.groupBy("block")
    told = blocks.applyInArrow(_tell(width), _ddl(_TOLD))
    shared = told.groupBy("bucket").applyInArrow(_share, _ddl(_SHARED))
    sent = blocks.cogroup(shared.groupBy("block")).applyInArrow(_send(width), _ddl(_SENT))
    found = sent.groupBy("bucket").applyInArrow(_factors, _ddl(_FOUND))
    return blocks.cogroup(found.groupBy("block")).applyInArrow(_cut(with_text), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null texts count as empty; texts under ``SPAN`` bytes keep everything; rows that repeat an id
    never remove each other's text; rows without an id come after all others. Very long texts are read in
    stretches; a task holds a block of about ``BLOCK_BYTES`` or one longer text. Extra columns are
    left behind. An empty table gives no rows.
    """
    return _removed(*_blocked(docs, []), False)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with the repeated passages cut out of ``text``.

    Edge cases as in ``remove_repeats``; other columns, whatever their names, come through unchanged. A cut that leaves
    part of a character takes the rest of it too.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    numbered = [f"c{k}" for k in range(len(rest))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(rest, numbered, strict=True)]
    plain, width = _blocked(docs.select("doc_id", "text", *columns, F.lit(0).alias("none")), [*numbered, "none"])
    cut = _removed(plain, width, True)
    return cut.select("doc_id", "text", *(F.col("rest").getField(n).alias(c) for c, n in zip(rest, numbered, strict=True))).select([F.col(f"`{c}`") for c in docs.columns])
