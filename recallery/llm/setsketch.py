"""Near-duplicate documents by SetSketch registers [operator 10]."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stored
from .components import connected_components, join_key_values
from .shingles import shingle_sets

#: Registers hold floor(1 - log_BASE(x)) of the least of exponential values with rate RATE.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: documents and shingles verified in one block; larger candidate groups are cut into several
BLOCK, BLOCK_SHINGLES = 1024, 6_000_000
#: bytes of text and documents whose blocks are verified together
PACK_BYTES, PACK = 4_000_000, 256
#: a pair goes if the threshold is this much less likely (in nats) than its best similarity
SURE = 14.0

_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = mix64(_SEEDS + np.uint64(77)) | np.uint64(1)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes. The sketch of a union is the larger of each register."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048, None] ^ _SEEDS
        part *= _ODD
        np.minimum(least, part.min(axis=0), out=least)
    uniform = (least >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54
    level = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(65537) + rows[:, k])
    return key.view(np.int64)


def _chance(x):
    """Probability that one register exceeds the other, by the share of hashes that only it has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 21)


def plausible(sketch: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``others`` may have this similarity, by the joint likelihood of registers and sizes.

    A pair's registers are larger, smaller or equal with probabilities that depend on the
    similarity and on both (known) sizes. The likelihood at the best similarity on a grid is held
    against the largest at or above the threshold.
    """
    larger = (sketch > others).sum(axis=1)
    smaller = (sketch < others).sum(axis=1)
    equal = REGISTERS - larger - smaller
    u = size / (size + sizes)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best = np.full(len(others), -np.inf)
    above = np.full(len(others), -np.inf)
    for j in np.append(_GRID, threshold):
        p = _chance(np.clip(u - v * j, 1e-9, 1))
        q = _chance(np.clip(v - u * j, 1e-9, 1))
        value = larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-9, 1))
        value = np.where(j <= most + 1e-12, value, -np.inf)
        np.maximum(best, value, out=best)
        if j >= threshold:
            np.maximum(above, value, out=above)
    return above >= best - SURE


class _Group:
    """Documents of one candidate group, with their labels so far (positions)."""

    def __init__(self, sets: list[np.ndarray], percent: int, sketched: bool = True):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.sketch = np.stack([registers(s) for s in sets]) if sketched else None
        self.label = np.arange(len(sets))
        self.index = None

    def linked(self, common: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
        union = self.sizes[x] + self.sizes[others] - common
        return 100 * common >= self.percent * union

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with x, from an index of all hashes of the group."""
        if len(others) <= 4:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[o], assume_unique=True)) for o in others])
        if self.index is None:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            self.index = values, np.append(first, len(flat)), owner[order]
        values, first, owner = self.index
        at = np.searchsorted(values, self.sets[x])
        begin, many = first[at], first[at + 1] - first[at]
        ends = np.cumsum(many)
        found = owner[np.repeat(begin - ends + many, many) + np.arange(ends[-1])]
        return np.bincount(found, minlength=len(self.sets))[others]

    def join(self, x: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[x]))
        self.label[np.isin(self.label, labels)] = labels[0]

    def compare(self, x: int) -> None:
        """Link x with every document outside its component that is similar enough."""
        other = np.flatnonzero(self.label != self.label[x])
        size = self.sizes[x]
        other = other[100 * np.minimum(self.sizes[other], size) >= self.percent * np.maximum(self.sizes[other], size)]
        if len(other):
            other = other[plausible(self.sketch[x], size, self.sketch[other], self.sizes[other], self.percent / 100)]
        if not len(other):
            return
        best = other[np.argmax((self.sketch[other] == self.sketch[x]).sum(axis=1))]
        one = np.array([best])
        if self.linked(self.common(x, one), x, one)[0]:
            self.join(x, one)
            other = other[self.label[other] != self.label[x]]
        if len(other):
            hit = other[self.linked(self.common(x, other), x, other)]
            if len(hit):
                self.join(x, hit)

    def solve(self) -> np.ndarray:
        """Components: each document outside the largest one has met all documents of the others."""
        met = np.zeros(len(self.sets), bool)
        for _ in range(len(self.sets)):
            largest = np.bincount(self.label).argmax()
            todo = np.flatnonzero(~met & (self.label != largest)) if met.any() else np.array([0])
            if not len(todo):
                break
            for x in todo.tolist():
                met[x] = True
                self.compare(x)
        return self.label


def sketch_documents(docs: DataFrame, words: int) -> DataFrame:
    """Per document: size of its shingle set, the two halves of a cryptographic digest of the whole set, and its band keys."""

    def sketch(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 1_000_000):
                sets = shingle_sets(texts[a:b], words)
                # the sets are sorted: equal digests are equal sets
                keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                bands = [band_keys(registers(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
                arrays = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "key1", "key2", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>")


def _verify(words: int, percent: int):
    """Components within each block; its first document may be the whole group's."""

    def verify(table):
        out_a, out_b, out_in = [], [], []
        table = table.sort_by([("grp", "ascending"), ("block", "ascending"), ("doc_id", "ascending")])
        ids, group, block = (table[c].to_numpy() for c in ("doc_id", "grp", "block"))
        cuts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (block[1:] != block[:-1]), [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = ids[a:b]
            found = _Group(shingle_sets(table["text"].slice(a, b - a).to_pylist(), words), percent)
            label = found.solve()
            root = np.flatnonzero(own == group[a])
            near = label == label[root[0]] if len(root) else np.zeros(b - a, bool)
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, label, own)
            out_a.append(own), out_b.append(least[label]), out_in.append(near)
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"a": join(out_a, pa.int64()), "b": join(out_b, pa.int64()), "near": join(out_in, pa.bool_())})

    return verify


def _narrow(words: int):
    """Size and registers of each text, in place of the text."""

    def narrow(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts], 1_000_000):
                sets = shingle_sets(texts[a:b], words)
                rest = batch.slice(a, b - a)
                keep = [rest.column(c) for c in ("doc_id", "grp", "blocks", "block")]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*keep, sizes, pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["doc_id", "grp", "blocks", "block", "size", "sketch"]
                )

    return narrow


def _meetings(narrow: DataFrame) -> DataFrame:
    """Rows of ``narrow`` dealt to meetings ``grp, block, party``: one block with one party of guests.

    Guests are the documents outside the component of their group's first one (``label <> grp``), cut
    into parties of about BLOCK; each party visits all blocks but those its guests are from.
    """
    marked = narrow.withColumn("outside", F.when(F.col("label") != F.col("grp"), F.col("doc_id")))
    every = join_key_values(marked, "grp", narrow.count(), guests=("count", "outside")).where("guests > 0")
    every = every.withColumn("parties", F.ceil(F.col("guests") / BLOCK).cast("int")).drop("guests", "outside")
    resident = every.withColumn("party", F.explode(F.sequence(F.lit(0), F.col("parties") - 1))).withColumn("guest", F.lit(False))
    guest = every.where("label <> grp").withColumn("party", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parties")).cast("int"))
    guest = guest.withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guest = guest.where("block <> home").withColumn("guest", F.lit(True))
    columns = ["grp", "block", "party", "doc_id", "label", "size", "sketch", "guest"]
    return resident.select(columns).unionByName(guest.select(columns))


def _plausible_pairs(percent: int, best_only: bool):
    """Of a meeting, each document that has to be compared on its full set, guests with their partners.

    With ``best_only`` one pair for each two components: that with the most equal registers.
    """

    def pairs(table):
        table = table.sort_by([("guest", "ascending"), ("doc_id", "ascending")])
        ids, label, size = (table[c].to_numpy() for c in ("doc_id", "label", "size"))
        root = table["grp"][0].as_py()
        guests = table["guest"].to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        partners: dict[int, list[int]] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for x in np.flatnonzero(guests).tolist():
            # two guests of different blocks meet in both; once is enough
            other = np.flatnonzero(~guests & (label != label[x]) & ((label == root) | (ids > ids[x])))
            other = other[100 * np.minimum(size[other], size[x]) >= percent * np.maximum(size[other], size[x])]
            if len(other):
                other = other[plausible(sketch[x], size[x], sketch[other], size[other], percent / 100)]
            if not len(other):
                continue
            if not best_only:
                partners[x] = other.tolist()
                continue
            equal = (sketch[other] == sketch[x]).sum(axis=1)
            order = np.argsort(-equal, kind="stable")
            of, first = np.unique(label[other[order]], return_index=True)
            for y_label, k in zip(of.tolist(), order[first].tolist(), strict=True):
                key = (int(label[x]), y_label)
                best[key] = max(best.get(key, (-1, 0, 0)), (int(equal[k]), x, int(other[k])))
        for _, x, y in best.values():
            partners.setdefault(x, []).append(y)
        at = sorted({*partners, *(y for found in partners.values() for y in found)})
        n = len(at)
        columns = [pa.array(np.full(n, table[c][0].as_py()), t) for c, t in (("grp", pa.int64()), ("block", pa.int32()), ("party", pa.int32()))]
        columns += [pa.array(v[at], pa.int64()) for v in (ids, label)]
        columns.append(pa.array([ids[partners.get(x, [])].tolist() for x in at], pa.list_(pa.int64())))
        return pa.Table.from_arrays(columns, ["grp", "block", "party", "doc_id", "label", "partners"])

    return pairs


def _confirm(words: int, percent: int):
    """Links among the plausible pairs of a meeting, on full sets."""

    def confirm(table):
        ids = table["doc_id"].to_numpy()
        found = _Group(shingle_sets(table["text"].to_pylist(), words), percent, sketched=False)
        _, found.label = np.unique(table["label"].to_numpy(), return_inverse=True)  # what is joined already counts as one
        order = np.argsort(ids)
        for x, partners in enumerate(table["partners"]):
            others = order[np.searchsorted(ids[order], np.array(partners.as_py(), np.int64))]
            others = others[found.label[others] != found.label[x]]
            if len(others):
                hit = others[found.linked(found.common(x, others), x, others)]
                if len(hit):
                    found.join(x, hit)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, found.label, ids)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(least[found.label], pa.int64())})

    return confirm


def _across(narrow: DataFrame, texts: DataFrame, words: int, percent: int, best_only: bool) -> DataFrame:
    """Links ``a, b`` between documents of different blocks; only those of plausible pairs move texts."""
    schema = "grp long, block int, party int, doc_id long, label long, partners array<long>"
    chosen = _meetings(narrow).groupBy("grp", "block", "party").applyInArrow(_plausible_pairs(percent, best_only), schema)
    chosen = stored(chosen, "plausible")
    full = texts.select("doc_id", "text").join(chosen.hint("merge"), "doc_id")
    return stored(full.groupBy("grp", "block", "party").applyInArrow(_confirm(words, percent), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``. Documents of
    equal sets (by a 128-bit digest of the whole set) are one class, found by grouping. The classes' sketches are cut into bands; those that
    meet in a band (at the threshold all but one of ten million pairs do) form candidate groups, in
    which likelihood estimates choose what is compared on full sets. Groups are cut into blocks
    of about 1024: each block is solved with the group's first document as a guest. Whatever that
    one's component does not hold then visits the other blocks in parties of about 1024, as sketches;
    of each two components the likeliest pair is compared on full sets first, then every plausible pair
    of documents that are still apart, so no link is lost and a task holds two blocks at most.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows without an id
    stay, with a null component. Rows that repeat an id count as one document. Extra columns go.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(sketch_documents(plain, words), "sketches")
    sets = ["n_shingles", "key1", "key2"]
    classes = stored(
        sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = join_key_values(banded, "band", BANDS * classes.count(), low=("min", "rep")).where("rep <> low")
    groups = stored(connected_components(shared.select(F.col("rep").alias("a"), F.col("low").alias("b"))), "groups")
    sized = groups.join(classes.select(F.col("rep").alias("node"), "n_shingles").hint("merge"), "node")
    counted = join_key_values(sized, "label", groups.count(), members=("count", "node"), shingles=("sum", "n_shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = counted.select(F.col("node").alias("doc_id"), F.col("label").alias("grp"), blocks.alias("blocks"))
    # members grow with the documents: never broadcast
    texts = plain.join(members.hint("merge"), "doc_id").groupBy("doc_id", "grp", "blocks").agg(F.min("text").alias("text"))
    texts = stored(texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "candidates")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = texts.where("doc_id = grp AND blocks > 1").withColumn("home", F.col("block")).withColumn("block", everywhere).where("block <> home").drop("home")
    size, many = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    pack = F.pmod(F.xxhash64("grp", "block"), F.lit(max((size or 0) // PACK_BYTES, many // PACK) + 1))
    verified = texts.unionByName(first).withColumn("pack", pack).groupBy("pack").applyInArrow(_verify(words, percent), "a long, b long, near boolean")
    verified = stored(verified, "verified")
    links = verified.select("a", "b")
    labels = stored(connected_components(links), "labels")
    large = texts.where("blocks > 1")
    narrow = stored(large.mapInArrow(_narrow(words), "doc_id long, grp long, blocks int, block int, size long, sketch binary"), "narrow")
    for best_only in (True, False):
        labelled = narrow.join(labels.hint("merge"), narrow.doc_id == labels.node, "left").withColumn("label", F.coalesce("label", "doc_id")).drop("node")
        labelled = stored(labelled, "labelled")
        if labelled.where("label <> grp").isEmpty():
            break
        links = links.union(_across(labelled, large, words, percent, best_only))
        labels = stored(connected_components(links), "labels")
    of_class = classes.join(labels, classes.rep == labels.node, "left").select(*sets, F.coalesce("label", "rep").alias("component"))
    out = sketched.join(of_class, sets, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
