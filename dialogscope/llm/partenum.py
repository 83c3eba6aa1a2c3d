"""N-gram Jaccard join by PartEnum signatures: complete, without pairs inside groups of copies.

A document's set holds the hashes of its distinct word shingles. Sizes fall into bands whose bounds
grow by 1 / similarity, so similar sets lie in one band or in neighbouring ones; each pair of
neighbouring bands is an instance, with the largest symmetric difference ``k`` that two similar
sets can have there. An instance divides the domain of shingles into partitions, and each of them
into two halves; a signature is the content of one half, that is, of every subset of one of the two
second-level partitions. Of ``k // 2 + 1`` partitions, one has a difference of at most one element,
so that one of its halves is the same: the two sets share a signature. There are half as many partitions
more, so that they share several, and each set keeps its weakest halves (those of fewest elements, in an order that is the same
for all sets) to itself, one less than are shared: the strongest shared half is sent by both. What is kept is
empty or one shingle, which would put all texts with a common shingle in one group. A set with too many empty halves sends the
shingles of its prefix, too (the smallest hashes, as many as ``similarity`` leaves), of which two similar sets share one.

1. Every task emits (signature, document) once for equal sets that it sees; sorted by signature,
   what stands alone goes. Equal sets are one node from there on.
2. Each group with a signature gives pairs with one node only, which are verified exactly; that node leaves the group.
3. Links make components. The nodes of groups that still hold several components are grouped anew, so that pairs
   don't grow with the square of a group: their shingles are put in order, rarer ones first, and two similar sets
   agree in one of the first fifth of both (the prefix that ``similarity`` leaves). Nodes that share a rare shingle (of up to
   ``few`` of these nodes) in their prefixes form the new groups, which give the pairs across components that a bound on the
   difference (counts of shingles in cells) doesn't rule out.
4. Only nodes with fewer rare shingles than their prefix is long (on the test data a hundredth of the nodes) go on
   in the signatures' groups, which give the pairs across components that the bound allows.
5. What was verified makes the final components: pairs that weren't verified lie inside one.

Defined results: a null, empty or blank text has an empty set (n_shingles 0), its own component and
no links; a text with fewer words than a shingle has one shingle, the whole sequence; rows that repeat a
doc_id are one node with the union of their links; rows without a doc_id come back with a null
component; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import connected, over_texts, partitions, run_bounds, scratch, stored, tidy, utf8, whole_runs

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Counts of shingles per document that bound differences from below; a byte each.
CELLS = 256
SEEN = 50_000
#: Pairs that a task bounds at a time.
PAIRS = 20_000
#: A shingle that so many of the nodes in open groups hold, or fewer, is rare.
FEW = 32
#: One shingle in so many (by its hash) can be rare: half of them are enough for nearly every prefix.
DOMAIN = 2
#: Ids that a task counts at a time.
HELD = 1_000_000
#: Rows of equal sets are dealt to so many tasks a set.
SALTS = 16
#: Ranges of signatures; a task holds one of them at a time (a power of two).
BUCKETS = 2048
#: Partitions beyond the least number that is complete, as a share of it.
SPARE = 0.5
#: Bytes of a word that a table hashes.
POSITIONS = 64

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
        return x ^ (x >> _U(32))


@functools.cache
def _of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for every byte at every place in a word (A-Z as a-z, white space 0), and which bytes are white space."""
    table = mix(np.arange(1, POSITIONS * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(POSITIONS, 256)
    table[:, 65:91] = table[:, 97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    table[:, space] = 0
    return table.ravel(), space


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, lower-cased, and how many of them each text has.

    A word's hash is the sum of its bytes' numbers; longer words than the table is are hashed one by one.
    """
    table, space = _of_bytes()
    joined = b" ".join([b"", *texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    blank = space[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])))
    if not len(starts):
        return np.zeros(0, _U), sizes
    spans = np.diff(starts, append=len(raw))  # with the white space that follows
    place = np.arange(len(raw) - starts[0], dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), spans)
    np.minimum(place, POSITIONS - 1, out=place)
    place <<= 8
    place |= raw[starts[0] :]
    hashes = np.add.reduceat(table[place], starts - starts[0])
    for i in np.flatnonzero(ends - starts > POSITIONS):
        hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]].lower())
    return hashes, sizes


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, sizes = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(flat), _U)
        for k in range(min(words, len(flat))):
            rolled[: len(flat) - k] = rolled[: len(flat) - k] * _U(0x9E3779B97F4A7C15) + flat[k:]
        rolled = mix(rolled)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            own = np.sort(rolled[at : at + n - words + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], _U))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


@functools.lru_cache(maxsize=4)
def bands(similarity: int, largest: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands."""
    low = [1]
    while low[-1] < largest:
        low.append(low[-1] * 100 // similarity + 1)
    return np.array(low, np.int64)


@functools.lru_cache(maxsize=512)
def partitions_of(instance: int, similarity: int) -> tuple[int, int]:
    """First-level partitions of an instance, and how many halves two similar sets have in common at least."""
    low = bands(similarity)
    hi = int(low[instance + 1]) - 1
    k = (hi + hi * 100 // similarity) * (100 - similarity) // (100 + similarity)
    least = k // 2 + 1
    parts = least + math.ceil(least * SPARE)
    return parts, 2 * parts - k


def signatures(sets: list[np.ndarray], similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of every non-empty set."""
    index = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(index):
        return np.zeros(0, _U), index
    low = bands(similarity)
    size = np.array([len(sets[i]) for i in index], np.int64)
    band = np.searchsorted(low, size, "right") - 1
    flat = np.concatenate([sets[i] for i in index])
    found, owners, short = [], [], np.zeros(len(index), bool)
    for down in (0, 1):
        instance = band - down
        use = instance >= 0
        which = index[use]
        items = flat[np.repeat(use, size)] if not use.all() else flat
        if not len(which):
            continue
        count, inst = size[use], instance[use]
        parts = np.array([partitions_of(int(i), similarity) for i in inst], np.int64)
        slots = 2 * parts[:, 0]
        base = np.concatenate([[0], np.cumsum(slots)])
        with np.errstate(over="ignore"):
            seed = mix((inst + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
            u = mix(items ^ np.repeat(seed, count))
            slot = (u >> _U(33)).astype(np.int64) % np.repeat(slots, count)
            at = np.repeat(base[:-1], count) + slot
            # content of a half: the sum of its elements' hashes, taken in parts that floats hold exactly
            held = np.bincount(at, minlength=base[-1])
            total = np.zeros(base[-1], _U)
            for shift in (0, 22, 44):
                part = ((u >> _U(shift)) & _U((1 << 22) - 1)).astype(np.float64)
                total += mix(np.bincount(at, weights=part, minlength=base[-1]).astype(_U) + _U(shift + 1))
            own = (np.arange(base[-1]) - np.repeat(base[:-1], slots)).astype(_U)
            sig = mix(total ^ mix(own * _U(0xC2B2AE3D27D4EB4F) + np.repeat(seed, slots) + held.astype(_U)))
        # the weakest halves stay at home, one less than two similar sets have in common: by elements, then by slot
        order = np.argsort(np.repeat(np.arange(len(which)) << 42, slots) | np.minimum(held, 255) << 34 | own.astype(np.int64))
        sent = np.zeros(base[-1], bool)
        sent[order[np.arange(base[-1]) - np.repeat(base[:-1], slots) >= np.repeat(parts[:, 1] - 1, slots)]] = True
        sent &= held > 0
        short[use] |= np.add.reduceat((held == 0).astype(np.int64), base[:-1]) >= parts[:, 1]
        found.append(sig[sent])
        owners.append(np.repeat(which, slots)[sent])
    for i, n in zip(index[short], size[short], strict=True):
        prefix = sets[i][: n - (n * similarity + 99) // 100 + 1]
        found.append(mix(prefix ^ _U(0x9FB21C651E98DF25)))
        owners.append(np.full(len(prefix), i))
    return np.concatenate(found), np.concatenate(owners)


def _emit(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Rows of two kinds: once per document its size and the hash of its set; signatures with their documents, packed by
    ``BUCKETS`` ranges of their hashes (``sig`` is the range), so that Spark deals out thousands of signatures a row."""

    def each():
        seen: dict[bytes, None] = {}
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = shingle_sets(utf8(batch.column(1)), words)
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fresh = []
            for s, h in zip(sets, hashes, strict=True):
                fresh.append(s if h not in seen else s[:0])
                if len(seen) >= SEEN:
                    seen.clear()
                seen[h] = None
            sig, owner = signatures(fresh, similarity)
            n = len(sets)
            own = np.array([xxhash.xxh3_64_intdigest(i.to_bytes(8, "little", signed=True)) for i in ids.tolist()], _U)
            bucket = (sig >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, of, bounds = sig[order], ids[owner[order]], run_bounds(bucket[order])
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            packed, n = len(spans), len(sets)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([bucket[order][bounds[:-1]], own.view(np.int64)])),
                    pa.concat_arrays([pa.nulls(packed, pa.int64()), pa.array(ids, pa.int64())]),
                    pa.concat_arrays([pa.nulls(packed, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]),
                    pa.concat_arrays([pa.nulls(packed, pa.binary()), pa.array(hashes, pa.binary())]),
                    *(pa.concat_arrays([pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()), pa.nulls(n, pa.binary())]) for x in (sig, of)),
                ],
                ["sig", "doc_id", "n", "h", "sigs", "ids"],
            )

        return work

    return over_texts(docs.where("doc_id is not null"), ["doc_id", "text"], "sig long, doc_id long, n long, h binary, sigs binary, ids binary", each)


def _shared(rows: DataFrame) -> DataFrame:
    """sig, doc_id, n, h: the signatures that another row has, too, and the rows of documents."""
    schema = "sig long, doc_id long, n long, h binary"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def several() -> Iterator[pa.RecordBatch]:
            sig, ids = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held, strict=True))
            order = np.argsort(sig)
            sig = sig[order]
            keep = np.zeros(len(sig), bool)
            np.equal(sig[1:], sig[:-1], out=keep[1:])
            keep[:-1] |= keep[1:]
            n = int(keep.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(ids[order[keep]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["sig", "doc_id", "n", "h"])
            held.clear()

        for batch in batches:
            of_docs = batch.filter(batch.column("n").is_valid())
            if of_docs.num_rows:
                yield of_docs.select(["sig", "doc_id", "n", "h"])
            packed = batch.filter(batch.column("n").is_null())
            for own, sigs, ids in zip(*(packed.column(c).to_pylist() for c in ("sig", "sigs", "ids")), strict=True):
                if held and own != bucket:
                    yield from several()
                bucket = own
                held.append((sigs, ids))
        if held:
            yield from several()

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, schema)


def _led(groups: DataFrame) -> DataFrame:
    """sig, lead, id: the first node of each signature's group with each of the others; ``groups``: sig, id, place.

    First is the node with the least ``place``.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, ids = batch.column("sig").to_numpy(), batch.column("id").to_numpy()
            bounds = run_bounds(sigs)
            leads = ids[bounds[:-1]].copy()
            if sig is not None and sigs[0] == sig:
                leads[0] = lead
            of = np.repeat(leads, np.diff(bounds))
            sig, lead = sigs[-1], leads[-1]
            other = of != ids
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (sigs, of, ids)], ["sig", "lead", "id"])

    return groups.repartition("sig").sortWithinPartitions("sig", "place", "id").mapInArrow(run, "sig long, lead long, id long")


def _may_link(n_a: np.ndarray, n_b: np.ndarray, cells_a: np.ndarray, cells_b: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs can be similar, by sizes and by counts in cells; never rules out a similar pair."""
    fits = 100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
    differ = np.abs(cells_a.astype(np.int16) - cells_b).sum(1)
    return fits & ((100 + similarity) * differ <= (100 - similarity) * (n_a + n_b))


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _cross_pairs(groups: DataFrame, similarity: int) -> DataFrame:
    """(a, b) of nodes that share a signature, lie in two components and may be similar."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # two nodes may share many signatures
        for table in whole_runs(batches, "sig"):
            sig, ids, comp, n = (table.column(c).to_numpy() for c in ("sig", "id", "component", "n"))
            cells, bounds = _cells(table.column("cells")), run_bounds(sig)
            left, right, held = [], [], 0

            def near() -> Iterator[pa.RecordBatch]:
                i, j = np.repeat(left, list(map(len, right))), np.concatenate(right)
                ok = _may_link(n[i], n[j], cells[i], cells[j], similarity)
                pairs = set(zip(np.minimum(ids[i], ids[j])[ok].tolist(), np.maximum(ids[i], ids[j])[ok].tolist(), strict=True)) - seen
                if pairs:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.update(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])
                left.clear()
                right.clear()

            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                for i in range(lo, hi - 1):
                    rest = np.flatnonzero(comp[i + 1 : hi] != comp[i]) + i + 1
                    for at in range(0, len(rest), PAIRS):
                        left.append(i)
                        right.append(rest[at : at + PAIRS])
                        held += len(right[-1])
                        if held >= PAIRS:
                            yield from near()
                            held = 0
            if left:
                yield from near()

    return groups.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n, the set as 64-bit hashes, and its counts in cells, of texts with words; the rows of an id lie together, and its equal sets are
    given once (or a few times, if it has more than ``SEEN`` or several tasks have it)."""

    def each():
        last, seen = None, set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last
            ids, sets = batch.column(0).to_pylist(), shingle_sets(utf8(batch.column(1)), words)
            fresh = []
            for k, (i, s) in enumerate(zip(ids, sets, strict=True)):
                if i != last or len(seen) >= SEEN:
                    seen.clear()
                last, h = i, xxhash.xxh3_128_digest(s)
                if len(s) and h not in seen:
                    fresh.append(k)
                seen.add(h)
            sets = [sets[k] for k in fresh]
            cells = [np.minimum(np.bincount((s >> _U(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in fresh], pa.int64()), *(pa.array(x, t) for x, t in (([len(s) for s in sets], pa.int64()), ([s.tobytes() for s in sets], pa.binary()), (cells, pa.binary())))],
                ["id", "n", "shingles", "cells"],
            )

        return work

    return over_texts(docs, ["id", "text"], "id long, n long, shingles binary, cells binary", each)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose sets are similar. Bounds by sizes and cells come first, then the sets."""
    small = sets.select("id", "n", "cells")
    for side in ("a", "b"):
        pairs = pairs.join(small.toDF(side, f"n_{side}", f"cells_{side}"), side)

    @tidy
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                fits = _may_link(n_a, n_b, _cells(batch.column("cells_a")), _cells(batch.column("cells_b")), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    # a shuffle lies between the two functions: in one task they would take two Python workers a core, which an executor keeps for all later steps
    pairs = pairs.mapInArrow(bounded, "a long, b long").hint("rebalance")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select("id", "shingles").toDF(side, f"set_{side}"), side)

    @tidy
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            if keep.any():
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """(sig, id) of groups with two nodes or more; of signatures with the same nodes one stays."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)]
    several = groups.groupBy("sig").agg(F.count("*").alias("size"), *marks).where("size > 1")
    several = several.groupBy("size", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig")
    return groups.join(several, "sig", "left_semi")


def _prefixes(open_nodes: DataFrame, sets: DataFrame, similarity: int, few: int = FEW) -> DataFrame:
    """sig (a rare shingle), id, component of nodes with it in their prefix; sig is null for nodes with too few of them.

    ``open_nodes`` has id, component, n and the number of sets. The order is the same for all: rare shingles of the domain by the
    number of these nodes and the hash, then all others, of which none is listed here. A similar set shares at
    least ceil(similarity * n) of n shingles, so the first one that two similar sets share is among the first
    n - ceil(similarity * n) + 1 of each. A node of several sets (of rows that repeat its doc_id) has all rare ones in
    its prefix, and too few.
    """

    @tidy
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                own = own[own % DOMAIN == 0]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), i))], ["sig", "id"])

    @tidy
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, key) of runs of 2 to ``few`` rows, the key being their length and 58 bits of the hash; per id, minus the
        number of shingles that it alone has."""
        alone: list[np.ndarray] = []
        sig, ids, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the open run (its last rows) and its length so far

        def told(sigs: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            alone.append(own[sizes == 1])
            many = (sizes > 1) & (sizes <= few)
            return pa.RecordBatch.from_arrays([pa.array(own[many]), pa.array(sizes[many] - 1 << 58 | (sigs[many].view(_U) >> _U(6)).view(np.int64))], ["id", "key"])

        def counted() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate([np.zeros(0, np.int64), *alone]), return_counts=True)
            alone.clear()
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(-n)], ["id", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, own, before = batch.column("sig").to_numpy(), batch.column("id").to_numpy(), 0
            if len(sig) and sigs[0] == sig[0]:
                before = size - len(sig)  # rows of the run that were let go
            else:
                yield told(sig, ids, np.full(len(sig), size))
                sig, ids = sig[:0], ids[:0]
            sigs, own = np.concatenate([sig, sigs]), np.concatenate([ids, own])
            bounds = run_bounds(sigs)
            sizes = np.diff(bounds)
            of_row = np.repeat(sizes + np.where(np.arange(len(sizes)) == 0, before, 0), sizes)
            last = bounds[-2]
            yield told(sigs[:last], own[:last], of_row[:last])
            sig, ids, size = sigs[last:][: few + 1].copy(), own[last:][: few + 1].copy(), int(of_row[-1])
            if sum(map(len, alone)) >= HELD:
                yield counted()
        yield told(sig, ids, np.full(len(sig), size))
        yield counted()

    rows = open_nodes.select("id").join(sets.select("id", "shingles"), "id").mapInArrow(listed, "sig long, id long")
    rows = rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(rare, "id long, key long")
    all_rows = open_nodes.join(rows, "id", "left")
    own = Window.partitionBy("id")
    is_rare = F.coalesce(F.col("key") > 0, F.lit(False))
    alone = F.coalesce(F.sum(F.when(F.col("key") < 0, -F.col("key"))).over(own), F.lit(0))
    length = F.when(F.col("sets") > 1, F.lit(1 << 40)).otherwise(F.col("n") - F.floor((F.col("n") * similarity + 99) / 100) + 1)
    all_rows = all_rows.select(
        "id", "component", F.when(is_rare, F.col("key")).alias("sig"), (length - alone).alias("room"), F.count_if(is_rare).over(own).alias("shared"),
        F.row_number().over(own.orderBy(~is_rare, "key")).alias("k"),
    )
    in_prefix, too_few = F.col("sig").isNotNull() & (F.col("k") <= F.col("room")), (F.col("shared") < F.col("room")) & (F.col("k") == 1)
    first = F.when(in_prefix & too_few, F.array("sig", F.lit(None).cast("long"))).when(in_prefix, F.array("sig")).when(too_few, F.array(F.lit(None).cast("long")))
    return all_rows.select("id", "component", F.explode(first).alias("sig"))


def _nodes_and_groups(docs: DataFrame, words: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, id) with the node of each document, links (a, b) of nodes by doc_id, and groups (sig, id)."""
    with scratch(docs.sparkSession):
        rows = stored(_shared(_emit(docs, words, similarity)), "signatures")
        of_docs = rows.where("n is not null")
        # equal sets: the smallest doc_id, first within each of some salts; only sets that several rows have are joined
        salted = of_docs.where("n > 0").groupBy("h", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
        first = salted.groupBy("h").agg(F.min("id").alias("id"), F.sum("rows").alias("rows")).where("rows > 1").select("h", "id")
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        dealt = of_docs.select("doc_id", "n", "h", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
        nodes = dealt.join(first, ["h", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("id"))
        nodes = stored(nodes, "nodes", outlives=2)
        # rows that repeat a doc_id with other texts: their sets are linked by that doc_id
        same_id = nodes.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b")

        groups = rows.where("n is null").join(nodes.where("n_shingles > 0").select("doc_id", "id").distinct(), "doc_id").select("sig", "id").distinct()
        groups = stored(groups, "all-groups")
        return nodes, same_id, stored(_distinct_groups(groups), "groups", outlives=1)


def components(docs: DataFrame, *, words: int = WORDS, similarity: int = SIMILARITY, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    with scratch(spark):
        nodes, same_id, groups = _nodes_and_groups(docs, words, similarity)
        # the node with most shared signatures comes first: the middle of a group of near copies, as a rule
        place = stored(groups.groupBy("id").agg((-F.count("*")).alias("place")), "places")
        # the sets of nodes in groups, in buckets by id: their texts are shuffled here, once at any size (by a merge join, which also sorts them by id),
        # the sets, which are larger and don't compress, in none of the joins below
        texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
        sets = stored(_sets(texts.join(place.select("id").hint("merge"), "id", "left_semi"), words), "sets", bucket="id")

        led = stored(_led(groups.join(place, "id")), "led")
        pairs = stored(led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct(), "pairs")
        links = stored(_verified(pairs, sets, similarity).union(same_id), "links")

        def still_open(of: DataFrame, component: DataFrame) -> DataFrame:
            """Groups that hold several components, without the nodes' sets: sig, id, component."""
            within = of.select("sig", "id").join(component, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
            open_ = within.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
            return within.join(open_, "sig", "left_semi")

        def verify(found: DataFrame) -> DataFrame:
            nonlocal pairs
            more = stored(found.distinct().join(pairs, ["a", "b"], "left_anti"), "more-pairs")
            pairs = pairs.union(more)
            return stored(_verified(more, sets, similarity), "more-links")

        # all pairs with a group's first node are decided: the others go on
        within = stored(still_open(led, connected(links)), "open-groups")
        per_id = sets.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("sets"))  # several where rows repeat a doc_id
        open_nodes = stored(within.select("id", "component").distinct().join(per_id, "id"), "open-nodes")
        parted = stored(_prefixes(open_nodes, sets, similarity, few), "prefixes")
        cells = sets.select("id", "n", "cells")
        shared = parted.where("sig is not null")
        several = shared.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
        links = links.union(verify(_cross_pairs(shared.join(several, "sig", "left_semi").join(cells, "id"), similarity)))
        final = stored(connected(links), "components", outlives=1)
        # what no rare shingle decides
        common = within.select("sig", "id").join(parted.where("sig is null").select("id"), "id", "left_semi")
        left = stored(still_open(_distinct_groups(common), final), "left-groups")
        last = verify(_cross_pairs(left.join(cells, "id"), similarity))
        if not last.isEmpty():
            final = stored(connected(links.union(last)), "components", outlives=1)
    nodes = nodes.join(final, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    blank = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return nodes.union(blank)
