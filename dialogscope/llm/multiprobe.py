"""Nearest neighbours by multiprobe p-stable hashing.

Vectors fall into ranges of norms, each half the one above. In a range they are scaled by its upper end and get one
coordinate more, so that all have norm 1 and the largest inner product is the smallest Euclidean distance; a
vector far longer than the others doesn't squeeze them into a few buckets. A table's hash is a number of projections on Gaussian
(2-stable) directions, cut into slots of ``width``; that number follows the logarithm of the range's size (``hashes_for``),
so buckets don't grow in proportion to the vectors. A range of up to ``WHOLE`` vectors is one bucket.

A query visits, in every table of every range, its own bucket and those of ``probes - 1`` perturbations (each projection one slot
up, down or as it is) in the order of their estimated success: the sum of squared distances to the slot borders that are
crossed, smallest first, among sets of borders that are good on average (``templates``). The buckets' candidates are
merged across tables and reranked by exact inner products in double precision. A query that found fewer candidates than it
is due visits all buckets: it meets all vectors, in blocks.

Buckets are dealt to parts. A vector goes once to each part that holds buckets of it, with their numbers, and a query to the
parts that it visits, so copies don't grow with tables and probes. A part with more than its share of vectors is salted:
its vectors are divided, its queries copied. Equal vectors are one candidate that stands for its smallest ids, so a vector
that a third of the rows hold neither fills a bucket nor is searched for twice.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length
than the commonest (the shortest, on ties) take no part; of rows that repeat a vec_id with the same vector one counts,
with another vector each is a candidate and a query; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from dialogscope.llm.common import run_bounds, stored

TABLES = 40
WIDTH = 2.0
PROBES = 96
NEAREST = 20
SEED = 7
#: Ranges of norms; the last one holds all that is shorter.
RANGES = 16
#: A range of so many vectors is one bucket.
WHOLE = 256
#: Bytes of vectors in one part (about), and half of those in one of its salts (at most, about).
PART_BYTES = 50_000_000
LEAST_PARTS = 8


def hashes_for(vectors: int) -> int:
    """Projections of a table over so many vectors; none for a few."""
    return 0 if vectors <= WHOLE else round(4.7 + 0.47 * math.log2(vectors))


@lru_cache(maxsize=64)
def templates(m: int, probes: int) -> np.ndarray:
    """Sets of borders with the least expected cost, as rows over the 2 * m borders in the order of their distance.

    A projection's two borders are at places that add up to 2 * m - 1, and no set has both.
    """
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))  # expected squares of the m nearer of uniform places and of their complements
    far = 1 - j / (m + 1) + near
    cost = [*near, *far[::-1]]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        own, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - i in chosen for i in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (own - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (own + cost[last + 1], (*chosen, last + 1)))
    rows = np.zeros((len(out), 2 * m), bool)
    for k, chosen in enumerate(out):
        rows[k, list(chosen)] = True
    return rows


def perturbations(within: np.ndarray, probes: int) -> np.ndarray:
    """Slot shifts [vector, probe, projection], cheapest first; ``within``: places inside the slots, 0 to 1."""
    n, m = within.shape
    borders = np.concatenate([within, 1 - within], axis=1)  # one slot down, one slot up
    order = np.argsort(borders, axis=1, kind="stable")
    sets = templates(m, 2 * probes)
    cost = np.take_along_axis(borders, order, 1) ** 2 @ sets.T.astype(float)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    crossed = np.zeros((n, best.shape[1], 2 * m), np.int8)
    np.put_along_axis(crossed, np.broadcast_to(order[:, None, :], crossed.shape), sets[best].astype(np.int8), 2)
    return crossed[:, :, m:] - crossed[:, :, :m]


class Tables:
    """The projections of every table of one range, fixed by the seed, and its buckets' numbers (32 bits)."""

    def __init__(self, dim: int, scale: float, hashes: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.scale, self.hashes, self.tables, self.width = scale, hashes, tables if hashes else 1, width
        self.directions = rng.normal(size=(self.tables, dim + 1, hashes))
        self.offsets = rng.uniform(0, width, (self.tables, 1, hashes))
        self.code = rng.integers(1, 1 << 62, (self.tables, hashes)) | 1
        self.start = rng.integers(1, 1 << 62, self.tables)

    def _numbers(self, table: int, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys + self.start[table]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.uint32)

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table: [vector, table]."""
        unit = v / self.scale
        more = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        slots = np.floor((np.column_stack([unit, more]) @ self.directions + self.offsets) / self.width).astype(np.int64)
        with np.errstate(over="ignore"):
            return np.column_stack([self._numbers(t, (slots[t] * self.code[t]).sum(-1)) for t in range(self.tables)])

    def of_queries(self, v: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each query visits: [vector, tables x probes]."""
        v = v / np.abs(v).max(1, keepdims=True)
        unit = v / np.sqrt((v**2).sum(1, keepdims=True))
        places = (np.column_stack([unit, np.zeros(len(v))]) @ self.directions + self.offsets) / self.width
        out = []
        for t in range(self.tables):
            own = np.floor(places[t])
            with np.errstate(over="ignore"):
                key = (own.astype(np.int64) * self.code[t]).sum(-1)[:, None]
                if self.hashes:
                    key = key + perturbations(places[t] - own, probes).astype(np.int64) @ self.code[t]
            out.append(self._numbers(t, key))
        return np.concatenate(out, axis=1)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as arrays of doubles of one length."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # minus zero becomes zero
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(F.coalesce(ok, F.lit(False)))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``; ``ends`` counts its items."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


SCHEMA = "part int, salt int, is_query boolean, g long, rep long, keys binary, v binary"


def _rows(g: np.ndarray, rep: np.ndarray, v: np.ndarray, keys: np.ndarray, salts: np.ndarray, is_query: bool) -> Iterator[pa.RecordBatch]:
    """A row for each part that holds some of a vector's ``keys`` [vector, key] (for queries, for each of its salts)."""
    parts = len(salts)
    owner, flat = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel()
    order = np.argsort(owner * parts + flat % parts, kind="stable")
    flat, at = flat[order], (owner * parts + flat % parts)[order]
    bounds = run_bounds(at)
    who, part = np.divmod(at[bounds[:-1]], parts)
    for salt in range(int(salts[part].max(initial=1))):
        use = salts[part] > salt if is_query else (g[who] % salts[part]) == salt
        if use.any():
            held = np.repeat(use, np.diff(bounds))
            own = who[use]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[use].astype(np.int32)),
                    pa.array(np.full(len(own), salt, np.int32)),
                    pa.array(np.full(len(own), is_query)),
                    pa.array(g[own]),
                    pa.array(rep[own]),
                    _binaries(flat[held], np.cumsum(np.diff(bounds)[use])),
                    _binaries(v[own], np.arange(1, len(own) + 1) * v.shape[1]),
                ],
                ["part", "salt", "is_query", "g", "rep", "keys", "v"],
            )


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of binary values one after the other, and how many each value has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return items, np.diff(offsets) // np.dtype(kind).itemsize


def _best(nearest: int, kind: str):
    """Per part and salt the nearest candidates of each query; the vectors come first, the queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, index = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("part", "salt")], axis=1)
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            bounds = run_bounds(place[:, 0].astype(np.int64) << 33 | place[:, 1].astype(np.int64) << 1 | is_query)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo == hi:
                    continue
                if (here := tuple(place[lo])) != now:
                    now, pieces, index = here, [], None
                own = batch.slice(lo, hi - lo)
                g, rep = own.column("g").to_numpy(), own.column("rep").to_numpy()
                v, (flat, size) = _flat(own.column("v"), kind)[0].reshape(hi - lo, -1), _flat(own.column("keys"), "<u4")
                if not is_query[lo]:
                    pieces.append((g, rep, v, flat, size))
                    continue
                if not pieces:
                    continue
                if index is None:
                    g_, rep_, v_, all_keys, sizes = (np.concatenate([x[k] for x in pieces]) for k in range(5))
                    order = np.argsort(all_keys, kind="stable")
                    index, pieces = (all_keys[order], np.repeat(np.arange(len(g_)), sizes)[order], g_, rep_, v_), [None]
                keys, (flat, of, g_, rep_, v_) = np.split(flat, np.cumsum(size)[:-1]), index
                found: list[tuple] = []
                for q, query, mine in zip(g, v.astype(float), keys, strict=True):
                    first, last = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                    size = last - first
                    total = int(size.sum())
                    if not total:
                        continue
                    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)
                    seen = np.zeros(len(g_), bool)
                    seen[of[at]] = True
                    rows = np.flatnonzero(seen)
                    scores = (v_[rows].astype(float) * query).sum(1)  # row by row, so that a pair's score is the same in every part
                    if len(rows) > nearest + 1:
                        cut = -np.partition(-scores, nearest)[nearest]
                        over = np.flatnonzero(scores > cut)
                        ties = np.flatnonzero(scores == cut)
                        ties = ties[np.argsort(rep_[rows[ties]], kind="stable")[: nearest + 1 - len(over)]]
                        keep = np.concatenate([over, ties])
                        rows, scores = rows[keep], scores[keep]
                    found.append((np.full(len(rows), q), g_[rows], scores))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["q", "g", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, *, nearest: int = NEAREST, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id of ``queries`` (one column) among ``vectors``."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"  # what a row carries; sums are of doubles
    good = stored(clean(vectors), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = good.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= nearest + 1)
    groups = ranked.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    widest = F.array_max(F.transform("v", F.abs))  # squares of parts of it neither overflow nor vanish
    norm = widest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / widest) * (x / widest)))
    # the number of a group is its own once it is written
    groups = stored(groups.withColumn("g", F.monotonically_increasing_id()).withColumn("norm", norm), "vector-groups")
    wanted = good.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct().join(groups.select("v", "g"), "v").select("vec_id", "g")
    wanted = stored(wanted, "queries")
    top = groups.agg(F.max("norm").alias("m"), F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest, dim, n = float(top["m"]), int(top["d"]), int(top["n"])
    rows = max(1, PART_BYTES // (dim * np.dtype(kind).itemsize))
    in_range = F.least(F.floor(-F.log2(F.col("norm") / largest)), F.lit(RANGES - 1)).cast("int")
    sizes = {r["r"]: r["n"] for r in groups.groupBy(in_range.alias("r")).agg(F.count("*").alias("n")).collect()}  # RANGES rows at most
    made = {r: Tables(dim, largest * 2.0**-r, hashes_for(size), tables, width, SEED + r) for r, size in sizes.items()}
    query_groups = groups.join(wanted.select("g").distinct(), "g", "left_semi")

    def near_of(asked: DataFrame, parts: int, whole: bool) -> DataFrame:
        """q, g, score of the candidates kept; ``whole``: of all vectors, which lie in blocks."""

        def vector_keys(batch: pa.RecordBatch) -> Iterator[tuple]:
            g, rep, v, r = batch.column("g").to_numpy(), batch.column("rep").to_numpy(), _matrix(batch.column("v")), batch.column("r").to_numpy()
            for one in np.unique(r):
                own = r == one
                yield g[own], rep[own], v[own], (g[own] % parts).astype(np.uint32)[:, None] if whole else made[one].of_vectors(v[own])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(parts, np.int64)
            for batch in batches:
                for *_, keys in vector_keys(batch):
                    held += np.bincount(np.unique(np.arange(len(keys))[:, None] * parts + keys % parts) % parts, minlength=parts)
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["part", "n"])

        all_vectors = groups.select("g", "rep", "v", in_range.alias("r"))
        loads = all_vectors.mapInArrow(counted, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row per part
        salts = np.ones(parts, np.int64)
        for row in loads:
            salts[row["part"]] = max(1, -(-row["n"] // (2 * rows)))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, rep, v, keys in vector_keys(batch):
                    for at in range(0, len(g), 2048):
                        to = slice(at, at + 2048)
                        yield from _rows(g[to], rep[to], v[to].astype(kind), keys[to], salts, False)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, rep, v = batch.column("g").to_numpy(), batch.column("rep").to_numpy(), _matrix(batch.column("v")) if batch.num_rows else None
                for at in range(0, batch.num_rows, 128):
                    to = slice(at, at + 128)
                    keys = [np.tile(np.arange(parts, dtype=np.uint32), (len(g[to]), 1))] if whole else [x.of_queries(v[to], probes) for x in made.values()]
                    yield from _rows(g[to], rep[to], v[to].astype(kind), np.concatenate(keys, axis=1), salts, True)

        dealt = all_vectors.mapInArrow(index, SCHEMA).union(asked.select("g", "rep", "v").mapInArrow(visits, SCHEMA))
        dealt = dealt.repartition(int(salts.sum()), "part", "salt").sortWithinPartitions("part", "salt", "is_query")
        return dealt.mapInArrow(_best(nearest, kind), "q long, g long, score double")

    # up to a part's rows, each part may hold all vectors; from there on it holds some of their copies, one a table
    parts = sum(x.tables * sizes[r] for r, x in made.items()) // rows if n > rows else LEAST_PARTS
    near = stored(near_of(query_groups, parts, False), "near")
    due = min(nearest, n - 1)  # other vectors that a query can find, copies of its own aside
    found = near.where("q <> g").groupBy("q").agg(F.countDistinct("g").alias("found"))
    short = query_groups.join(found, query_groups["g"] == found["q"], "left").where(F.coalesce("found", F.lit(0)) < due).select("g", "rep", "v")
    short = stored(short, "short-queries")
    if not short.isEmpty():
        again = near_of(short, -(-n // rows), True)
        near = near.join(short.select(F.col("g").alias("q")), "q", "left_anti").union(again)
    near = near.groupBy("q", "g").agg(F.max("score").alias("score"))
    near = near.join(groups.select("g", "ids", "rep"), "g")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    near = near.withColumn("k", best).where(F.col("k") <= nearest + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    in_list = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("k", F.row_number().over(in_list)).where(F.col("k") <= nearest + 1).drop("k")
    lists = near.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("list"))  # nearest + 1 at most
    pairs = wanted.select(F.col("vec_id").alias("query_id"), F.col("g").alias("q")).join(lists, "q").select("query_id", "q", F.explode("list").alias("x"))
    pairs = pairs.select("query_id", "q", "x.vec_id", "x.score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
