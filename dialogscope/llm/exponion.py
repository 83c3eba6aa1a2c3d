"""Product codes of vectors by k-means whose search for the nearest entry is bounded by an exponion's ball.

A vector's integer parts (``floor(scale * x)``) are assigned to the nearest entry of their position's codebook. The search begins
at the entry that the part had before (in the first round, at the one with the closest first component), at squared distance U.
An entry nearer than that, or as near, is at most twice as far from the old entry as the part is: its squared
distance from the old entry is at most 4 U. So only the old entry's neighbours within that radius are tried, in the order
of a table in which every entry's neighbours are sorted by distance. All distances are exact integers; of equally near entries the
first counts. Rounds of replacing entries by the floor of their parts' mean follow; only sums by entry leave the tasks.

Numbers: components are 64-bit integers where squared distances can't overflow, and Python's own beyond that. Sums travel in limbs of 48 bits;
an error beyond 2^63-1 is given as that.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; the first kept vector (by vec_id, nulls last, then
by its components) whose length is a multiple of the number of parts sets the dimension, and vectors of any other are dropped as well.
With fewer vectors than entries, each is an entry. Repeated rows all count. Labels are only compared, nulls count as
one. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogscope.llm.common import bound_batches, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Largest component for which 64 bits hold a squared distance of a vector of 2,048 components.
PLAIN = 1 << 24
LIMBS = 4
_LIMB = 48
MOST = (1 << 63) - 1

Codebooks = list[list[list[int]]]


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: 64-bit integers, or Python's where they are too large."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < PLAIN:
        return scaled.astype(np.int64)
    exact = lambda x: int(x * scale // 1) if abs(x) < 1e15 else int(x) * scale
    return np.array([exact(float(x)) for x in vectors.ravel()], object).reshape(vectors.shape)


class Codebook:
    """The entries of one position, and for each its neighbours by distance."""

    def __init__(self, entries: list[list[int]]):
        plain = all(abs(x) < PLAIN for entry in entries for x in entry)
        self.entries = np.array(entries, np.int64 if plain else object)
        between = ((self.entries[:, None] - self.entries[None]) ** 2).sum(2)
        # a stable order by distance: equally far neighbours by index
        self.order = np.array([sorted(range(len(entries)), key=row.__getitem__) for row in between.tolist()], np.int64)
        self.near = np.take_along_axis(between, self.order, 1)
        self.by_first = np.argsort(self.entries[:, 0], kind="stable")

    def start(self, parts: np.ndarray) -> np.ndarray:
        """The entry with the closest first component."""
        firsts = self.entries[self.by_first, 0]
        right = np.minimum(np.searchsorted(firsts, parts[:, 0]), len(firsts) - 1)
        left = np.maximum(right - 1, 0)
        closer = np.abs(firsts[left] - parts[:, 0]) <= np.abs(firsts[right] - parts[:, 0])
        return self.by_first[np.where(closer, left, right)]

    def nearest(self, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of, and squared distance to, each part's nearest entry, searched from the one it had ``before``."""
        if parts.dtype == object or self.entries.dtype == object:
            parts = parts.astype(object)
        distance = lambda rows, index: ((parts[rows] - self.entries[index]) ** 2).sum(1)
        best, least = before.copy(), distance(slice(None), before)
        reach = 4 * least
        rows = np.arange(len(parts))
        for rank in range(self.order.shape[1]):
            rows = rows[self.near[before[rows], rank] <= reach[rows]]
            if not len(rows):
                break
            index = self.order[before[rows], rank]
            far = distance(rows, index)
            better = (far < least[rows]) | (far == least[rows]) & (index < best[rows])
            best[rows[better]], least[rows[better]] = index[better], far[better]
        return best, least


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _coded(vectors: np.ndarray, codebooks: list[Codebook], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and errors summed over the parts."""
    parts = np.split(integers(vectors), len(codebooks), axis=1)
    found = [b.nearest(p, b.start(p) if before is None else before[:, i]) for i, (b, p) in enumerate(zip(codebooks, parts, strict=True))]
    return np.stack([index for index, _ in found], 1), sum(error for _, error in found)


def assigned(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vectors`` (vec_id, label, vector, and a code where a round went before) with ``code`` and ``error`` anew."""
    bound_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        for batch in batches:
            if batch.num_rows:
                old = None
                if "code" in batch.schema.names:
                    old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
                codes, errors = _coded(_matrix(batch), books, old)
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("vector")]
                columns += [pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary()), pa.array([min(int(x), MOST) for x in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "code", "error"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in ("vec_id", "label", "vector")]
    return vectors.mapInArrow(run, ", ".join([*fields, "code binary", "error long"]))


def _sums(coded: DataFrame, parts: int) -> DataFrame:
    """part, entry, number of parts and, component by component, the limbs of their sum: added up in each task, then once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for part, values in enumerate(np.split(integers(_matrix(batch)), parts, axis=1)):
                by_entry = np.argsort(codes[:, part], kind="stable")
                entries, at = np.unique(codes[by_entry, part], return_index=True)
                added, counts = np.add.reduceat(values[by_entry], at), np.diff(np.append(at, len(codes)))
                for entry, total, n in zip(entries.tolist(), added.tolist(), counts.tolist(), strict=True):
                    own = sums.setdefault((part, entry), [0] * (1 + len(total)))
                    own[:] = [x + y for x, y in zip(own, [n, *total], strict=True)]
        if sums:
            split = [[[x >> _LIMB * i & (1 << _LIMB) - 1 if i < LIMBS - 1 else x >> _LIMB * i for i in range(LIMBS)] for x in own[1:]] for own in sums.values()]
            columns = [[k[0] for k in sums], [k[1] for k in sums], [own[0] for own in sums.values()], [sum(x, []) for x in split]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "n", "limbs"])

    partial = coded.select("code", "vector").mapInArrow(run, "part int, entry int, n long, limbs array<long>")
    each = partial.select("part", "entry", "n", F.posexplode("limbs").alias("at", "limb"))
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("limb").alias("limb")).groupBy("part", "entry").agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "limb"))), lambda x: x["limb"]).alias("limbs")
    )


def updated(codebooks: Codebooks, sums: list) -> Codebooks:
    """Entries replaced by the floor of their parts' mean; those without parts stay."""
    out = [[list(entry) for entry in book] for book in codebooks]
    for row in sums:
        totals = [sum(x << _LIMB * i for i, x in enumerate(row["limbs"][at : at + LIMBS])) for at in range(0, len(row["limbs"]), LIMBS)]
        out[row["part"]][row["entry"]] = [x // row["n"] for x in totals]
    return out


def clean(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that take part, of whatever dimension."""
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).cast("array<double>").alias("vector"))
    return vectors.where(F.col("vector").isNotNull() & finite)


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (a byte for each part) and error of each vector that takes part, and the codebooks.

    ``entries`` is 256 at most. The codebooks (``entries`` times the dimension) are all that the driver holds.
    """
    vectors = clean(embeddings)
    usable = vectors.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    by_id = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = usable.orderBy(*by_id).select(F.size("vector").alias("n")).first()
    size = first["n"] if first else parts
    vectors = usable.where(F.size("vector") == size)
    initial = [integers(np.array(r["vector"])).tolist() for r in vectors.orderBy(*by_id).limit(entries).collect()]
    width = size // parts
    codebooks = [[v[i * width : (i + 1) * width] for v in initial] for i in range(parts)]
    if initial:
        for _ in range(rounds):
            vectors = stored(assigned(vectors, codebooks).drop("error"), "vector-codes")
            codebooks = updated(codebooks, _sums(vectors, parts).collect())
        return assigned(vectors, codebooks).select("vec_id", "label", "code", "error"), codebooks
    return vectors.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), codebooks


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (the errors of all rows of its label) and codebooks_sha256."""
    coded, codebooks = encode(embeddings)
    coded = stored(coded, "vector-codes")
    most = F.lit(MOST).cast("decimal(38,0)")
    labels = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    labels = labels.withColumnRenamed("label", "of_label")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
