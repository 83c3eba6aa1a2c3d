"""Line dedup with sharded cuckoo filters in front of exact reference-count tables.

The index holds, for each line key, which documents have it (``refs``) and how many they are with
the largest doc_id among them (``counts``): exact tables, so inserting a document and deleting it
again leaves what was there before. One cuckoo filter per shard of the key space holds the
fingerprints of the keys found in ``min_docs`` documents or more. A key that comes to that count
enters its shard's filter, one that falls below it leaves.

To decide on documents, their keys are dealt out by shard and pass the filter of the shard, which
comes first in the stream; what passes (a few lines) is joined with the exact counts. Shards with
many references are salted, with a copy of the filter for each salt, so that a line that a third
of the documents hold doesn't end in one task.

Keys: a line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; lines under ``min_chars`` code
points have none. A key is held as its 128-bit hash.

Defined results: a null or empty text is one empty line and comes back as an empty text; rows that
share a doc_id count as one document and are cut alike; rows without a doc_id aren't counted and stay
whole; an empty table gives no rows; other columns stay as they are, but n_lines and n_dropped (in any case of letters)
are replaced by the result's.

The references that pass a filter are joined with the counts by key; a line of very many documents is one key there,
whose references Spark's adaptive execution splits among tasks (nothing above the join needs their partitioning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import over_texts, stored, utf8

MIN_DOCS = 5
MIN_CHARS = 40
SHARDS = 64
#: Frequent keys in one shard's filter, about: the first documents inserted set the number of shards.
KEYS_A_SHARD = 500_000
#: References of one shard that go to one task; shards with more get salts.
ROWS_A_SALT = 200_000
SLOTS = 4
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key, or None if it is too short to have one."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


class CuckooFilter:
    """Fingerprints of 16 bits, four to a bucket, each in one of two buckets; supports deletion."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.7 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        prints = np.maximum((keys >> np.uint64(48)).astype(np.uint16), 1)
        # all keys of a shard agree in what the shard is made of, so the bucket comes from a mix of all bits
        first = (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)) & self.mask
        return prints, first.astype(np.int64), (first ^ self._turn(prints)).astype(np.int64)

    def _turn(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> CuckooFilter:
        """The filter with the keys added; OverflowError, and a filter in no defined state, if they don't fit."""
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (first, second):
            for slot in range(SLOTS):
                free = left[self.table[bucket[left], slot] == 0]
                taken, at = np.unique(bucket[free], return_index=True)
                self.table[taken, slot] = prints[free[at]]
                left = np.setdiff1d(left, free[at], assume_unique=True)
        for i in left:
            if not self._kick(int(first[i]), int(prints[i])):
                raise OverflowError("the filter is full")
        return self

    def _kick(self, bucket: int, fingerprint: int) -> bool:
        for k in range(500):
            empty = np.flatnonzero(self.table[bucket] == 0)
            if len(empty):
                self.table[bucket, empty[0]] = fingerprint
                return True
            slot = (bucket + k) % SLOTS
            self.table[bucket, slot], fingerprint = fingerprint, int(self.table[bucket, slot])
            bucket ^= int(self._turn(np.array([fingerprint], np.uint16))[0])
        return False

    def delete(self, keys: np.ndarray) -> CuckooFilter:
        """Takes one fingerprint of each key away; the keys must have been inserted."""
        for fingerprint, *buckets in zip(*self._places(keys), strict=True):
            for bucket in buckets:
                at = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
        return self


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (doc_id, h1, h2) of the line keys of each document."""

    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if doc_id is not None:
                    own = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                    ids += [doc_id] * len(own)
                    keys += own
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "h1", "h2"])

        return work

    return over_texts(docs, ["doc_id", "text"], "doc_id long, h1 long, h2 long", each).distinct()


class LineIndex:
    """References, counts and filters of the documents inserted so far."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS, rows_a_salt: int = ROWS_A_SALT, keys_a_shard: int = KEYS_A_SHARD):
        self.spark, self.min_docs, self.min_chars, self.shards, self.rows_a_salt, self.keys_a_shard = spark, min_docs, min_chars, shards, rows_a_salt, keys_a_shard
        self.refs = spark.createDataFrame([], "doc_id long, h1 long, h2 long")
        self.counts = spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        self.filters = spark.createDataFrame([], "shard int, table binary")
        self.empty = True

    def _shard(self):
        return F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; one that is there already with the same lines changes nothing."""
        new = line_refs(docs, self.min_chars)
        if not self.empty:
            new = new.join(self.refs, ["doc_id", "h1", "h2"], "left_anti")
        new = stored(new, "line-refs")
        more = new.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        if self.empty:
            self.refs, counts = new, stored(more, "line-counts")
            self._build(counts.where(F.col("n") >= self.min_docs))
        else:
            counts = self.counts.union(more).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
            self._replace(self.refs.union(new), stored(counts, "line-counts"))
        self.counts, self.empty = counts, False
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes the documents of these doc_ids out again."""
        gone = stored(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi"), "line-refs-gone")
        refs = stored(self.refs.join(gone, ["doc_id", "h1", "h2"], "left_anti"), "line-refs")
        touched = gone.select("h1", "h2").distinct()
        recount = refs.join(touched, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        counts = stored(self.counts.join(touched, ["h1", "h2"], "left_anti").union(recount), "line-counts")
        self._replace(refs, counts)
        self.counts = counts
        return self

    def _replace(self, refs: DataFrame, counts: DataFrame) -> None:
        before = self.counts.where(F.col("n") >= self.min_docs).select("h1", "h2")
        after = counts.where(F.col("n") >= self.min_docs).select("h1", "h2")
        self.refs = refs
        if after.count() // self.keys_a_shard > 2 * self.shards:
            self._build(after)
        else:
            self._refilter(after.join(before, ["h1", "h2"], "left_anti"), before.join(after, ["h1", "h2"], "left_anti"), after)

    def _built(self, frequent: DataFrame) -> DataFrame:
        """The filters of these keys' shards; one that doesn't fit gets twice the size."""

        def built(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            size = len(keys)
            while True:
                try:
                    return pd.DataFrame({"shard": [key[0]], "table": [CuckooFilter.sized(size).insert(keys["h1"].to_numpy()).table.tobytes()]})
                except OverflowError:
                    size *= 2

        return frequent.select(self._shard(), "h1").groupBy("shard").applyInPandas(built, "shard int, table binary")

    def _build(self, frequent: DataFrame) -> None:
        """All filters anew, in as many shards as the keys call for."""
        self.shards = max(self.shards, frequent.count() // self.keys_a_shard)
        self.filters = stored(self._built(frequent), "line-filters")

    def _refilter(self, up: DataFrame, down: DataFrame, frequent: DataFrame) -> None:
        """Lets keys enter and leave their shards' filters; one that gets too full is built anew from all its frequent keys."""
        moves = up.select(self._shard(), "h1", F.lit(True).alias("enters")).union(down.select(self._shard(), "h1", F.lit(False)))

        def changed(key: tuple, old: pd.DataFrame, move: pd.DataFrame) -> pd.DataFrame:
            enters = move["h1"].to_numpy()[move["enters"].to_numpy(bool)]
            leaves = move["h1"].to_numpy()[~move["enters"].to_numpy(bool)]
            held = CuckooFilter(np.frombuffer(old["table"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else CuckooFilter.sized(0)
            held.delete(leaves)
            table = b""
            if (held.table != 0).sum() + len(enters) <= 0.8 * held.table.size:
                try:
                    table = held.insert(enters).table.tobytes()
                except OverflowError:  # pairs of buckets can be full before the filter is
                    pass
            return pd.DataFrame({"shard": [key[0]], "table": [table]})

        changes = stored(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(changed, "shard int, table binary"), "line-filters")
        full = changes.where(F.length("table") == 0).select("shard")
        # the number of shards is bounded by the keys' number over ``keys_a_shard``
        again = self._built(frequent.withColumn("shard", self._shard()).join(F.broadcast(full), "shard", "left_semi"))
        self.filters = stored(changes.where(F.length("table") > 0).union(again), "line-filters")

    def dropped(self, refs: DataFrame) -> DataFrame:
        """(doc_id, h1, h2) of the references whose lines go."""
        salts = self.counts.groupBy(self._shard()).agg(F.ceil(F.sum("n") / self.rows_a_salt).alias("salts"))  # a row per shard
        salts = F.broadcast(salts)
        data = refs.select(self._shard(), "doc_id", "h1", "h2").join(salts, "shard", "left")
        data = data.select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).alias("salt"), "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("table"))
        front = self.filters.join(salts, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "table")
        front = front.select("shard", "salt", *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "h1", "h2")), "table")
        dealt = data.union(front).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, None
            for batch in batches:
                shards, tables = batch.column("shard").to_numpy(), batch.column("table")
                ends = np.unique(np.concatenate([np.flatnonzero(np.diff(shards)) + 1, np.flatnonzero(tables.is_valid().to_numpy(zero_copy_only=False)), [0, len(shards)]]))
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    if shards[a] != shard:
                        shard, held = shards[a], None
                    if tables[a].is_valid:
                        held = CuckooFilter(np.frombuffer(tables[a].as_py(), np.uint16).reshape(-1, SLOTS))
                        a += 1
                    if held is not None and a < b:
                        part = batch.slice(a, b - a).select(["doc_id", "h1", "h2"])
                        part = part.filter(pa.array(held.contains(part.column("h1").to_numpy())))
                        if part.num_rows:
                            yield part

        near = dealt.mapInArrow(passing, "doc_id long, h1 long, h2 long")
        exact = self.counts.where(F.col("n") >= self.min_docs)
        return near.join(exact, ["h1", "h2"]).where(F.col("doc_id") < F.col("last")).select("doc_id", "h1", "h2")

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``docs`` with the text that stays, and n_lines (before) and n_dropped.

        ``refs``: the references of these documents, where they are at hand.
        """
        dropped = self.dropped(line_refs(docs, self.min_chars) if refs is None else refs)
        fields = [f for f in docs.schema.fields if f.name.lower() not in ("text", "n_lines", "n_dropped")]
        names = [f.name for f in fields]
        lines_gone = "gone"
        while lines_gone in map(str.lower, names):
            lines_gone += "_"
        dropped = dropped.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias(lines_gone))
        joined = docs.select(*[F.col(f"`{c}`") for c in names], "text").join(dropped, "doc_id", "left")
        least = self.min_chars
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_lines long, n_dropped long"])

        def each():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                gone = batch.column(lines_gone)
                texts, lines, drops = [], [], []
                for i, text in enumerate(utf8(batch.column("text"))):
                    parts = text.split(b"\n")
                    lines.append(len(parts))
                    if gone[i].is_valid:
                        out = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in gone[i].as_py()}
                        parts = [x for x in parts if line_key(x, least) not in out]
                        text = b"\n".join(parts)
                    texts.append(text)
                    drops.append(lines[-1] - len(parts))
                columns = [batch.column(i) for i in range(len(names))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], [*names, "text", "n_lines", "n_dropped"])

            return work

        return over_texts(joined, [*[f"`{c}`" for c in names], "text", lines_gone], schema, each)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All of ``docs`` inserted into an empty index, and each cut by it."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs)
    return index.apply(docs, index.refs)
