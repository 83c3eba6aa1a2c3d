"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch, and in what is worked on at a time, so that long texts stay well inside a worker's memory.
BATCH_BYTES = 8_000_000
SLICE_BYTES = 1_000_000
#: Short rows (a few numbers) that one file takes, and the least number of files.
ROWS_A_FILE = 250_000
FEWEST_FILES = 8
#: Folders of intermediate tables: those of the open ``scratch`` blocks, innermost last, and those that outlive them.
_OPEN: list[list[str]] = []
_LASTING: list[tuple[SparkSession, str]] = []
#: Names of the bucketed ones.
_TABLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes; whoever set a bound of at most that keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all runs in one process, a local one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dialogscope-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _remove_lasting() -> None:
    for spark, path in _LASTING:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block go at its end, except those that outlive it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)


def stored(df: DataFrame, name: str, outlives: int = 0, bucket: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder (compressed, column-pruned), which lost executors don't touch.

    The table goes at the end of the innermost ``scratch`` block, or of one further out if it ``outlives`` so many;
    where there is none, when the Python driver ends.
    ``bucket``: a column by whose hash the rows lie in as many buckets as there are shuffle partitions, so that joins and groups by it
    don't shuffle them again.
    Spark deletes the shuffle files of a plan when the driver has collected it, so that is asked for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    blocks = _OPEN[: max(0, len(_OPEN) - outlives)]
    if blocks:
        blocks[-1].append(path)
    else:
        _LASTING.append((spark, path))
    if bucket:
        _TABLES[path] = path.rpartition("/")[2].replace("-", "_")
        df.write.bucketBy(partitions(spark), bucket).option("path", path).saveAsTable(_TABLES[path])
    else:
        df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if bucket:
        return spark.table(_TABLES[path])
    return spark.read.schema(schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most so many short rows, in no more partitions than they call for.

    Whatever the number of shuffle partitions, so that small tables aren't written as hundreds of files: for each, Hadoop's local file system starts
    processes (chmod), which count with all of the executor's memory until they run.
    """
    return df.coalesce(max(FEWEST_FILES, rows // ROWS_A_FILE))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, at whose end Arrow's pool gives what it doesn't use back to the system.

    Else each Python worker keeps its largest task's 40 to 60 MB through all later steps.
    """

    @functools.wraps(run)
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return once


def over_texts(
    df: DataFrame, columns: list[str], schema: str, each: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """``mapInArrow`` over some columns; ``each()`` runs once a task and gives the function for a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
                del out, part
            del batch

    bound_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in parts of about ``most`` bytes of texts; a longer text is a part of its own."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, a null as empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A dictionary that computes what it lacks.

    At ``most`` entries it becomes the old generation and starts anew: what is used again is taken
    over from there, the rest goes with the next change of generation.
    """

    def __init__(self, compute: Callable, most: int = 150_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def binary(arrays: list) -> pa.Array:
    return pa.array([None if x is None else x.tobytes() for x in arrays], pa.binary())


def connected(nodes_links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has a link: columns ``id`` and ``component``.

    ``nodes_links`` holds undirected links ``a``, ``b`` (long). Every round joins each id's
    neighbours to the smallest of them (large-star, then small-star) and writes the links, until none
    changes, which their number and two sums of hashes tell; the number of rounds grows with the logarithm
    of the component's size.
    """

    def state(links: DataFrame):
        return links.agg(F.count("*"), *[F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "a", "b")), F.lit(0)) for k in (1, 2)]).first()

    links = stored(nodes_links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-links")
    before = state(links)
    for _ in range(rounds):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        links = stored(few_files(small, before[0]), "component-links")  # a round adds no links
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    lows = links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return lows.union(lows.select(F.col("component").alias("id"), "component").distinct())


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no run of equal keys is split; the rows arrive sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        first_of_last = int(run_bounds(keys.to_numpy(zero_copy_only=False))[-2])
        if held and first_of_last == 0 and held[-1].column(key)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        if held and first_of_last == 0:
            yield pa.Table.from_batches(held)
            held = [batch]
            continue
        if first_of_last:
            yield pa.Table.from_batches([*held, batch.slice(0, first_of_last)])
            held = [batch.slice(first_of_last)]
        else:
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)
