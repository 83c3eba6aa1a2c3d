"""Append-only logs as streams: one record per id across restarts, last row wins, a log of progress."""

from __future__ import annotations

import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from dialogscope.sources.store import BucketStore


def follow(spark: SparkSession, path: str, schema, *, fmt: str = "json", files_per_trigger: int = 100, single_file: bool = False) -> DataFrame:
    """The files below a folder as they come; ``single_file``: one named file of a folder.

    ``files_per_trigger`` bounds what is done again after a failure: progress is kept after so many files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt)
    if single_file:
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def append_once(stream: DataFrame, sink: str, key: str, order: str, checkpoint: str, *, buckets: int = 64, name: str | None = None) -> StreamingQuery:
    """Appends the first row of each key that the sink doesn't have yet; safe to run again after a failure at any point.

    The sink is partitioned by a hash of the key (``bucket``): a batch reads the keys of those partitions only that it
    has rows for, and no other column. What is in a partition counts, whether or not the batch that wrote it came to its end.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def batch(rows: DataFrame, _: int) -> None:
        ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
        first = ranked.where("__k = 1").drop("__k").withColumn("bucket", bucket).persist()  # the source is read once
        touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        files, _at = _folder(spark, sink)
        there = [p for b in touched if files.exists(_folder(spark, p := f"{sink}/bucket={b}")[1])]
        new = first
        if there:
            new = first.join(spark.read.schema(rows.select(key).schema).parquet(*there).distinct(), key, "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(sink)
        first.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def upsert(stream: DataFrame, sink: str, key: str | list[str], order: str | None, checkpoint: str, *, buckets: int = 64, changes: bool = False) -> StreamingQuery:
    """Keeps the latest row of each key in a ``BucketStore``: a batch rewrites the buckets that it has rows for.

    ``order`` decides which of two rows with a key is later, whatever batches they come in, so a batch that is repeated
    after a failure changes nothing. ``changes``: the stream gives changed rows (update mode).
    """
    store = BucketStore(stream.sparkSession, sink, key, buckets)

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()  # the source, and what state gives out, are read once
        store.set(rows, order)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch)
    return writer.outputMode("update" if changes else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, sink: str, key: str | list[str] = "key") -> DataFrame:
    """The rows that ``upsert`` has kept."""
    return BucketStore(spark, sink, key).read()


class ProgressLog(StreamingQueryListener):
    """Writes each event of the session's streams to a folder, as a small JSON file, to be read by ``progress_log``.

    Rows out are null where a sink doesn't count them. An event that can't be written is named on stderr and never ends a stream.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), {}

    def _write(self, event: dict) -> None:
        try:
            name = f"{event['kind']}-{event.get('batch', 0):012d}-{uuid.uuid4().hex}.json"
            files, path = _folder(self.spark, f"{self.folder}/{name}")
            stream = files.create(path, False)
            try:
                stream.write(bytearray(json.dumps(event, ensure_ascii=False).encode()))
            finally:
                stream.close()
        except Exception as error:  # a log must not end a run
            print(f"warning: could not log {event.get('kind')}: {error}", file=sys.stderr)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._write({"kind": "started", "query": str(event.id), "run": str(event.runId), "name": event.name, "at": str(event.timestamp)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        out = p.sink.numOutputRows if p.sink is not None else -1
        rows = {"rows_in": p.numInputRows, "rows_out": None if out < 0 else out, "ms": (p.durationMs or {}).get("triggerExecution")}
        self._write({"kind": "progress", "query": str(p.id), "run": str(p.runId), "name": p.name, "at": str(p.timestamp), "batch": p.batchId, **rows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._write({"kind": "failed" if event.exception else "ended", "query": str(event.id), "run": run, "name": self.names.pop(run, None), "error": event.exception})


def progress_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events that a ``ProgressLog`` has written."""
    schema = "kind string, query string, run string, name string, at string, batch long, rows_in long, rows_out long, ms long, error string"
    return spark.read.schema(schema).json(folder)


def last_wins(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, to be written in complete or update mode."""
    others = [c for c in stream.columns if c != key]
    best = stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def windowed(stream: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Counts per key and tumbling window, with a bound on lateness (an extension)."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), key).count()
