"""Streams with state, their restarts, the log of progress, and the table of buckets that they write to."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from dialogscope.operators import sets
from dialogscope.sources.records import cache_key
from dialogscope.sources.store import KEEP, BucketStore
from dialogscope.streaming import logs, state

TURNS = "conv string, turn int, text string, cost double"


def _turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(conv, turn, rng.choice(["call them", "hello", "", None]), rng.choice([0.5, 1.25, None])) for conv in "abcde" for turn in range(8)]
    return [*rows, ("a", None, "call them", 1.0), ("quiet", 0, "hello", 1.0), ("late", 9, "call them", 0.0), ("late", 5, None, 0.0)]


def _write(folder, k: int, rows: list[tuple]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("conv", "turn", "text", "cost"), r, strict=True))) + "\n" for r in rows))


@pytest.mark.parametrize("sizes", [[44], [7, 1, 20, 16]])
def test_latched_stream_equals_batch_in_any_order(spark, tmp_path, sizes):
    """Rows shuffled over micro-batches, the stream stopped and started again between them."""
    rows = _turns(1)
    assert len(rows) == sum(sizes)
    random.Random(2).shuffle(rows)
    flag = F.col("text").contains("call")
    for k, n in enumerate(sizes):
        _write(tmp_path / "in", k, [rows.pop() for _ in range(n)])
        stream = logs.follow(spark, str(tmp_path / "in"), TURNS, files_per_trigger=1).withColumn("place", F.concat_ws("/", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(""))))
        logs.upsert(state.latched(stream, "conv", "turn", flag, "called"), str(tmp_path / "out"), "place", "called", str(tmp_path / "ck"), changes=True).awaitTermination()
    got = {(r["conv"], r["turn"], r["text"], r["called"]) for r in logs.latest(spark, str(tmp_path / "out")).collect()}
    want = sets.latched(spark.createDataFrame(_turns(1), TURNS), "conv", "turn", flag, "called").collect()
    assert got == {(r["conv"], r["turn"], r["text"], r["called"]) for r in want}
    assert any(x[3] for x in got) and not all(x[3] for x in got)


@pytest.mark.parametrize("fail_closed", [False, True])
def test_budget_stream_equals_batch_over_restarts(spark, tmp_path, fail_closed):
    rows = sorted((r for r in _turns(3) if r[1] is not None), key=lambda r: r[1])
    for k, part in enumerate([rows[:5], rows[5:30], rows[30:]]):
        part = list(part)
        random.Random(k).shuffle(part)
        _write(tmp_path / "in", k, part)
        stream = logs.follow(spark, str(tmp_path / "in"), TURNS, files_per_trigger=1)
        # rows of a turn that two batches share would have no order
        replayed = state.spend_replay(stream, "turn", "cost", 3.0, by="conv", fail_closed=fail_closed)
        logs.append_once(replayed.withColumn("id", F.concat("conv", F.lit("/"), "turn")), str(tmp_path / "out"), "id", "turn", str(tmp_path / "ck")).awaitTermination()
    got = {(r["conv"], r["turn"], r["spent"], r["runs"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = sets.spend_replay(spark.createDataFrame(rows, TURNS), "turn", "cost", 3.0, by="conv", fail_closed=fail_closed).collect()
    assert got == {(r["conv"], r["turn"], r["spent"], r["runs"]) for r in want}
    stopped = state.spend_replay(logs.follow(spark, str(tmp_path / "in"), TURNS), "turn", "cost", 3.0, by="conv", fail_closed=fail_closed, stop=True)
    logs.append_once(stopped, str(tmp_path / "stopped"), "turn", "turn", str(tmp_path / "ck2")).awaitTermination()
    assert all(r["runs"] for r in spark.read.parquet(str(tmp_path / "stopped")).collect())


def test_resumption_between_sink_and_checkpoint(spark, tmp_path):
    """A batch that reached the sink but not the checkpoint is done again, and each key still has one row."""
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    for k in range(4):
        _write(source, k, [(f"c{k * 10 + i}", 0, None, None) for i in range(10)])

    def run():
        logs.append_once(logs.follow(spark, str(source), TURNS, files_per_trigger=2), sink, "conv", "turn", str(checkpoint)).awaitTermination()
        return sorted(r["conv"] for r in spark.read.parquet(sink).collect())

    everything = sorted(f"c{i}" for i in range(40))
    assert run() == everything
    for mark in (checkpoint / "commits").iterdir():
        if mark.name.strip(".").split(".")[0] == "1":
            mark.unlink()
    (tmp_path / "out" / "_SUCCESS").unlink(missing_ok=True)  # as if the job had died while it moved its files
    assert run() == everything
    _write(source, 9, [("c3", 1, None, None), ("new", 1, None, None)])
    assert run() == sorted([*everything, "new"])


def test_progress_log(spark, tmp_path):
    listener = logs.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            _write(tmp_path / "in", k, [("a", k, None, None)] * (k + 1))
        logs.append_once(logs.follow(spark, str(tmp_path / "in"), TURNS, files_per_trigger=1), str(tmp_path / "out"), "turn", "turn", str(tmp_path / "ck"), name="turns").awaitTermination()
        broken = logs.follow(spark, str(tmp_path / "in"), TURNS).select(F.raise_error(F.lit("broken")).alias("x"))
        q = broken.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            q.awaitTermination()
        for _ in range(100):
            if len(list((tmp_path / "log").glob("[ef]*.json"))) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    events = logs.progress_log(spark, str(tmp_path / "log")).collect()
    mine = [r for r in events if r["name"] == "turns"]
    assert sorted((r["kind"], r["batch"], r["rows_in"]) for r in mine if r["kind"] == "progress" and r["rows_in"]) == [("progress", 0, 1), ("progress", 1, 2), ("progress", 2, 3)]
    assert {r["kind"] for r in mine} == {"started", "progress", "ended"}
    assert ["broken" in r["error"] for r in events if r["kind"] == "failed"] == [True]


def test_a_log_that_cannot_be_written_ends_nothing(spark, tmp_path, capsys):
    (tmp_path / "file").write_text("")
    logs.ProgressLog(spark, str(tmp_path / "file" / "log"))._write({"kind": "started"})
    assert "could not log started" in capsys.readouterr().err


def test_store_sets_and_gets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "store"), "key", buckets=8)
    schema = "key string, content string, cost double"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.set(frame([(f"k{i}", "first", 0.5) for i in range(20)] + [(None, "nobody", 1.0)]))
    before = store.manifest()[1]
    store.set(frame([("k3", "second", None), ("new", "x", 1.0)]))
    after = store.manifest()[1]
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2 and all(after[b] == before[b] for b in before if b not in touched)
    assert {tuple(r) for r in store.get(frame([("k3", "", 0.0), ("k3", "", 0.0), ("none", "", 0.0), (None, "", 0.0)])).collect()} == {("k3", "second", None)}
    assert store.read().count() == 21
    pruned = store.get(frame([("k3", "", 0.0)]))
    assert all(f"bucket={b}" in pruned.inputFiles()[0] for b in touched & {store._touched(frame([("k3", "", 0.0)]))[0]})
    assert store.set(frame([])) == 2


def test_store_keeps_the_greatest_in_order_and_cleans_up(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "store"), ["a", "b"], buckets=2)
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 3), v) for v in range(60)]
    rng.shuffle(rows)
    for at in range(0, 60, 10):
        store.set(spark.createDataFrame(rows[at : at + 10], "a int, b int, v int"), order="v")
    best = {}
    for a, b, v in rows:
        best[a, b] = max(v, best.get((a, b), -1))
    assert {((r["a"], r["b"]), r["v"]) for r in store.read().collect()} == set(best.items())
    folders = [p for p in (tmp_path / "store" / "data").iterdir()]
    assert len(folders) <= KEEP + 1 and len([p for p in (tmp_path / "store" / "manifests").iterdir() if p.name.isdigit()]) == KEEP


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    write = lambda who: [BucketStore(spark, root, "k", buckets=4).set(spark.createDataFrame([(f"{who}{i}", who) for i in range(part, part + 4)], "k string, who string")) for part in (0, 4, 8)]
    threads = [threading.Thread(target=write, args=(who,)) for who in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["k"] for r in BucketStore(spark, root, "k").read().collect()) == sorted(f"{w}{i}" for w in "xy" for i in range(12))
    assert BucketStore(spark, root, "k").manifest()[0] == 6


def test_replies_by_request(spark, tmp_path):
    """The cache of replies: the key is the request's hash, a repeated request finds the last reply."""
    asked = spark.createDataFrame([("m", "hello", 0.0, 10, 1, "reply"), ("m", "hello", 0.5, 10, 1, "other"), ("m", "hello", 0.0, 10, None, "no seed")], "model string, messages string, temperature double, max_tokens int, seed int, content string")
    keyed = asked.withColumn("key", cache_key(*map(F.col, asked.columns[:5])))
    store = BucketStore(spark, str(tmp_path / "cache"), "key")
    store.set(keyed.select("key", "content"))
    store.set(keyed.where("content = 'other'").select("key", F.lit("newer").alias("content")))
    found = keyed.drop("content").join(store.get(keyed), "key").collect()
    assert sorted(r["content"] for r in found) == ["newer", "no seed", "reply"]


def test_budget_state_travels_with_the_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    replayed = state.spend_replay(logs.follow(spark, str(tmp_path / "in"), TURNS), "turn", "cost", 3.0, by="conv")
    assert "FlatMapGroupsInPandasWithState" in replayed._jdf.queryExecution().analyzed().toString()
