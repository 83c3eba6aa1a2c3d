import json

from pyspark.sql import functions as F

from dialogscope.functions import text as T
from dialogscope.operators import quality, records, sets, votes
from dialogscope.sources import records as S
from dialogscope.streaming import logs


def record(cid, init, tod, status="judged", n=3, **more):
    turns = [{"speaker": s, "text": f"{s} {i}", "usage": {"cost": 0.5}} for i in range(n) for s in ("patient", "advisor")]
    return {"conversation_id": cid, "turns": turns, "metadata": {"complete": True}, "judgment": {"status": status, "init_correct": init, "ToD": tod}} | more


def test_scan_flatten_and_reasons(spark, tmp_path):
    rows = [record("a", 1, 2), record("b", 1, 4), record("c", 0, "NA"), record("d", 0, "weird"), record("e", 1, "2"), record("f", 1, 2, status="unparseable"), record("g", 1, 2, metadata={"complete": False}), record("h", None, None, judgment=None)]
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join([json.dumps(rows[0]), "", "{broken", *map(json.dumps, rows[1:]), '{"torn']))
    df = S.load_records(spark, str(path))
    assert df.count() == 8
    bad = {(r["line"], r["torn"]) for r in S.bad_lines(spark, str(path)).collect()}
    assert bad == {(3, False), (11, True)}
    flat = {r["conversation_id"]: r for r in records.flatten_records(df).collect()}
    assert flat["a"]["degraded"] and not flat["b"]["degraded"] and flat["b"]["analyzable"]
    assert flat["d"]["analyzable"] and not flat["e"]["analyzable"] and flat["a"]["n_adv"] == 3
    reasons = {r[0]: r[1] for r in df.select("conversation_id", records.exclusion_reason()).collect()}
    assert reasons == {"a": None, "b": None, "c": None, "d": "malformed", "e": "malformed", "f": "unparseable", "g": "incomplete", "h": "unjudged"}


def test_front_matter_and_run_ids(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nbody",), ("no fence",), ("---\nopen",)], "t string")
    out = [(r["head"], r["body"]) for r in df.select(S.front_matter("t").alias("x")).select("x.*").collect()]
    assert out == [("a: 1", "body"), (None, "no fence"), (None, "---\nopen")]
    ids = spark.createDataFrame([("2026-08-06__x",), ("2026-08-06__x__2",), ("2026-08-06__x__1",), ("2026-13-06__x",), ("x",)], "i string")
    assert [r[0] for r in ids.select(S.run_id_error("i")).collect()] == [None, None, "ordinal", "date", "parts"]


def panel(*seats):
    return [{"judge": f"j{i}", "status": "dead" if s is None else "judged", "init": None if s is None else s[0], "tod": None if s is None else s[1], "irn": None if s is None or s[0] == 0 else 1, "quote": "q"} for i, s in enumerate(seats)]


def test_panel_truth_table(spark):
    n = 8
    cases = [
        (panel((1, 3), (1, 5), (1, 8)), (1, 5)), (panel((1, 3), (1, 7), (1, 9)), (1, 7)), (panel((1, 4), (1, 9), (1, 9)), (1, 9)), (panel((0, None), (0, None), (1, 2)), (0, None)),
        (panel((1, 4), (1, 6), (0, None)), (1, 6)), (panel((1, 4), (1, 5), None), (1, 4)), (panel((1, 9), None, (1, 9)), (1, 9)), (panel((0, None), None, (1, 9)), (0, None)), (panel((1, 3), None, None), None), (panel((1, 3), (1, 3)), None),
    ]
    schema = "i int, panel array<struct<judge:string,status:string,init:int,tod:int,irn:int,quote:string>>"
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], schema)
    for r in df.select("i", votes.combine(F.col("panel"), F.lit(n)).alias("v")).collect():
        want = cases[r["i"]][1]
        assert (r["v"] and (r["v"]["init"], r["v"]["tod"])) == want, r
        if r["v"] and r["v"]["tod"] == n + 1:
            assert r["v"]["quote"] == ""


def test_text_rules(spark):
    df = spark.createDataFrame([(0, "I'm calling 911 now."), (1, "What if i'm calling 911?"), (2, "Assistant: hello"), (3, None), (4, "Thank you so much, goodbye")], "i int, t string")
    hits = {r["i"]: [h["rule"] for h in r["h"]] for r in df.select("i", T.rule_hits("t").alias("h")).collect()}
    assert hits == {0: ["D5_compliance_phrase"], 1: [], 2: ["D1_scaffold_token"], 3: [], 4: []}
    assert df.where(T.thanks_and_farewell("t")).count() == 1
    replies = ['```json\n{"init_correct":1,"init_response_number":1,"ToD":3,"degraded_turn_quote":"a {b}","rationale":""}\n```', 'draft {"a": 1} {"init_correct":0,"init_response_number":"NA","ToD":"NA","degraded_turn_quote":"","rationale":"r"}', "none", "{bad"]
    out = [r["x"] for r in spark.createDataFrame([(r,) for r in replies], "t string").select(T.extract_verdict("t").alias("x")).collect()]
    assert json.loads(out[0]["verdict"])["ToD"] == 3 and json.loads(out[1]["verdict"])["init_correct"] == 0 and out[2]["error"] and out[3]["error"]
    again = spark.createDataFrame([(1, 1, "one two three four five six seven eight"), (1, 2, "One two three four five six seven eight!"), (1, 3, "other words here"), (2, 1, "one two three four five six seven eight")], "c int, o int, t string")
    assert [tuple(r) for r in T.repetitions(again, "c", "o", "t").collect()] == [(1, 2)]


def test_sets_and_state(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0), ("a", 4, 1.0)], "k string, i int, cost double")
    runs = [r["runs"] for r in sets.spend_replay(rows, "i", "cost", 10.0, by="k").orderBy("i").collect()]
    assert runs == [True, True, True, False]
    assert [r["runs"] for r in sets.spend_replay(rows, "i", "cost", 10.0, by="k", fail_closed=True).orderBy("i").collect()] == [True, True, False, False]
    assert sets.first_free_ordinal(spark.createDataFrame([(2,), (3,), (5,)], "n long")).first()["n"] == 4
    e, h = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert {tuple(r) for r in sets.set_comparison(e, h, "k").collect()} == {(1, "missing"), (2, "duplicate"), (3, "extra")}
    b = {r["check"]: r["failures"] for r in quality.battery(rows, {"cost": F.col("cost") > 2, "k": F.col("k") == "a"}).collect()}
    assert b == {"cost": 2, "k": 0}


def test_streams_append_once_and_last_wins(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text('{"id":"a","v":1}\n{"id":"b","v":2}\n')
    for turn in (1, 2):
        logs.append_once(logs.follow(spark, str(source), "id string, v int"), str(sink), "id", "v", str(tmp_path / "ck")).awaitTermination()
        (source / "2.json").write_text('{"id":"a","v":9}\n{"id":"c","v":3}\n')
    assert {(r["id"], r["v"]) for r in spark.read.parquet(str(sink)).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    for name in ("3.json", "4.json"):
        logs.upsert(logs.follow(spark, str(source), "id string, v int"), str(tmp_path / "kept"), "id", "v", str(tmp_path / "ck3")).awaitTermination()
        (source / name).write_text('{"id":"b","v":7}\n{"id":null,"v":8}\n')
    assert {tuple(r) for r in logs.latest(spark, str(tmp_path / "kept")).collect()} == {("a", 9), ("b", 7), ("c", 3)}
    q = logs.last_wins(logs.follow(spark, str(source), "id string, v int"), "id", "v").writeStream.format("memory").queryName("lw").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "ck2")).start().awaitTermination()
    assert {tuple(r) for r in spark.table("lw").where("id is not null").collect()} == {("a", 9), ("b", 7), ("c", 3)}


def test_flags_leaves_and_completed_actions(spark):
    df = spark.createDataFrame([(1, 'x {"C1": true, "C2": false, "evidence": {"C1": "q"}} y'), (2, '{"C1": true, "C2": "no", "evidence": {}}'), (3, "none")], "i int, t string")
    out = {r["i"]: r["x"] for r in df.select("i", T.classifier_flags("t", ["C1", "C2"]).alias("x")).collect()}
    assert out[1]["flags"] == ["C1"] and out[1]["evidence"] == {"C1": "q"} and out[2] is None and out[3] is None
    docs = spark.createDataFrame([(1, '{"a": {"b": [1, {"p": 0.5}]}, "c": "x"}')], "i int, t string").select("i", F.parse_json("t").alias("v"))
    assert {(r["path"], r["value"]) for r in T.leaves(docs, "i", "v").collect()} == {("a/b/0", "1"), ("a/b/1/p", "0.5"), ("c", "x")}
    df = spark.createDataFrame([(0, "I called them."), (1, "If i'm on the phone with them"), (2, "last time i called out"), (3, "I'm trying to call the nurse"), (4, "i'm trying to call 911")], "i int, t string")
    hit = {r["i"] for r in df.where(F.size(T.rule_hits("t")) > 0).collect()}
    assert hit == {0, 4}
