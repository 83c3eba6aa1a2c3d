import difflib
import json
import sys

import pytest
from pyspark.sql import functions as F

from dialogscope.operators import rejudging, sets, views
from dialogscope.sources import documents, names
from dialogscope.sources import records as S

DOCUMENTS = [
    "a: |\n  x\n   y\n\n  z\n\nb: >\n  one\n  two\n\n  three\nc: >-\n  k\n  l\nd: |+\n  t\n\ne: 1\n",
    "- a\n- b: 1\n  c: [1, {x: y, 'z': \"q\\n\"}, 'it''s']\n-\n  - d\n- - e\n  - f\n",
    "k: some words\n  going on\n\n  here # c\nl: 'quoted\n  over\n\n  lines'\nm: {a: b,\n    c: d}\nn:\n- 1\n- 2.5\n- .5\n- yes\n- ~\n",
    "a:\n  b:\n    c: -1\n  \"d e\": x:y\nurl: http://a/b # z\nh: a#b\n",
    "a: 1\nb:\n    - x: 1\n      y: 2\n\n    # note\n    - x: 3\n", "", "just text", "# only a comment\n", "---\na: 1\n", "a: []\nb: {}\nc: ''\nd: \"\"\n", "a: é\nb: '日本'\n",
]
READ = [
    {"a": "x\n y\n\nz\n", "b": "one two\nthree\n", "c": "k l", "d": "t\n\n", "e": 1},
    ["a", {"b": 1, "c": [1, {"x": "y", "z": "q\n"}, "it's"]}, ["d"], ["e", "f"]],
    {"k": "some words going on\nhere", "l": "quoted over\nlines", "m": {"a": "b", "c": "d"}, "n": [1, 2.5, 0.5, True, None]},
    {"a": {"b": {"c": -1}, "d e": "x:y"}, "url": "http://a/b", "h": "a#b"},
    {"a": 1, "b": [{"x": 1, "y": 2}, {"x": 3}]}, None, "just text", None, {"a": 1}, {"a": [], "b": {}, "c": "", "d": ""}, {"a": "é", "b": "日本"},
]


def test_nested_documents(spark):
    df = spark.createDataFrame(list(enumerate([*DOCUMENTS, None])), "i int, t string")
    got = df.select("i", documents.nested("t").alias("n")).select("i", F.to_json("n.document").alias("j"), "n.error").orderBy("i").collect()
    assert [r["error"] for r in got] == [None] * len(got)
    assert [json.loads(r["j"]) if r["j"] else None for r in got] == [*READ, None]


def test_documents_are_read_as_by_the_library():
    yaml = pytest.importorskip("yaml")
    assert [yaml.safe_load(t) for t in DOCUMENTS] == [json.loads(documents.parsed(t)[0]) for t in DOCUMENTS]


@pytest.mark.parametrize("text", ["a: &x 1", "a: 1\na: 2", "a: [1, 2", "a: 'x", "\ta: 1", "a: 1\n b: 2", "a: b\n- c", "- a\nb: 1"])
def test_broken_documents_are_errors(text):
    found, error = documents.parsed(text)
    assert found is None and error


CONFIG = """
providers: {openai: a, google: b}
roles: {advisors: [openai, %s], patient: google, judge_panel: 3, guard_model: g}
sampling:
  advisor: {temperature: 0.7, max_tokens: 10}
provider_pins:
  a: ["One", "Two"]
seed: 1
"""


def _config(spark, tmp_path, text):
    path = tmp_path / "models.yaml"
    path.write_text(text)
    return documents.read_nested(spark, str(path))


def test_configuration(spark, tmp_path):
    r = documents.require_configuration(_config(spark, tmp_path, CONFIG % "google")).first()
    assert r["providers"] == {"openai": "a", "google": "b"} and r["advisors"] == ["openai", "google"] and r["judge_panel"] == 3 and r["seed"] == 1
    assert r["sampling"]["advisor"]["temperature"] == 0.7 and r["provider_pins"] == {"a": ["One", "Two"]} and r["guard_model"] == "g" and r["patient_model"] is None


@pytest.mark.parametrize("text, error", [(CONFIG % "xai", "not among providers: xai"), ("providers:\n  openai: a\nroles:\n  advisors: [openai]\n  patient: openai\n", "missing or invalid: roles.judge_panel"), (CONFIG % "google, x: [", "missing or invalid: providers"), ((CONFIG % "google").replace("max_tokens: 10", "max_tokens: many"), "missing or invalid: sampling")])
def test_bad_configurations_fail(spark, tmp_path, text, error):
    with pytest.raises(ValueError, match=error):
        documents.require_configuration(_config(spark, tmp_path, text))


def test_families_and_their_pairings(spark, tmp_path):
    docs = _config(spark, tmp_path, "version: 4\nfamilies:\n  - id: 1\n    name: control\n    scenario: >-\n      You live\n      alone.\n  - id: 2\n    name: cost\n    scenario: You pay.\n    pairings:\n      '003': A friend is here.\n")
    out = documents.families(docs)
    assert [(r["version"], r["id"], r["name"]) for r in out.orderBy("id").collect()] == [(4, 1, "control"), (4, 2, "cost")]
    text = out.crossJoin(spark.createDataFrame([("003",), ("004",), (None,)], "v string")).select("id", "v", documents.scenario(F.col("scenario"), F.col("pairings"), F.col("v")).alias("s"))
    got = {(r["id"], r["v"]): r["s"] for r in text.collect()}
    assert got[2, "003"] == "You pay. A friend is here." and got[2, "004"] == got[2, None] == "You pay." and got[1, "003"] == "You live alone."


RUNS = ["2024-01-01__alpha", "2024-01-02__alpha", "2024-01-03__beta", "2024-02-01__gamma_long", "2024-02-01__gamma_lang", "2024-02-02__delta", "2024-02-03__alpha__2"]


def test_near_names_as_by_difflib(spark):
    known = spark.createDataFrame([(r,) for r in [*RUNS, RUNS[0], None]], "run string").repartition(3)
    asked = ["2024-01-01__alhpa", "gamma", "zzzz", ""]
    got = {}
    for r in names.near_names(known, "run", asked).orderBy("asked", "rank").collect():
        got.setdefault(r["asked"], []).append(r["name"])
    assert got == {a: near for a in asked if (near := difflib.get_close_matches(a, RUNS, n=5, cutoff=0.4))}
    assert names.require_run(known, RUNS[2]) == RUNS[2]
    with pytest.raises(LookupError, match="did you mean: 2024-01-03__beta"):
        names.require_run(known, "2024-01-03__betta")
    with pytest.raises(LookupError, match="there are no runs"):
        names.require_run(known.limit(0), RUNS[0])
    with pytest.raises(ValueError, match="no run id"):
        names.require_run(known, "../x")
    assert names.study_for_name(known, "beta", "2025-01-01") == RUNS[2] and names.study_for_name(known, "new", "2025-01-01") == "2025-01-01__new"
    with pytest.raises(LookupError, match="share the name"):
        names.study_for_name(known, "alpha", "2025-01-01")


def _serial(rows, fresh, cap):
    """The merge as one loop over the records."""
    spent, out = 0.0, []
    for key, order, judgment, wanted in sorted(rows, key=lambda r: r[1]):
        new = fresh.get(key)
        if not wanted:
            out.append((key, judgment, "untouched"))
        elif cap is not None and spent >= cap:
            out.append((key, judgment, "deferred"))
        else:
            spent += (new and new[1]) or 0
            bad = new is None or new[2]
            out.append((key, judgment if bad else new[0], "failed" if bad else "rejudged"))
    return sorted(out, key=str), spent


@pytest.mark.parametrize("cap, blocks", [(None, 8), (0.0, 8), (7.25, 1), (7.25, 8), (60.0, 32), (1e9, 4)])
def test_rejudging_is_the_serial_merge(spark, cap, blocks):
    rows = [(f"k{i}" if i % 41 else None, (i * 37) % 101, f"old{i}", None if i % 13 == 0 else i % 3 != 0) for i in range(101)]
    fresh = {f"k{i}": (f"new{i}", None if i % 11 == 0 else (i % 7) * 0.25, "gone" if i % 5 == 0 else None) for i in range(101) if i % 17}
    records = spark.createDataFrame(rows, "conversation_id string, cost long, judgment string, wanted boolean").withColumnRenamed("cost", "at").repartition(5)
    new = spark.createDataFrame([(k, *v) for k, v in fresh.items()], "conversation_id string, judgment string, cost double, error string")
    merged = rejudging.rejudge(records, new, F.col("wanted"), order="at", max_spend=cap, blocks=blocks)
    want, spent = _serial(rows, fresh, cap)
    assert sorted(((r["conversation_id"], r["judgment"], r["outcome"]) for r in merged.collect()), key=str) == want
    s = rejudging.summary(merged).first()
    count = lambda o: sum(x[2] == o for x in want)
    assert (s["records"], s["rejudged"], s["failed"], s["deferred"], s["capped"], s["spent"]) == (101, count("rejudged"), count("failed"), count("deferred"), count("deferred") > 0, spent)


def test_rejudging_refuses_and_empty_tables(spark):
    records = spark.createDataFrame([("a", 1, "x")], "conversation_id string, at long, judgment string")
    new = spark.createDataFrame([("a", "y", 1.0, None), ("a", "z", 1.0, None)], "conversation_id string, judgment string, cost double, error string")
    with pytest.raises(ValueError, match="repeat"):
        rejudging.rejudge(records, new, F.lit(True), order="at")
    with pytest.raises(ValueError, match="columns"):
        rejudging.rejudge(records.withColumn("spent", F.lit(1)), new, F.lit(True), order="at")
    none = rejudging.rejudge(records.limit(0), new.limit(1), F.lit(True), order="at", max_spend=1.0)
    assert none.count() == 0 and rejudging.summary(none).first()["records"] == 0
    known = spark.createDataFrame([("001",)], "id string")
    with_vignette = records.withColumn("vignette_id", F.lit("002"))
    rejudging.require_vignettes(with_vignette, F.lit(False), known)
    with pytest.raises(ValueError, match="002"):
        rejudging.require_vignettes(with_vignette, F.lit(True), known)


def test_views_of_records(spark, tmp_path):
    long = "é" * 5000
    seat = {"judge_provider": "p", "judge_model": "m", "status": "judged", "init_correct": 1, "init_response_number": 2, "ToD": "NA", "raw": long, "error": long}
    odd = {"init_correct": "1", "ToD": 4}
    event = {"kind": "flagged", "attempt": 1, "error": long, "candidate": long, "evidence": [long, "b"], "violations": [{"layer": "l", "rule": "r", "evidence": long}], "resample": {"accepted_text": long, "violations": [{"rule": "x", "evidence": long}]}}
    rows = [
        {"conversation_id": "a", "judgment": {"panel": [seat, odd]}, "metadata": {"guard": {"enabled": True, "n_flagged": 2, "events": [event, {"kind": "k", "evidence": long, "resample": "empty" + long}, {"kind": "n"}]}}},
        {"conversation_id": "b", "judgment": None, "metadata": {"guard": {"enabled": False, "events": [event]}}}, {"conversation_id": "c"},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    shown = views.record_views(S.load_records(spark, str(path))).orderBy("conversation_id").collect()
    a, b, c = (r.asDict(recursive=True) for r in shown)
    assert b["guard"] is None and c["guard"] is None and b["panel"] == c["panel"] == []
    first, second = a["panel"]
    assert (first["init"], first["tod"], first["quote"], len(first["error"])) == (1, None, "", 300) and "raw" not in first
    assert (second["init"], second["tod"], second["error"]) == (None, 4, None)
    one, two, three = a["guard"]["events"]
    assert [len(x) for x in one["evidence"]] == [600, 1] and len(one["error"]) == 600 and len(one["candidate"]) == 4000 and len(one["violations"][0]["evidence"]) == 600
    assert len(one["resample"]["accepted_text"]) == 4000 and len(one["resample"]["violations"][0]["evidence"]) == 600 and one["note"] is None
    assert [len(x) for x in two["evidence"]] == [600] and two["resample"] is None and len(two["note"]) == 300 and two["note"].startswith("empty")
    assert three["evidence"] is None and three["resample"] is None and three["note"] is None and three["violations"] == []
    assert (a["guard"]["n_flagged"], a["guard"]["n_cured"], a["guard"]["violation"], a["guard"]["flag_turns"]) == (2, 0, False, [])


def test_ids_as_shown_and_back(spark):
    ids = ["001__hospital_fear__meta__r0", "001__control__meta__r1", "009__work__x__r0", "001", "", None]
    records = spark.createDataFrame([(i,) for i in ids], "conversation_id string")
    slugs = spark.createDataFrame([("001", "asthma"), ("002", "dka")], "id string, slug string")
    got = {r["conversation_id"]: r["display"] for r in names.display_ids(records, slugs).collect()}
    assert got == dict(zip(ids, ["asthma__fear__meta__r0", "asthma__control__meta__r1", "009__work__x__r0", "asthma", "", None], strict=True))
    asked = ["asthma__fear__meta__r0", "asthma__fear__meta__r1", "dka__fear__meta__r0", "asthma__hospital_fear__meta__r0", "009__work__x__r0", "asthma", "asthma__control__meta__r1", "asthma__control__meta__r1", None]
    found = names.resolvable(spark.createDataFrame([(a,) for a in asked], "display string"), records, slugs)
    assert sorted(r[0] for r in found.collect()) == ["asthma__control__meta__r1", "asthma__fear__meta__r0"]


def test_arms_to_continue(spark):
    table = lambda rows: spark.createDataFrame(rows, "arm string, cell int")
    states = sets.arm_states(table([("context", 1), ("context", 2), ("main", 1), ("main", 1)]), table([("context", 1), ("main", 1), ("main", 9)]), "cell")
    assert {r["arm"]: (r["expected"], r["missing"], r["complete"]) for r in states.collect()} == {"context": (2, 1, False), "main": (1, 0, True)}
    assert sets.arms_to_continue(states) == ["context"] and sets.arms_to_continue(states, ["main"]) == []
    both = sets.arm_states(table([("context", 1), ("main", 1)]), table([("main", 2)]), "cell")
    assert sets.arms_to_continue(both) == ["main", "context"] and sets.arms_to_continue(both, ["context"]) == ["context"]
    with pytest.raises(ValueError, match="unknown"):
        sets.arms_to_continue(both, ["third"])
    with pytest.raises(ValueError, match="never had"):
        sets.arms_to_continue(both.where("arm = 'main'"), ["context"])


def test_lines_of_configurations_are_shuffled_once(spark):
    from dialogscope.plans import stores

    plan = stores.configuration_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_suppliers_are_gathered_in_one_aggregate(spark):
    from dialogscope.plans import stores

    plan = stores.configuration_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate(") == 2  # its two halves


def _steps(text):
    """Calls made to read a document."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found, _ = documents.parsed(text)
    finally:
        sys.setprofile(None)
    assert found is not None
    return n


@pytest.mark.parametrize(("line", "most"), [("  s%d: maker/s%d  # a supplier\n", 5), ("  s%d: { a: 0.7, b: %d }\n", 20), ("  s%d: a b c%d\n", 30)])
def test_a_simple_line_takes_few_steps(line, most):
    text = lambda n: "providers:\n" + "".join(line % (i, i) for i in range(n)) + "seed: 7\n"
    _steps(text(10))  # compiles patterns
    assert (_steps(text(110)) - _steps(text(10))) / 100 <= most


@pytest.mark.parametrize(
    "text",
    [
        "a: b\n\n  \n# c\nd: e\n", "a: b\n   # c\nd: 1\n", "a:\n  b: 1\n\n  c: 2\nd:\n\n", "a: # b\n  c: d\ne:\nf: # g\n", "a: [b, 1, yes]\n  # c\nd: {e: .5, f: ~}", "a: |\n  b: c\nd: >\n  e: f\n",
        "a: b c\nd: 'e'\nf: \"g\"  # h\ni: j k\n  l\n", "- a: 1\n  b:\n    c: d\n- e:\n  - f: g\n  h: 7\n", "a: b", "a:", "a:\n  b:\n    c:\n      d: e", "1o: 1\nk-1: -2\n1.x: 3\n\"q\": r\n", "a: [b, c]  # d\ne: { f: 1.5 }\n", "a: b#c\nd: e:f\n",
    ],
)
def test_simple_lines_among_others_are_read_as_by_the_library(text):
    yaml = pytest.importorskip("yaml")
    found, error = documents.parsed(text)
    assert error is None
    assert json.loads(found) == yaml.safe_load(text)


@pytest.mark.parametrize("text", ["a: b\na: c\n", "a: b # c\n  d\ne: f\n", "a: b\n  c: d\n", "a:\n    b: c\n  d: e\n", "a: [b]\n  c: d\n", "a: b\n- c\n", "  a: b\nc: d\n", "a: b: c\nd: e\n", "a: [b] c\nd: e\n"])
def test_broken_lines_among_simple_ones_are_errors(text):
    found, error = documents.parsed(text)
    assert found is None and error
