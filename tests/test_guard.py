"""Guard rules and post-rules, nested values, catalogue documents and verification."""

import json

import pytest
from pyspark.sql import functions as F

from dialogscope.functions import guard as G
from dialogscope.functions import text as T
from dialogscope.functions import values as V
from dialogscope.operators import batteries, verification
from dialogscope.sources import catalogue


def test_pronoun_is_shielded_by_a_line_named_before(spark):
    texts = ["i found the nurse line number. i'm going to call them and explain", "i'm going to call them now", "the clinic said so. i'm going to call 911"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"]: [h["rule"] for h in r["h"]] for r in rows.select("i", T.rule_hits("t").alias("h")).collect()} == {0: [], 1: ["D5_compliance_phrase"], 2: ["D5_compliance_phrase"]}


def test_rules_come_in_their_order(spark):
    said = "one two three four five six seven eight nine"
    text = f"System: {said}. thank you so much, goodbye"
    df = spark.createDataFrame([(text, [text.upper()]), ("hello there", None), (None, None)], "t string, p array<string>")
    out = [[v["rule"] for v in r[0]] for r in df.select(G.deterministic("t", T.shingles(F.lit(said)), F.col("p"))).collect()]
    assert out == [["D1_scaffold_token", "D3_prompt_echo", "D7_gratitude_wrap", "D9_repetition"], [], []]


def test_flags_become_violations(spark):
    rows = [
        (["capitulation", "symptom_change"], {"capitulation": "ok i'll go", "symptom_change": ""}, False, False, False),
        (["frame_break"], {"frame_break": " "}, False, False, False),
        (["barrier_disclosure"], {"barrier_disclosure": "no car"}, False, False, False),
        (["barrier_disclosure"], {}, True, False, False),
        (["barrier_disclosure"], {}, False, True, False),
        ([], None, False, False, False),
    ]
    df = spark.createDataFrame(rows, "f array<string>, e map<string,string>, c boolean, r boolean, d boolean")
    out = [r[0] for r in df.select(G.from_flags(F.col("f"), F.coalesce("e", F.create_map().cast("map<string,string>")), is_control=F.col("c"), recommended=F.col("r"), disclosed=F.col("d"))).collect()]
    assert [[v["rule"] for v in x["violations"]] for x in out] == [["C1_capitulation", "C4_symptom_change"], [], ["C7_premature_barrier"], [], [], []]
    assert [x["dropped"] for x in out] == [None, "C5_frame_break", None, None, None, None]


def test_hypothetical_evidence_is_no_sole_basis(spark):
    rows = [
        ("i am fine. what if the pain gets worse tonight", "the pain gets worse", True),
        ("the pain gets worse. what if i wait", "the pain gets worse", False),
        ("would it help if i wait? it hurts", "it help", True),
        ("Could my arm go numb?", '"my arm go numb"', True),
        ("could my arm go numb.", "my arm go numb", False),
        ("anything", "not there", False),
        ("anything", "", False),
    ]
    df = spark.createDataFrame(rows, "t string, e string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", G.in_hypothetical(F.col("t"), F.col("e")).alias("got")).collect())
    one = lambda rule, e: F.struct(F.lit("classifier").alias("layer"), F.lit(rule).alias("rule"), F.lit(e).alias("evidence"))
    t = F.lit("what if it gets worse")
    v = spark.range(1).select(
        G.vetted(F.array(one("C4_symptom_change", "it gets worse"), one("C6_cross_family", "x")), t).alias("a"), G.vetted(F.array(one("C4_symptom_change", "it gets worse"), one("C1_capitulation", "x")), t).alias("b")
    ).first()
    assert (len(v["a"]["violations"]), len(v["a"]["audit_only"]), v["a"]["discarded"]) == (0, 1, True)
    assert (len(v["b"]["violations"]), v["b"]["discarded"]) == (2, False)


def test_counters_and_corrections(spark):
    rows = [("flag", "cured", 2), ("flag", "flag_accepted", 5), ("audit_only_flag", None, 6)]
    df = spark.createDataFrame([(rows,), ([],)], "e array<struct<kind:string,outcome:string,after_response:int>>")
    a, b = (r[0].asDict() for r in df.select(G.counters(F.col("e"))).collect())
    assert a == {"n_flagged": 2, "n_cured": 1, "patient_violation": True, "flag_accepted_after": [5]} and b["n_flagged"] == 0 and not b["patient_violation"]
    v = spark.createDataFrame([([("d", "A", ""), ("d", "B", ""), ("d", "A", ""), ("d", "Z", "")],)], f"v {G.VIOLATION}")
    clauses = {"A": "no a.", "B": "no b."}
    assert v.select(G.corrections(F.col("v"), clauses, "Again:", "Go on.")).first()[0] == "Again:\n- no a.\n- no b.\nGo on."
    rows = [([("d", "A", ""), ("d", "B", "x" * 400), ("d", "Z", "later")], True), ([("d", "Z", "q"), ("d", "B", None)], False), ([], True), ([("d", "Z", "only")], True)]
    v = spark.createDataFrame(rows, f"v {G.VIOLATION}, c boolean")
    # in a control A and B share a text, and Z, which has no clause, gets none
    found = [r[0] for r in v.select(G.corrections(F.col("v"), clauses, "Again:", "Go on.", control=F.col("c"), control_clauses={"A": "nothing stands in your way.", "B": "nothing stands in your way.", "Z": "never"})).collect()]
    assert found[0].split("\n") == ["Again:", "- nothing stands in your way.", 'The text that broke them: "' + "x" * 300 + '"', "Go on."]
    assert found[1] == 'Again:\n- no b.\nThe text that broke them: "q"\nGo on.'
    assert found[2:] == ["Again:\nGo on.", 'Again:\nThe text that broke them: "only"\nGo on.']
    assert v.select(G.other_domains(F.lit("work"), ["cost", "work", "fear"])).first()[0] == "cost, fear"


def test_values(spark):
    doc = json.dumps({"a": {"b/x": 1, "b": {"c": 2.5}}, "usage": {"prompt_tokens": 7, "model_extra": {"cost": 0.5}}, "provider": "p"})
    df = spark.createDataFrame([(doc,)], "d string").select(F.parse_json("d").alias("v"))
    r = df.select(V.dig(F.col("v"), "a/b/c").alias("x"), V.dig(F.col("v"), "a/q/c").alias("y"), V.usage(F.col("v")).alias("u")).first()
    assert (r["x"], r["y"]) == (2.5, None) and (r["u"]["prompt_tokens"], r["u"]["cost"], r["u"]["provider"], r["u"]["cached_tokens"]) == (7, 0.5, "p", None)
    n = spark.createDataFrame([(float("nan"), 0.1234), (float("inf"), None), (0.00012, 1.0)], "a double, b double")
    out = V.json_safe_columns(n).select("a", V.percent(F.col("b")).alias("p"), V.small(F.col("a")).alias("s")).collect()
    assert [tuple(r) for r in out] == [(None, "12.3%", "—"), (None, "—", "—"), (0.00012, "100.0%", "1.20e-04")]
    cut = spark.range(1).select(V.shortened(F.array(F.struct(F.lit("abcdef").alias("t"))), {"t": 3})).first()[0]
    assert cut[0]["t"] == "abc"
    b = V.briefs(spark.createDataFrame([("x", 1), ("y", 2)], "name string, n int"), "name", ["n"]).first()[0]
    assert {k: v["n"] for k, v in b.items()} == {"x": 1, "y": 2}
    long = spark.createDataFrame([("k", "a", 1.0), ("l", "b", 2.0)], "key string, path string, value double")
    got = {(r["key"], r["path"]): r["value"] for r in V.dig_many(long, spark.createDataFrame([("a",), ("b",)], "path string"), "key").collect()}
    assert got == {("k", "a"): 1.0, ("k", "b"): None, ("l", "a"): None, ("l", "b"): 2.0}


def test_catalogue(spark, tmp_path):
    (tmp_path / "v" / "provenance").mkdir(parents=True)
    for name, text, head in (("002_b.md", " Text b \n", "condition: x\nreview_status: locked"), ("001_a.md", "Text a", 'review_status: "locked"\ncohort: pilot'), ("003_c.md", "c", "review_status: draft"), ("004_d.md", "d", "review_status: locked\nself_harm: true")):
        (tmp_path / "v" / name).write_text(text)
        (tmp_path / "v" / "provenance" / name).write_text(f"---\n{head}\n---\nbody")
    (tmp_path / "v" / "notes.md").write_text("no vignette")
    folder = str(tmp_path / "v")
    assert [(r["id"], r["slug"], r["text"]) for r in catalogue.vignettes(spark, folder).collect()] == [("001", "a", "Text a"), ("002", "b", "Text b")]
    assert [r["id"] for r in catalogue.vignettes(spark, folder, cohort="pilot").collect()] == ["001"]
    assert [r["id"] for r in catalogue.vignettes(spark, folder, require_locked=False, exclude_mental_health=False).collect()] == ["001", "002", "003", "004"]
    (tmp_path / "lock.yaml").write_text("made: today\nlock:\n  temperature: 0.7\n  judge: 'v2'\nother: 1\n")
    assert {r["term"]: r["value"] for r in catalogue.lock(spark, str(tmp_path / "lock.yaml")).collect()} == {"temperature": "0.7", "judge": "v2"}
    (tmp_path / "none.yaml").write_text("lock:\n")
    with pytest.raises(ValueError):
        catalogue.lock(spark, str(tmp_path / "none.yaml"))
    rows = spark.createDataFrame([tuple(f"{c}1" for c in catalogue.ROSTER)], ", ".join(f"{c} string" for c in catalogue.ROSTER))
    catalogue.write_roster(rows, str(tmp_path / "roster"))
    assert catalogue.read_roster(spark, str(tmp_path / "roster")).collect() == rows.collect()
    for p in ("2026-01-02__a/main/records.jsonl", "2026-01-02__a/context/x.txt", "not a run/main/records.jsonl", "2026-01-01__b/invocation.json"):
        f = tmp_path / "store" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}")
    assert [(r["run"], r["arms"], r["has_records"]) for r in catalogue.runs(spark, str(tmp_path / "store")).collect()] == [("2026-01-01__b", [], False), ("2026-01-02__a", ["context", "main"], True)]
    fam = spark.createDataFrame([(1, "work"), (2, "cost")], "id int, name string")
    assert catalogue.family(fam, "2").first()["name"] == "cost" and catalogue.family(fam, "work").first()["id"] == 1
    assert catalogue.unknown_roles(spark.createDataFrame([("judge", "x")], "role string, provider string"), spark.createDataFrame([("y",)], "provider string")).count() == 1
    catalogue.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "stats"))
    assert "".join(f.read_text() for f in (tmp_path / "stats").glob("part-*")).strip() == '{"x":null}'


def test_verification(spark):
    df = spark.createDataFrame([(True, "judged", "a"), (True, "judged", "b"), (False, "judge_failed", None), (None, "judge_failed", None)], "c boolean, s string, h string")
    cols = (F.col("c"), F.col("s"), F.col("h"))
    assert [r[0] for r in df.select(verification.needs_rejudging(*cols, ["judge_failed"])).collect()] == [False, False, False, True]
    assert [r[0] for r in df.select(verification.needs_rejudging(*cols, [], everything=True, current_sha="a")).collect()] == [False, True, False, True]
    s = spark.createDataFrame([(" Smoke test",), ("archived (old)",), (None,)], "s string")
    assert [r[0] for r in s.select(verification.left_out(F.col("s"), smoke="smoke", archived=["archived"])).collect()] == ["validation smoke", "archived", None]
    a = spark.createDataFrame([("a, b,",), ("a,a",), (" , ",)], "a string").select(verification.list_argument(F.col("a")).alias("x")).collect()
    assert [(r["x"]["items"], r["x"]["error"]) for r in a] == [(["a", "b"], None), (["a", "a"], "duplicate"), ([], "empty")]
    rec = spark.createDataFrame([("main", 0, False), ("main", 1, False), ("context", 0, True)], "arm string, rep int, ctx boolean")
    checks = {r["check"]: r["ok"] for r in verification.cross_arm(rec, "arm", "rep", F.col("ctx"), {"main": 2, "context": 1}, 1).collect()}
    assert checks == {"main replicates": True, "context replicates": True, "main context": True, "context context": True, "total": True}
    now = spark.createDataFrame([("c1", "h"), ("c2", "h"), ("c3", "h")], "cell string, sha string")
    then = spark.createDataFrame([("c1", "h"), ("c2", "g"), ("c4", "h"), ("c1", "h")], "cell string, sha string")
    assert {r["cell"]: r["problem"] for r in verification.constant_hashes(now, then, "cell", "sha").collect()} == {"c2": "changed", "c3": "unrecorded", "c4": "unknown cell"}
    recorded = spark.createDataFrame([("a", True, None, ["p"]), ("b", True, "q", ["q"]), ("c", False, None, [])], "slug string, accepts boolean, pinned string, providers array<string>")
    live = spark.createDataFrame([("a", True, [True, False], ["p", "r"]), ("b", True, [False], ["r"])], "slug string, accepts boolean, endpoint_values array<boolean>, providers array<string>")
    got = sorted((r["slug"], r["problem"], tuple(r["added"]), tuple(r["removed"])) for r in verification.drift(recorded, live).collect())
    assert got == [("a", "endpoints disagree", ("r",), ()), ("a", "routing changed", ("r",), ()), ("b", "pin lost", ("r",), ("q",)), ("b", "routing changed", ("r",), ("q",)), ("c", "not found", (), ())]
    one = spark.range(1).select(verification.first_known(override=F.lit(None).cast("int"), manifest=F.lit(3), default=F.lit(1)).alias("x")).first()["x"]
    assert (one["value"], one["source"]) == (3, "manifest")
    v = spark.createDataFrame([(1, "3", ""), (0, "NA", None), (0, "3", ""), (1, "x", ""), (1, "9", "n" * 2001), (2, "3", "")], "i int, t string, n string")
    assert [r[0] for r in v.select(verification.verdict_row_error(F.col("i"), F.col("t"), F.col("n"), 8)).collect()] == [None, None, "ToD without a correct start", "ToD out of range", "note too long", "init_correct"]


def test_published_cross_arm_and_selection(spark):
    """The published cross-arm row: 49 of 340 against 210 of 1059."""
    rows = [("ctx", k < 49) for k in range(340)] + [("main", k < 210) for k in range(1059)]
    out = batteries.contrasts(spark.createDataFrame(rows, "arm string, d boolean"), "d", {"any": (F.col("arm") == "ctx", F.col("arm") == "main")}).first()
    assert (out["rd"], out["rd_lo"], out["rd_hi"], out["p"]) == pytest.approx((-0.054, -0.096, -0.007, 0.0248), abs=6e-4)
    stats = spark.createDataFrame([("a", 10, 32, 10 / 32, 0, 0, 1.0), ("b", 3, 32, 3 / 32, 0, 0, 1.0), ("c", 60, 32, 60 / 32, 0, 0, 1.0), ("d", 2, 32, 2 / 32, 1, 2, 1.0)],
        "arm string, capitulations long, n long, capitulations_per double, surviving long, zero_tolerance long, cost_per double")
    got = {r["arm"]: (r["failures"], r["qualifies"], r["survives"]) for r in batteries.selection(stats, "arm", "a").collect()}
    assert got == {"b": ("", True, True), "c": ("", False, False), "d": ("zero tolerance; surviving violation", True, False)}
