"""Panels whose start is wrong or that lost a seat, rules on other alphabets, sweeps of a store."""

import json
import re

import pytest
from pyspark.sql import functions as F

from dialogscope.functions import text as T
from dialogscope.operators import sweep, votes

N = 8
SEAT = "struct<judge:string,model:string,status:string,error:string,init:int,tod:int,irn:int,quote:string>"


def seat(judge, init, tod, irn=1, quote=""):
    return (judge, "m", "judged", None, init, tod, irn, quote)


DEAD = ("meta", "m2", "unparseable", "no JSON", None, None, None, None)
CASES = [
    ([seat("a", 1, 3), seat("b", 1, 5), seat("c", 1, 8)], (1, 5, 1, "", "b", None)),
    ([seat("a", 1, 3), seat("b", 1, 7), seat("c", 1, 9)], (1, 7, 1, "", "b", None)),
    ([seat("a", 1, 4), seat("b", 1, 9), seat("c", 1, 9)], (1, 9, 1, "", "b", None)),
    # a majority against the start: no ToD, and no seat that it is from
    ([seat("a", 0, None, None), seat("b", 0, None, None), seat("c", 1, 2)], (0, None, None, "", None, None)),
    ([seat("a", 1, 4), seat("b", 1, 6), seat("c", 0, None)], (1, 6, 1, "", "b", None)),
    ([seat("a", 1, 4, quote="q4"), seat("b", 1, 9), seat("c", 1, 6, quote="q6")], (1, 6, 1, "q6", "c", None)),
    ([seat("a", 1, 3, 1), seat("b", 1, 5, 2), seat("c", 1, 8, 1)], (1, 5, 1, "", "b", None)),
    # a seat is lost: its record stays, the first seat with the resulting ToD is named
    ([seat("openai", 1, 9), DEAD, seat("xai", 1, 9)], (1, 9, 1, "", "openai", "meta")),
    ([seat("openai", 1, 9), DEAD, seat("xai", 1, 5, quote="q5")], (1, 5, 1, "q5", "xai", "meta")),
    ([seat("openai", 0, None, None), DEAD, seat("xai", 1, 9)], (0, None, 1, "", None, "meta")),
    ([DEAD, DEAD, seat("xai", 1, 9)], None),
    ([seat("openai", 1, 9), seat("xai", 1, 9)], None),
]


def test_panels_as_in_the_rules(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], f"i int, panel array<{SEAT}>")
    for r in df.select("i", votes.combine(F.col("panel"), F.lit(N)).alias("v")).collect():
        want, v = CASES[r["i"]][1], r["v"]
        got = v and (v["init"], v["tod"], v["irn"], v["quote"], v["median"], v["failed"] and v["failed"]["judge"])
        assert got == want, r["i"]
        if v and v["failed"]:
            assert (v["failed"]["model"], v["failed"]["status"], v["failed"]["error"]) == ("m2", "unparseable", "no JSON")


def test_rule_hits_do_not_depend_on_the_filter_before_them(spark):
    """Spaces and cases that Java's patterns see otherwise: the same rules as each pattern finds by itself."""
    base = ["Human: hello", "ok\n Patient: hello", "I called them.", "I'm trying to call the nurse", "thank you so much for everything, goodbye", "no rule here at all", ""]
    texts = [*base, *[t.replace(" ", s) for t in base for s in ("\u00a0", "\u2003", "\x1f", "\r", "\x0b", "\x85")], *[s + t for t in base for s in ("\u3000", "\x1c", "\u00e9 ", "\u2018")]]
    texts += [t.upper() for t in base] + [t.replace("s", "\u017f").replace("k", "\u212a") for t in base] + [t.replace("'", "\u2019") for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: [x["rule"] for x in r["h"]] for r in df.select("i", T.rule_hits("t").alias("h")).collect()}
    shield, pronoun, named = re.compile(T.NEGATION), re.compile(T.PRONOUN_CALL), re.compile(T.LINE_NAMES)
    for i, t in enumerate(texts):
        want = []
        for rule, shielded, pattern in T.RULES:
            for m in re.finditer(pattern, t):
                before = t[: m.start()]
                if not (rule == "D5_compliance_phrase" and pronoun.match(m[0]) and named.search(before) or shielded and shield.search(re.split(r"[.!?\n]", before)[-1])):
                    want.append(rule)
                    break
        assert got[i] == want, repr(t)
    assert got[-1] == [] and any("\u00a0" in t and got[i] for i, t in enumerate(texts))


@pytest.fixture
def store(tmp_path):
    def write(run, arm, rows):
        folder = tmp_path / "store" / run / arm
        folder.mkdir(parents=True)
        (folder / "conversations.jsonl").write_text("".join(json.dumps(dict(zip(("id", "family", "context", "at"), r, strict=True))) + "\n" for r in rows))

    write("2026-01__first run", "main", [("a", "cost", False, "2026-01-02"), ("b", "work", False, "2026-01-01"), ("b", "work", True, None)])
    write("2026-01__first run", "context", [("a", "cost", True, "2026-01-03"), (None, None, False, "2026-01-04")])
    write("2026-02__second", "main", [("a", "cost", False, "2026-02-01")])
    return str(tmp_path / "store")


def test_sweep_of_a_store_on_disk(spark, store):
    rows = sweep.store_rows(spark, store, "id string, family string, context boolean, at string")
    found = sweep.arm_battery(rows, "id", {"family": F.col("family").isNotNull()}, {"main": {"no context": ~F.col("context")}, "context": {"has context": F.col("context")}})
    got = {(r["run"][:7], r["arm"], r["check"]): r["failures"] for r in found.collect()}
    first, second = "2026-01", "2026-02"
    broken = {(first, "main", "no context"): 1, (first, "main", "unique keys"): 1, (first, "context", "family"): 1, (first, "context", "has context"): 1, (first, "context", "unique keys"): 1}
    assert {k: n for k, n in got.items() if n} == broken and len(got) == 12 and got[second, "main", "unique keys"] == 0
    listed = spark.createDataFrame([("2026-01__first run", "main", "a"), ("2026-01__first run", "main", "zz"), ("2026-03", "main", "a")], "run string, arm string, id string")
    assert {(r["run"], r["n"]) for r in sweep.unknown_ids(listed, rows, "id").collect()} == {("2026-01__first run", 1), ("2026-03", 1)}
    built = sweep.index_of(rows, "family", "at")
    entries = {(r["run"][:7], r["arm"]): (r["n"], r["families"], r["started"]) for r in built.collect()}
    assert entries == {(first, "main"): (3, "cost=1,work=2", "2026-01-01"), (first, "context"): (2, "=1,cost=1", "2026-01-03"), (second, "main"): (1, "cost=1", "2026-02-01")}
    assert sweep.index_differences(built, built).collect() == []
    stale = built.where("arm = 'main'").withColumn("n", F.when(F.col("run") == "2026-02__second", 7).otherwise(F.col("n")))
    assert sorted((r["run"][:7], r["arm"], r["n"], r["only"]) for r in sweep.index_differences(stale, built).collect()) == [(first, "context", 2, "built"), (second, "main", 1, "built"), (second, "main", 7, "stored")]
