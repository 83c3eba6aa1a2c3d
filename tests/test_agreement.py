"""Agreement of two raters: published labels and figures, and draws of a bootstrap against drawn rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogscope.operators import agreement, resampling

# A published audit's labels (stratum, other rater's start and kind, gap of the two turns, conversations), its population, figures and intervals.
LABELS = [
    ("degraded", 0, "init0", None, 6), ("degraded", 1, "degraded", 0, 5), ("degraded", 1, "degraded", 2, 1), ("degraded", 1, "held_firm", None, 2), ("held_firm", 0, "init0", None, 2),
    ("held_firm", 1, "degraded", None, 4), ("held_firm", 1, "held_firm", None, 21), ("init0", 0, "init0", None, 9),
]
POPULATION = {"degraded": 214, "init0": 232, "held_firm": 1024}
FIGURES = {
    "n": 50, "init_raw_agree": 0.84, "init_weighted_agree": 0.8860094302271171, "init_raw_kappa": 0.5975855130784707, "init_weighted_kappa": 0.6684777247742943, "kind_raw_agree": 0.72,
    "kind_weighted_agree": 0.7620127416045781, "kind_raw_kappa": 0.5586380832282472, "kind_weighted_kappa": 0.5601720019235857, "both_init_n": 33, "both_init_raw_agree": 0.8181818181818182,
    "both_init_raw_kappa": 0.543778801843318, "tod_n": 6, "tod_exact": 0.8333333333333334, "tod_within_1": 0.8333333333333334, "panel_degraded_share": 0.145578231292517,
    "human_degraded_share": 0.16559046899182953, "held_firm_init_agree": 0.9259259259259259, "held_firm_kind_agree": 0.7777777777777778,
}
INTERVALS = {
    "init_weighted_agree": (0.7982111363063742, 0.9584062196307092), "init_raw_kappa": (0.43674176776429807, 0.7690531177829101), "init_weighted_kappa": (0.5004298010439977, 0.8586662928678103),
    "kind_weighted_agree": (0.6384083792247056, 0.8706079257099663), "kind_raw_kappa": (0.39795304033714624, 0.7168030207677785), "kind_weighted_kappa": (0.3995880889998496, 0.7409342861769291),
    "degraded_kind_agree": (0.14285714285714285, 0.7142857142857143), "held_firm_kind_agree": (0.6296296296296297, 0.9259259259259259), "init0_kind_agree": (1.0, 1.0), "tod_exact": (0.5, 1.0),
    "tod_within_1": (0.5, 1.0), "human_degraded_share": (0.07239678940359212, 0.27379332685455127),
}


def _audit(spark):
    rows = [(s, 0 if s == "init0" else 1, init, s, kind, gap, n) for s, init, kind, gap, n in LABELS]
    cells = spark.createDataFrame(rows, "stratum string, panel_init int, human_init int, panel_kind string, human_kind string, gap int, n long")
    sizes = cells.groupBy("stratum").agg(F.sum("n").alias("n_s"))
    population = spark.createDataFrame(list(POPULATION.items()), "stratum string, pop long")
    return cells, sizes.join(population, "stratum").select("stratum", (F.col("pop") / (sum(POPULATION.values()) * F.col("n_s"))).alias("weight"))


def test_published_figures_and_intervals(spark):
    cells, weights = _audit(spark)
    found = agreement.figures(cells, weights).first().asDict()
    assert {k: found[k] for k in FIGURES} == pytest.approx(FIGURES, abs=1e-12)
    got = {r["target"]: r for r in agreement.bootstrap(cells, weights, 10_000, 20_260_626).collect()}
    assert got.keys() == INTERVALS.keys()
    for name, (lo, hi) in INTERVALS.items():
        step = 1 / 14 if name == "degraded_kind_agree" else 0  # its lower end lies between two of 14 conversations
        assert (got[name]["lo"], got[name]["hi"]) == pytest.approx((lo, hi), abs=0.02 + step), name
    # a replicate without a conversation that both call degraded has no such share
    assert 9_980 <= got["tod_exact"]["replicates"] <= 10_000 and got["init_raw_kappa"]["replicates"] == 10_000


def test_cells_of_rows_with_missing_labels(spark):
    rows = [("degraded", 6, 1, 3, 1, 4), ("degraded", 6, 1, 3, 1, None), ("held_firm", 6, 1, 9, 1, 3), ("init0", 6, 0, None, 0, None), ("degraded", 6, 1, 2, 1, 6)]
    df = spark.createDataFrame(rows, "stratum string, turns int, panel_init int, panel_tod int, human_init int, human_tod int")
    got = {(r["panel_kind"], r["human_kind"], r["gap"]): r["n"] for r in agreement.label_cells(df).collect()}
    assert got == {("degraded", "degraded", 1): 1, ("degraded", "held_firm", None): 1, ("held_firm", "degraded", None): 1, ("init0", "init0", None): 1, ("degraded", "degraded", 2): 1}
    weights = spark.createDataFrame([("degraded", 0.2), ("held_firm", 0.2), ("init0", 0.2)], "stratum string, weight double")
    only = agreement.label_cells(df.where("stratum = 'init0'"))
    assert agreement.figures(only, weights).first()["init_raw_kappa"] is None  # chance agreement is 1
    assert agreement.bootstrap(only, weights, 10, 1).where("target = 'init_raw_kappa'").collect() == []


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_replicates_have_the_moments_of_drawn_rows(spark, monkeypatch, chunk):
    """One chunk or many: totals are exact, and means and spreads those of drawing units with replacement."""
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rng = random.Random(1)
    rows = [(i, "s" if i % 3 else "t", float(rng.randint(0, 40)), 1.0) for i in range(90)]
    units = spark.createDataFrame(rows, "u int, g string, x double, one double").repartition(3)
    got = resampling.replicate_sums(units, ["x", "one"], ["u"], 1000, 7, "g").toPandas()
    assert len(got) == 2000 and sorted(got["rep"].unique()) == list(range(1000))
    for name, n in (("s", 60), ("t", 30)):
        mine, x = got[got["g"] == name], np.array([r[2] for r in rows if r[1] == name])
        assert (mine["one"] == n).all()
        assert abs(mine["x"].mean() - x.sum()) < 4 * np.sqrt(n * x.var() / 1000)
        assert mine["x"].std() == pytest.approx(np.sqrt(n * x.var()), rel=0.1)
    again = resampling.replicate_sums(units.repartition(5), ["x", "one"], ["u"], 1000, 7, "g").toPandas()
    assert got.sort_values(["rep", "g"])["x"].tolist() == again.sort_values(["rep", "g"])["x"].tolist()
    assert resampling.replicate_sums(units.limit(0), ["x", "one"], ["u"], 5, 7).toPandas()["x"].tolist() == [0.0] * 5
