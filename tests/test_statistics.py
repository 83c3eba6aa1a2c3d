import math

import pytest
from pyspark.sql import functions as F

from dialogscope.functions import exact
from dialogscope.functions import intervals as I
from dialogscope.operators import models, rates, resampling


def test_wilson_limits(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (170, 886)], "k long, n long")
    out = {(r["k"], r["n"]): (r["rate"], r["lo"], r["hi"]) for r in rates.with_rates(rows).collect()}
    assert out[0, 0] == (None, 0.0, 1.0)
    assert out[0, 10][1] == pytest.approx(0.0, abs=1e-12) and out[10, 10][2] == pytest.approx(1.0)
    assert out[170, 886] == pytest.approx((0.19187, 0.16730, 0.21911), abs=1e-5)


def test_published_contrast(spark):
    rows = spark.createDataFrame([(170, 886, 4, 179), (0, 50, 10, 50), (3, 5, 0, 0)], "k long, n long, k0 long, n0 long")
    a, b, c = rates.contrast(rows).orderBy(F.desc("n0"), F.desc("n")).collect()
    assert (a["rd"], a["rd_lo"], a["rd_hi"]) == pytest.approx((0.170, 0.128, 0.200), abs=6e-4)
    assert a["rr"] == pytest.approx(8.59, abs=0.005) and a["odds"] == pytest.approx(10.39, abs=0.005)
    assert (a["odds_lo"], a["odds_hi"]) == pytest.approx((3.80, 28.38), abs=0.01)
    assert a["p"] == pytest.approx(1.42e-10, rel=0.01) and not a["corrected"]
    assert b["corrected"] and c["rd"] is None


def test_exact_values():
    assert exact.mcnemar(3, 6) == pytest.approx(0.5078125) and exact.mcnemar(0, 0) == 1.0
    assert exact.rate_ratio(7, 28, 93, 92) == pytest.approx((0.2473, 0.0912, 0.5794, 0.000508), rel=2e-3)
    assert exact.rate_ratio(0, 0, 1, 1) == (None, None, None, 1.0) and exact.rate_ratio(3, 0, 1, 1)[0] is None
    assert exact.chi2_sf(39.0760, 6) == pytest.approx(6.92e-7, rel=2e-3) and exact.chi2_sf(4.0147, 4) == pytest.approx(0.404, abs=1e-3)
    m = exact.minimum_detectable(200, 200, 0.1)
    assert m / math.sqrt((0.1 + m) * (0.9 - m) / 200 + 0.09 / 200) == pytest.approx(1.959964 + 0.841621, abs=1e-4)


def test_holm_ties_and_cap(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.01), ("c", 0.04), ("d", 0.9)], "t string, p double").withColumn("f", F.lit(1))
    out = {r["t"]: r["p_holm"] for r in I.holm(rows, "p", ["f"]).collect()}
    assert out == pytest.approx({"a": 0.04, "b": 0.04, "c": 0.08, "d": 0.9})


def test_survival(spark):
    rows = spark.createDataFrame([(t,) for t in (1, 2, 3, 9, 9, 9)], "tod long")
    s = {r["t"]: r["k"] for r in rates.resistance(rows, "tod", 8).collect()}
    assert (s[1], s[2], s[8]) == (5, 4, 3)
    h = {r["t"]: (r["at_risk"], r["events"]) for r in rates.hazard(rows, "tod", 8).collect()}
    assert h[2] == (5, 1) and h[8] == (3, 0)


def test_kappa_without_variation_is_null(spark):
    rows = spark.createDataFrame([(1, 1)] * 5, "x int, y int")
    assert rates.kappa_table(rows, "x", "y").first()["kappa"] is None
    rows = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "x int, y int")
    assert rates.kappa_table(rows, "x", "y").first()["kappa"] == pytest.approx(0.4)


def test_bootstrap_covers_and_one_cluster_is_certain(spark):
    rows = spark.createDataFrame([(c, t, (c + i) % 3 == 0) for c in range(14) for t in (True, False) for i in range(20)], "c int, t boolean, d boolean")
    r = resampling.cluster_difference(rows, "c", F.col("t"), F.col("d"), 300).first()
    assert r["lo"] <= r["rd"] <= r["hi"] and r["replicates"] == 300
    one = resampling.cluster_difference(rows.where("c = 0"), "c", F.col("t"), F.col("d"), 50).first()
    assert one["se"] == 0.0


def test_models_recover_a_known_effect(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        u = rng.normal(0, 0.7)
        for t in (0, 1):
            p = 1 / (1 + math.exp(-(-1 + 1.2 * t + u)))
            rows += [(c, t, bool(x)) for x in rng.random(60) < p]
    cells = models.collapse(spark.createDataFrame(rows, "c int, t int, d boolean").withColumn("m", F.lit("m")), "c", {"t": F.col("t")}, F.col("d"), ["m"])
    for model in ("glmm", "gee", "logit", "slope"):
        r = models.fit(cells, ["m"], ["t"], model).where("term = 't'").first()
        assert r["error"] is None and abs(r["beta"] - 1.2) < 0.3 and 0 < r["se"] < 0.3, model
    assert 0.4 < models.fit(cells, ["m"], ["t"], "glmm").first()["sd"] < 1.0
    assert models.likelihood_ratio(cells, ["m"], ["t"], "t").first()["p"] < 1e-6


def test_short_stratum_raises(spark):
    rows = spark.createDataFrame([(i, "s", i % 3) for i in range(4)], "id int, stratum string, a int")
    assert models.diversity_sample(rows, "stratum", ["a"], F.col("id"), {"s": 3}).count() == 3
    with pytest.raises(Exception, match="quota"):
        models.diversity_sample(rows, "stratum", ["a"], F.col("id"), {"s": 5}).count()
