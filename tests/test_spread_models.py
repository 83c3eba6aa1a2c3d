"""Fits over clusters in many tasks are those of one task."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogscope.operators import models, spread_models

COLUMNS = ["beta", "se", "odds", "p", "sd", "loglik"]


def _cells(spark, clusters: int, seed: int = 1):
    """Clusters with a shift of their own, two terms, one to six rows on each design."""
    rng = np.random.default_rng(seed)
    shift = rng.normal(0, 0.8, clusters)
    rows = []
    for c in range(clusters):
        for x, z in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0)):
            n = int(rng.integers(1, 7))
            p = 1 / (1 + np.exp(-(-0.5 + 0.9 * x - 0.4 * z + shift[c])))
            rows.append((f"c{c}", x, z, int(rng.binomial(n, p)), n))
    return spark.createDataFrame(rows, "cluster string, x double, z double, k long, n long").repartition(8)


@pytest.mark.parametrize("model", ["logit", "glmm", "slope"])
def test_spread_fit_equals_the_fit_in_one_task(spark, monkeypatch, model):
    monkeypatch.setattr(spread_models, "ENTRIES", 20_000)  # several slices a task
    cells = _cells(spark, 150)
    one = {r["term"]: r for r in models.fit(cells.withColumn("all", F.lit(1)), ["all"], ["x", "z"], model).collect()}
    many = {r["term"]: r for r in spread_models.fit(cells, ["x", "z"], model).collect()}
    assert one.keys() == many.keys() == {"(intercept)", "x", "z"}
    for term, r in many.items():
        for c in COLUMNS:
            assert r[c] == one[term][c] or r[c] == pytest.approx(one[term][c], rel=2e-4, abs=1e-6), (term, c)


def test_many_clusters_are_few_patterns(spark):
    """A million clusters of the same 150 kinds: the same estimates, errors a thousandth of a root smaller."""
    few = _cells(spark, 150)
    times = spark.range(7000).select(F.col("id").alias("copy"))
    many = few.join(times).withColumn("cluster", F.concat("cluster", F.lit("/"), "copy")).drop("copy")
    began = time.time()
    got = {r["term"]: r for r in spread_models.fit(many, ["x", "z"], "glmm").collect()}
    want = {r["term"]: r for r in spread_models.fit(few, ["x", "z"], "glmm").collect()}
    assert time.time() - began < 300
    for term in want:
        assert got[term]["beta"] == pytest.approx(want[term]["beta"], abs=1e-4)
        assert got[term]["se"] == pytest.approx(want[term]["se"] / np.sqrt(7000), rel=1e-2)
    assert got["x"]["loglik"] == pytest.approx(7000 * want["x"]["loglik"], rel=1e-6)


def test_a_model_that_cannot_be_fitted_is_a_row_with_its_error(spark):
    cells = spark.createDataFrame([("a", 1.0, 3, 3), ("b", 1.0, 0, 2)], "cluster string, x double, k long, n long")
    assert all(r["error"] or r["se"] is None or r["se"] >= 0 for r in spread_models.fit(cells, ["x"], "glmm").collect())
    (row, *_rest) = spread_models.fit(cells.limit(0), ["x"], "logit").collect()
    assert row["term"] == "(intercept)"
