"""One logistic model over any number of clusters: sums over clusters are made where they lie, steps on the driver.

A cluster's share of a likelihood follows from its cells alone, so clusters with the same cells are one pattern with a count. In each
step all places that it needs values of are sent to the tasks; each task adds up over its patterns, and what comes back
is a number for each place. The driver holds coefficients and their Hessian.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogscope.operators.models import FITTED, NODES, intercept_shifts, maximize, per_cluster, slope_shifts, summary

#: Entries (cells x nodes) of the matrix that a task works on at a time.
ENTRIES = 2_000_000


def patterns(cells: DataFrame, terms: list[str]) -> DataFrame:
    """``cells`` (design rows with k and n, in order) and the number of clusters that have just these."""
    design = cells.groupBy("cluster", *terms).agg(F.sum("k").cast("double").alias("k"), F.sum("n").cast("double").alias("n"))
    rows = F.array_sort(F.collect_list(F.array(F.lit(1.0), *terms, "k", "n")))
    return design.groupBy("cluster").agg(rows.alias("cells")).groupBy("cells").agg(F.count("*").cast("double").alias("clusters"))


def _summed(table: DataFrame, width: int, nodes: int, part: Callable) -> np.ndarray:
    """The sum over all patterns of ``part(x, k, n, pattern of each cell, clusters of each pattern)``, a vector of ``width``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            sizes = batch["cells"].map(len).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES // nodes, "right")) - 1)
                flat = np.array([list(c) for cells in batch["cells"].iloc[at:to] for c in cells])
                of = np.repeat(np.arange(to - at), sizes[at:to])
                total += part(flat[:, :-2], flat[:, -2], flat[:, -1], of, batch["clusters"].to_numpy()[at:to])
                at = to
        yield pd.DataFrame({"at": np.arange(width), "value": total})

    sums = table.mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(width)
    for r in sums.collect():  # ``width`` rows
        out[r["at"]] = r["value"]
    return out


def _logit(table: DataFrame, m: int, ridge: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Coefficients, their information, the sum of squared scores of clusters, and the number of clusters."""
    beta = np.zeros(m)
    prior = np.zeros(m) if ridge is None else np.array([0.0, *[1 / ridge**2] * (m - 1)])

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        def part(x, k, n, of, clusters):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            scores = np.zeros((len(clusters), m))
            np.add.at(scores, of, x * (k - n * p)[:, None])
            info = x.T @ (x * (n * p * (1 - p) * clusters[of])[:, None])
            return np.concatenate([clusters @ scores, info.ravel(), ((scores * clusters[:, None]).T @ scores).ravel(), [clusters.sum()]])

        v = _summed(table, m + 2 * m * m + 1, 1, part)
        return v[:m], v[m : m + m * m].reshape(m, m), v[m + m * m : -1].reshape(m, m), round(v[-1])

    for _ in range(200):
        grad, info, _, _ = sums(beta)
        step = np.linalg.solve(info + np.diag(prior) + 1e-10 * np.eye(m), grad - prior * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    _, info, meat, clusters = sums(beta)
    return beta, info, meat, clusters


def fit(cells: DataFrame, terms: list[str], model: str, ridge: float | None = None) -> DataFrame:
    """A row per term, as of ``models.fit`` without groups. ``model``: "logit" (cluster-robust), "glmm" or "slope"."""
    spark, m = cells.sparkSession, 1 + len(terms)
    table = patterns(cells, terms).persist()  # read in every step; a lost part is counted again
    try:
        sd = loglik = None
        if model == "logit":
            beta, info, meat, clusters = _logit(table, m, ridge)
            bread = np.linalg.pinv(info)
            cov = clusters / max(1, clusters - 1) * bread @ meat @ bread
            se = np.sqrt(np.maximum(np.diag(cov), 0))
        else:
            beta, se, sd, loglik = _mixed(table, m, model, ridge)
        rows = summary(terms, beta, se, sd, loglik)
    except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
        rows = [["(intercept)", *[None] * 8, str(e)]]
    finally:
        table.unpersist()
    return spark.createDataFrame([tuple(r) for r in rows], FITTED)


def _mixed(table: DataFrame, m: int, model: str, ridge: float | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    slope = model == "slope"
    at, weight = np.polynomial.hermite.hermgauss(24 if slope else NODES)
    a, b = (v.ravel() for v in np.meshgrid(at, at, indexing="ij"))
    logw = (np.log(weight)[:, None] + np.log(weight)[None, :]).ravel() - math.log(math.pi) if slope else np.log(weight) - 0.5 * math.log(math.pi)
    more = 3 if slope else 1

    def logliks(places: np.ndarray) -> np.ndarray:
        def part(x, k, n, of, clusters):
            shifts = [slope_shifts(t, x, a, b) if slope else intercept_shifts(t, at) for t in places]
            return np.array([clusters @ per_cluster(x @ t[:-more], k, n, of, len(clusters), s, logw) for t, s in zip(places, shifts, strict=True)])

        values = _summed(table, len(places), len(logw), part)
        return values - (0.5 * (places[:, 1:-1] ** 2).sum(1) / ridge**2 if ridge and not slope else 0.0)

    start, *_ = _logit(table, m, ridge or 5.0 if not slope else 5.0)
    tail = np.array([math.log(0.5), math.log(0.5), 0.0] if slope else [math.log(0.5)])
    bound = np.concatenate([np.full(m, 25.0), [4.0, 4.0, 3.0] if slope else [4.0]])
    low = np.concatenate([-bound[:m], [-6.0, -6.0, -3.0] if slope else [-6.0]])
    theta, se, best = maximize(logliks, np.concatenate([start, tail]), low, bound)
    return theta[:m], se[:m], math.exp(theta[m]), float(best)
