"""Logistic models on collapsed counts: Spark groups the rows, numpy fits a few hundred cells.

The rows collapse to (cluster, design row) -> (k, n); the number of cells follows the design and the
clusters, not the rows. In ``fit`` one model is one group of ``applyInPandas``, so families are fitted side by side;
``spread_models.fit`` fits one model whose clusters lie in many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.functions.exact import chi2_upper_tail

NODES = 60


def collapse(rows: DataFrame, cluster: str, terms: dict[str, Column], flag: Column, by: list[str]) -> DataFrame:
    cols = [c.cast("double").alias(name) for name, c in terms.items()]
    return rows.groupBy(*by, F.col(cluster).alias("cluster"), *cols).agg(F.count_if(F.coalesce(flag, F.lit(False))).alias("k"), F.count("*").alias("n"))


def logit(x: np.ndarray, k: np.ndarray, n: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Coefficients by iteratively reweighted least squares; ``ridge``: sd of a normal prior on all but the first."""
    beta = np.zeros(x.shape[1])
    prior = np.zeros(x.shape[1]) if ridge is None else np.array([0.0, *[1 / ridge**2] * (x.shape[1] - 1)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (k - n * p) - prior * beta
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(prior) + 1e-10 * np.eye(len(beta)), grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return beta


def sandwich(x: np.ndarray, k: np.ndarray, n: np.ndarray, cluster: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Cluster-robust covariance with the usual small-sample factor G / (G - 1)."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    bread = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
    names = np.unique(cluster)
    scores = np.array([(x[cluster == g] * (k - n * p)[cluster == g, None]).sum(0) for g in names])
    factor = len(names) / max(1, len(names) - 1)
    return factor * bread @ (scores.T @ scores) @ bread


def exchangeable(x: np.ndarray, k: np.ndarray, n: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GEE with exchangeable correlation on grouped binary rows: coefficients and robust covariance.

    Within a cluster, the inverse of (1 - a) I + a J acts on sums, so single rows are never written out.
    """
    beta, alpha = logit(x, k, n), 0.0
    names = np.unique(cluster)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        s = np.sqrt(p * (1 - p))
        # moment estimate of the correlation from standardized residual sums
        r1 = k * (1 - p) / s - (n - k) * p / s
        r2 = k * ((1 - p) / s) ** 2 + (n - k) * (p / s) ** 2
        pairs = sum(n[cluster == g].sum() * (n[cluster == g].sum() - 1) / 2 for g in names) - x.shape[1]
        phi = r2.sum() / max(1, n.sum() - x.shape[1])
        alpha = sum((r1[cluster == g].sum() ** 2 - r2[cluster == g].sum()) / 2 for g in names) / max(1, pairs) / phi
        alpha = min(max(alpha, -0.2), 0.9)
        hess, grad, meat = 0, 0, 0
        for g in names:
            i = cluster == g
            m, d, w = n[i].sum(), x[i] * s[i, None], n[i]
            c = alpha / (1 - alpha + m * alpha)
            ds, rs = (d * w[:, None]).sum(0), r1[i].sum()
            h = ((d * w[:, None]).T @ d - c * np.outer(ds, ds)) / (1 - alpha)
            u = ((d * r1[i, None]).sum(0) - c * ds * rs) / (1 - alpha)
            hess, grad, meat = hess + h, grad + u, meat + np.outer(u, u)
        step = np.linalg.solve(hess + 1e-10 * np.eye(len(beta)), grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    bread = np.linalg.pinv(hess)
    return beta, bread @ meat @ bread


def maximize(logliks, theta: np.ndarray, low: np.ndarray, high: np.ndarray, e: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Newton steps on central differences, halved until the value rises: the place, standard errors, the value.

    ``logliks`` gives the values at the rows of a matrix of places, so that all places of a step are asked for at once.
    Errors are NaN where the Hessian is singular or not negative there.
    """
    m = len(theta)
    eye = np.eye(m) * e
    pairs = [(i, j) for i in range(m) for j in range(i)]
    around = np.array([np.zeros(m), *eye, *-eye, *[s * eye[i] + t * eye[j] for i, j in pairs for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1))]])
    sizes = 0.5 ** np.arange(20)

    def derivatives(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        values = logliks(theta + around)
        mid, up, down = values[0], values[1 : m + 1], values[m + 1 : 2 * m + 1]
        hess = np.diag((up - 2 * mid + down) / e**2)
        for (i, j), (pp, pm, mp, mm) in zip(pairs, values[2 * m + 1 :].reshape(-1, 4), strict=True):
            hess[i, j] = hess[j, i] = (pp - pm - mp + mm) / (4 * e**2)
        return mid, (up - down) / (2 * e), hess

    for _ in range(100):
        best, grad, hess = derivatives(theta)
        values, vectors = np.linalg.eigh(hess)
        step = np.clip(vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-3)), -2, 2)
        rises = False
        for some in (sizes[:1], sizes[1:]):  # a whole step is enough mostly
            places = np.clip(theta + some[:, None] * step, low, high)
            tried = logliks(places)
            if rises := (tried > best).any():
                first = int(np.argmax(tried > best))
                theta, gain = places[first], tried[first] - best
                break
        if not rises or gain < 1e-10:
            break
    best, _, hess = derivatives(theta)
    if np.linalg.cond(hess) > 1e12:
        return theta, np.full(m, np.nan), best
    variance = np.diag(np.linalg.inv(-hess))
    return theta, np.sqrt(np.where(variance > 0, variance, np.nan)), best


def _each(loglik):
    return lambda places: np.array([loglik(p) for p in places])


def _mixed(x, k, n, of, clusters: int, shifts, weights) -> float:
    """Log-likelihood of grouped binary rows, integrated over a cluster's shift: a row per cell, a column per node."""
    return float(per_cluster(x, k, n, of, clusters, shifts, weights).sum())


def per_cluster(x, k, n, of, clusters: int, shifts, weights) -> np.ndarray:
    eta = x[:, None] + shifts
    logp = k[:, None] * -np.logaddexp(0, -eta) + (n - k)[:, None] * -np.logaddexp(0, eta)
    per = np.zeros((clusters, eta.shape[1]))
    np.add.at(per, of, logp)
    per += weights[None, :]
    top = per.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(per - top).sum(1))


def intercept_shifts(theta: np.ndarray, at: np.ndarray) -> np.ndarray:
    return math.sqrt(2) * math.exp(theta[-1]) * at[None, :]


def slope_shifts(theta: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s0, s1, rho = math.exp(theta[-3]), math.exp(theta[-2]), math.tanh(theta[-1])
    u1 = s1 * (rho * a + math.sqrt(1 - rho * rho) * b)
    return math.sqrt(2) * (s0 * a[None, :] + x[:, 1:2] * u1[None, :])


def random_intercept(x: np.ndarray, k: np.ndarray, n: np.ndarray, cluster: np.ndarray, nodes: int = NODES, ridge: float | None = None):
    """Maximum likelihood with a normal intercept per cluster by Gauss-Hermite quadrature.

    Gives coefficients, standard errors, the intercepts' sd and the log-likelihood. ``ridge``: sd of a
    normal prior on all coefficients but the first.
    """
    at, weight = np.polynomial.hermite.hermgauss(nodes)
    names, of = np.unique(cluster, return_inverse=True)
    logw = np.log(weight) - 0.5 * math.log(math.pi)

    def loglik(theta: np.ndarray) -> float:
        total = _mixed(x @ theta[:-1], k, n, of, len(names), intercept_shifts(theta, at), logw)
        return total - (0.5 * (theta[1:-1] ** 2).sum() / ridge**2 if ridge else 0.0)

    start = np.append(logit(x, k, n, ridge or 5.0), math.log(0.5))
    bound = np.append(np.full(x.shape[1], 25.0), 4.0)
    theta, se, best = maximize(_each(loglik), start, np.append(-bound[:-1], -6.0), bound)
    return theta[:-1], se[:-1], math.exp(theta[-1]), best


def random_slope(x: np.ndarray, k: np.ndarray, n: np.ndarray, cluster: np.ndarray, nodes: int = 24):
    """As ``random_intercept``, with a correlated normal slope of the first term beside the intercept."""
    at, weight = np.polynomial.hermite.hermgauss(nodes)
    a, b = (v.ravel() for v in np.meshgrid(at, at, indexing="ij"))
    logw = (np.log(weight)[:, None] + np.log(weight)[None, :]).ravel() - math.log(math.pi)
    names, of = np.unique(cluster, return_inverse=True)

    def loglik(theta: np.ndarray) -> float:
        return _mixed(x @ theta[:-3], k, n, of, len(names), slope_shifts(theta, x, a, b), logw)

    start = np.concatenate([logit(x, k, n, 5.0), [math.log(0.5), math.log(0.5), 0.0]])
    bound = np.concatenate([np.full(x.shape[1], 25.0), [4.0, 4.0, 3.0]])
    theta, se, best = maximize(_each(loglik), start, np.concatenate([-bound[:-3], [-6.0, -6.0, -3.0]]), bound)
    return theta[:-3], se[:-3], math.exp(theta[-3]), best


FITTED = "term string, beta double, se double, odds double, odds_lo double, odds_hi double, p double, sd double, loglik double, error string"


def summary(terms: list[str], beta: np.ndarray, se: np.ndarray, sd: float | None, loglik: float | None) -> list[list]:
    """The rows of ``FITTED`` of one model; a coefficient without a standard error has no interval and no p."""
    exp = lambda v: math.exp(v) if v < 709 else math.inf
    rows = []
    for name, b, s in zip(["(intercept)", *terms], map(float, beta), map(float, se), strict=True):
        z = abs(b) / s if s and s == s else float("nan")
        p = math.erfc(z / math.sqrt(2)) if z == z else None
        ok = s == s
        rows.append([name, b, s if ok else None, exp(b), exp(b - 1.959963984540054 * s) if ok else None, exp(b + 1.959963984540054 * s) if ok else None, p, sd, loglik, None])
    return rows


def fit(cells: DataFrame, by: list[str], terms: list[str], model: str, ridge: float | None = None) -> DataFrame:
    """A row per group and term. ``model``: "logit" (cluster-robust), "gee", "glmm" or "slope"; a failure is a row with its error."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*terms, "cluster"])
        x = np.column_stack([np.ones(len(frame)), *[frame[t].to_numpy(float) for t in terms]])
        k, n, cluster = frame["k"].to_numpy(float), frame["n"].to_numpy(float), frame["cluster"].astype(str).to_numpy()
        sd = loglik = None
        try:
            if model == "glmm":
                beta, se, sd, loglik = random_intercept(x, k, n, cluster, ridge=ridge)
            elif model == "slope":
                beta, se, sd, loglik = random_slope(x, k, n, cluster)
            else:
                if model == "gee":
                    beta, cov = exchangeable(x, k, n, cluster)
                else:
                    beta = logit(x, k, n, ridge)
                    cov = sandwich(x, k, n, cluster, beta)
                se = np.sqrt(np.maximum(np.diag(cov), 0))
        except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
            return pd.DataFrame([[*key, "(intercept)", *[None] * 8, str(e)]], columns=[*by, *[f.split()[0] for f in FITTED.split(", ")]])
        return pd.DataFrame([[*key, *r] for r in summary(terms, beta, se, sd, loglik)], columns=[*by, *[f.split()[0] for f in FITTED.split(", ")]])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), FITTED])
    return cells.groupBy(*by).applyInPandas(one, schema)


def likelihood_ratio(cells: DataFrame, by: list[str], terms: list[str], drop: str) -> DataFrame:
    """Twice the gain in log-likelihood from a term, and its p with one degree of freedom."""
    rest = [t for t in terms if t != drop]
    without = cells.groupBy(*by, "cluster", *rest).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    full = fit(cells, by, terms, "glmm").where("term = '(intercept)'").select(*by, F.col("loglik").alias("full"))
    less = fit(without, by, rest, "glmm").where("term = '(intercept)'").select(*by, F.col("loglik").alias("less"))
    gain = F.greatest(F.lit(0.0), 2 * (F.col("full") - F.col("less")))
    return full.join(less, by).select(*by, gain.alias("lr")).withColumn("p", chi2_upper_tail(F.col("lr"), F.lit(1)))


#: Rows among which a diversity sample is chosen in one task.
MOST_CHOICES = 1_000_000


def diversity_sample(rows: DataFrame, stratum: str, axes: list[str], order: Column, quotas: dict[str, int]) -> DataFrame:
    """Per stratum its quota of rows, each the one whose levels were taken least so far.

    Choosing is sequential, but only ever among combinations of levels: each keeps its first rows in
    the given order, up to the quota, so one small group reaches the task that chooses. That group has at most
    combinations x quota rows; beyond ``MOST_CHOICES`` the axes are too fine for this, and that is an error.
    """
    most = max(quotas.values())
    combinations = rows.where(F.col(stratum).isin(*quotas)).select(stratum, *axes).distinct().limit(MOST_CHOICES // most + 1).count()
    if combinations * most > MOST_CHOICES:
        raise ValueError(f"more than {MOST_CHOICES} rows to choose from: the axes have too many levels")
    few = rows.withColumn("__o", order)
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, *axes).orderBy("__o"))).where(F.col("__r") <= most)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple[str, object], int] = {}
        out = []
        for name in sorted(quotas):
            left = frame[frame[stratum] == name].sort_values("__o").to_dict("records")
            if len(left) < quotas[name]:
                raise ValueError(f"stratum {name} has {len(left)} rows for a quota of {quotas[name]}")
            for _ in range(quotas[name]):
                seen = [[taken.get((a, r[a]), 0) for a in axes] for r in left]
                at = min(range(len(left)), key=lambda i: (max(seen[i]), sum(seen[i]), i))
                row = left.pop(at)
                for a in axes:
                    taken[a, row[a]] = taken.get((a, row[a]), 0) + 1
                out.append(row)
        return pd.DataFrame(out, columns=frame.columns)

    few = few.where(F.col(stratum).isin(*quotas)).withColumn("__all", F.lit(True))
    return few.groupBy("__all").applyInPandas(choose, few.schema).drop("__o", "__r", "__all")
