"""Queries over outcomes: rates, contrasts, survival, exact tests, agreement, resampling, models.

On the driver tables a record is a labelled document: init is ``quality``, degraded is ``toxic`` among
those, family is ``lang`` (control: en), cluster and advisor are ``source``. A turn of failure is a user's
first ``error`` event, in the order of time; T is the number of the user's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.functions import exact
from dialogscope.functions import intervals as I
from dialogscope.operators import models, rates, resampling, sets, spread_models

CONTROL = "en"
LAST = 8


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("family"), F.col("source").alias("cluster"), "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.join(labels, "doc_id")
    return rows.withColumn("init", F.col("quality") == 1).withColumn("degraded", (F.col("quality") == 1) & (F.col("toxic") == 1))


def started(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where("init")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, n (events), tod (place of the first error, n + 1 without one)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    first = F.min(F.when(F.col("event_type") == "error", F.struct("ts", "event_id")))
    per = events.groupBy("user_id").agg(first.alias("f"), F.count("*").alias("n"))
    at = events.join(per, "user_id").groupBy("user_id", "n").agg(F.count_if(F.col("f").isNull() | (F.struct("ts", "event_id") < F.col("f"))).alias("before"))
    return at.select("user_id", "n", (F.col("before") + 1).alias("tod"))


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


OUT = """out AS (SELECT d.doc_id, d.lang AS family, d.source AS cluster, d.n_chars, l.quality = 1 AS init, l.quality = 1 AND l.toxic = 1 AS degraded
    FROM documents d JOIN labels l USING (doc_id))"""
TOD = """e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    tod AS (SELECT user_id, n, coalesce(min(r) FILTER (event_type = 'error'), n + 1) AS tod FROM e GROUP BY user_id, n)"""
Z = "1.959963984540054"


def _wilson(k: str, n: str, side: int) -> str:
    p, sign = f"({k}::DOUBLE / {n})", "-" if side < 0 else "+"
    d = f"(1 + {Z} * {Z} / {n})"
    x = f"(({p} + {Z} * {Z} / (2 * {n})) / {d} {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} = 0 THEN {0.0 if side < 0 else 1.0}::DOUBLE ELSE {'greatest(0.0' if side < 0 else 'least(1.0'}, {x}) END"


def _rates(k: str = "k", n: str = "n") -> str:
    return f"round(CASE WHEN {n} > 0 THEN {k}::DOUBLE / {n} END, 9) AS rate, round({_wilson(k, n, -1)}, 9) AS lo, round({_wilson(k, n, 1)}, 9) AS hi"


FISHER = """pm AS (SELECT family, k, n, k0, n0, unnest(range(greatest(0, k + k0 - n0), least(n, k + k0) + 1)) AS x FROM g2),
    lp AS (SELECT family, k, x, lgamma(k + k0 + 1) - lgamma(x + 1) - lgamma(k + k0 - x + 1) + lgamma(n + n0 - k - k0 + 1) - lgamma(n - x + 1)
        - lgamma(n0 - k - k0 + x + 1) - lgamma(n + n0 + 1) + lgamma(n + 1) + lgamma(n0 + 1) AS l FROM pm),
    fp AS (SELECT a.family, least(1.0, sum(exp(a.l)) FILTER (a.l <= b.l + ln(1 + 1e-7))) AS p FROM lp a JOIN lp b ON a.family = b.family AND b.x = b.k GROUP BY a.family)"""
PAIRS = f"""g AS (SELECT family, count(*) FILTER (degraded) AS k, count(*) AS n FROM out WHERE init GROUP BY family),
    g2 AS (SELECT t.family, t.k, t.n, b.k AS k0, b.n AS n0 FROM g t, g b WHERE b.family = '{CONTROL}' AND t.family <> '{CONTROL}')"""


def primary_contrast(spark, sf_dir):
    return rounded(rates.against_control(started(spark, sf_dir), "degraded", "family", CONTROL))


def rates_by_dim(spark, sf_dir):
    return rounded(rates.rates_by_dimensions(started(spark, sf_dir), "degraded", ["family", "cluster"]))


def cell_matrix(spark, sf_dir):
    return rounded(rates.cells(started(spark, sf_dir), "degraded", "family", "cluster"))


def wilson_by_family(spark, sf_dir):
    return rounded(rates.with_rates(rates.counts(outcomes(spark, sf_dir), "init", "family")))


def accounting(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("records"), F.count_if("init").alias("started"), F.count_if("degraded").alias("degraded"), F.count_distinct("family").alias("families"),
        F.count_distinct("cluster").alias("clusters"), F.mode("n_chars", True).alias("mode_chars"),
    )


def pooled_contrast(spark, sf_dir):
    rows = started(spark, sf_dir).withColumn("pool", F.when(F.col("family") == CONTROL, "control").otherwise("structural"))
    return rounded(rates.against_control(rows, "degraded", "pool", "control"))


def chi2_omnibus(spark, sf_dir):
    return rounded(rates.chi_squared(started(spark, sf_dir), "degraded", "family").drop("p"))


def chi2_p(spark, sf_dir):
    return rounded(rates.chi_squared(started(spark, sf_dir), "degraded", "cluster"))


def holm_family(spark, sf_dir):
    tests = rates.against_control(started(spark, sf_dir), "degraded", "family", CONTROL).select("family", "p", F.lit(1).alias("one"))
    out = I.holm(tests, "p", ["one"]).drop("one").withColumn("significance", I.significance("p_holm"))
    return rounded(out)


def tod_hist(spark, sf_dir):
    return failures(spark, sf_dir).where("tod <= n").groupBy("tod").agg(F.count("*").alias("n"))


def tod_quantiles(spark, sf_dir):
    q = failures(spark, sf_dir).where("tod <= n").agg(F.percentile("tod", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return rounded(q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))


def resistance_curve(spark, sf_dir):
    return rounded(rates.resistance(failures(spark, sf_dir), "tod", LAST))


def hazard(spark, sf_dir):
    return rounded(rates.hazard(failures(spark, sf_dir), "tod", LAST))


def mcnemar_pairs(spark, sf_dir):
    """Orders of a customer in two priorities: late-priced in the one and not in the other."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    arm = orders.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_totalprice"))
    both = arm.toDF("key", "a", "b").where("a is not null and b is not null").select((F.col("a") > 200_000).alias("a"), (F.col("b") > 200_000).alias("b"))
    counts = both.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    return rounded(counts.withColumn("p", exact.mcnemar_exact(F.col("b"), F.col("c"))), 6)


def rate_ratio(spark, sf_dir):
    """Errors per user, each event type's users against those of clicks."""
    rows = started(spark, sf_dir)
    g = rates.counts(rows, "degraded", "family")
    base = g.where(F.col("family") == CONTROL).select(F.col("k").alias("k0"), F.col("n").alias("n0"))
    pairs = g.where(F.col("family") != CONTROL).crossJoin(F.broadcast(base))
    out = pairs.withColumn("r", exact.poisson_rate_ratio(F.col("k"), F.col("k0"), F.col("n").cast("double"), F.col("n0").cast("double")))
    return rounded(out.select("family", "k", "n", "k0", "n0", "r.ratio", "r.lo", "r.hi", "r.p"), 6)


def mde(spark, sf_dir):
    g = rates.counts(started(spark, sf_dir), "degraded", "family")
    base = g.where(F.col("family") == CONTROL).select(F.col("k").alias("k0"), F.col("n").alias("n0"))
    pairs = g.where(F.col("family") != CONTROL).crossJoin(F.broadcast(base))
    return rounded(pairs.select("family", "n", "n0", I.detectable_difference("n", "n0", I.rate("k0", "n0")).alias("mde")), 6)


def kappa_raw(spark, sf_dir):
    """Agreement of two raters: the label, and whether a document has more than 2,000 characters."""
    rows = outcomes(spark, sf_dir).select(F.col("init").cast("int").alias("x"), (F.col("n_chars") > 2000).cast("int").alias("y"))
    return rounded(rates.kappa_table(rows, "x", "y"))


def kappa_weighted(spark, sf_dir):
    """The same, each stratum (language) weighted to its share of all documents."""
    rows = outcomes(spark, sf_dir).select(F.col("family").alias("stratum"), F.col("init").cast("int").alias("x"), (F.col("n_chars") > 2000).cast("int").alias("y"))
    pop = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("pop"))
    weights = rates.stratum_weights(rows, pop, "stratum").select("stratum", "weight")
    return rounded(rates.kappa_table(rows.join(F.broadcast(weights), "stratum"), "x", "y", "weight"))


def stratified_weights(spark, sf_dir):
    rows = outcomes(spark, sf_dir).select(F.col("family").alias("stratum"))
    pop = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("pop"))
    return rounded(rates.stratum_weights(rows, pop, "stratum"), 12)


def weakest_group(spark, sf_dir):
    r = rates.with_rates(rates.counts(outcomes(spark, sf_dir), "init", "cluster"))
    return r.agg(F.min_by("cluster", F.struct("rate", "cluster")).alias("cluster"), F.round(F.min("rate"), 9).alias("rate"))


def decision_rule(spark, sf_dir):
    c = rates.against_control(started(spark, sf_dir), "degraded", "family", CONTROL)
    return c.select("family", I.decision("rd_lo", "rd_hi").alias("decision"))


def cost_estimate(spark, sf_dir):
    g = outcomes(spark, sf_dir).groupBy("family").agg(F.count("*").alias("cells"))
    return g.select("family", "cells", F.round(I.estimate_usd("cells"), 6).alias("usd"), F.round(I.headroom(F.lit(100.0), I.estimate_usd("cells")), 6).alias("headroom"))


def cluster_bootstrap(spark, sf_dir):
    rows = started(spark, sf_dir)
    return resampling.cluster_difference(rows, "cluster", F.col("family") != CONTROL, F.col("degraded"), 5000)


def paired_bootstrap(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    return resampling.paired_difference(rows, F.col("init"), F.col("n_chars") > 2000, 20_000)


def stratified_bootstrap(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("family", "cluster").agg(F.avg(F.col("degraded").cast("double")).alias("rate"))
    return resampling.stratified_rate(rows, "rate", ["cluster"], 1000, 3, "family")


def _cells(spark, sf_dir, by):
    rows = started(spark, sf_dir).withColumn("all", F.lit("all"))
    return models.collapse(rows, "cluster", {"structural": F.col("family") != CONTROL}, F.col("degraded"), by)


def glmm_intercept(spark, sf_dir):
    return models.fit(_cells(spark, sf_dir, ["all"]), ["all"], ["structural"], "glmm")


def glmm_customers(spark, sf_dir):
    """Clusters are customers, over many tasks: whether an order is large, by its urgency."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("all", F.lit("all"))
    cells = models.collapse(rows, "o_custkey", {"urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}, F.col("o_totalprice") > 150_000, ["all"])
    return spread_models.fit(cells, ["urgent"], "glmm")


def glmm_slope(spark, sf_dir):
    return models.fit(_cells(spark, sf_dir, ["all"]), ["all"], ["structural"], "slope")


def glmm_likelihood_ratio(spark, sf_dir):
    return models.likelihood_ratio(_cells(spark, sf_dir, ["all"]), ["all"], ["structural"], "structural")


def gee_exchangeable(spark, sf_dir):
    return models.fit(_cells(spark, sf_dir, ["all"]), ["all"], ["structural"], "gee")


def logit_cluster_robust(spark, sf_dir):
    return models.fit(_cells(spark, sf_dir, ["all"]), ["all"], ["structural"], "logit")


def glmm_by_family(spark, sf_dir):
    """Each family against the control, with the ridge that per-family models use."""
    rows = started(spark, sf_dir)
    control = rows.where(F.col("family") == CONTROL)
    others = rows.where(F.col("family") != CONTROL).select("family").distinct()
    pairs = rows.where(F.col("family") != CONTROL).withColumn("t", F.lit(1)).select("family", "cluster", "degraded", "t")
    both = pairs.union(control.select("cluster", "degraded").crossJoin(F.broadcast(others)).select("family", "cluster", "degraded", F.lit(0)))  # a row per family
    return models.fit(models.collapse(both, "cluster", {"t": F.col("t")}, F.col("degraded"), ["family"]), ["family"], ["t"], "glmm", ridge=5.0)


def diversity_sample(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("stratum", F.when(~F.col("init"), "init0").when(F.col("degraded"), "degraded").otherwise("held_firm"))
    rows = rows.select("doc_id", "stratum", "family", "cluster")
    return models.diversity_sample(rows, "stratum", ["family", "cluster"], F.xxhash64("doc_id"), {"init0": 20, "degraded": 10, "held_firm": 20})


def quota_sample(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("stratum", F.when(~F.col("init"), "init0").when(F.col("degraded"), "degraded").otherwise("held_firm"))
    s = sets.quota_sample(rows, "stratum", "cluster", F.col("doc_id"), {"init0": 20, "degraded": 10, "held_firm": 20})
    return s.select("doc_id", "stratum", "cluster", F.col("place").cast("long").alias("place"), F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        primary_contrast, rates_by_dim, cell_matrix, wilson_by_family, accounting, pooled_contrast, chi2_omnibus, chi2_p, holm_family, tod_hist, tod_quantiles, resistance_curve, hazard,
        mcnemar_pairs, rate_ratio, mde, kappa_raw, kappa_weighted, stratified_weights, weakest_group, decision_rule, cost_estimate, cluster_bootstrap, paired_bootstrap,
        stratified_bootstrap, glmm_intercept, glmm_customers, glmm_slope, glmm_likelihood_ratio, gee_exchangeable, logit_cluster_robust, glmm_by_family, diversity_sample, quota_sample,
    )
}

_CONTRAST_ROWS = f"""c AS (SELECT g2.*, fp.p, k::DOUBLE / n AS p1, k0::DOUBLE / n0 AS p0, {_wilson("k", "n", -1)} AS l1, {_wilson("k", "n", 1)} AS u1,
        {_wilson("k0", "n0", -1)} AS l0, {_wilson("k0", "n0", 1)} AS u0, least(k, n - k, k0, n0 - k0) = 0 AS corrected,
        CASE WHEN least(k, n - k, k0, n0 - k0) = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS h FROM g2 JOIN fp USING (family)),
    o AS (SELECT *, (k + h) * (n0 - k0 + h) / ((n - k + h) * (k0 + h)) AS odds_, sqrt(1 / (k + h) + 1 / (n - k + h) + 1 / (k0 + h) + 1 / (n0 - k0 + h)) AS se,
        greatest(-1.0, p1 - p0 - sqrt((p1 - l1) ** 2 + (u0 - p0) ** 2)) AS rdl, least(1.0, p1 - p0 + sqrt((u1 - p1) ** 2 + (p0 - l0) ** 2)) AS rdh FROM c)"""
_CONTRAST_OUT = f"""k, n, k0, n0, round(p1 - p0, 9) AS rd, round(rdl, 9) AS rd_lo, round(rdh, 9) AS rd_hi, round(CASE WHEN k0 > 0 THEN p1 / p0 END, 9) AS rr,
    round(odds_, 9) AS odds, round(odds_ * exp(-{Z} * se), 9) AS odds_lo, round(odds_ * exp({Z} * se), 9) AS odds_hi, corrected, round(p, 9) AS p"""
_KAPPA = """t AS (SELECT x, y, sum(w) AS w FROM r GROUP BY x, y), s AS (SELECT sum(w) AS w, sum(CASE WHEN x = y THEN w ELSE 0.0 END) AS a FROM t),
    px AS (SELECT x AS v, sum(w) AS wx FROM t GROUP BY x), py AS (SELECT y AS v, sum(w) AS wy FROM t GROUP BY y),
    ch AS (SELECT coalesce(sum(wx * wy), 0.0) AS c FROM px JOIN py USING (v)), k AS (SELECT a / w AS po, c / (w * w) AS pe FROM s, ch)
    SELECT round(po, 9) AS agreement, round(pe, 9) AS chance, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM k"""
_MDE = """q AS (SELECT *, k0::DOUBLE / n0 AS p0, (1.959963984540054 + 0.8416212335729143) ** 2 AS zz FROM g2), r AS (SELECT *, 1 + zz / n AS a_, zz * (1 - 2 * p0) / n AS b_, zz * p0 * (1 - p0) * (1.0 / n + 1.0 / n0) AS c_ FROM q),
    d AS (SELECT *, least(1 - p0, (b_ + sqrt(b_ * b_ + 4 * a_ * c_)) / (2 * a_)) AS mde FROM r)"""
_STRATA = """st AS (SELECT *, CASE WHEN NOT init THEN 'init0' WHEN degraded THEN 'degraded' ELSE 'held_firm' END AS stratum FROM out)"""

ORACLE_SQL = {
    "primary_contrast": f"WITH {OUT}, {PAIRS}, {FISHER}, {_CONTRAST_ROWS} SELECT family, {_CONTRAST_OUT} FROM o",
    "pooled_contrast": f"""WITH {OUT.replace("d.lang AS family", "CASE WHEN d.lang = 'en' THEN 'en' ELSE 'structural' END AS family")}, {PAIRS}, {FISHER}, {_CONTRAST_ROWS}
        SELECT family AS pool, {_CONTRAST_OUT} FROM o""",
    "rates_by_dim": f"""WITH {OUT}, s AS (SELECT * FROM out WHERE init), a AS (SELECT 'overall' AS dimension, 'all' AS level, degraded FROM s
        UNION ALL SELECT 'family', family, degraded FROM s UNION ALL SELECT 'cluster', cluster, degraded FROM s),
        c AS (SELECT dimension, level, count(*) FILTER (degraded) AS k, count(*) AS n FROM a GROUP BY ALL) SELECT *, {_rates()} FROM c""",
    "cell_matrix": f"""WITH {OUT}, s AS (SELECT * FROM out WHERE init), grid AS (SELECT * FROM (SELECT DISTINCT family FROM s), (SELECT DISTINCT cluster FROM s)),
        c AS (SELECT grid.family, grid.cluster, count(*) FILTER (degraded) AS k, count(s.doc_id) AS n FROM grid LEFT JOIN s USING (family, cluster) GROUP BY ALL) SELECT *, {_rates()} FROM c""",
    "wilson_by_family": f"WITH {OUT}, c AS (SELECT family, count(*) FILTER (init) AS k, count(*) AS n FROM out GROUP BY family) SELECT *, {_rates()} FROM c",
    "accounting": f"""WITH {OUT} SELECT count(*) AS records, count(*) FILTER (init) AS started, count(*) FILTER (degraded) AS degraded, count(DISTINCT family) AS families,
        count(DISTINCT cluster) AS clusters, (SELECT n_chars FROM out GROUP BY n_chars ORDER BY count(*) DESC, n_chars LIMIT 1) AS mode_chars FROM out""",
    "chi2_omnibus": f"""WITH {OUT}, g AS (SELECT family, count(*) FILTER (degraded) AS k, count(*) AS n FROM out WHERE init GROUP BY family),
        e AS (SELECT k, n, n * K2 / N2 AS h, n * (N2 - K2) / N2 AS m, G FROM g, (SELECT sum(k)::DOUBLE AS K2, sum(n)::DOUBLE AS N2, count(*) AS G FROM g))
        SELECT round(sum((k - h) ** 2 / h + (n - k - m) ** 2 / m), 9) AS chi2, max(G) - 1 AS df, round(min(least(h, m)), 9) AS min_expected FROM e""",
    "holm_family": f"""WITH {OUT}, {PAIRS}, {FISHER}, s AS (SELECT family, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS step FROM fp),
        h AS (SELECT family, p, max(step) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS a FROM s)
        SELECT family, round(p, 9) AS p, round(a, 9) AS p_holm, CASE WHEN a < 0.05 THEN 'significant' ELSE 'not-significant' END AS significance FROM h""",
    "tod_hist": f"WITH {TOD} SELECT tod, count(*) AS n FROM tod WHERE tod <= n GROUP BY tod",
    "tod_quantiles": f"WITH {TOD} SELECT round(quantile_cont(tod, 0.25), 9) AS q1, round(quantile_cont(tod, 0.5), 9) AS median, round(quantile_cont(tod, 0.75), 9) AS q3 FROM tod WHERE tod <= n",
    "resistance_curve": f"""WITH {TOD}, t AS (SELECT unnest(range(1, {LAST + 1})) AS t), c AS (SELECT t, count(*) FILTER (tod > t) AS k, count(*) AS n FROM t, tod GROUP BY t) SELECT *, {_rates()} FROM c""",
    "hazard": f"""WITH {TOD}, t AS (SELECT unnest(range(2, {LAST + 1})) AS t), c AS (SELECT t, count(*) FILTER (tod >= t) AS at_risk, count(*) FILTER (tod = t) AS events FROM t, tod GROUP BY t)
        SELECT *, round(CASE WHEN at_risk > 0 THEN events::DOUBLE / at_risk END, 9) AS hazard FROM c""",
    "mcnemar_pairs": """WITH o AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS b FROM orders GROUP BY o_custkey),
        c AS (SELECT count(*) AS pairs, count(*) FILTER (a > 200000 AND b <= 200000) AS b, count(*) FILTER (a <= 200000 AND b > 200000) AS c FROM o WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT *, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1),
            lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 6) AS p FROM c""",
    "mde": f"""WITH {OUT}, {PAIRS}, {_MDE} SELECT family, n, n0, round(mde, 6) AS mde FROM d""",
    "kappa_raw": f"WITH {OUT}, r AS (SELECT init::INT AS x, (n_chars > 2000)::INT AS y, 1.0::DOUBLE AS w FROM out), {_KAPPA}",
    "kappa_weighted": f"""WITH {OUT}, pop AS (SELECT lang AS family, count(*) AS pop FROM documents GROUP BY lang), n AS (SELECT family, count(*) AS n FROM out GROUP BY family),
        r AS (SELECT init::INT AS x, (n_chars > 2000)::INT AS y, pop::DOUBLE / ((SELECT sum(pop) FROM pop) * n) AS w FROM out JOIN pop USING (family) JOIN n USING (family)), {_KAPPA}""",
    "stratified_weights": f"""WITH {OUT}, pop AS (SELECT lang AS family, count(*) AS pop FROM documents GROUP BY lang), n AS (SELECT family, count(*) AS n FROM out GROUP BY family)
        SELECT family AS stratum, n, pop, round(pop::DOUBLE / ((SELECT sum(pop) FROM pop)::DOUBLE * n), 12) AS weight FROM pop JOIN n USING (family)""",
    "weakest_group": f"""WITH {OUT}, r AS (SELECT cluster, avg(init::INT) AS rate FROM out GROUP BY cluster) SELECT cluster, round(rate, 9) AS rate FROM r ORDER BY rate, cluster LIMIT 1""",
    "decision_rule": f"""WITH {OUT}, {PAIRS}, {FISHER}, {_CONTRAST_ROWS} SELECT family, CASE WHEN rdl > 0.10 THEN 're-run recommended' WHEN rdh < -0.10 THEN 'investigate'
        WHEN rdl >= -0.10 AND rdh <= 0.10 THEN 'disclose and publish' ELSE 'inconclusive' END AS decision FROM o""",
    "cost_estimate": f"""WITH {OUT} SELECT family, count(*) AS cells, round(count(*) * (0.0782::DOUBLE * 1.30::DOUBLE), 6) AS usd, round(100.0::DOUBLE / (count(*) * (0.0782::DOUBLE * 1.30::DOUBLE)), 6) AS headroom FROM out GROUP BY family""",
    "quota_sample": f"""WITH {OUT}, {_STRATA}, p AS (SELECT *, row_number() OVER (PARTITION BY stratum, cluster ORDER BY doc_id) AS place FROM st),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY place, cluster) AS rank FROM p)
        SELECT doc_id, stratum, cluster, place, rank FROM r WHERE rank <= CASE stratum WHEN 'degraded' THEN 10 ELSE 20 END""",
}
