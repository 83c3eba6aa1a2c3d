"""Queries over two raters of a stratified sample (labelled documents, judged by their length and by the label), and over a store of runs.

The panel's start is right where a text has over 200 characters, the other rater's where the document is of quality; degradation
begins at a turn that follows the length. A stratum is the panel's kind; the population counts all documents as ten of the sample.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogscope.operators import agreement, rates, sweep

TURNS = 6


def _rated(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(documents, "doc_id")
    panel, human = F.col("n_chars") > 200, F.col("quality") == 1
    tod = lambda init, shift: F.when(init, F.pmod(F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, shift).otherwise(0), F.lit(9)) + 2)
    rows = rows.select(
        "doc_id", F.lit(TURNS).alias("turns"), panel.cast("int").alias("panel_init"), human.cast("int").alias("human_init"),
        tod(panel, F.lit(0)).alias("panel_tod"), tod(human, F.col("doc_id") % 3).alias("human_tod"),
    )
    return rows.withColumn("stratum", agreement.decision_kind("panel_init", "panel_tod", "turns"))


def _weights(rows):
    population = rows.groupBy("stratum").agg((10 * F.count("*") + F.when(F.col("stratum") == "init0", 7).otherwise(0)).alias("pop"))
    return rates.stratum_weights(rows, population, "stratum")


def agreement_figures(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    found = agreement.figures(agreement.label_cells(rows), _weights(rows))
    return found.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def agreement_bootstrap(spark, sf_dir):
    """Intervals of the twelve figures that get one."""
    rows = _rated(spark, sf_dir)
    return agreement.bootstrap(agreement.label_cells(rows), _weights(rows), 10_000, 20_260_626)


def _store(spark, sf_dir):
    """Orders as records: the run is the year, the arm the status, the family the priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("*", F.date_format("o_orderdate", "yyyy").alias("run"), F.col("o_orderstatus").alias("arm"))


def store_sweep(spark, sf_dir):
    """Checks of each arm, one of them for finished orders alone; the key that should be unique is the customer."""
    checks = {"priced": F.col("o_totalprice") > 2000, "customer": F.col("o_custkey") > 10}
    return sweep.arm_battery(_store(spark, sf_dir), "o_custkey", checks, {"F": {"finished early": F.col("o_orderdate") < F.lit("1995-06-18")}})


def store_index(spark, sf_dir):
    """Differences from an index that was stored before urgent orders came in."""
    rows = _store(spark, sf_dir)
    before = sweep.index_of(rows.where("NOT (o_orderpriority = '1-URGENT' AND month(o_orderdate) = 1)"), "o_orderpriority", "o_orderdate")
    return sweep.index_differences(before, sweep.index_of(rows, "o_orderpriority", "o_orderdate"))


QUERIES = {f.__name__: f for f in (agreement_figures, agreement_bootstrap, store_sweep, store_index)}


def _kappa(where: str, a: str, b: str, values: list[str], w: str) -> str:
    whole = f"sum({w}) FILTER ({where})"
    share = lambda cond: f"coalesce(sum({w}) FILTER ({where} AND {cond}), 0) / {whole}"
    chance = " + ".join(f"({share(f'{a} = {v}')}) * ({share(f'{b} = {v}')})" for v in values)
    return f"(({share(f'{a} = {b}')}) - ({chance})) / nullif(1 - ({chance}), 0)"


def _sql() -> str:
    kinds = [f"'{k}'" for k in agreement.KINDS]
    out = {"n": "count(*)"}
    for label, values in (("init", ["0", "1"]), ("kind", kinds)):
        a, b = f"panel_{label}", f"human_{label}"
        out |= {f"{label}_raw_agree": f"avg(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0 END)", f"{label}_weighted_agree": f"sum(weight) FILTER ({a} = {b})"}
        out |= {f"{label}_raw_kappa": _kappa("true", a, b, values, "1.0::DOUBLE"), f"{label}_weighted_kappa": _kappa("true", a, b, values, "weight")}
    for k in agreement.KINDS:
        out[f"{k}_n"] = f"count(*) FILTER (stratum = '{k}')"
        out |= {f"{k}_{x}_agree": f"avg(CASE WHEN panel_{x} = human_{x} THEN 1.0::DOUBLE ELSE 0 END) FILTER (stratum = '{k}')" for x in ("init", "kind")}
    one, fell = "panel_init = 1 AND human_init = 1", "CASE WHEN {}_kind = 'degraded' THEN 1 ELSE 0 END"
    a, b = fell.format("panel"), fell.format("human")
    out |= {"both_init_n": f"count(*) FILTER ({one})", "both_init_raw_agree": f"avg(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0 END) FILTER ({one})", "both_init_raw_kappa": _kappa(one, f"({a})", f"({b})", ["1", "0"], "1.0::DOUBLE")}
    fallen, gap = "panel_kind = 'degraded' AND human_kind = 'degraded'", "abs(panel_tod - human_tod)"
    out |= {"tod_n": f"count(*) FILTER ({fallen})"} | {f"tod_{name}": f"avg(CASE WHEN {gap} <= {most} THEN 1.0::DOUBLE ELSE 0 END) FILTER ({fallen})" for name, most in (("exact", 0), ("within_1", 1))}
    out |= {f"{who}_degraded_share": f"coalesce(sum(weight) FILTER ({who}_kind = 'degraded'), 0)" for who in ("panel", "human")}
    columns = ", ".join(f"round({c}, 9) AS {k}" if not k.endswith("n") else f"{c} AS {k}" for k, c in out.items())
    kind = lambda who: f"CASE WHEN {who}_init = 0 THEN 'init0' WHEN {who}_tod <= {TURNS} THEN 'degraded' ELSE 'held_firm' END AS {who}_kind"
    return f"""WITH r AS (SELECT doc_id, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS panel_init, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS human_init,
            CASE WHEN n_chars > 200 THEN n_chars % 9 + 2 END AS panel_tod,
            CASE WHEN quality = 1 THEN (n_chars + CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 ELSE 0 END) % 9 + 2 END AS human_tod FROM labels JOIN documents USING (doc_id)),
        k AS (SELECT *, {kind("panel")}, {kind("human")} FROM r), s AS (SELECT *, panel_kind AS stratum FROM k),
        p AS (SELECT stratum, count(*) AS n_s, 10 * count(*) + CASE WHEN stratum = 'init0' THEN 7 ELSE 0 END AS pop FROM s GROUP BY stratum),
        w AS (SELECT s.*, pop::DOUBLE / ((SELECT sum(pop) FROM p) * n_s) AS weight FROM s JOIN p USING (stratum))
        SELECT {columns} FROM w"""


_INDEX = """SELECT run, arm, sum(n)::BIGINT AS n, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS families, min(s)::VARCHAR AS started
            FROM (SELECT run, arm, o_orderpriority, count(*) AS n, min(o_orderdate) AS s FROM {} GROUP BY 1, 2, 3) GROUP BY 1, 2"""
_STORE = "r AS (SELECT *, strftime(o_orderdate, '%Y') AS run, o_orderstatus AS arm FROM orders)"

ORACLE_SQL = {
    "agreement_figures": _sql(),
    "store_sweep": f"""WITH {_STORE}, c AS (SELECT run, arm, count(*) FILTER (NOT coalesce(o_totalprice > 2000, false)) AS priced, count(*) FILTER (NOT coalesce(o_custkey > 10, false)) AS customer,
            count(*) FILTER (arm = 'F' AND NOT coalesce(o_orderdate < DATE '1995-06-18', false)) AS "finished early" FROM r GROUP BY 1, 2),
        k AS (SELECT run, arm, 'unique keys' AS "check", count(*) FILTER (n > 1) AS failures FROM (SELECT run, arm, o_custkey, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
        u AS (SELECT run, arm, "check", failures FROM (UNPIVOT c ON priced, customer, "finished early" INTO NAME "check" VALUE failures) UNION ALL SELECT * FROM k)
        SELECT *, failures = 0 AS ok FROM u""",
    "store_index": f"""WITH {_STORE}, e AS (SELECT * FROM r WHERE NOT (o_orderpriority = '1-URGENT' AND month(o_orderdate) = 1)), b AS ({_INDEX.format("r")}), s AS ({_INDEX.format("e")})
        SELECT *, 'stored' AS "only" FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'built' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM s)""",
}
