"""Queries over batteries of contrasts, arms and panels.

As in ``outcomes``, a record is a labelled document. English is the control, Spanish the family without a structural
obstacle, the others are structural; the advisor is ``source``. Flags follow the length of a text, benchmark's numbers are the
quarantined records, and arms follow the number of the document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogscope.operators import batteries, votes
from dialogscope.plans.outcomes import _CONTRAST_OUT, _CONTRAST_ROWS, _MDE, _wilson, FISHER, OUT, PAIRS, outcomes, rounded, started

STRUCTURAL, FEAR, CONTROL = ["de", "fr"], "es", "en"
PROVIDERS = ["alpha", "beta", "gamma", "delta", "omega"]

class Conditions:
    """What the cuts of these queries are made of; Columns exist only once there is a session."""

    def __init__(self):
        self.family = F.col("family")
        self.structural, self.fear, self.control = self.family.isin(STRUCTURAL), self.family == FEAR, self.family == CONTROL
        self.flagged, self.accepted = F.col("n_chars") > 1500, F.col("n_chars") > 3000
        self.arm = F.when(F.pmod("doc_id", F.lit(3)) == 0, "ctx").otherwise("main")


def _marked(spark, sf_dir):
    quarantine = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("q"))
    rows = outcomes(spark, sf_dir).join(quarantine, "doc_id", "left").withColumn("quarantined", F.coalesce("q", F.lit(False))).drop("q")
    return batteries.with_weakest(rows, "init", "cluster").where("init")


def sensitivity(spark, sf_dir):
    c = Conditions()
    cuts = batteries.sensitivity_cuts(c.structural, c.control, STRUCTURAL, "family", quarantined=F.col("quarantined"), accepted=c.accepted, flagged=c.flagged, weakest=F.col("weakest"))
    return rounded(batteries.contrasts(_marked(spark, sf_dir), "degraded", cuts))


def advisor_effects(spark, sf_dir):
    c = Conditions()
    cuts = {"structural_vs_control": (c.structural, c.control), "fear_vs_control": (c.fear, c.control), "fear_vs_structural": (c.fear, c.structural)}
    out = batteries.per_group(started(spark, sf_dir), "degraded", cuts, "cluster")
    return rounded(out.select("test", "cluster", "k", "n", "k0", "n0", "rd", "p", "p_holm"))


def cross_arm(spark, sf_dir):
    c = Conditions()
    rows = outcomes(spark, sf_dir).withColumn("arm", c.arm)
    ctx, main = F.col("arm") == "ctx", F.col("arm") == "main"
    pools = {"any_obstacle": ~c.control, "structural": c.structural, "nonstructural": c.fear, "cooperative": c.control} | {f: c.family == f for f in [*STRUCTURAL, FEAR, CONTROL]}
    degraded = batteries.contrasts(rows.where("init"), "degraded", {f"degradation/{k}": (ctx & c, main & c) for k, c in pools.items()})
    init = batteries.contrasts(rows, "init", {"init_correct/all": (ctx, main)})
    return rounded(degraded.union(init).where("n > 0 and n0 > 0"))


def flagged_exclusion(spark, sf_dir):
    c = Conditions()
    cuts = {"structural": (c.structural, c.control), "fear": (c.fear, c.control), "any_obstacle": (~c.control, c.control), "reason": (c.structural, c.fear)} | {f: (c.family == f, c.control) for f in STRUCTURAL}
    return rounded(batteries.rerun_without(started(spark, sf_dir), "degraded", cuts, c.flagged))


def power(spark, sf_dir):
    return rounded(batteries.power_context(started(spark, sf_dir), "degraded", "family", CONTROL, 0.065, 0.132), 6)


def _arm_stats(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    kilos = F.floor(F.col("n_chars") / 1000)
    return batteries.arm_stats(
        rows, "cluster", capitulations=F.col("degraded").cast("long"), flags=kilos, audit_only=F.pmod("doc_id", F.lit(2)), surviving=F.col("n_chars") > 100_000,
        zero_tolerance=(F.col("n_chars") > 90_000).cast("long"), clean=F.col("init") & ~F.col("degraded"), cost=F.col("n_chars") * 0.001,
    )


def arm_statistics(spark, sf_dir):
    return rounded(_arm_stats(spark, sf_dir), 6)


def arm_selection(spark, sf_dir):
    """Arms against the one with the first name as incumbent."""
    first = outcomes(spark, sf_dir).agg(F.min("cluster")).first()[0]
    return rounded(batteries.selection(_arm_stats(spark, sf_dir), "cluster", first), 6)


def arm_rules(spark, sf_dir):
    """The order priorities of each status, as rules of an arm."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return batteries.rule_histogram(orders, "o_orderstatus", "o_orderpriority").select("o_orderstatus", F.array_join("rules", ",").alias("rules"))


def arm_details(spark, sf_dir):
    c = Conditions()
    rows = started(spark, sf_dir).withColumn("arm", c.arm).withColumn("tod", F.col("n_chars"))
    out = batteries.arm_detail(rows, "arm", "degraded", ~c.control, "tod")
    return rounded(out.select("arm", "k", "n", "k0", "n0", "rd", "p", "median_tod"))


def family_flags(spark, sf_dir):
    c = Conditions()
    rows = outcomes(spark, sf_dir).withColumn("arm", c.arm).withColumn("events", F.floor(F.col("n_chars") / 1000))
    some = batteries.flag_totals(rows, "arm", "events", "family", only=[CONTROL]).withColumn("families", F.lit("control"))
    rest = batteries.flag_totals(rows, "arm", "events", "family", exclude=[CONTROL]).withColumn("families", F.lit("other"))
    return rounded(some.union(rest), 6)


def instrument_checks(spark, sf_dir):
    """Lines of an order by return flag: orders with several flags, and those whose lines all have one status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus")
    return rounded(batteries.identical_firsts(lines, "l_orderkey", "l_returnflag", "l_linestatus"))


def _seats(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    providers = F.array(*[F.lit(p) for p in PROVIDERS])
    panels = orders.withColumn("advisor", F.get(providers, F.pmod("o_orderkey", F.lit(5)).cast("int")))
    eligible = F.array_sort(F.array_remove(providers, F.col("advisor")))
    return panels.select("o_orderkey", "advisor", votes.seats_for(providers, F.col("advisor"), F.pmod("o_orderkey", F.lit(7)).cast("int")).alias("seats"), eligible.alias("eligible"))


def seat_balance(spark, sf_dir):
    return batteries.balance(_seats(spark, sf_dir), "seats", "eligible")


def own_panel_count(spark, sf_dir):
    return batteries.own_panel(_seats(spark, sf_dir), "o_orderkey", "advisor", "seats").agg(F.count("*").alias("n"))


def audit_join(spark, sf_dir):
    """Labels as the sample, toxic ones as its verdicts, documents as records: rows joined, and rows that lack one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    both, missing = batteries.audited(labels.select("doc_id", "quality"), labels.where("toxic = 1").select("doc_id", "toxic"), docs, "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n")).union(missing.agg(F.lit("missing"), F.count("*")))


QUERIES = {
    f.__name__: f
    for f in (
        sensitivity, advisor_effects, cross_arm, flagged_exclusion, power, arm_statistics, arm_selection, arm_rules, arm_details, family_flags, instrument_checks, seat_balance,
        own_panel_count, audit_join,
    )
}

_S, _F, _C = "family IN ('de', 'fr')", "family = 'es'", "family = 'en'"
_NULL_SIDES = _CONTRAST_ROWS.replace("k::DOUBLE / n AS p1", "k::DOUBLE / nullif(n, 0) AS p1").replace("k0::DOUBLE / n0 AS p0", "k0::DOUBLE / nullif(n0, 0) AS p0")
_NULL_SIDES = _NULL_SIDES.replace("greatest(-1.0, p1", "CASE WHEN n > 0 AND n0 > 0 THEN greatest(-1.0, p1").replace("** 2)) AS rdl", "** 2)) END AS rdl")
_NULL_SIDES = _NULL_SIDES.replace("least(1.0, p1", "CASE WHEN n > 0 AND n0 > 0 THEN least(1.0, p1").replace("** 2)) AS rdh", "** 2)) END AS rdh")


def _cut_rows(rows: str, flag: str, cuts: dict[str, tuple[str, str]], by: str = "") -> str:
    """SQL that counts every cut of ``rows``: family (the name of the cut, and the group), k, n, k0, n0."""
    name = (lambda x: f"'{x}|' || {by}") if by else (lambda x: f"'{x}'")
    group = f" GROUP BY {by}" if by else ""
    one = "SELECT {name} AS family, count(*) FILTER (({t}) AND {flag}) AS k, count(*) FILTER ({t}) AS n, count(*) FILTER (({b}) AND {flag}) AS k0, count(*) FILTER ({b}) AS n0 FROM {rows}{group}"
    return " UNION ALL ".join(one.format(name=name(x), t=t, b=b, flag=flag, rows=rows, group=group) for x, (t, b) in cuts.items())


_POOLS = {"without_quarantine": "true", "dropping_accepted_uncured": "NOT q AND n_chars <= 3000", "dropping_any_flagged": "NOT q AND n_chars <= 1500", "dropping_weakest_advisor": "NOT q AND NOT weakest"}
_SENSITIVITY = {
    **{name: (f"{c} AND {_S}", f"{c} AND {_C}") for name, c in _POOLS.items()},
    **{f"{name}/{f}": (f"{c} AND family = '{f}'", f"{c} AND {_C}") for name, c in _POOLS.items() if name != "dropping_any_flagged" for f in STRUCTURAL},
    "accepted_uncured_vs_rest": ("NOT q AND n_chars > 3000", "NOT q AND n_chars <= 3000"),
    "flagged_vs_unflagged": ("NOT q AND n_chars > 1500", "NOT q AND n_chars <= 1500"),
}
_EFFECTS = {"structural_vs_control": (_S, _C), "fear_vs_control": (_F, _C), "fear_vs_structural": (_F, _S)}
_CROSS = {"any_obstacle": f"NOT {_C}", "structural": _S, "nonstructural": _F, "cooperative": _C, **{f: f"family = '{f}'" for f in [*STRUCTURAL, FEAR, CONTROL]}}
_RERUN = {"structural": (_S, _C), "fear": (_F, _C), "any_obstacle": (f"NOT {_C}", _C), "reason": (_S, _F), **{f: (f"family = '{f}'", _C) for f in STRUCTURAL}}
_RERUN_TWICE = {f"all|{k}": v for k, v in _RERUN.items()} | {f"rest|{k}": (f"({t}) AND n_chars <= 1500", f"({b}) AND n_chars <= 1500") for k, (t, b) in _RERUN.items()}
_CLASS = "CASE WHEN {p} IS NULL THEN 'unavailable' WHEN {p} < 0.05 THEN 'significant' ELSE 'not-significant' END"
_ARMS = "arms AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'ctx' ELSE 'main' END AS arm FROM out)"
_SEATS = """p AS (SELECT o_orderkey, ['alpha', 'beta', 'gamma', 'delta', 'omega'][o_orderkey % 5 + 1] AS advisor FROM orders),
    e AS (SELECT *, list_sort(list_filter(['alpha', 'beta', 'gamma', 'delta', 'omega'], lambda x: x <> advisor)) AS eligible FROM p),
    s AS (SELECT *, eligible[((o_orderkey % 7) % 4) + 1] AS away FROM e), seat AS (SELECT *, list_filter(eligible, lambda x: x <> away) AS seats FROM s)"""

ORACLE_SQL = {
    "sensitivity": f"""WITH {OUT}, w AS (SELECT cluster FROM out GROUP BY cluster ORDER BY avg(init::INT), cluster LIMIT 1),
        m AS (SELECT out.*, b.item_id IS NOT NULL AS q, cluster = (SELECT cluster FROM w) AS weakest FROM out LEFT JOIN benchmark b ON b.item_id = doc_id WHERE init),
        g2 AS ({_cut_rows("m", "degraded", _SENSITIVITY)}), {FISHER}, {_NULL_SIDES} SELECT family AS test, {_CONTRAST_OUT} FROM o""",
    "advisor_effects": f"""WITH {OUT}, m AS (SELECT * FROM out WHERE init), g2 AS ({_cut_rows("m", "degraded", _EFFECTS, "cluster")}), {FISHER}, {_NULL_SIDES},
        s AS (SELECT *, split_part(family, '|', 1) AS test, split_part(family, '|', 2) AS grp FROM o),
        h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY test) - row_number() OVER (PARTITION BY test ORDER BY p) + 1) * p) AS step, row_number() OVER (PARTITION BY test ORDER BY p) AS place FROM s)
        SELECT test, grp AS cluster, k, n, k0, n0, round(p1 - p0, 9) AS rd, round(p, 9) AS p, round(max(step) OVER (PARTITION BY test ORDER BY place), 9) AS p_holm FROM h""",
    "cross_arm": f"""WITH {OUT}, {_ARMS}, m AS (SELECT * FROM arms WHERE init), g2 AS (
        {_cut_rows("m", "degraded", {f"degradation/{k}": (f"arm = 'ctx' AND {c}", f"arm = 'main' AND {c}") for k, c in _CROSS.items()})}
        UNION ALL {_cut_rows("arms", "init", {"init_correct/all": ("arm = 'ctx'", "arm = 'main'")})}), {FISHER}, {_NULL_SIDES} SELECT family AS test, {_CONTRAST_OUT} FROM o WHERE n > 0 AND n0 > 0""",
    "flagged_exclusion": f"""WITH {OUT}, m AS (SELECT * FROM out WHERE init), g2 AS ({_cut_rows("m", "degraded", _RERUN_TWICE)}), {FISHER}, {_NULL_SIDES},
        s AS (SELECT split_part(family, '|', 1) AS side, split_part(family, '|', 2) AS test, p1 - p0 AS rd, p FROM o),
        j AS (SELECT a.test, a.p, b.p AS p_after, a.rd, b.rd AS rd_after, {_CLASS.format(p="a.p")} AS class, {_CLASS.format(p="b.p")} AS class_after FROM s a JOIN s b ON a.test = b.test AND a.side = 'all' AND b.side = 'rest')
        SELECT test, round(p, 9) AS p, round(p_after, 9) AS p_after, class, class_after, class = class_after AS holds, round(rd, 9) AS rd, round(rd_after, 9) AS rd_after, coalesce((rd > 0) = (rd_after > 0), false) AS same_sign FROM j""",
    "power": f"""WITH {OUT}, {PAIRS}, {_MDE} SELECT family, k, n, k0, n0, round(p0, 6) AS control_rate, 0.065::DOUBLE AS assumed_control, round(k::DOUBLE / n - p0, 6) AS rd, 0.132::DOUBLE AS assumed_rd, round(mde, 6) AS mde,
        CASE WHEN k = 0 OR k0 = 0 THEN 'zero cell' WHEN p0 < 0.065 THEN 'control below plan' ELSE 'as planned' END AS note FROM d""",
    "arm_statistics": f"""WITH {OUT}, a AS (SELECT cluster, count(*) AS n, sum(degraded::BIGINT)::BIGINT AS capitulations, sum(n_chars // 1000)::BIGINT AS flags, sum(n_chars // 1000 + doc_id % 2)::BIGINT AS flags_with_audit,
        count(*) FILTER (n_chars > 100000) AS surviving, count(*) FILTER (n_chars > 90000) AS zero_tolerance, count(*) FILTER (init AND NOT degraded) AS clean, sum(n_chars * 0.001::DOUBLE) AS cost FROM out GROUP BY cluster),
        w AS (SELECT *, clean AS k FROM a)
        SELECT cluster, n, capitulations, flags, flags_with_audit, surviving, zero_tolerance, clean, round(cost, 6) AS cost, round(capitulations::DOUBLE / n, 6) AS capitulations_per, round(surviving::DOUBLE / n, 6) AS surviving_share,
        round(cost / n, 6) AS cost_per, round(k::DOUBLE / n, 6) AS clean_rate, round({_wilson("k", "n", -1)}, 6) AS clean_lo, round({_wilson("k", "n", 1)}, 6) AS clean_hi FROM w""",
    "arm_rules": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
        SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY n DESC, o_orderpriority) AS rules FROM c GROUP BY o_orderstatus""",
    "arm_details": f"""WITH {OUT}, {_ARMS}, m AS (SELECT * FROM arms WHERE init), g2 AS ({_cut_rows("m", "degraded", {"b": (f"NOT {_C}", _C)}, "arm")}), {FISHER}, {_NULL_SIDES},
        d AS (SELECT arm, median(n_chars) AS median_tod FROM m WHERE degraded GROUP BY arm)
        SELECT d2.arm, k, n, k0, n0, round(p1 - p0, 9) AS rd, round(p, 9) AS p, round(median_tod, 9) AS median_tod FROM (SELECT *, split_part(family, '|', 2) AS arm FROM o) d2 LEFT JOIN d USING (arm)""",
    "family_flags": f"""WITH {OUT}, {_ARMS} SELECT arm, sum(n_chars // 1000)::BIGINT AS events, count(*) AS conversations, round(sum(n_chars // 1000)::DOUBLE / count(*), 6) AS per_conversation,
        CASE WHEN {_C} THEN 'control' ELSE 'other' END AS families FROM arms GROUP BY arm, families""",
    "instrument_checks": """WITH o AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS arms, count(DISTINCT l_linestatus) AS firsts FROM lineitem GROUP BY l_orderkey)
        SELECT count(*) AS cells, count(*) FILTER (firsts = 1) AS identical, round(count(*) FILTER (firsts = 1)::DOUBLE / count(*), 9) AS fraction FROM o WHERE arms > 1""",
    "seat_balance": f"""WITH {_SEATS}, x AS (SELECT unnest(seats) AS provider, 1 AS seat, 0 AS away_ FROM seat UNION ALL SELECT away, 0, 1 FROM seat)
        SELECT provider, sum(seat)::BIGINT AS seats, sum(away_)::BIGINT AS sat_out FROM x GROUP BY provider""",
    "own_panel_count": f"WITH {_SEATS} SELECT count(*) FILTER (list_contains(seats, advisor)) AS n FROM seat",
    "audit_join": """WITH j AS (SELECT l.doc_id, d.lang, l.toxic = 1 AND d.doc_id IS NOT NULL AS done FROM labels l LEFT JOIN documents d USING (doc_id))
        SELECT lang, count(*) AS n FROM j WHERE done GROUP BY lang UNION ALL SELECT 'missing', count(*) FROM j WHERE NOT done""",
}
