"""Queries over guard post-rules, selections and checks of a run, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogscope.functions import guard as G
from dialogscope.functions import values as V
from dialogscope.operators import verification


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


def _flags():
    i = F.col("doc_id")
    names = [*G.FLAG_RULES, "barrier_disclosure"]
    raised = F.filter(F.array(*[F.lit(x) for x in names]), lambda x: F.pmod(i + F.length(x), F.lit(5)) == 0)
    evidence = F.map_from_entries(F.transform(raised, lambda x: F.struct(x, F.when(F.pmod(i, F.lit(2)) == 0, F.concat(x, F.lit("!"))).otherwise(""))))
    return raised, evidence


def flag_violations(spark, sf_dir):
    """Flags that follow from the document's number, as violations: counts by the rules that remain and the rule that was dropped."""
    raised, evidence = _flags()
    v = G.from_flags(raised, evidence, is_control=F.col("lang") == "en", recommended=F.pmod("doc_id", F.lit(3)) == 0, disclosed=F.lit(False))
    out = _docs(spark, sf_dir).select(v.alias("v"))
    return out.groupBy(F.array_join(F.transform("v.violations", lambda x: x["rule"]), ",").alias("rules"), F.col("v.dropped").alias("dropped")).agg(F.count("*").alias("n"))


def hypothetical_evidence(spark, sf_dir):
    """The third word of each message as evidence: how often it stands in a what-if."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    c = c.withColumn("text", F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("Would "), F.lower("text"), F.lit("?"))).when(F.pmod("conv_id", F.lit(3)) == 1, F.concat(F.lit("what if "), "text")).otherwise(F.col("text")))
    word = F.regexp_extract("text", r"^\S+\s+\S+\s+(\S+)", 1)
    return c.groupBy("role").agg(F.count_if(G.in_hypothetical(F.col("text"), word)).alias("hypothetical"), F.count("*").alias("n"))


def rejudge_selection(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    wanted = verification.needs_rejudging(F.col("o_orderstatus") != "P", F.col("o_orderpriority"), F.lit(None).cast("string"), ["1-URGENT", "5-LOW"])
    return o.groupBy(wanted.alias("wanted")).agg(F.count("*").alias("n"))


def view_exclusion(spark, sf_dir):
    why = verification.left_out(F.concat(F.lit(" "), F.upper("event_type")), smoke="view", archived=["cl", "err"])
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def list_arguments(spark, sf_dir):
    """Two regions' initials and one word of the nation as an argument."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat_ws(",", F.concat(F.lit(" "), F.left("n_name", F.lit(1))), F.lit(""), F.substring("n_name", 2, 1), F.when(F.col("n_regionkey") == 0, F.left("n_name", F.lit(1))))
    a = verification.list_argument(text)
    return n.select("n_nationkey", F.array_join(a["items"], "|").alias("items"), a["error"].alias("error"))


def arm_checks(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("arm", F.when(F.pmod("doc_id", F.lit(3)) == 0, "context").otherwise("main")).withColumn("rep", F.when(F.col("arm") == "main", F.pmod("doc_id", F.lit(2))).otherwise(0).cast("int"))
    return verification.cross_arm(d, "arm", "rep", F.col("lang") == "en", {"main": 2, "context": 1}, 100)


def prompt_constancy(spark, sf_dir):
    """Cells are two hundred groups of customers in each nation; prompts recorded are their market segments: one that all share, or several."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(F.sequence(F.lit(0), F.lit(199))).alias("part"), "n_nationkey")
    n = n.select((F.col("n_nationkey") * 1000 + F.col("part")).cast("long").alias("cell"), F.lit("BUILDING").alias("sha"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 200).cast("long").alias("cell"), F.col("c_mktsegment").alias("sha"))
    return verification.constant_hashes(n, c, "cell", "sha")


def reply_usage(spark, sf_dir):
    """Usage under one of two names in each event's properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    name = F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("prompt_tokens")).otherwise("input_tokens")
    reply = F.concat(F.lit('{"usage":{"'), name, F.lit('":'), F.pmod("event_id", F.lit(100)).cast("string"), F.lit(',"model_extra":{"cost":0.5}}}'))
    u = V.usage(F.parse_json(reply))
    return e.groupBy("event_type").agg(F.sum(u["prompt_tokens"]).alias("tokens"), F.sum(u["cost"]).alias("cost"), F.count(u["cached_tokens"]).alias("cached"))


def number_formats(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    share = F.when(F.col("n_nationkey") > 0, F.col("n_nationkey") / 61)
    return n.select("n_nationkey", V.percent(share, 2).alias("share"), V.json_safe(F.when(F.col("n_regionkey") == 0, float("nan")).otherwise(share)).alias("safe"))


QUERIES = {
    f.__name__: f
    for f in (flag_violations, hypothetical_evidence, rejudge_selection, view_exclusion, list_arguments, arm_checks, prompt_constancy, reply_usage, number_formats)
}

_NAMES = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(G.FLAG_RULES.items()))
ORACLE_SQL = {
    "flag_violations": f"""WITH r AS (SELECT * FROM (VALUES {_NAMES}) t(flag, rule, i)),
        f AS (SELECT d.doc_id, string_agg(rule, ',' ORDER BY i) AS rules, count(*) AS c FROM documents d, r WHERE (doc_id + length(flag)) % 5 = 0 GROUP BY doc_id),
        x AS (SELECT d.doc_id, coalesce(c, 0) = 1 AND d.doc_id % 2 = 1 AS blank, coalesce(rules, '') AS rules,
            lang <> 'en' AND (d.doc_id + length('barrier_disclosure')) % 5 = 0 AND d.doc_id % 3 <> 0 AS early FROM documents d LEFT JOIN f USING (doc_id))
        SELECT array_to_string(list_filter([CASE WHEN NOT blank AND rules <> '' THEN rules END, CASE WHEN early THEN '{G.PREMATURE}' END], lambda y: y IS NOT NULL), ',') AS rules, CASE WHEN blank THEN rules END AS dropped, count(*) AS n
        FROM x GROUP BY ALL""",
    "hypothetical_evidence": rf"""WITH c AS (SELECT role, CASE conv_id % 3 WHEN 0 THEN 'Would ' || lower(text) || '?' WHEN 1 THEN 'what if ' || text ELSE text END AS t FROM conversations),
        w AS (SELECT role, t, regexp_replace(regexp_extract(t, '^\S+\s+\S+\s+(\S+)', 1), '^"+|"+$', '', 'g') AS e FROM c), p AS (SELECT *, CASE WHEN e <> '' THEN instr(lower(t), lower(e)) ELSE 0 END AS pos FROM w),
        s AS (SELECT *, regexp_extract(left(t, greatest(pos - 1, 0)::INT), '[^.!?\n]*$') AS pre, substr(t, pos) AS rest FROM p), q AS (SELECT *, regexp_extract(rest, '^[^.!?\n]*') AS tail FROM s)
        SELECT role, count(*) FILTER (e <> '' AND pos > 0 AND (regexp_matches(pre, '{G.HYPOTHETICAL}') OR (regexp_matches(pre || tail, '{G.MODAL_QUESTION}') AND substr(rest, length(tail) + 1, 1) = '?'))) AS hypothetical, count(*) AS n FROM q GROUP BY role""",
    "rejudge_selection": "SELECT o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW') AS wanted, count(*) AS n FROM orders GROUP BY 1",
    "view_exclusion": "SELECT CASE WHEN event_type LIKE 'view%' THEN 'validation smoke' WHEN event_type LIKE 'cl%' THEN 'cl' WHEN event_type LIKE 'err%' THEN 'err' END AS why, count(*) AS n FROM events GROUP BY 1",
    "list_arguments": """WITH a AS (SELECT n_nationkey, list_filter([trim(left(n_name, 1)), trim(substr(n_name, 2, 1)), CASE WHEN n_regionkey = 0 THEN trim(left(n_name, 1)) END], lambda x: x IS NOT NULL AND x <> '') AS i FROM nation)
        SELECT n_nationkey, array_to_string(i, '|') AS items, CASE WHEN len(i) = 0 THEN 'empty' WHEN len(i) <> len(list_distinct(i)) THEN 'duplicate' END AS error FROM a""",
    "arm_checks": """WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'context' ELSE 'main' END AS arm, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 2 END AS rep, lang = 'en' AS c FROM documents),
        p AS (SELECT arm, count(*) AS n, list_sort(list(DISTINCT rep)) AS r, list_sort(list(DISTINCT c)) AS c FROM d GROUP BY arm)
        SELECT arm || ' replicates' AS "check", r = range(CASE arm WHEN 'main' THEN 2 ELSE 1 END) AS ok, array_to_string(r, ',') AS detail FROM p
        UNION ALL SELECT arm || ' context', c = [arm = 'context'], array_to_string(c, ',') FROM p UNION ALL SELECT 'total', sum(n) = 300, sum(n)::BIGINT::VARCHAR FROM p""",
    "prompt_constancy": """WITH s AS (SELECT (c_nationkey * 1000 + c_custkey % 200)::BIGINT AS cell, list(DISTINCT c_mktsegment) AS r FROM customer GROUP BY 1),
        n AS (SELECT (n_nationkey * 1000 + part)::BIGINT AS cell FROM nation, range(200) AS t(part))
        SELECT * FROM (SELECT n.cell, CASE WHEN r IS NULL THEN 'unrecorded' WHEN len(r) > 1 THEN 'several' WHEN r[1] <> 'BUILDING' THEN 'changed' END AS problem FROM n LEFT JOIN s USING (cell)) WHERE problem IS NOT NULL""",
    "reply_usage": "SELECT event_type, sum(event_id % 100)::BIGINT AS tokens, count(*) * 0.5::DOUBLE AS cost, 0 AS cached FROM events GROUP BY 1",
    "number_formats": """SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN format('{:.2f}%', n_nationkey / 61.0::DOUBLE * 100) ELSE '—' END AS share, CASE WHEN n_regionkey <> 0 AND n_nationkey > 0 THEN n_nationkey / 61.0::DOUBLE END AS safe FROM nation""",
}
