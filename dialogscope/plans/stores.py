"""Queries over what people and earlier runs leave behind: nested documents, names, and judgments made again, from the driver tables.

An order stands for a record: its priority is the judgment, its lines make the fresh one (their greatest return flag, their quantity as the cost), and
an order of a customer whose number ends in 7 fails.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogscope.operators import rejudging, sets, verification, views
from dialogscope.sources import documents, names

CAP = 20_000.0
STATUSES = ["1-URGENT", "5-LOW"]


def _merged(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("judgment"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("judgment"), F.sum("l_quantity").alias("cost"))
    fresh = lines.join(o.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "judgment", "cost", F.when(F.col("o_custkey") % 10 == 7, "upstream").alias("error"))
    wanted = verification.needs_rejudging(F.col("o_orderstatus") != "P", F.col("judgment"), F.lit(None).cast("string"), STATUSES)
    return rejudging.rejudge(o, fresh, wanted, key="o_orderkey", order="o_orderkey", max_spend=CAP)


def rejudge_merge(spark, sf_dir):
    """Every order with its judgment after the merge, what became of it, and the spending before it."""
    return _merged(spark, sf_dir).select("o_orderkey", "judgment", "outcome", "error", F.col("spent").cast("double").alias("spent"))


def rejudge_summary(spark, sf_dir):
    return rejudging.summary(_merged(spark, sf_dir))


def nested_messages(spark, sf_dir):
    """Every message written as a nested document (quoted for users, as a literal block for others) and read back."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    block = F.concat(F.lit("|-\n      "), F.replace("text", F.lit("\n"), F.lit("\n      ")))
    body = F.when(F.col("text").isNull(), "~").when(F.col("role") == "user", quoted).otherwise(block)
    text = F.concat(F.lit("id:\n  conversation: "), F.col("conv_id"), F.lit("\n  turn: "), F.col("turn"), F.lit("\nmessages:\n  - role: "), F.col("role"), F.lit("\n    text: "), body, F.lit("\n"))
    read = c.select(documents.nested(text).alias("n")).select(F.col("n.document").alias("d"), "n.error")
    get = lambda path, t, name: F.try_variant_get("d", path, t).alias(name)
    out = read.select(get("$.id.conversation", "long", "conv_id"), get("$.id.turn", "long", "turn"), get("$.messages[0].role", "string", "role"), get("$.messages[0].text", "string", "text"), "error")
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "error")


def configuration_errors(spark, sf_dir):
    """Each order as a configuration: its suppliers are providers and advisors, its customer's number names the patient's; low priority has no seed."""
    # dealt by order once, for the sets and the join; the set of an order is what is distinct
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").repartition("l_orderkey")
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.concat(F.lit("s"), "l_suppkey"))).alias("s"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(per, "o_orderkey")
    text = F.concat(
        F.lit("providers:\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("  "), x, F.lit(": maker/"), x, F.lit("  # a supplier"))), "\n"),
        F.lit("\nroles:\n  advisors: ["), F.array_join("s", ", "), F.lit("]\n  patient: s"), F.col("o_custkey"), F.lit("\n  judge_panel: 3\nsampling:\n  advisor: { temperature: 0.7, max_tokens: 10 }\n"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("seed: 7\n"),
    )
    read = o.select("o_orderkey", documents.nested(text).alias("n")).select("o_orderkey", "n.document")
    found = documents.configuration(read)
    return found.select("o_orderkey", F.size("advisors").cast("long").alias("advisors"), F.array_join("errors", "; ").alias("errors"))


def near_part_names(spark, sf_dir):
    """The five parts (name, brand and number) most like each first word of a name with a brand."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("_")), "p_brand", "p_partkey").alias("name"), F.split("p_name", " ")[0].alias("word"))
    asked = [f"{r[0]}_Brand#1" for r in parts.select("word").distinct().collect()]  # some words of a vocabulary
    return names.near_names(parts, "name", asked)


def event_views(spark, sf_dir):
    """Every document as the draft, the error and the evidence (its lines) of a guard event, as it is shown."""
    lines = F.expr("to_variant_object(split(text, '\n'))")
    absent = {c: F.lit(None).cast("string") for c in ("outcome", "rejected_text", "correction")}
    absent |= {"rejected_cost": F.lit(None).cast("double"), "resample": F.to_variant_object(F.struct(F.col("text").alias("accepted_text"))), "violations": F.lit(None).cast("array<struct<layer:string,rule:string,evidence:string>>")}
    e = F.struct(F.lit("regenerated").alias("kind"), F.lit(1).alias("after_response"), F.lit(0).alias("attempt"), F.col("lang").alias("rule"), F.col("text").alias("error"), F.col("text").alias("candidate"), lines.alias("evidence"), *[v.alias(c) for c, v in absent.items()])
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", views.events(F.array(e))[0].alias("e"))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return d.select("doc_id", F.col("e.rule").alias("rule"), sha("e.candidate", "candidate"), sha("e.error", "error"), sha("e.resample.accepted_text", "accepted"), sha(F.array_join("e.evidence", "\n"), "evidence"))


def _named(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    family = F.when(F.col("o_orderpriority") == "1-URGENT", "hospital_fear").when(F.col("o_orderpriority") == "2-HIGH", "cost_medical_debt").otherwise(F.lower("o_orderpriority"))
    records = o.select("o_orderkey", F.concat_ws("__", F.col("o_custkey") % 40, family, F.lower("o_orderstatus"), F.concat(F.lit("r"), F.col("o_orderkey") % 3)).alias("conversation_id"))
    slugs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("id"), F.lower("n_name").alias("slug"))
    return records, slugs


def shown_ids(spark, sf_dir):
    """Each order's record id (of forty vignettes, 25 with a slug) as it is shown, and whether an id that is shown for it with another replicate names a record."""
    records, slugs = _named(spark, sf_dir)
    shown = names.display_ids(records, slugs)
    others = shown.select("o_orderkey", F.concat(F.expr("left(display, length(display) - 1)"), F.col("o_orderkey") % 5).alias("other"))
    found = names.resolvable(others, records, slugs, display="other").withColumn("found", F.lit(True))
    rows = shown.join(others, "o_orderkey").join(found, "other", "left")
    return rows.select("o_orderkey", "display", F.coalesce("found", F.lit(False)).alias("found"))


def arm_progress(spark, sf_dir):
    """Orders of even customers are cells of the main arm, others of the context arm; those with lines that were returned or accepted are finished."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "main").otherwise("context").alias("arm"))
    back = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sets.arm_states(o, o.join(back, "o_orderkey"), "o_orderkey")


QUERIES = {f.__name__: f for f in (shown_ids, arm_progress, event_views, rejudge_merge, rejudge_summary, nested_messages, configuration_errors, near_part_names)}

_MERGED = f"""WITH l AS (SELECT l_orderkey, max(l_returnflag) AS mode, sum(l_quantity) AS cost FROM lineitem GROUP BY 1),
    t AS (SELECT o_orderkey, o_orderpriority AS old, mode, cost, o_custkey % 10 = 7 AS bad, o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW') AS wanted FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
    s AS (SELECT *, coalesce(sum(CASE WHEN wanted THEN coalesce(cost, 0) ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t),
    m AS (SELECT *, CASE WHEN NOT wanted THEN 'untouched' WHEN spent >= {CAP} THEN 'deferred' WHEN mode IS NULL OR bad THEN 'failed' ELSE 'rejudged' END AS outcome FROM s)"""
ORACLE_SQL = {
    "shown_ids": """WITH r AS (SELECT o_orderkey, (o_custkey % 40)::VARCHAR AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 'fear' WHEN '2-HIGH' THEN 'cost' ELSE lower(o_orderpriority) END AS f, lower(o_orderstatus) AS a, o_orderkey % 3 AS r, o_orderkey % 5 AS other FROM orders),
        k AS (SELECT DISTINCT v, f, a, r FROM r)
        SELECT o_orderkey, coalesce(lower(n_name), r.v) || '__' || r.f || '__' || r.a || '__r' || r.r AS display, n_name IS NOT NULL AND k.v IS NOT NULL AS found
        FROM r LEFT JOIN nation ON n_nationkey::VARCHAR = r.v LEFT JOIN k ON k.v = r.v AND k.f = r.f AND k.a = r.a AND k.r = r.other""",
    "arm_progress": """WITH o AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'main' ELSE 'context' END AS arm, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N') AS done FROM orders)
        SELECT arm, count(*) AS expected, count(*) FILTER (NOT done) AS missing, bool_and(done) AS complete FROM o GROUP BY arm""",
    "event_views": """SELECT doc_id, lang AS rule, sha256(left(text, 4000)) AS candidate, sha256(left(text, 600)) AS error, sha256(left(text, 4000)) AS accepted,
        sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: left(x, 600)), chr(10))) AS evidence FROM documents""",
    "rejudge_merge": f"""{_MERGED} SELECT o_orderkey, CASE WHEN outcome = 'rejudged' THEN mode ELSE old END AS judgment, outcome,
        CASE WHEN outcome = 'failed' THEN CASE WHEN mode IS NULL THEN 'no judgment' ELSE 'upstream' END END AS error, spent::DOUBLE AS spent FROM m""",
    "rejudge_summary": f"""{_MERGED} SELECT count(*) AS records, count(*) FILTER (outcome <> 'untouched') AS targets, count(*) FILTER (outcome = 'rejudged') AS rejudged, count(*) FILTER (outcome = 'failed') AS failed,
        count(*) FILTER (outcome = 'deferred') AS deferred, bool_or(outcome = 'deferred') AS capped, sum(cost) FILTER (outcome IN ('rejudged', 'failed'))::DOUBLE AS spent,
        count(*) FILTER (outcome IN ('rejudged', 'failed') AND cost IS NULL) AS calls_missing_cost FROM m""",
    "nested_messages": """SELECT conv_id, turn, role, sha256(CASE WHEN role = 'user' THEN text ELSE rtrim(text, chr(10)) END) AS text_sha256, CAST(NULL AS VARCHAR) AS error FROM conversations""",
    "configuration_errors": """WITH l AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS advisors, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)
        SELECT o_orderkey, advisors, concat_ws('; ', CASE WHEN o_orderpriority = '5-LOW' THEN 'missing or invalid: seed' END, CASE WHEN NOT list_contains(s, o_custkey) THEN 'not among providers: s' || o_custkey END) AS errors
        FROM orders JOIN l ON l_orderkey = o_orderkey""",
}
