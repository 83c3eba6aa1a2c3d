"""Queries over conversations, grids, votes, windows, text, cost, checks and comparisons.

``conversations`` rows are turns (assistant is the advisor, user the patient). Panels are three votes on an
order, worked out from its key. Append-only logs are users' events; a later row of a user wins.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.functions import text as T
from dialogscope.operators import quality, records, sets, votes
from dialogscope.plans.outcomes import OUT, outcomes, rounded
from dialogscope.sources.records import last_wins
from dialogscope.streaming import logs, state


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = records.turns_of(c, "conv_id", "turn", "role", "text")
    adv = F.filter("turns", lambda t: t["role"] == "assistant")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.size(adv).cast("long").alias("n_adv"), F.get(adv, F.lit(0))["text"].alias("first_advisor"))


def render_transcript(spark, sf_dir):
    turns = records.turns_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return turns.select("conv_id", F.sha2(records.transcript("turns", "role", "text"), 256).alias("sha"))


def outcome_buckets(spark, sf_dir):
    """Customers by their first order under 20,000: ToD its place, n the number of orders."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("x"))
    low = F.array_position(F.transform("x", lambda r: r["o_totalprice"] < 20_000), True)
    n = F.size("x").cast("long")
    rows = per.select("o_custkey", n.alias("n"), F.when(low == 0, n + 1).otherwise(low).alias("tod"), F.when(F.get("x", F.lit(0))["o_totalprice"] > 50_000, 1).otherwise(0).alias("init"))
    return rows.groupBy(records.outcome("init", "tod", "n").alias("outcome"), records.bucket("init", "tod", "n").alias("bucket")).agg(F.count("*").alias("n"))


def cell_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat_ws("__", "r_name", "n_name", F.format_string("r%d", "n_nationkey")).alias("cell"))


def _grid(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return sets.grid(n, p, replicates=3)


def _done(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority"), F.pmod("o_orderkey", F.lit(2)).cast("int").alias("replicate")).distinct()


def grid_cross(spark, sf_dir):
    return _grid(spark, sf_dir).select("nation", "priority", F.col("replicate").cast("long").alias("replicate"))


def resume_anti(spark, sf_dir):
    return sets.remaining(_grid(spark, sf_dir), _done(spark, sf_dir), ["nation", "priority", "replicate"]).select("nation", "priority", F.col("replicate").cast("long").alias("replicate"))


def missing_extra_dupes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("k"))
    return sets.set_comparison(parts, lines, "k").groupBy("status").agg(F.count("*").alias("n"), F.min("k").alias("least"))


def orphans(spark, sf_dir):
    """Customers without an urgent order of more than 250,000."""
    large = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 250000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def exclusion_semi(spark, sf_dir):
    excluded = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).withColumn("quarantined", F.lit(True))
    rows = outcomes(spark, sf_dir).join(excluded, "doc_id", "left")
    return rows.groupBy(F.coalesce("quarantined", F.lit(False)).alias("quarantined")).agg(F.count("*").alias("n"), F.count_if("degraded").alias("degraded"))


def paired_arms(spark, sf_dir):
    """Suppliers' and customers' balances by nation, as two arms that are paired by it."""
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("a"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("b"))
    return a.join(b, "k").select("k", F.round(F.col("a") - F.col("b"), 4).alias("difference"))


def kway_match(spark, sf_dir):
    arms = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("first"))
    first = arms.groupBy("k", "arm").agg(F.min("first").alias("first"))
    return first.groupBy("k").agg(F.count("*").alias("arms"), F.count_distinct("first").alias("firsts")).where("arms > 1").groupBy("arms", "firsts").agg(F.count("*").alias("n"))


def hash_manifest_diff(spark, sf_dir):
    """Documents whose text differs from the benchmark item of the same number, by hash."""
    then = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.sha2("text", 256).alias("sha"))
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("sha"))
    return sets.differences(then, now, "k", "sha")


def prior_vs_current(spark, sf_dir):
    """Each customer's last order priority in an earlier and in a later half of the orders' keys."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    half = o.agg(F.percentile("o_orderkey", 0.5).alias("m"))
    both = o.crossJoin(F.broadcast(half))  # one row
    before = last_wins(both.where("o_orderkey <= m").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")
    after = last_wins(both.where("o_orderkey > m").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")
    return sets.changes(before, after, "o_custkey", "o_orderpriority").groupBy("change").agg(F.count("*").alias("n"))


def _panels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")

    def seat(i: int):
        v = F.pmod(F.col("o_orderkey") * 7 + i * 5, F.lit(11)).cast("int")
        return F.struct(
            F.lit(f"judge{i}").alias("judge"), F.when(F.pmod(F.col("o_orderkey") + i * 3, F.lit(7)) == 0, "unparseable").otherwise("judged").alias("status"),
            F.when(v == 10, 0).otherwise(1).alias("init"), F.when(v < 10, v + 2).alias("tod"), F.when(v < 10, F.pmod(v, F.lit(2)) + 1).alias("irn"), F.concat(F.lit("q"), v).alias("quote"),
        )

    return o.select("o_orderkey", F.array(seat(0), seat(1), seat(2)).alias("panel"))


def panel_votes(spark, sf_dir):
    out = _panels(spark, sf_dir).select("o_orderkey", votes.combine(F.col("panel"), F.lit(8)).alias("v"))
    return out.select("o_orderkey", *[F.col(f"v.{c}").cast("long").alias(c) for c in ("init", "tod", "irn")], "v.quote", "v.median", "v.aggregation", F.array_join("v.splits", ",").alias("splits"), F.col("v.failed.judge").alias("failed"))


def panel_agreement(spark, sf_dir):
    a = _panels(spark, sf_dir).select(votes.agreement(F.col("panel")).alias("a")).select("a.init_unanimous", "a.tod_unanimous", *[F.col(f"a.{c}").cast("long").alias(c) for c in ("tod_votes", "spread")])
    return a.groupBy("init_unanimous", "tod_votes", "tod_unanimous", "spread").agg(F.count("*").alias("n"))


def panel_for_rotation(spark, sf_dir):
    names = F.array(*map(F.lit, ("anthro", "cohere", "deep", "mist", "open")))
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.array_join(votes.seats_for(names, F.element_at(names, F.pmod("n_nationkey", F.lit(5)) + 1), F.col("n_regionkey")), ",").alias("seats"))


def verdict_validate(spark, sf_dir):
    v = _panels(spark, sf_dir).select(F.explode("panel").alias("s"))
    e = votes.verdict_error(F.col("s.init"), F.col("s.irn"), F.col("s.tod"), F.when(F.col("s.tod") == 9, "").otherwise(F.when(F.col("s.init") == 1, F.col("s.quote")).otherwise("")), F.lit(8))
    return v.groupBy(e.alias("error")).agg(F.count("*").alias("n"))


def last_row_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return last_wins(e, "user_id", "event_id")


def sticky_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    out = sets.latched(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "failed_before")
    return out.groupBy("event_type", "failed_before").agg(F.count("*").alias("n"))


def spend_cap_replay(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = sets.spend_replay(o, "o_orderkey", "o_totalprice", 500_000.0, by="o_custkey")
    return out.groupBy("runs").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


def free_ordinal(spark, sf_dir):
    return sets.first_free_ordinal(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")))


def round_robin_sample(spark, sf_dir):
    rows = outcomes(spark, sf_dir).where("init")
    turns = sets.round_robin(rows, "cluster", F.col("doc_id"))
    return turns.select("doc_id", "cluster", F.col("place").cast("long").alias("place"))


def shingle_overlap(spark, sf_dir):
    """Eight-word shingles that documents share with benchmark items."""
    return T.shared_shingles(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"))


def normalize_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha2(T.normalize("text"), 256).alias("words"), F.size(T.words("text")).cast("long").alias("n"))


def quote_verbatim(spark, sf_dir):
    """Whether a turn stands verbatim in the document of the same number."""
    c = table(spark, sf_dir, "conversations").where("turn = 1").select("conv_id", F.col("text").alias("quote"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    return c.join(d, "conv_id").select("conv_id", T.quote_verbatim("quote", "text").alias("verbatim"))


def rule_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.rule_hits("text").alias("hits"), T.thanks_and_farewell("text").alias("thanks"))
    return c.groupBy(F.coalesce(F.array_join(F.transform("hits", lambda h: h["rule"]), ","), F.lit("")).alias("rules"), "thanks").agg(F.count("*").alias("n"))


def gratitude_wrap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count_if(T.thanks_and_farewell("text")).alias("both"), F.count_if(F.col("text").rlike(T.THANKS)).alias("thanks"))


def repetition_pairs(spark, sf_dir):
    """Users' messages, with those of every fifth conversation said again with other marks."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    again = users.where("conv_id % 5 = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.lit("  "), "text", F.lit("!!")).alias("text"))
    return T.repetitions(users.union(again), "conv_id", "turn", "text")


def template_fill_hash(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    filled = T.fill(F.lit("You live in {nation}.\n\n\n\nThat is in {region}."), {"nation": F.col("n_name"), "region": F.col("r_name")})
    return n.select("n_nationkey", T.fingerprint(filled, F.lit("v1")).alias("sha"))


def verdict_extraction(spark, sf_dir):
    """Verdicts written into replies with fences, prose and braces, taken out again."""
    o = _panels(spark, sf_dir).select("o_orderkey", F.explode("panel").alias("s"))
    verdict = F.to_json(F.struct(F.col("s.init").alias("init_correct"), F.col("s.irn").alias("init_response_number"), F.col("s.tod").alias("ToD"), F.col("s.quote").alias("degraded_turn_quote"), F.lit("as {said}").alias("rationale")), {"ignoreNullFields": "false"})
    reply = F.concat(F.lit('Here {is} a draft: {"a": 1}\n```json\n'), verdict, F.lit("\n```"))
    out = o.select(T.extract_verdict(reply).alias("x"), F.col("s.init").alias("init"))
    return out.groupBy("x.error", (F.get_json_object("x.verdict", "$.init_correct").cast("int") == F.col("init")).alias("same")).agg(F.count("*").alias("n"))


def turn_cost(spark, sf_dir):
    """Line items as the turns of an order: charged by price and discount, missing where it is not discounted."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", "l_extendedprice")
    cost = li.withColumn("cost", F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * F.col("l_discount") / 1000))
    return quality.cost_report(cost, "cost", F.col("cost").isNull(), ["l_returnflag"]).select("l_returnflag", F.round("cost", 3).alias("cost"), "missing", "lower_bound")


def check_battery(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    checks = {
        "text_present": F.length("text") > 0, "lang_known": F.col("lang").isin("en", "de", "fr", "es"), "length_recorded": F.col("n_chars") == F.length("text"),
        "source_named": F.col("source").rlike("^src[0-9]+$"), "long_enough": F.col("n_chars") >= 100,
    }
    return quality.battery(d, checks)


def observed_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").withColumn("version", F.lit("v2"))
    out = quality.observed(o, ["o_orderstatus", "o_orderpriority", "version"], {"o_orderstatus": "F", "version": "v1"})
    return out.select("term", F.array_join("values", ",").alias("values"), "locked", "problem")


def catalogue_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = quality.index(o, ["o_orderstatus"], "o_orderpriority", "o_orderdate")
    pairs = F.transform(F.map_entries("families"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("o_orderstatus", "n", F.array_join(F.array_sort(pairs), ",").alias("families"), F.date_format("started", "yyyy-MM-dd").alias("started"))


def stats_diff(spark, sf_dir):
    """Mean price by priority, over all orders and without finished ones: paths whose value moved by 1 % or more."""
    o = table(spark, sf_dir, "orders")
    a = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("before"))
    b = o.where("o_orderstatus <> 'F'").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("after"))
    moved = F.abs(F.col("after") - F.col("before")) >= 0.01 * F.abs(F.col("before"))
    return rounded(a.join(b, "o_orderpriority", "left").select("o_orderpriority", "before", "after", (F.signum("after") == F.signum("before")).alias("same_sign"), moved.alias("moved")), 4)


def _stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    now = spark.read.parquet(path)
    return logs.follow(spark, path, now.schema, fmt="parquet", single_file=now.inputFiles()[0].endswith(f"/{name}.parquet"), **options)


def stream_last_wins(spark, sf_dir):
    """The same as ``last_row_wins``, from a stream of the events file."""
    events = _stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    sink = _scratch(spark)
    logs.upsert(events, sink, "user_id", "event_id", _scratch(spark)).awaitTermination()
    return logs.latest(spark, sink)


def sticky_state_stream(spark, sf_dir):
    """The same as ``sticky_state``, from a stream: state by user, changed rows merged into a table of events."""
    events = _stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    latched, sink = state.latched(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "failed_before"), _scratch(spark)
    logs.upsert(latched, sink, "event_id", "failed_before", _scratch(spark), changes=True).awaitTermination()
    return logs.latest(spark, sink).groupBy("event_type", "failed_before").agg(F.count("*").alias("n"))


def spend_cap_stream(spark, sf_dir):
    """The same as ``spend_cap_replay``, from a stream: whole files in one batch, so that keys are in order."""
    orders = _stream(spark, sf_dir, "orders", files_per_trigger=2**31 - 1).select("o_custkey", "o_orderkey", "o_totalprice")
    replayed, sink = state.spend_replay(orders, "o_orderkey", "o_totalprice", 500_000.0, by="o_custkey"), _scratch(spark)
    logs.upsert(replayed, sink, "o_orderkey", "spent", _scratch(spark)).awaitTermination()
    return logs.latest(spark, sink).groupBy("runs").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


def _scratch(spark: SparkSession) -> str:
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dialogscope-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


QUERIES = {
    f.__name__: f
    for f in (
        turn_counts, render_transcript, outcome_buckets, cell_ids, grid_cross, resume_anti, missing_extra_dupes, orphans, exclusion_semi, paired_arms, kway_match, hash_manifest_diff,
        prior_vs_current, panel_votes, panel_agreement, panel_for_rotation, verdict_validate, last_row_wins, sticky_state, spend_cap_replay, free_ordinal, round_robin_sample, shingle_overlap,
        normalize_text, quote_verbatim, rule_hits, gratitude_wrap, repetition_pairs, template_fill_hash, verdict_extraction, turn_cost, check_battery, observed_values, catalogue_index, stats_diff,
        stream_last_wins, sticky_state_stream, spend_cap_stream,
    )
}

_SEATS = """s AS (SELECT o_orderkey, i, (o_orderkey * 7 + i * 5) % 11 AS v, (o_orderkey + i * 3) % 7 = 0 AS bad FROM orders, (SELECT unnest(range(3)) AS i)),
    j AS (SELECT o_orderkey, i, CASE WHEN v = 10 THEN 0 ELSE 1 END AS init, CASE WHEN v < 10 THEN v + 2 END AS tod, CASE WHEN v < 10 THEN v % 2 + 1 END AS irn, 'q' || v AS quote, bad FROM s)"""
_WORDS = "regexp_extract_all(lower(text), '[a-z'']+')"
_DONE = """done AS (SELECT DISTINCT n_name AS nation, o_orderpriority AS priority, o_orderkey % 2 AS replicate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    grid AS (SELECT n_name AS nation, priority, replicate FROM nation, (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT unnest(range(3)) AS replicate))"""
_LAST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
_LATCHED = """WITH e AS (SELECT event_type, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before FROM events)
        SELECT event_type, failed_before, count(*) AS n FROM e GROUP BY ALL"""
_CAPPED = """WITH o AS (SELECT o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500000 AS runs FROM orders)
        SELECT runs, count(*) AS n, round(sum(o_totalprice), 2) AS cost FROM o GROUP BY runs"""

ORACLE_SQL = {
    "turn_counts": """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS n_adv, arg_min(text, turn) FILTER (role = 'assistant') AS first_advisor FROM conversations GROUP BY conv_id""",
    "render_transcript": r"""SELECT conv_id, sha256(string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id""",
    "outcome_buckets": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
        p AS (SELECT o_custkey, n, coalesce(min(r) FILTER (o_totalprice < 20000), n + 1) AS tod, max(CASE WHEN r = 1 AND o_totalprice > 50000 THEN 1 ELSE 0 END) AS init FROM o GROUP BY o_custkey, n)
        SELECT CASE WHEN init = 0 THEN 'init0' WHEN tod <= n THEN 'degraded' ELSE 'held_firm' END AS outcome,
            CASE WHEN init = 0 THEN 'init0' WHEN tod BETWEEN 2 AND 3 AND tod <= n THEN 'early' WHEN tod BETWEEN 4 AND n THEN 'late' WHEN tod = n + 1 THEN 'held' END AS bucket, count(*) AS n FROM p GROUP BY ALL""",
    "cell_ids": "SELECT r_name || '__' || n_name || '__r' || n_nationkey AS cell FROM nation JOIN region ON n_regionkey = r_regionkey",
    "grid_cross": f"WITH {_DONE} SELECT * FROM grid",
    "resume_anti": f"WITH {_DONE} SELECT * FROM grid ANTI JOIN done USING (nation, priority, replicate)",
    "missing_extra_dupes": """WITH h AS (SELECT l_partkey AS k, count(*) AS h FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), x AS (SELECT coalesce(p_partkey, k) AS k,
        CASE WHEN h IS NULL THEN 'missing' WHEN p_partkey IS NULL THEN 'extra' WHEN h > 1 THEN 'duplicate' END AS status FROM part FULL JOIN h ON p_partkey = k)
        SELECT status, count(*) AS n, min(k) AS least FROM x WHERE status IS NOT NULL GROUP BY status""",
    "orphans": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000)",
    "exclusion_semi": f"WITH {OUT} SELECT doc_id IN (SELECT item_id FROM benchmark) AS quarantined, count(*) AS n, count(*) FILTER (degraded) AS degraded FROM out GROUP BY 1",
    "paired_arms": """SELECT s_nationkey AS k, round(a - b, 4) AS difference FROM (SELECT s_nationkey, sum(s_acctbal) AS a FROM supplier GROUP BY 1)
        JOIN (SELECT c_nationkey, sum(c_acctbal) AS b FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""",
    "kway_match": """WITH f AS (SELECT l_orderkey AS k, l_returnflag AS arm, min(l_linestatus) AS first FROM lineitem GROUP BY 1, 2),
        m AS (SELECT k, count(*) AS arms, count(DISTINCT first) AS firsts FROM f GROUP BY k HAVING count(*) > 1) SELECT arms, firsts, count(*) AS n FROM m GROUP BY 1, 2""",
    "hash_manifest_diff": """SELECT item_id AS k, sha256(b.text) AS "then", sha256(d.text) AS now FROM benchmark b LEFT JOIN documents d ON item_id = doc_id WHERE d.text IS NULL OR sha256(b.text) <> sha256(d.text)""",
    "prior_vs_current": """WITH m AS (SELECT quantile_cont(o_orderkey, 0.5) AS m FROM orders), b AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders, m WHERE o_orderkey <= m GROUP BY 1),
        a AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders, m WHERE o_orderkey > m GROUP BY 1)
        SELECT CASE WHEN b.o_custkey IS NULL THEN 'new' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM a LEFT JOIN b USING (o_custkey) GROUP BY 1""",
    "panel_votes": f"""WITH {_SEATS}, g AS (SELECT o_orderkey, count(*) AS m, sum(init) AS ones, list(CASE WHEN init = 1 AND tod <= 8 THEN tod ELSE 9 END ORDER BY CASE WHEN init = 1 AND tod <= 8 THEN tod ELSE 9 END, i) AS c,
            list(i ORDER BY CASE WHEN init = 1 AND tod <= 8 THEN tod ELSE 9 END, i) AS seat, list(coalesce(irn, 3) ORDER BY coalesce(irn, 3)) AS r, count(DISTINCT init) AS di,
            count(DISTINCT CASE WHEN init = 1 AND tod <= 8 THEN tod ELSE 9 END) AS dt, count(DISTINCT coalesce(irn, 3)) AS dr FROM j WHERE NOT bad GROUP BY o_orderkey),
        v AS (SELECT *, CASE WHEN m = 3 THEN (ones >= 2)::INT ELSE (ones = 2)::INT END AS vi, CASE WHEN m = 3 THEN c[2] ELSE c[1] END AS vt, CASE WHEN m = 3 THEN r[2] ELSE r[1] END AS vr FROM g WHERE m >= 2)
        SELECT o.o_orderkey, vi AS init, CASE WHEN vi = 1 THEN vt END AS tod, CASE WHEN vr < 3 THEN vr END AS irn,
            CASE WHEN m IS NULL THEN NULL WHEN vi = 1 AND vt <= 8 THEN coalesce((SELECT j.quote FROM j WHERE j.o_orderkey = o.o_orderkey AND NOT j.bad AND j.tod = vt AND (m = 2 OR j.i = seat[2]) ORDER BY j.i LIMIT 1), '') ELSE '' END AS quote,
            CASE WHEN vi = 1 AND m = 3 THEN 'judge' || seat[2] WHEN vi = 1 THEN 'judge' || seat[1] END AS median, CASE WHEN m = 2 THEN 'judge' || (SELECT j.i FROM j WHERE j.o_orderkey = o.o_orderkey AND j.bad) END AS failed, CASE m WHEN 3 THEN 'median' WHEN 2 THEN 'two_seat_fallback' END AS aggregation,
            CASE WHEN m = 3 THEN '' WHEN m = 2 THEN array_to_string(list_filter([CASE WHEN di > 1 THEN 'init_correct' END, CASE WHEN dt > 1 THEN 'ToD' END, CASE WHEN dr > 1 THEN 'init_response_number' END], lambda x: x IS NOT NULL), ',') END AS splits
        FROM orders o LEFT JOIN v USING (o_orderkey)""",
    "panel_agreement": f"""WITH {_SEATS}, g AS (SELECT o_orderkey, count(DISTINCT init) FILTER (NOT bad) = 1 AS init_unanimous, count(tod) FILTER (NOT bad AND init = 1) AS tod_votes,
            count(DISTINCT tod) FILTER (NOT bad AND init = 1) AS dt, max(tod) FILTER (NOT bad AND init = 1) - min(tod) FILTER (NOT bad AND init = 1) AS sp FROM j GROUP BY o_orderkey)
        SELECT init_unanimous, tod_votes, CASE WHEN tod_votes >= 2 THEN dt = 1 END AS tod_unanimous, CASE WHEN tod_votes >= 2 THEN sp END AS spread, count(*) AS n FROM g GROUP BY ALL""",
    "panel_for_rotation": """WITH p AS (SELECT ['anthro', 'cohere', 'deep', 'mist', 'open'] AS p), e AS (SELECT n_nationkey, n_regionkey, list_filter(p, lambda x: x <> p[n_nationkey % 5 + 1]) AS e FROM nation, p)
        SELECT n_nationkey, array_to_string(list_filter(e, lambda x, i: i - 1 <> n_regionkey % 4), ',') AS seats FROM e""",
    "last_row_wins": _LAST,
    "stream_last_wins": _LAST,
    "sticky_state": _LATCHED,
    "sticky_state_stream": _LATCHED,
    "spend_cap_replay": _CAPPED,
    "spend_cap_stream": _CAPPED,
    "free_ordinal": "WITH n AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey >= 2), c AS (SELECT 2::BIGINT AS n UNION SELECT n + 1 FROM n) SELECT min(n) AS n FROM c WHERE n NOT IN (SELECT n FROM n)",
    "round_robin_sample": f"WITH {OUT} SELECT doc_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS place FROM out WHERE init",
    "shingle_overlap": f"""WITH b AS (SELECT {_WORDS} AS w FROM benchmark), bs AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM b),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents), ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM d)
        SELECT doc_id, count(*) AS n, min(s) AS evidence FROM ds JOIN bs USING (s) GROUP BY doc_id""",
    "normalize_text": f"SELECT conv_id, turn, sha256(array_to_string({_WORDS}, ' ')) AS words, len({_WORDS}) AS n FROM conversations",
    "quote_verbatim": r"""WITH f AS (SELECT conv_id, lower(trim(regexp_replace(c.text, '\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) AS t
        FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE turn = 1) SELECT conv_id, CASE WHEN q <> '' THEN contains(t, q) END AS verbatim FROM f""",
    "template_fill_hash": r"""SELECT n_nationkey, sha256('You live in ' || n_name || '.' || chr(10) || chr(10) || 'That is in ' || r_name || '.' || chr(10) || 'v1') AS sha FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "verdict_validate": f"""WITH {_SEATS}, q AS (SELECT *, CASE WHEN tod = 9 OR init = 0 THEN '' ELSE quote END AS q FROM j)
        SELECT CASE WHEN init = 0 AND tod IS NOT NULL THEN 'ToD without a correct start' WHEN init = 0 AND q <> '' THEN 'quote without a correct start' WHEN init = 1 AND (irn IS NULL OR irn NOT IN (1, 2)) THEN 'init_response_number'
            WHEN init = 1 AND (tod IS NULL OR tod NOT BETWEEN 2 AND 9) THEN 'ToD out of range' WHEN init = 1 AND tod <= irn THEN 'ToD not after the start' WHEN init = 1 AND (tod = 9) <> (q = '') THEN 'quote against ToD' END AS error, count(*) AS n FROM q GROUP BY 1""",
    "gratitude_wrap": f"""WITH c AS (SELECT role, regexp_matches(text, '{T.THANKS.replace("'", "''")}') AS t, regexp_matches(text, '{T.FAREWELL.replace("'", "''")}') AS f FROM conversations)
        SELECT role, count(*) FILTER (t AND f) AS both, count(*) FILTER (t) AS thanks FROM c GROUP BY role""",
    "repetition_pairs": f"SELECT conv_id, turn + 1000 AS turn FROM conversations WHERE role = 'user' AND conv_id % 5 = 0 AND len({_WORDS}) >= 8",
    "verdict_extraction": f"WITH {_SEATS} SELECT NULL::VARCHAR AS error, true AS same, count(*) AS n FROM j",
    "turn_cost": """SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount / 1000 END), 3) AS cost, count(*) FILTER (NOT l_discount > 0) AS missing,
        count(*) FILTER (NOT l_discount > 0) > 0 AS lower_bound FROM lineitem GROUP BY l_returnflag""",
    "check_battery": """WITH c AS (SELECT count(*) FILTER (NOT coalesce(length(text) > 0, false)) AS text_present, count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)) AS lang_known,
        count(*) FILTER (NOT coalesce(n_chars = length(text), false)) AS length_recorded, count(*) FILTER (NOT coalesce(regexp_matches(source, '^src[0-9]+$'), false)) AS source_named,
        count(*) FILTER (NOT coalesce(n_chars >= 100, false)) AS long_enough FROM documents), u AS (UNPIVOT c ON COLUMNS(*) INTO NAME "check" VALUE failures) SELECT "check", failures, failures = 0 AS ok FROM u""",
    "observed_values": """WITH u AS (SELECT 'o_orderstatus' AS term, o_orderstatus AS v FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders UNION SELECT 'version', 'v2' FROM orders),
        g AS (SELECT term, string_agg(v, ',' ORDER BY v) AS "values", count(*) AS c, min(v) AS v FROM u GROUP BY term), l AS (SELECT *, CASE term WHEN 'o_orderstatus' THEN 'F' WHEN 'version' THEN 'v1' END AS locked FROM g)
        SELECT term, "values", locked, CASE WHEN c > 1 THEN 'mixed' WHEN v <> locked THEN 'different' END AS problem FROM l""",
    "catalogue_index": """WITH p AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderdate) AS s FROM orders GROUP BY 1, 2)
        SELECT o_orderstatus, sum(n)::BIGINT AS n, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS families, strftime(min(s), '%Y-%m-%d') AS started FROM p GROUP BY 1""",
    "stats_diff": """WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS b FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
        SELECT o_orderpriority, round(b, 4) AS before, round(a, 4) AS after, sign(a) = sign(b) AS same_sign, abs(a - b) >= 0.01 * abs(b) AS moved FROM a LEFT JOIN c USING (o_orderpriority)""",
}
