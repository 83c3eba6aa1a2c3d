"""Prefix trie of conversations, merged from partial tries.

A node is a sequence of first turns. Its key is the exclusive-or, 128 bits wide, of a hash of each turn (position, role, text): it can
be summed over any pieces of a conversation, so a conversation of any length is worked on in blocks, and it says what
the parent's key is. Turns are dealt out by ranges of (conversation, turn), so that a very long conversation fills many tasks; what is
known of its earlier blocks (rows, keys) is a row a block.

Every partition makes a table of the nodes of its own rows, with sums of members (a partial trie); tables of ``FAN`` partitions are
merged at a time by key, until one is left. Ends are merged likewise, as lists of the conversations of one
``CHUNK`` of ids; a node's digest is fed with its chunks in their order, one at a time.

The rollup takes nodes with two members or more. Others are chains of a single conversation: one leaf, and nothing saved. Each
round adds to a node what the nodes 2^k below it have gathered, so the rounds are the logarithm of the shared depth.

Defined results: a null role or text is an empty one; turns of a conversation go by turn (null first), then role, then text; repeated rows are turns
like others; rows without a conv_id are dropped. ``conv_id % every`` has the sign of conv_id. An empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import bound_batches, partitions, stored

#: Conversations share the first turns of the one at the last multiple of ``EVERY``, under ``HEADS`` of them.
EVERY = 20
HEADS = 4
#: Partial tries that are merged at a time.
FAN = 32
#: Ids (as a power of two) whose conversations' ends go in one list.
CHUNK = 14
_KEY = ["k1", "k2"]


def _hashes(*columns: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, row, t1, t2, words) and blocks (conv_id, block, first_row, before, turns).

    ``row - first_row + before`` is a turn's number in its conversation, ``turns`` the number of turns of all.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    order = ["conv_id", "turn", "role", "text", "given"]  # given: equal rows aren't one key
    dealt = turns.withColumn("given", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    t1, t2 = _hashes("role", "text")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    place = F.monotonically_increasing_id()  # the partition, and the row in it
    rows = dealt.select("conv_id", F.shiftright(place, 33).alias("block"), place.alias("row"), t1.alias("t1"), t2.alias("t2"), words.alias("words"))
    rows = stored(rows, "turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    along = Window.partitionBy("conv_id").orderBy("block")
    earlier = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("conv_id", "block", "first_row", earlier.alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    return rows, blocks


def rebuilt(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, block, at, t1, t2, words), and conversations (conv_id, length)."""
    rows, blocks = numbered_turns(conversations)
    own = blocks.groupBy("conv_id").agg(F.max("turns").alias("n"))
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long")
    convs = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "skip": taken}).join(base, "base", "left")
    convs = convs.withColumn("head", F.least("skip", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "skip", "head", (F.col("head") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("length")), "conversations")
    number = F.col("row") - F.col("first_row") + F.col("before")
    facts = blocks.join(convs.select("conv_id", "skip", "head"), "conv_id")
    numbered = rows.join(facts, ["conv_id", "block"]).withColumn("i", number)
    kept = numbered.where("i >= skip").select("conv_id", "block", (F.col("i") - F.col("skip") + F.col("head")).alias("at"), "t1", "t2", "words")
    first = blocks.where((F.col("conv_id") % every == 0) & (F.col("before") < heads)).select("conv_id", "block", "first_row", "before")
    lent = rows.join(first, ["conv_id", "block"]).withColumn("at", number).where(F.col("at") < heads).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "words")
    taken_over = convs.where("head > 0").join(lent, "base").where("at < head").select("conv_id", F.lit(-1).cast("long").alias("block"), "at", "t1", "t2", "words")
    return kept.union(taken_over), convs.select("conv_id", "length")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth: conv_id, depth, key, parent's key, words of the last turn, whether it ends there."""
    turns = turns.withColumns(dict(zip(("x1", "x2"), _hashes("at", "t1", "t2"), strict=True))).drop("t1", "t2")
    in_block = Window.partitionBy("conv_id", "block").orderBy("at")
    running = turns.withColumns({f"r{i}": F.bit_xor(f"x{i}").over(in_block) for i in (1, 2)})
    whole = turns.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"e{i}") for i in (1, 2)])
    whole = whole.join(convs, "conv_id")
    keys = {f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"e{i}")) for i in (1, 2)}
    rows = running.join(whole, ["conv_id", "block"]).withColumns(keys)
    depth = F.col("at") + 1
    deep = rows.select("conv_id", depth.alias("depth"), *_KEY, *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "words", (depth == F.col("length")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"), (F.col("length") == 0).alias("ends"))
    return deep.union(roots)


def merged(rows: DataFrame, by: list[str], first: list[Column], again: list[Column], fan: int = FAN) -> DataFrame:
    """``rows`` grouped ``by`` some columns: within partitions first, then the tables of ``fan`` of them at a time."""
    part, left = F.spark_partition_id(), partitions(rows.sparkSession)
    table = rows.withColumn("part", F.pmod(part, F.lit(left)))
    aggregates = first
    while True:
        left = -(-left // fan)
        table = table.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy(*by, "part").agg(*aggregates)
        aggregates = again
        if left == 1:
            return table.drop("part")


def _merged_nodes(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """Key, depth, parent's key, words, n_convs and conv_id (the smallest member) of every node."""
    same = [F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "words")]
    return merged(rows, _KEY, [*same, F.count("*").alias("n_convs")], [*same, F.sum("n_convs").alias("n_convs")], fan)


def ends_digests(rows: DataFrame, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """Key and ends_sha256 of the nodes where conversations end."""
    ends = rows.where("ends").withColumn("chunk", F.shiftright("conv_id", chunk))
    # a chunk's lists hold 2^chunk ids at most
    lists = merged(ends, [*_KEY, "chunk"], [F.collect_list("conv_id").alias("ids")], [F.flatten(F.collect_list("ids")).alias("ids")], fan)
    written = F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",")
    ordered = lists.select(*_KEY, "chunk", written.alias("ids")).repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield _digests(done)
        if key:
            yield _digests([(*key, state.hexdigest())])

    bound_batches(rows.sparkSession)
    return ordered.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(range(3), (pa.int64(), pa.int64(), pa.string()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in columns], ["k1", "k2", "ends_sha256"])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Key, n_leaves and saved_tokens of the nodes with two members or more.

    nodes: key, parent's key, depth, words, n_convs, n_children and ``chains``, the number of children with one member.
    """
    shared = nodes.where("n_convs > 1")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("chains")).cast("long")
    table = stored(shared.select(*_KEY, "p1", "p2", "depth", leaves.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "rollup")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    table = table.drop("depth")
    for _ in range(int(deepest).bit_length()):
        gains = table.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        gained = table.join(gains.withColumnsRenamed({"p1": "k1", "p2": "k2"}), _KEY, "left")
        above = table.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        table = stored(gained.join(above, ["p1", "p2"], "left").select(*_KEY, F.col("q1").alias("p1"), F.col("q2").alias("p2"), *sums), "rollup")
    return table.select(*_KEY, "n_leaves", "saved_tokens")


def build(conversations: DataFrame, every: int = EVERY, heads: int = HEADS, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(paths(*rebuilt(conversations, every, heads)), "paths")
    nodes = stored(_merged_nodes(rows, fan), "nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains"))
    nodes = nodes.join(children.withColumnsRenamed({"p1": "k1", "p2": "k2"}), _KEY, "left").fillna(0, ["n_children", "chains"])
    nodes = stored(nodes, "nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(rolled_up(nodes), _KEY, "left").join(ends_digests(rows, fan, chunk), _KEY, "left").join(parents, ["p1", "p2"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
