"""Document fingerprints of closed syncmers, in Spark's own functions alone.

Of a text's UTF-8 bytes every ``k`` in a row are a k-mer. Its inner substrings of ``s`` bytes are compared by hash; where
the least of them (or one as small) is the first or the last, the k-mer is a closed syncmer: an anchor. That
depends on the k-mer's own bytes only, so whatever stands around a passage, its anchors are the same, and among any
``k - s`` k-mers in a row there is one at least. A fingerprint holds an anchor's hash (48 bits) and its position, for the
``SKETCH`` anchors of the whole text with the smallest hashes, the first of each hash.

Two fingerprints are compared below the smaller of the two largest hashes that they hold (all, where a fingerprint
holds all of its text's anchors), which makes their anchors samples by the same rule. Anchors of equal hash match if another pair of
equal hash lies equally far apart in the two texts; if there is none, one pair counts. The likeness is twice the number
of matches over the number of both texts' anchors: a text that shares two thirds with another of its length has 0.67.

Because anchors need no context, the edited text's fingerprint is put together: from the anchors of what is left of its own text, of
the part of the next document, and of the few k-mers over the seam. The texts are cut into ``CHUNK`` bytes within
an expression, so that a long text takes no more memory than its bytes and some anchors for each chunk.

Documents meet the next one by ranges of the descending doc_id (nulls last, then by a hash of the text), one exchange of the texts; the
first row of each range is copied to the range before.

Defined results: a null text is an empty one, with an empty fingerprint; two empty fingerprints have a likeness of 1, an empty and
another 0. A text without an anchor (of under ``k`` bytes, or a little more) has one: the hash of all its bytes, at 0. Rows that share a
doc_id are put in order by a hash of their texts; a single row is its own next document. An empty table gives no rows, and other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import partitions

K = 12
S = 4
SKETCH = 64
CHUNK = 4096
#: Ranges of documents for each partition, so that ranges dealt out by hash even out.
RANGES = 4


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hash(value: str) -> str:
    return f"shiftrightunsigned(xxhash64({value}), 16)"


def _anchors(chunk: str, base: str, k: int, s: int) -> str:
    """SQL for the array of (h, p) of the closed syncmers of a binary value that begins at ``base``."""
    last = k - s
    first_least = " AND ".join(f"v <= h[i + {j}]" for j in range(1, last))
    last_least = " AND ".join(f"h[i + {last}] <= h[i + {j}]" for j in range(last - 1, 0, -1))
    # where the last is greater than the first, only the first can be the least, and where both are equal one test serves for both
    closed = f"i + {last} < size(h) AND IF(v > h[i + {last}], {last_least}, {first_least})"
    marks = f"array_compact(transform(h, (v, i) -> IF({closed}, i, NULL)))"
    found = f"transform({marks}, i -> struct({_hash(f'substring(x, i + 1, {k})')} AS h, {base} + i AS p))"
    inner = f"transform(sequence(1, length(x) - {s - 1}), i -> xxhash64(substring(x, i, {s})))"
    return _let(chunk, "x", f"IF(length(x) >= {k}, {_let(inner, 'h', found)}, CAST(array() AS array<struct<h: bigint, p: int>>))")


def _sorted(anchors: str) -> str:
    """SQL for the anchors by hash, the first of each hash."""
    return _let(f"sort_array({anchors})", "a", "filter(a, (y, j) -> j = 0 OR y.h <> a[j - 1].h)")


def _least(anchors: str, sketch: int) -> str:
    """SQL for the anchors with the smallest hashes, the first of each hash."""
    return f"slice({_sorted(anchors)}, 1, {sketch})"


def sketches(data: str, ends: list[str | None], k: int = K, s: int = S, sketch: int = SKETCH, chunk: int = CHUNK) -> F.Column:
    """For each of ``ends`` (columns, in bytes; None: all) the least anchors of the binary column ``data`` up to there, in one pass over it."""
    # the first anchor of a hash is the last to go when a text is cut
    begin, stop = f"{chunk} * c", f"{chunk} * c + {chunk + k - 1}"
    cut = lambda end: f"CASE WHEN {stop} <= {end} THEN b WHEN {begin} >= {end} THEN slice(b, 1, 0) ELSE filter(b, y -> y.p + {k} <= {end}) END"
    parts = ", ".join(f"slice({'b' if end is None else cut(end)}, 1, {sketch}) AS e{n}" for n, end in enumerate(ends))
    found = _sorted(_anchors(f"substring({data}, {chunk} * c + 1, {chunk + k - 1})", f"{chunk} * c", k, s))
    each = _let(found, "b", f"struct({parts})")
    chunks = f"transform(sequence(0, greatest(length({data}) - {k}, 0) DIV {chunk}), c -> {each})"
    whole = ", ".join(f"IF(size(w) = 1, w[0].e{n}, {_least(f'flatten(w.e{n})', sketch)}) AS e{n}" for n in range(len(ends)))
    return F.expr(_let(chunks, "w", f"struct({whole})"))


def _or_all(anchors: str, data: str) -> F.Column:
    """The anchors, or that of the whole text where there is none."""
    none = "CAST(array() AS array<struct<h: bigint, p: int>>)"
    return F.expr(f"CASE WHEN size({anchors}) > 0 THEN {anchors} WHEN length({data}) = 0 THEN {none} ELSE array(struct({_hash(data)} AS h, 0 AS p)) END")


def likeness(one: str, other: str, sketch: int = SKETCH) -> F.Column:
    """The likeness of two columns of least anchors."""
    bound = lambda c: f"IF(size({c}) < {sketch}, 281474976710655, element_at({c}, -1).h)"  # noqa: E731  the largest hash
    # both are in the order of their hashes, and so are the two lists of what they share
    shared = lambda c: f"filter({c}, y -> array_contains(g, y.h))"
    pairs = f"IF(size(g) = 0, CAST(array() AS array<int>), zip_with({shared('a')}, {shared('b')}, (y, z) -> y.p - z.p))"
    offsets = _let("array_intersect(a.h, b.h)", "g", f"sort_array({pairs})")
    on_line = "size(filter(d, (y, j) -> y <=> get(d, j - 1) OR y <=> get(d, j + 1)))"
    matches = _let(offsets, "d", f"greatest({on_line}, least(size(d), 1))")
    share = f"CASE WHEN a = b THEN 1D ELSE 2D * {matches} / (size(a) + size(b)) END"
    within = lambda c: f"filter({c}, y -> y.h <= m)"
    return F.expr(_let(f"least({bound(one)}, {bound(other)})", "m", _let(within(one), "a", _let(within(other), "b", share))))


def written(anchors: str) -> F.Column:
    """A fingerprint as text: ``hash@position`` in hexadecimal, by ascending hash."""
    return F.expr(f"array_join(transform({anchors}, y -> concat(lower(lpad(hex(y.h), 12, '0')), '@', lower(hex(y.p)))), ' ')")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("data", F.col("text").cast("binary"))
    found = texts.withColumn("found", sketches("data", [None], k, s, sketch)).withColumn("own", _or_all("found.e0", "data"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), written("own").alias("fingerprint"))


def _with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``order`` and the number of its range, and of each range the first row once more, marked ``guest``, in the range before.

    A pass over doc_ids and hashes alone finds where ranges begin: a few rows for each partition.
    """
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), F.xxhash64("text").alias("h"))
    n = RANGES * partitions(docs.sparkSession)
    keys = docs.select(order.alias("order")).repartitionByRange(n, "order")
    firsts = sorted(tuple(r["first"]) for r in keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min("order").alias("first")).collect())
    if not firsts:
        return docs.select("*", order.alias("order"), F.lit(0).alias("range"), F.lit(False).alias("guest"))
    begins = F.array(*[F.struct(F.lit(a).alias("absent"), F.lit(d).cast("long").alias("down"), F.lit(h).cast("long").alias("h")) for a, d, h in firsts])
    step = lambda lo, e: lo + F.call_function("shiftleft", F.lit(1), e)
    fits = lambda lo, e: (step(lo, e) <= len(firsts)) & (F.col("order") >= F.get(begins, step(lo, e) - 1))
    # how many ranges begin at or before this row, by bisection
    number = F.aggregate(F.sequence(F.lit(len(firsts).bit_length() - 1), F.lit(0), F.lit(-1)), F.lit(0), lambda lo, e: F.when(fits(lo, e), step(lo, e)).otherwise(lo))
    own = docs.select("*", order.alias("order")).select("*", number.alias("range"))
    guests = own.where(F.col("order") == F.get(begins, F.col("range") - 1)).dropDuplicates(["order"])
    before = F.when(F.col("range") == 1, len(firsts)).otherwise(F.col("range") - 1).alias("range")
    return own.select("*", F.lit(False).alias("guest")).union(guests.select(*[c for c in own.columns if c != "range"], before, F.lit(True)))


def edited_pairs(docs: DataFrame, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """Every text and its edited text (the last third from the next document) with their fingerprints and likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _with_ranges(texts).repartition("range").withColumn("n_chars", F.length("text"))
    along = Window.partitionBy("range").orderBy("guest", "order")
    kept = F.expr("left(text, n_chars - n_chars DIV 3)")
    lent = F.expr("left(text, coalesce(borrower, 0) DIV 3)")  # what the document before takes
    rows = dealt.withColumn("borrower", F.lag("n_chars").over(along)).withColumns({"data": F.col("text").cast("binary"), "kept": kept.cast("binary"), "lent": lent.cast("binary")})
    rows = rows.withColumn("found", sketches("data", [None, "length(kept)", "length(lent)"], k, s, sketch)).withColumn("own", _or_all("found.e0", "data"))
    rows = rows.select("doc_id", "n_chars", "range", "guest", "order", "kept", "lent", "own", F.col("found.e1").alias("in_kept"), F.col("found.e2").alias("in_lent"))
    after = {f"next_{c}": F.lead(c).over(along) for c in ("lent", "own", "in_lent")}
    rows = rows.withColumns(after).where("not guest").withColumn("edited", F.concat("kept", "next_lent"))
    begin = f"greatest(length(kept) - {k - 1}, 0)"
    seam = _anchors(f"substring(edited, {begin} + 1, length(kept) + {k - 1} - {begin})", begin, k, s)
    shifted = "transform(next_in_lent, y -> struct(y.h AS h, y.p + length(kept) AS p))"
    rows = rows.withColumn("found", F.expr(_least(f"concat(in_kept, {shifted}, {seam})", sketch))).withColumn("changed", _or_all("found", "edited"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written("own").alias("fingerprint"), written("changed").alias("edited_fingerprint"),
        likeness("own", "changed", sketch).alias("near_edited"), likeness("own", "next_own", sketch).alias("near_next"),
    )
