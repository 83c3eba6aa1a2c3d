"""Document log-likelihood under a gated recurrent language model.

Counts. The tokens of every training document are counted (words as 64-bit hashes), and the table of
counts grows with the corpus. The ``HEAD`` commonest tokens are divided into classes by frequency; the
other tokens form two more classes, in which a token's probability is its smoothed share of the class.

Network. A gated recurrent unit reads the tokens (those outside the head as their class), and its state
gives a softmax over classes and, within head classes, a softmax over their tokens. It starts at the
unigram distribution and is trained in numpy by truncated back-propagation on every training document: rounds of
data-parallel passes over disjoint parts of the documents, whose parameters are averaged with the number of tokens as
weights. A document's round and shard follow from its doc_id and the number of tokens in the corpus, so the network
doesn't depend on how the table is stored or partitioned.

Scores. Texts are encoded once; training and scoring read their ids. Whole documents are scored in windows, with the state
carried from one to the next. Counts of the ``KNOWN`` commonest tokens travel with the model; rarer tokens
are joined with the table of counts.

Defined results: a null or empty text is its end token alone; rows that share a doc_id are one document,
whose figures are the sums over its rows; a missing doc_id is hashed as empty text; without training
tokens every token has the probability of an unseen one; an empty table gives no rows; other columns are
left alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogscope.llm.common import Memo, over_texts, run_bounds, slices, stored, utf8

HEAD = 2048
CLASS_SIZE = 64
KNOWN = 200_000
HIDDEN = 16
WINDOW = 16
LANES = 1024
#: In training a text is cut into pieces of so many tokens, each from a state of zeros, so that lanes are full.
PIECE = 256
#: Tokens of a pool, in which texts of like lengths are put together.
POOL, SCORE_POOL = 1_000_000, 4_000_000
ROUNDS = 3
#: Tokens in one shard, over all rounds: a copy of the network is trained on each and averaged with the others.
SHARD_TOKENS = 4_000_000
RATE = 0.01
SMOOTH = 0.1
END = b""  # words are never empty


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n): the hash of each token of the training documents and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            counts: Counter = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if not held_out(doc_id):
                    counts.update(text.lower().split())
                    counts[END] += 1
            if counts:
                keys = np.fromiter(map(word_hash, counts), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(counts.values()), pa.int64())], ["h", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lexicon:
    """Places of the commonest tokens: the head first, each with its count; classes; totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.place = {int(h): i for i, h in enumerate(hashes)}
        self.counts, self.total, self.distinct = counts, total, distinct
        self.head = min(HEAD, len(hashes))
        self.classes = -(-self.head // CLASS_SIZE)  # and two more: known and rare tokens outside the head
        known, rare = int(counts[self.head :].sum()), total - int(counts.sum())
        self.norm = total + SMOOTH * (distinct + 1)
        mass = [known + SMOOTH * (len(hashes) - self.head), rare + SMOOTH * (distinct - len(hashes) + 1)]
        #: log10 of what turns the unigram share of a token into its share of the known or rare class
        self.shift = [float(np.log10(self.norm / m)) if m > 0 else 0.0 for m in mass]
        self.mass = np.array([*(counts[k : min(k + CLASS_SIZE, self.head)].sum() for k in range(0, self.head, CLASS_SIZE)), *mass], float)

    def encoder(self) -> Memo:
        """Token to its place, or the number of known tokens for a rare one."""
        get, rare = self.place.get, len(self.place)
        return Memo(lambda word: get(word_hash(word), rare), 100_000)


def unit(lexicon: Lexicon) -> dict[str, np.ndarray]:
    """The network before training: the unigram distribution whatever the state."""
    rng = np.random.default_rng(0)
    inputs = lexicon.classes * CLASS_SIZE + 3  # head (padded to full classes, as targets are), known, rare, beginning
    inner = np.full((lexicon.classes, CLASS_SIZE), -30.0)
    for k in range(lexicon.classes):
        own = lexicon.counts[k * CLASS_SIZE : min((k + 1) * CLASS_SIZE, lexicon.head)]
        inner[k, : len(own)] = np.log(np.maximum(own, 0.5))
    p = {
        "x": rng.normal(0, 0.3, (3 * HIDDEN, inputs)),
        "u": rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)),
        "c": np.zeros((lexicon.classes + 2, HIDDEN)),
        "cb": np.log(np.maximum(lexicon.mass, 0.5)),
        "w": np.zeros((lexicon.classes, CLASS_SIZE, HIDDEN)),
        "wb": inner,
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _steps(p: dict, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States after each step of a window, and what back-propagation needs; arrays are [feature, time, lane]."""
    span, lanes, H = *inputs.shape, HIDDEN
    x = np.take(p["x"], inputs.ravel(), axis=1).reshape(3 * H, span, lanes)
    states, gates, inner, new = (np.empty((n, span, lanes), p["u"].dtype) for n in (H, 2 * H, H, H))
    first = h
    for t in range(span):
        g = p["u"] @ h
        rz = g[: 2 * H]
        rz += x[: 2 * H, t]
        gates[:, t] = _sigmoid(rz)
        inner[:, t] = g[2 * H :]
        n = gates[:H, t] * g[2 * H :]
        n += x[2 * H :, t]
        np.tanh(n, out=n)
        new[:, t] = n
        h = h - n
        h *= gates[H:, t]
        h += n
        states[:, t] = h
    return states, (first, states, gates, inner, new)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def _outputs(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target (class, and place within head classes); adds gradients. ``states``: [feature, token]."""
    heads = len(p["w"])
    klass = np.minimum(targets // CLASS_SIZE, heads)
    klass[targets >= heads * CLASS_SIZE] = targets[targets >= heads * CLASS_SIZE] - heads * (CLASS_SIZE - 1)
    order = np.argsort(klass, kind="stable")
    states, targets, klass = np.take(states, order, axis=1), targets[order], klass[order]
    ends, at = np.searchsorted(klass, np.arange(heads + 1)), np.arange(len(targets))
    q = p["c"] @ states
    q += p["cb"][:, None]
    _softmax(q)
    logp = np.log(np.maximum(q[klass, at], 1e-30))
    back = None
    if grads is not None:
        q[klass, at] -= 1
        grads["c"] += q @ states.T
        grads["cb"] += q.sum(1)
        back = p["c"].T @ q
    for k in range(heads):
        own = slice(ends[k], ends[k + 1])
        if ends[k] < ends[k + 1]:
            s, place = states[:, own], targets[own] - k * CLASS_SIZE
            q = p["w"][k] @ s
            q += p["wb"][k][:, None]
            _softmax(q)
            at = np.arange(len(place))
            logp[own] += np.log(np.maximum(q[place, at], 1e-30))
            if grads is not None:
                q[place, at] -= 1
                grads["w"][k] += q @ s.T
                grads["wb"][k] += q.sum(1)
                back[:, own] += p["w"][k].T @ q
    out = np.empty_like(logp)
    out[order] = logp
    if back is not None:
        unordered = np.empty_like(back)
        unordered[:, order] = back
        back = unordered
    return out, back


def _back(p: dict, inputs: np.ndarray, kept: tuple, back: np.ndarray, grads: dict) -> None:
    first, states, gates, inner, new = kept
    H, lanes = HIDDEN, inputs.shape[1]
    dh, da = np.zeros((H, lanes), back.dtype), np.empty((3 * H, lanes), back.dtype)
    dx = np.empty((3 * H, *inputs.shape), back.dtype)
    for t in range(len(inputs) - 1, -1, -1):
        h = states[:, t - 1] if t else first
        r, z, g, n = gates[:H, t], gates[H:, t], inner[:, t], new[:, t]
        dh += back[:, t]
        dn = dh * (1 - z)
        dn *= 1 - n * n
        da[2 * H :] = dn * r
        da[:H] = da[2 * H :] * g * (1 - r)
        da[H : 2 * H] = dh * (h - n) * z * (1 - z)
        grads["u"] += da @ h.T
        dh *= z
        dh += p["u"].T @ da
        dx[: 2 * H, t] = da[: 2 * H]
        dx[2 * H :, t] = dn
    flat = inputs.ravel()
    order = np.argsort(flat, kind="stable")
    bounds = run_bounds(flat[order])[:-1]
    grads["x"][:, flat[order][bounds]] += np.add.reduceat(np.take(dx.reshape(3 * H, -1), order, axis=1), bounds, axis=1)


def windows(texts: list[np.ndarray], begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Windows over groups of texts of like lengths: (texts, inputs, targets, real, first), time first.

    A window holds the texts of its group that go on; few long texts get longer windows.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for lo in range(0, len(order), LANES):
        group = order[lo : lo + LANES]
        sizes = np.array([len(texts[i]) for i in group])
        at = 0
        # the group's texts one after the other, with their beginnings as places
        flat = np.concatenate([texts[i] for i in group]).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        while at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, "left"))
            span = min(int(np.clip(4096 // live, WINDOW, 256)), int(sizes[0]) - at)
            steps = at + np.arange(span)[:, None]
            real = steps < sizes[None, :live]
            place = np.where(real, begins[None, :live] + steps, 0)
            targets = flat[place]
            inputs = flat[np.maximum(place - 1, 0)]
            if at == 0:
                inputs[0] = begin
            yield group[:live], inputs, targets, real, at == 0
            at += span


def score_texts(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the classes and head tokens of each text."""
    total, begin, h = np.zeros(len(texts)), p["x"].shape[1] - 1, None
    for which, inputs, targets, real, first in windows(texts, begin):
        h = np.zeros((HIDDEN, len(which)), np.float32) if first else h[:, : len(which)]
        states, _ = _steps(p, inputs, h)
        h = states[:, -1]
        lane = np.broadcast_to(np.arange(len(which)), real.shape)[real]
        logp, _ = _outputs(p, states[:, real], targets[real], None)
        total[which] += np.bincount(lane, weights=logp, minlength=len(which))
    return total / np.log(10)


def train_texts(p: dict, texts: list[np.ndarray], moments: dict, rate: float = RATE) -> None:
    """One pass of truncated back-propagation (Adam), in place."""
    begin, h = p["x"].shape[1] - 1, None
    for which, inputs, targets, real, first in windows(texts, begin):
        h = np.zeros((HIDDEN, len(which)), np.float32) if first else h[:, : len(which)]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        states, kept = _steps(p, inputs, h)
        h = states[:, -1]
        _, back = _outputs(p, states[:, real], targets[real], grads)
        full = np.zeros_like(states)
        full[:, real] = back
        _back(p, inputs, kept, full, grads)
        moments["t"] += 1
        # few tokens make a small step
        size = np.float32(rate * min(1.0, real.sum() / 2048) * np.sqrt(1 - 0.99 ** moments["t"]) / (1 - 0.9 ** moments["t"]))
        for k, g in grads.items():
            g /= np.float32(max(1, real.sum()))
            m, v = moments[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            v += np.float32(0.01) * g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= size
            p[k] -= g


def _as_inputs(lexicon: Lexicon, places: np.ndarray) -> np.ndarray:
    """Places to what the network reads and predicts: head tokens, then the known and the rare class."""
    head, known = lexicon.head, len(lexicon.place)
    return np.where(places < head, places, np.where(places < known, head, head + 1))


def _padded(lexicon: Lexicon, ids: np.ndarray) -> np.ndarray:
    """Targets count from full classes: the two classes outside the head come after them."""
    return np.where(ids >= lexicon.head, ids - lexicon.head + lexicon.classes * CLASS_SIZE, ids)


def encoded(docs: DataFrame, lexicon: Lexicon, rounds: int) -> DataFrame:
    """One row for each text (h is null): doc_id, its tokens n, n_known, base and ids for the network, the part of its
    score that doesn't need the network, its training round (null if held out); and one for each rare word in it."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ["h", "n", "doc_id", "n_known", "base", "score", "round", "ids"]

    def each():
        lex = shared.value
        encode, rare = lex.encoder().__getitem__, len(lex.place)
        base = np.append(np.log10((lex.counts + SMOOTH) / lex.norm), 0.0)
        shifts = np.zeros(rare + 1)
        shifts[: lex.head] = -base[: lex.head]  # the network has all of a head token's probability
        shifts[lex.head : rare], shifts[rare] = lex.shift[0], lex.shift[1]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc_ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            split = [[*text.lower().split(), END] for text in texts]
            sizes = np.array([len(x) for x in split], np.int64)
            places = np.fromiter(map(encode, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            known, moved, n_known = (np.add.reduceat(x, first) for x in (base[places], shifts[places], (places < rare).astype(np.int64)))
            words, owner = list(itertools.chain.from_iterable(split)), np.repeat(np.arange(len(texts)), sizes)
            at = np.flatnonzero(places == rare)
            tail = Counter(zip(owner[at].tolist(), map(words.__getitem__, at.tolist()), strict=True))
            ids = _padded(lex, _as_inputs(lex, places)).astype("<u2")
            pieces = [x.tobytes() for x in np.split(ids, first[1:])]
            turns = [None if held_out(i) else xxhash.xxh3_64_intdigest(str(i), seed=11) % rounds for i in doc_ids]
            n, zeros = len(texts), np.zeros(len(tail))
            own = batch.column(0)
            columns = [
                (pa.nulls(n, pa.int64()), pa.array([word_hash(w) for _, w in tail], pa.int64())),
                (pa.array(sizes), pa.array(list(tail.values()), pa.int64())),
                (own, own.take(pa.array([i for i, _ in tail], pa.int64()))),
                (pa.array(n_known), pa.array(zeros.astype(np.int64))),
                (pa.array(known), pa.array(zeros)),
                (pa.array(known + moved), pa.array(zeros)),
                (pa.array(turns, pa.int32()), pa.nulls(len(tail), pa.int32())),
                (pa.array(pieces, pa.binary()), pa.nulls(len(tail), pa.binary())),
            ]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names)

        return work

    return over_texts(docs, ["doc_id", "text"], "h long, n long, doc_id long, n_known long, base double, score double, round int, ids binary", each)


def _pooled(rows: Iterator[tuple], pool: int = POOL) -> Iterator[list]:
    """Lists of rows (the last item: ids) with about so many tokens."""
    held, tokens = [], 0
    for row in rows:
        held.append(row)
        tokens += len(row[-1])
        if tokens >= pool:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def train(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Averaged parameters after the rounds over all training documents; ``texts``: doc_id, n, round, ids."""
    spark = texts.sparkSession
    shards = max(1, round(lexicon.total / SHARD_TOKENS))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int").alias("shard")
    p = unit(lexicon)
    for k in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            rows = ((s, np.frombuffer(ids.as_buffer(), "<u2")) for batch in batches for s, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for one, group in itertools.groupby(rows, key=lambda row: row[0]):
                own = {x: v.copy() for x, v in now.value.items()}
                moments, tokens = {x: (np.zeros_like(v), np.zeros_like(v)) for x, v in own.items()} | {"t": 0}, 0
                for held in _pooled(group):
                    train_texts(own, [ids[at : at + PIECE] for _, ids in held for at in range(0, len(ids), PIECE)], moments)
                    tokens += sum(len(ids) for _, ids in held)
                flat = np.concatenate([own[x].ravel() for x in sorted(own)]).astype(np.float64) * tokens
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "tokens", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, tokens, total = None, 0, None
            for batch in batches:
                for one, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first, tokens = one if first is None else first, tokens + n
                    total = np.frombuffer(raw).copy() if total is None else total + np.frombuffer(raw)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["shard", "tokens", "sums"])

        schema = "shard int, tokens long, sums binary"
        mine = texts.where(F.col("round") == k).select(shard, "doc_id", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
        parts = mine.select("shard", "ids").mapInArrow(run, schema)
        # one sum of the size of the network for each of a few partitions, in the order of shards, then theirs on the driver
        sums = parts.repartition(8, F.col("shard") % 8).sortWithinPartitions("shard").mapInArrow(added, schema).collect()
        now.unpersist()
        if not sums:
            continue
        sums.sort(key=lambda r: r["shard"])
        flat = sum(np.frombuffer(r["sums"]) for r in sums) / sum(r["tokens"] for r in sums)
        at, new = 0, {}
        for x in sorted(p):
            new[x] = flat[at : at + p[x].size].reshape(p[x].shape).astype(np.float32)
            at += p[x].size
        p = new
    return p


def lexicon_of(counts: DataFrame, known: int = KNOWN) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(known).toArrow()  # known rows at most
    return Lexicon(top["h"].to_numpy(), top["n"].to_numpy(), int(total["n"]), int(total["v"]))


def score(docs: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = stored(token_counts(docs), "token-counts")
    lexicon = lexicon_of(counts)
    rows = stored(encoded(docs, lexicon, rounds), "encoded-texts")
    texts = rows.where("h is null")
    shared = spark.sparkContext.broadcast(train(texts, lexicon, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ("doc_id", "n", "n_known", "base", "score")
        each = ((*values, np.frombuffer(ids.as_buffer(), "<u2")) for batch in batches for *values, ids in zip(*(batch.column(c).to_pylist() for c in kept), batch.column("ids"), strict=True))
        for held in _pooled(each, SCORE_POOL):
            doc_id, n, n_known, base, rest, ids = zip(*held, strict=True)
            whole = score_texts(shared.value, list(ids)) + np.array(rest)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(whole)], kept)

    whole = texts.select("doc_id", "n", "n_known", "base", "score", "ids").mapInArrow(run, "doc_id long, n long, n_known long, base double, score double")
    looked_up = rows.where("h is not null").select("h", "n", "doc_id").join(counts.withColumnRenamed("n", "c"), "h", "left")
    share_ = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / float(lexicon.norm))
    tail = looked_up.select("doc_id", F.lit(0).cast("long").alias("n"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"), share_.alias("base"), share_.alias("score"))
    sums = whole.union(tail).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")])
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return sums.select(
        "doc_id", out.alias("held_out"), F.col("n").alias("n_tokens"), "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
