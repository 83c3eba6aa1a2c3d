"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

Training. Trusted documents (label quality 1, not toxic) of each language, at most
``TRAIN_DOCS`` a language in the order of a hash of the doc_id: the bound that makes the model's size
independent of the corpus. Words are ``[^\\x20\\x09-\\x0D]+`` as written; the ``VOCABULARY`` commonest of a
language seen twice or more have ids, the others are one unknown word whose spelling costs
``OPEN_WORDS``. Counts, continuation counts, discounts and back-off weights are Spark aggregations; a
word after an unknown word is scored by the lowest order, and a context that begins with one has no counts of its own.

Scoring. The counts are dealt into shards by the middle word of a trigram: it decides about the
trigram, its context and the bigram. Every task turns its documents into ids, scores on the spot what
the lowest order decides (a bitmap of the bigrams tells), and packs the other trigrams by shard. A shard
is joined with its share of the trigrams in streams, the counts first; it has as many copies as the
load on its words asks for, so frequent words don't end in one task. Sums per document give the
perplexity.

Verdict. Trusted documents that are held out of training give, for each language, the perplexity at
``QUANTILE``; a document is kept up to that value, and some more for short texts (``SHORT``). A
language without such documents has no threshold and keeps everything.

Defined results: a null or empty text has one token, its end; rows that share a doc_id (or have none) are
scored together, as one document; a null language is a language of its own; without trusted documents all
is kept with a null perplexity; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import few_files, over_texts, scratch, slices, stored, tidy, utf8

TRAIN_DOCS = 700
VOCABULARY = 15_000
OPEN_WORDS = 1e6
#: One trusted document in so many is never trained on: thresholds come from those.
HOLD_OUT = 5
QUANTILE = 0.95
#: A short text's perplexity varies: its threshold is wider by 10 ** (SHORT / sqrt(tokens)).
SHORT = 2.0
SHARDS = 8
#: Bytes of texts whose trigrams come to one task, about; each has a copy of its shard's counts.
PART_BYTES = 24_000_000
#: Keys hold a language's number above two bits for the kind and three ids of 16 bits.
KIND, LANGUAGE = 48, 50
FILTER_BITS = 25

BEGIN, END, UNKNOWN, FIRST_WORD = 0, 1, 2, 3  # ids in each language, before those of its words


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trusted documents (doc_id, lang) and whether they are held out."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    found = docs.join(good, "doc_id", "left_semi").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return found.withColumn("held_out", F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HOLD_OUT)) == 0)


def _words(docs: DataFrame) -> DataFrame:
    def each():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words.setdefault(lang or "", Counter()).update(text.split())
            rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()] or [("", b"", 0)]
            lang, word, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        return work

    return over_texts(docs, ["lang", "text"], "lang string, word binary, n long", each).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of 16 bits in each language; tables have them plus the language's base, so that all differ."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.number, self.base, self.ids, self.size = {}, {}, {}, 0
        for lang, word in sorted(rows):
            own = self.ids.setdefault(lang, {})
            if word:
                own[word] = FIRST_WORD + len(own)
        for lang, own in self.ids.items():
            self.number[lang], self.base[lang] = len(self.base), self.size
            self.size += len(own) + FIRST_WORD
        if len(self.ids) > 1 << 64 - LANGUAGE or any(len(own) + FIRST_WORD > 1 << 16 for own in self.ids.values()):
            raise ValueError("more languages, or words in a language, than keys hold")

    def text(self, lang: str, text: bytes) -> np.ndarray | None:
        """begin, begin, the words, end; None for a language without a model."""
        if lang not in self.ids:
            return None
        get, words = self.ids[lang].get, text.split()
        out = np.empty(len(words) + 3, np.uint16)
        out[:2], out[-1] = BEGIN, END
        out[2:-1] = [get(w, UNKNOWN) for w in words]
        return out

    def bases(self) -> np.ndarray:
        return np.array(list(self.base.values()), np.int64)


def _trigrams(docs: DataFrame, shared) -> DataFrame:
    """(a, b, c, n) of the training texts, without those whose middle word is unknown; ``known``: whether the first is not."""

    def each():
        vocabulary, bases = shared.value, shared.value.bases()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [np.zeros(0, np.uint64)]
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                w = vocabulary.text(lang or "", text)
                if w is not None:
                    w = w.astype(np.uint64)
                    key = w[:-2] << np.uint64(32) | w[1:-1] << np.uint64(16) | w[2:] | np.uint64(vocabulary.number[lang or ""] << LANGUAGE)
                    keys.append(key[w[1:-1] != UNKNOWN])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            base = bases[(key >> np.uint64(LANGUAGE)).astype(np.int64)]
            known = (key >> np.uint64(32) & np.uint64(0xFFFF)) != UNKNOWN
            parts = [((key >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int64) + base).astype(np.int32) for s in (32, 16, 0)]
            return pa.RecordBatch.from_arrays([*map(pa.array, parts), pa.array(n.astype(np.int64)), pa.array(known)], ["a", "b", "c", "n", "known"])

        return work

    return over_texts(docs, ["lang", "text"], "a int, b int, c int, n long, known boolean", each).groupBy("a", "b", "c", "known").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    n = counts.agg(*[F.coalesce(F.sum(F.when(F.col("n") == k, 1)), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * y * up / own if own else 0.5 * k for k, own, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1 * k), 0.95 * k) for k, d in zip((1, 2, 3), found, strict=True))


def _discounted(counts: DataFrame, context: list[str], total: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Adds ``share`` (the discounted share in its context); and per context the weight of the lower order."""
    d1, d2, d3 = _discounts(counts)
    d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    per = counts.groupBy(*context).agg(F.sum("n").alias(total), F.sum(d).alias("__d")).withColumn(weight, F.col("__d") / F.col(total)).drop("__d")
    return counts.join(per, context).withColumn("share", (F.col("n") - d) / F.col(total)), per


class Model:
    """Broadcast parts (vocabulary, lowest order, back-off of words, bitmap, shards) and the sharded counts."""

    def __init__(self, vocabulary, unigram, backoff, bitmap, shard_of, copies, tables):
        self.vocabulary, self.unigram, self.backoff, self.bitmap = vocabulary, unigram, backoff, bitmap
        self.shard_of, self.copies, self.tables = shard_of, copies, tables


def _bit(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    key = b.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64)
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _marked(bitmap: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the bits of these bigrams are set; the bitmap stays packed."""
    at = _bit(b, c)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def train(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, vocabulary: int = VOCABULARY, shards: int = SHARDS) -> tuple[Model | None, DataFrame]:
    """The model (None without trusted documents) and the trusted documents with what is held out."""
    spark = docs.sparkSession
    good = stored(trusted(docs, labels), "trusted")
    langs = {r["lang"]: r["trained"] for r in good.groupBy("lang").agg((F.min(F.col("held_out").cast("int")) == 0).alias("trained")).collect()}
    if not langs:
        return None, good
    # a language whose trusted documents are all held out is trained on them, and has no threshold
    good = good.withColumn("held_out", F.col("held_out") & F.col("lang").isin([lang for lang, some in langs.items() if some]))
    # the limit on the rank goes into the window: every task keeps its first ones of a language before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = good.where(~F.col("held_out")).withColumn("rank", rank).where(F.col("rank") <= train_docs)
    sample = stored(docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").select("lang", "text"), "training-texts")
    words = _words(sample).where("n >= 2").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    best = words.where(F.col("k") <= vocabulary).select("lang", "word").toArrow()  # bounded by languages x vocabulary
    rows = list(zip(best["lang"].to_pylist(), best["word"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(Vocabulary(rows + [(lang, b"") for lang in langs]))
    v = shared.value

    c3 = stored(_trigrams(sample, shared), "trigrams")
    n_trigrams = c3.count()  # of the bounded sample
    c2 = stored(few_files(c3.groupBy("b", "c").agg(F.count("*").alias("n")), n_trigrams), "bigrams")
    c3 = c3.where("known").drop("known")
    bases = v.bases()
    lang_of = spark.createDataFrame(pa.table({"c": np.arange(v.size, dtype=np.int32), "lang": np.repeat(bases, np.diff([*bases, v.size]))}))
    c1 = c2.groupBy("c").agg(F.count("*").alias("n")).join(lang_of, "c")
    p1, rest1 = _discounted(c1, ["lang"], "total", "rest")
    p1 = p1.select("c", "share").toArrow()  # a row per word
    rest1 = {r["lang"]: r["rest"] for r in rest1.collect()}
    unigram = np.zeros(max(1, v.size))
    unigram[p1["c"].to_numpy()] = p1["share"].to_numpy()
    for lang, base in v.base.items():
        size = len(v.ids[lang]) + FIRST_WORD
        unigram[base : base + size] += rest1.get(base, 1.0) / size
    log_uni = spark.createDataFrame(pa.table({"c": np.arange(len(unigram), dtype=np.int32), "p1": unigram}))

    p2, rest2 = _discounted(c2, ["b"], "total", "rest2")
    p2 = p2.join(log_uni, "c").select("b", "c", (F.col("share") + F.col("rest2") * F.col("p1")).alias("p2"))
    p2 = stored(few_files(p2, n_trigrams), "p2")
    p3, rest3 = _discounted(c3, ["a", "b"], "total", "rest3")
    p3 = p3.join(p2, ["b", "c"]).select("a", "b", "c", (F.col("share") + F.col("rest3") * F.col("p2")).alias("p"))
    backoff = np.zeros(max(1, v.size))
    load = np.zeros(max(1, v.size))
    per_word = rest2.toArrow()  # a row per word
    at = per_word["b"].to_numpy()
    backoff[at], load[at] = np.log10(np.maximum(per_word["rest2"].to_numpy(), 1e-12)), per_word["total"].to_numpy()
    shard_of, weight = np.zeros(max(1, v.size), np.int64), np.zeros(shards)
    for b in np.argsort(-load, kind="stable"):
        shard_of[b] = weight.argmin()
        weight[shard_of[b]] += load[b]
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(shards, size // PART_BYTES)
    copies = np.maximum(1, np.ceil(weight / max(weight.sum(), 1) * parts)).astype(np.int64)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bit(batch.column("b").to_numpy(), batch.column("c").to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    bitmap = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for part in p2.select("b", "c").coalesce(4).mapInArrow(marked, "bits binary").toArrow()["bits"]:  # 4 MB each
        bitmap |= np.frombuffer(part.as_buffer(), np.uint8)
    starts = _bit(bases + BEGIN, bases + BEGIN)  # a text's first context, which is no bigram
    np.bitwise_or.at(bitmap, starts >> 3, (128 >> (starts & 7)).astype(np.uint8))
    lookup = spark.createDataFrame(pa.table({"b": np.arange(len(shard_of), dtype=np.int32), "shard": shard_of.astype(np.int32)}))
    tables = (
        p3.select(F.lit(3).alias("kind"), "a", "b", "c", F.log10("p").alias("x"))
        .union(p2.select(F.lit(2), F.lit(0), "b", "c", F.log10("p2")))
        .union(rest3.select(F.lit(1), "a", "b", F.lit(0), F.log10(F.greatest("rest3", F.lit(1e-12)))))
        .join(lookup, "b")
    )
    model = Model(v, np.log10(np.maximum(unigram, 1e-12)), backoff, bitmap, shard_of, copies, stored(tables, "counts"))
    return model, good


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_tokens and perplexity of every document."""
    spark = docs.sparkSession
    tables = model.tables
    light = Model(model.vocabulary, model.unigram, model.backoff, model.bitmap, model.shard_of, model.copies, None)
    shared = spark.sparkContext.broadcast(light)
    starts = np.concatenate([[0], np.cumsum(model.copies)]).astype(np.int64)
    n_parts = int(starts[-1])
    open_word = float(np.log10(OPEN_WORDS))
    schema = "part int, kind int, docs binary, counts binary, payload binary, lang string"

    @tidy
    def pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = shared.value.vocabulary.bases()
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            cols = {c: batch.column(c).to_numpy()[order] for c in ("kind", "a", "b", "c", "x")}
            number = np.searchsorted(bases, cols["b"], "right") - 1
            a, b, c = (np.where(cols["kind"] == none, 0, cols[x] - bases[number]).astype(np.uint64) for x, none in (("a", 2), ("b", 0), ("c", 1)))
            key = number.astype(np.uint64) << np.uint64(LANGUAGE) | cols["kind"].astype(np.uint64) << np.uint64(KIND) | a << np.uint64(32) | b << np.uint64(16) | c
            found, at = np.unique(shard[order], return_index=True)
            for s, lo, hi in zip(found, at, [*at[1:], len(shard)], strict=True):
                for part in range(int(starts[s]), int(starts[s + 1])):
                    yield _row(part, 0, None, None, key[lo:hi].tobytes() + cols["x"][lo:hi].astype(np.float32).tobytes(), None)

    def _row(part, kind, docs_, counts, payload, lang):
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([docs_], pa.binary()), pa.array([counts], pa.binary()), pa.array([payload], pa.binary()), pa.array([lang], pa.string())],
            ["part", "kind", "docs", "counts", "payload", "lang"],
        )

    @tidy
    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.vocabulary
        turn = TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in slices(whole)):
            groups: dict[str, list[tuple[int | None, np.ndarray]]] = {}
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                groups.setdefault(lang or "", []).append((doc_id, v.text(lang or "", text)))
            for lang, rows in groups.items():
                turn += 1
                ids = np.array([-(1 << 63) if i is None else i for i, _ in rows], "<i8")
                if rows[0][1] is None:
                    yield _row(turn % n_parts, 1, ids.tobytes(), np.zeros(len(ids), "<i4").tobytes(), np.zeros(len(ids)).tobytes(), lang)
                    continue
                sizes = np.array([len(w) - 2 for _, w in rows], np.int64)
                a, b, c = (np.concatenate([w[k : len(w) - 2 + k] for _, w in rows]) for k in range(3))
                owner = np.repeat(np.arange(len(rows)), sizes)
                at_a, at_b, at_c = (x.astype(np.int64) + v.base[lang] for x in (a, b, c))
                local = b == UNKNOWN
                context, pair = _marked(m.bitmap, at_a, at_b), _marked(m.bitmap, at_b, at_c)
                local |= ~context & ~pair
                score = np.where(local, m.unigram[at_c] + np.where(b == UNKNOWN, 0.0, m.backoff[at_b]), 0.0) - np.where(c == UNKNOWN, open_word, 0.0)
                sums = np.bincount(owner, weights=score, minlength=len(rows))
                yield _row(turn % n_parts, 1, ids.tobytes(), sizes.astype("<i4").tobytes(), sums.tobytes(), lang)
                away = np.flatnonzero(~local)
                shard = m.shard_of[at_b[away]]
                away, shard = away[np.argsort(shard, kind="stable")], np.sort(shard, kind="stable")
                found, at = np.unique(shard, return_index=True)
                for s, lo, hi in zip(found, at, [*at[1:], len(shard)], strict=True):
                    own = away[lo:hi]
                    who, counts = np.unique(owner[own], return_counts=True)
                    part = int(starts[s]) + turn % int(m.copies[s])
                    yield _row(part, 2, ids[who].tobytes(), counts.astype("<i4").tobytes(), a[own].tobytes() + b[own].tobytes() + c[own].tobytes(), lang)

    @tidy
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        part, pieces, keys, values = None, [], None, None
        for batch in batches:
            for p, kind, ids, counts, payload, lang in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "docs", "counts", "payload", "lang")), strict=True):
                if p != part:
                    part, pieces, keys = p, [], None
                if kind == 0:
                    n = len(payload) // 12
                    pieces.append((np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.float32, n, 8 * n)))
                    continue
                ids, counts = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4")
                if kind == 1:
                    sums, tokens = np.frombuffer(payload), counts.astype(np.int64)
                else:
                    if keys is None:
                        keys = np.concatenate([x for x, _ in pieces]) if pieces else np.zeros(0, np.uint64)
                        values = np.concatenate([x for _, x in pieces]) if pieces else np.zeros(0, np.float32)
                        order = np.argsort(keys)
                        keys, values = np.append(keys[order], np.uint64((1 << 64) - 1)), np.append(values[order], np.float32(0)).astype(float)
                    a, b, c = np.frombuffer(payload, np.uint16).reshape(3, -1).astype(np.uint64)
                    bigram, abc = b << np.uint64(16) | c, a << np.uint64(32) | b << np.uint64(16)
                    number, base = m.vocabulary.number[lang], m.vocabulary.base[lang]

                    def find(kind, key, number=number):
                        key = key | np.uint64(number << LANGUAGE | kind << KIND)
                        at = np.searchsorted(keys, key)
                        return keys[at] == key, values[at]

                    seen3, x3 = find(3, abc | c)
                    seen2, x2 = find(2, bigram)
                    seen1, x1 = find(1, abc)
                    lower = np.where(seen2, x2, m.backoff[b.astype(np.int64) + base] + m.unigram[c.astype(np.int64) + base])
                    score = np.where(seen3, x3, np.where(seen1, x1, 0.0) + lower)
                    sums, tokens = np.bincount(np.repeat(np.arange(len(ids)), counts), weights=score, minlength=len(ids)), np.zeros(len(ids), np.int64)
                nulls = ids == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array([lang] * len(ids)), pa.array(sums), pa.array(tokens)], ["doc_id", "lang", "score", "n_tokens"])

    counts = tables.mapInArrow(pack_counts, schema)
    texts = docs.select("doc_id", "lang", "text").mapInArrow(pack_texts, schema)
    dealt = counts.union(texts).repartition(n_parts, "part").sortWithinPartitions("part", "kind")
    sums = dealt.mapInArrow(look_up, "doc_id long, lang string, score double, n_tokens long").groupBy("doc_id", "lang").agg(F.sum("score").alias("score"), F.sum("n_tokens").alias("n_tokens"))
    perplexity = F.when(F.col("n_tokens") > 0, F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return sums.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and kept of every document."""
    with scratch(docs.sparkSession):
        model, good = train(docs, labels, train_docs=train_docs)
        if model is None:
            some = docs.groupBy("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.lit(0).cast("long").alias("n_tokens"))
            return some.select("doc_id", "lang", "n_tokens", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
        found = stored(perplexities(docs, model), "perplexities", outlives=1)
        held_out = found.join(good.where("held_out").select("doc_id", "lang"), ["doc_id", "lang"], "left_semi")
        limits = held_out.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("limit"))
        limits = stored(limits, "limits", outlives=1)
    wider = F.pow(F.lit(10.0), SHORT / F.sqrt(F.greatest("n_tokens", F.lit(1))))
    judged = found.join(limits, "lang", "left").withColumn("threshold", F.col("limit") * wider)
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", kept.alias("kept"))
