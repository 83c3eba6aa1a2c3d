"""Quality rules by distribution divergence.

A document's histogram over character classes, and its histogram over the commonest words of its
language, are held against references of that language by the Jensen-Shannon distance (base 2,
so from 0 to 1). The references are counted over every document of the language. Documents under
``min_words`` words aren't compared: they fail the base rules already.

Defined results: a null text has no words; a null ``lang`` is a language of its own; rows that
repeat a doc_id are judged one by one; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import over_texts, stored, utf8

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Reference words of a language, and the distances beyond which a document goes.
COMMON_WORDS = 100
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.50
#: Distinct languages up to which the references are broadcast (each has about 3 kB).
BROADCAST_LANGUAGES = 4096

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other ASCII", "Latin", "other")


def _class_of_byte() -> np.ndarray:
    """The class of the code point that a UTF-8 byte begins; continuation bytes have none."""
    of = np.full(256, len(CLASSES), np.uint8)
    of[:128] = 6
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\x0b\x0c\r", 3), (b".,;:'\"?-()", 4), (SYMBOLS, 5)):
        of[list(chars)] = k
    of[0xC2:0xD0] = 7
    of[0xD0:] = 8
    return of


def class_counts(text: bytes, of: np.ndarray) -> np.ndarray:
    return np.bincount(of[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if just one is empty, 0 if both are."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return float(bool(a) != bool(b))
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row per language: class counts, its commonest words (ties to the smaller word) and all its words."""

    def each():
        of = _class_of_byte()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words: dict[str, Counter] = {}
            classes: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words.setdefault(lang or "", Counter()).update(text.lower().split())
                classes[lang or ""] = classes.get(lang or "", 0) + class_counts(text, of)
            rows = [(lang, w, n, None) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, None, None, v.tolist()) for lang, v in classes.items()]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))],
                ["lang", "word", "n", "classes"],
            )

        return work

    counted = over_texts(docs, ["lang", "text"], "lang string, word binary, n long, classes array<long>", each)
    sums = [F.sum(F.coalesce(F.col("classes")[i], F.lit(0))).alias(f"c{i}") for i in range(len(CLASSES))]
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums)
    words = stored(words, "reference-words")
    best = words.where("word is not null").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common_words)
    best = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n_words"), F.array(*[F.sum(f"c{i}") for i in range(len(CLASSES))]).alias("classes"))
    return total.join(best, "lang", "left").select("lang", "n_words", "classes", F.col("top.word").alias("words"), F.col("top.n").alias("counts"))


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, code points in them, symbols, lines equal to an earlier line, words in repeated 3-word windows."""
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x and not x.isspace()]
        dup = len(full) - len(set(full))
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        # two steps of renumbering keep the window's key exact for any number of words
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, n = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = n[at] > 1
        if twice.any():
            inside = np.zeros(len(words), bool)
            for k in range(3):
                inside[k : len(words) - 2 + k] |= twice
            repeated = int(inside.sum())
    return words, chars, symbols, dup, repeated


def judge(
    docs: DataFrame,
    refs: DataFrame | None = None,
    *,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Counts, distances and the verdict of every row of ``docs`` (doc_id, text, lang)."""
    refs = stored(references(docs) if refs is None else refs, "references")
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    one = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).join(refs, "lang", "left")

    def each():
        of, known = _class_of_byte(), {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs = batch.column("lang").to_pylist()
            rows = []
            for i, (lang, text) in enumerate(zip(langs, utf8(batch.column("text")), strict=True)):
                if lang not in known:
                    top, counts = batch.column("words")[i].as_py() or [], batch.column("counts")[i].as_py() or []
                    rest = (batch.column("n_words")[i].as_py() or 0) - sum(counts)
                    classes = batch.column("classes")[i].as_py() or [0] * len(CLASSES)
                    if len(known) > BROADCAST_LANGUAGES:
                        known.clear()
                    known[lang] = ({w: k for k, w in enumerate(top)}, np.array([*counts, rest], float), np.array(classes, float))
                places, word_ref, class_ref = known[lang]
                words, chars, symbols, dup, repeated = base_counts(text)
                n = len(words)
                failed = n < min_words or 100 * repeated > MOST_REPEATED_PERCENT * n
                by_class = by_word = None
                if n >= min_words:
                    get, rest = places.get, len(places)
                    own = np.bincount(np.fromiter((get(w, rest) for w in text.lower().split()), np.int64, n), minlength=rest + 1)
                    by_class, by_word = distance(class_counts(text, of), class_ref), distance(own, word_ref)
                kept = not failed and by_class <= max_class_distance and by_word <= max_word_distance
                rows.append((n, chars, symbols, dup, repeated, failed, kept, by_class, by_word))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

        return work

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return over_texts(one, ["doc_id", "text", "lang", "n_words", "classes", "words", "counts"], schema, each)
