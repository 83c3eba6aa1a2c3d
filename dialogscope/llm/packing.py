"""Best-fit packing planned on the histogram of lengths.

1. Every task tokenizes its documents, cuts those over the limit (the first piece takes the
   remainder), and numbers its pieces of each length from 0.
2. The histogram of lengths has at most ``limit`` entries, whatever the number of documents. The
   plan is made on it: best-fit decreasing over counts, giving patterns (how many pieces of which
   lengths one sequence holds, and how many sequences do so).
3. A piece's rank within its length is its number in its task plus the pieces of that length in
   earlier tasks. Rank and length are joined with the plan's ranges: that gives the sequence and
   the place in it.

Defined results: a null or empty text has one token, the end; equal texts are packed one by one;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import over_texts, stored
from dialogscope.llm.pretokens import PartEncoder

LIMIT = 2048
END = 0


@lru_cache(maxsize=2)
def _encoders(path: str, pattern: str) -> tuple[Callable[[str], bytes] | None, Callable[[str], bytes], list[str]]:
    """What encodes a match of the pattern (None if the file's merges are no ranks), what encodes any text, and the added tokens.

    One per Python worker. The library takes some 30 MB there, so it is loaded when a text asks for it.
    """
    import tiktoken

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    file = json.loads(Path(path).read_text("utf-8"))
    added = [t["content"] for t in file.get("added_tokens") or []]
    vocab, merges = file["model"]["vocab"], ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"]]
    ids = [vocab[m] for m in merges]
    if ids != sorted(ids):
        return None, whole, added
    byte_of, special = {c: b for b, c in byte_letters().items()}, set(added)
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    merger = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: array("I", merger(piece.encode())).tobytes(), whole, added


def tokenizer(path: str, pattern: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as bytes, equal to those of the tokenizers library.

    The file's merges, when they come in the order of their ids, are ranks: a compiled merger then
    encodes single matches of the pattern. Any other file, and any text that ``PartEncoder`` can't
    cut safely, is encoded by the library itself. One per task: its memos grow to a hundred MB, which would otherwise
    lie in every idle worker of an executor while other steps run there.
    """
    piece, whole, added = _encoders(path, pattern)
    if piece is None:
        return whole
    parts = PartEncoder(pattern, piece, whole)
    return lambda text: whole(text) if any(x in text for x in added) else parts(text)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabulary files (fixed by that format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length in its task."""

    def each():
        encode, numbers = tokenizer(path, pattern), np.zeros(limit + 1, np.int64)
        end, task = np.array([END], "<u4").tobytes(), TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    length = min(limit, n % limit or limit) if k == 0 else limit
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, int(numbers[length])))
                    numbers[length] += 1
                    start, k = start + length, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            )

        return work

    return over_texts(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long", each)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, pieces of it in each)]), longest lengths first.

    Best-fit decreasing: each length goes, longest first, to the open patterns with the least room
    that still holds it. A pattern is split when only some of its sequences take another piece, so
    the work depends on the number of distinct lengths and not on the counts.
    """
    rooms: list[int] = []  # distinct rooms left, sorted
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, n: int, items: list[tuple[int, int]]) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((n, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = limit // length
                full, rest = divmod(left, per)
                if full:
                    put(limit - per * length, full, [(length, per)])
                if rest:
                    put(limit - rest * length, 1, [(length, rest)])
                break
            room = rooms[at]
            n, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            per = room // length
            full = min(n, left // per)
            if full:
                put(room - per * length, full, [*items, (length, per)])
                left -= full * per
            if full < n:
                if 0 < left < per:
                    put(room - left * length, 1, [*items, (length, left)])
                    full, left = full + 1, 0
                if full < n:
                    put(room, n - full, items)
    return [(n, items) for room in rooms for n, items in open_[room]]


def plan_rows(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, pieces of it per sequence, first sequence, offset of the first of them."""
    rows, taken, sequence = [], {}, 0
    for n, items in patterns:
        offset = 0
        for length, per in items:
            rows.append((length, taken.get(length, 0), per, sequence, offset))
            taken[length] = taken.get(length, 0) + n * per
            offset += length * per
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece with its sequence_id and offset; see the module's text."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, pattern, limit), "pieces")
    counts = cut.groupBy("task", "length").agg(F.max("number").alias("n")).withColumn("n", F.col("n") + 1)
    counts = stored(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    rows = sorted(plan_rows(plan(histogram, limit)))
    slots = np.array(rows, np.int64).reshape(-1, 5)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))
    shared = spark.sparkContext.broadcast(slots)  # its size follows the number of distinct lengths

    def each():
        table = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            hit = table[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            more, k = np.divmod(rank - hit[:, 1], hit[:, 2])
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(hit[:, 3] + more), pa.array(hit[:, 4] + k * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

        return work

    return over_texts(
        ranked, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", each
    )
