"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 machine.

Encoding. A sequence of tokens is the encoding of its bytes just when each token encodes to itself
and each neighbouring pair encodes to that pair. So every beginning of a piece has at most one last
token, and reading left to right it is enough to keep the places where a token may have begun that
can still grow: for each, how far it is in the vocabulary's trie and the token before it. That set
is a state of the transducer. A move says which token ends here, if any; the tokens are emitted once
every place that is left shares them, at most the longest entry behind. A move is simulated when it
is first met, and made part of the machine when it is met again.

Decoding. Every token moves the UTF-8 machine from state to state; moves are worked out when first
needed. Only complete code points leave the decoder, whatever the cuts between chunks.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows and
doc_ids give a row each; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dialogscope.llm.common import over_texts
from dialogscope.llm.pretokens import PartEncoder

#: States and moves met once that are kept at most; beyond that it is determinised anew.
MOST_STATES = 300_000
#: Ids decoded at a time.
CHUNK = 65_536
LIVE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size = [0] * (max(self.bytes_of) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for data, i in ranks.items():
            self.size[i] = len(data)
            node = 0
            for byte in data:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][byte]
            self.token[node] = i
        self.lookahead = 4 * max(self.size)
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.met: set[tuple] = set()
        self.start = self._state(((0, -1),))

    def _state(self, live: tuple[tuple[int, int], ...]) -> dict:
        """A state's moves: byte -> (moves of the next state, token that ends there or -1).

        Under LIVE it has the trie node and the token before, for each place where a token may have begun.
        """
        return self.states.get(live) or self.states.setdefault(live, {LIVE: live})

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The definition: join the neighbours of the lowest rank, leftmost first, until none join."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]], bool]:
        """Parts that stand at a token's left and right edge while it is merged, each with the rank
        of the merge that ends it; and whether the token encodes to itself."""
        if token not in self.edges:
            data = self.bytes_of[token]
            sides = []
            for side in (0, -1):
                part, rank, along = data, 1 << 60, []
                while True:
                    along.append((part, rank))
                    halves = self.merge(part, 2)
                    if len(part) == 1 or len(halves) != 2:
                        break
                    part, rank = halves[side], self.ranks[part]
                sides.append(along)
            self.edges[token] = (*sides, len(self.merge(data)) == 1)
        return self.edges[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two stay apart: nothing joins across their border while either is merged."""
        left, _, alone = self._edge(token)
        found = alone
        if alone and before >= 0:
            get = self.ranks.get
            for x, x_ends in self._edge(before)[1]:
                for y, y_ends in left:
                    rank = get(x + y)
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        found = False
        if len(self.pairs) >= 400_000:
            self.pairs.clear()
        self.pairs[before, token] = found
        return found

    def step(self, live: tuple[tuple[int, int], ...] | list[tuple[int, int]], byte: int) -> tuple[list[tuple[int, int]], int]:
        """The places that are left after a byte, longest first, and the token that ends with it or -1."""
        own, out = -1, []
        children, pairs = self.children, self.pairs
        for node, before in live:
            child = children[node].get(byte)
            if child is not None:
                if own < 0:
                    token = self.token[child]
                    if token >= 0:
                        fits = pairs.get((before, token))
                        if fits or fits is None and self.fits(before, token):
                            own = token
                if children[child]:
                    out.append((child, before))
        if own >= 0:
            out.append((0, own))
        return out, own

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to a place, from the token that ends at each place."""
        chain = []
        while at:
            chain.append(ends[at])
            at -= self.size[ends[at]]
        return chain[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ends = self.start, [-1]
        add = ends.append
        if len(piece) <= self.lookahead:
            try:
                for byte in piece:
                    state, own = state[byte]
                    add(own)
                return self._back(ends, len(piece))
            except KeyError:
                pass
        return self._slowly(piece, state, ends)

    def _slowly(self, piece: bytes, state: dict, ends: list[int]) -> list[int]:
        """From the first move that is missing: simulate it when first met, add it when met again."""
        live, out = state[LIVE], []
        for byte in piece[len(ends) - 1 :]:
            move = state.get(byte) if state else None
            if move:
                state, own = move
                live = state[LIVE]
            else:
                met = False
                if state:
                    met = (state[LIVE], byte) in self.met
                    self.met.add((state[LIVE], byte))
                live, own = self.step(live, byte)
                if met:
                    to = self._state(tuple(live))
                    state[byte] = (to, own)
                    state = to
                else:
                    state = None
            ends.append(own)
            if len(ends) > self.lookahead:
                ends = self._emit(ends, live, out)
        if len(self.states) + len(self.met) > self.most_states:
            self.reset()
        return out + self._back(ends, len(ends) - 1)

    def _emit(self, ends: list[int], live: list[tuple[int, int]], out: list[int]) -> list[int]:
        """Emits what all live places share and gives what is still open, renumbered."""
        chains = [self._back(ends, len(ends) - 1 - d) for d in self._depths(live)]
        shared = 0
        while all(len(c) > shared for c in chains) and len({c[shared] for c in chains}) == 1:
            shared += 1
        out += chains[0][:shared]
        cut = sum(self.size[t] for t in chains[0][:shared])
        return [-1, *ends[cut + 1 :]]

    def _depths(self, live: list[tuple[int, int]]) -> list[int]:
        if not hasattr(self, "depth"):
            self.depth = [0] * len(self.children)
            for node, below in enumerate(self.children):  # parents come before their children
                for child in below.values():
                    self.depth[child] = self.depth[node] + 1
        return [self.depth[node] for node, _ in live]


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """One move of the UTF-8 machine. State: bytes wanted, and bounds of the next; None on bad input."""
    wanted, low, high = state
    if wanted:
        return (wanted - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0x80, 0xBF)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


GROUND = (0, 0x80, 0xBF)


class Vocabulary:
    """Bytes of each id, the ids that hold whole code points only, and remembered moves of the others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.moves: dict[tuple[tuple[int, int, int], int], tuple[int, int, int] | None] = {}
        self.whole = np.array([self.move(GROUND, i) == GROUND for i in range(len(self.bytes_of))])

    def move(self, state: tuple[int, int, int], token: int) -> tuple[int, int, int] | None:
        key = (state, token)
        if key not in self.moves:
            for byte in self.bytes_of[token]:
                if state is None:
                    break
                state = utf8_step(state, byte)
            self.moves[key] = state
        return self.moves[key]


class StreamDecoder:
    """``feed`` ids; it gives the bytes of the code points complete so far. ``close`` wants none left."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state, self.carry = vocabulary, GROUND, b""

    def feed(self, ids: np.ndarray) -> bytes:
        v, at, n = self.v, 0, len(ids)
        partial = np.flatnonzero(~v.whole[ids])
        k = 0
        while k < len(partial) or self.state != GROUND:
            if self.state == GROUND:
                at = int(partial[k])
            if at >= n:
                break
            self.state = v.move(self.state, int(ids[at]))
            if self.state is None:
                raise ValueError("the ids don't decode to UTF-8")
            at += 1
            while k < len(partial) and partial[k] < at:
                k += 1
        data = self.carry + b"".join(map(v.bytes_of.__getitem__, ids.tolist()))
        self.carry = b""
        if self.state[0]:
            cut = len(data) - 1
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            data, self.carry = data[:cut], data[cut:]
        return data

    def close(self) -> None:
        if self.state != GROUND:
            raise ValueError("the ids end inside a code point")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[Callable[[str], bytes], Vocabulary]:
    """Text to ids, and the vocabulary; one per Python worker."""
    import tiktoken

    ranks = load_ranks(path)
    machine = Transducer(ranks)
    library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def piece(text: str) -> bytes:
        return array("I", machine.encode(text.encode())).tobytes()

    # the library splits (and so encodes) only the rare texts whose characters engines class differently
    return PartEncoder(pattern, piece, lambda text: np.array(library.encode_ordinary(text), "<u4").tobytes()), Vocabulary(ranks)


def decode(ids: np.ndarray, vocabulary: Vocabulary, chunk: int = CHUNK) -> Iterable[bytes]:
    stream = StreamDecoder(vocabulary)
    for k in range(0, len(ids), chunk):
        yield stream.feed(ids[k : k + chunk])
    stream.close()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""

    def each():
        encode, vocabulary = codec(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                raw = encode(text) if text else b""
                back = hashlib.sha256()
                for data in decode(np.frombuffer(raw, "<u4"), vocabulary):
                    back.update(data)
                n.append(len(raw) // 4)
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(back.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return over_texts(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every text."""

    def each():
        to_ids, _ = codec(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(to_ids(t) if t else b"", "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

        return work

    return over_texts(docs, ["doc_id", "text"], "doc_id long, ids array<int>", each)
