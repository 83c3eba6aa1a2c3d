"""Token counts by greedy longest match, linear in the text.

The vocabulary has beginnings of words and continuations. An automaton runs over a word's
characters through one trie. Where no entry can grow further, it doesn't go back to try shorter
entries: each trie node has a failure link to the node that is reached when the longest entries at
the front of its path have been taken, and the number of entries that are taken on that way. So a
character costs one move or one link, and the count comes without building a piece. The links are
worked out in breadth-first order when the automaton is compiled.

A word (``[^\\x20\\x09-\\x0D]+``) that can't be cut into entries counts as one unknown token.
Defined results: a null or empty text has no words and no tokens; repeated rows and doc_ids give a
row each; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from dialogscope.llm.common import Memo, over_texts, utf8

#: What begins a word in the vocabulary file.
WORD_MARK = "▁"
DEAD = -1


class LongestMatch:
    """Counts of greedy longest-match entries. ``starts`` may begin a word, ``inner`` continue one."""

    def __init__(self, starts: Iterable[str], inner: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        self.entry = [False, False]
        for root, entries in ((0, starts), (1, inner)):
            for text in entries:
                node = root
                for c in text:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.entry.append(False)
                    node = self.children[node][c]
                self.entry[node] = node > 1
        self._link()

    def _link(self) -> None:
        """fail[node], popped[node]: where the path continues after its front entries, and how many they are."""
        n = len(self.children)
        self.fail, self.popped = [DEAD] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                if self.entry[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.popped[node]
                    while at != DEAD and c not in self.children[at]:
                        at, popped = self.fail[at], popped + self.popped[at]
                    if at != DEAD:
                        self.fail[child], self.popped[child] = self.children[at][c], popped
                queue.append(child)

    def count(self, word: str) -> int | None:
        """Entries in the word, or None if it can't be cut."""
        children, fail, popped = self.children, self.fail, self.popped
        node = taken = 0
        for c in word:
            to = children[node].get(c)
            while to is None:
                taken += popped[node]
                node = fail[node]
                if node == DEAD:
                    return None
                to = children[node].get(c)
            node = to
        while node > 1:
            taken += popped[node]
            node = fail[node]
        return taken if node == 1 else None


@lru_cache(maxsize=2)
def counter(path: str) -> Memo:
    """Words (bytes) to counts, 0 for an unknown word; one per Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    starts = [x[len(WORD_MARK) :] for x in entries if x.startswith(WORD_MARK) and len(x) > len(WORD_MARK)]
    inner = [x for x in entries if WORD_MARK not in x]
    # a single character may begin a word, too: the file has the bare mark as an entry of its own
    machine = LongestMatch([*starts, *(x for x in inner if len(x) == 1)], inner)
    return Memo(lambda word: machine.count(word.decode()) or 0, 300_000)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one), n_unknown."""

    def each():
        count = counter(path).__getitem__

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens, unknown = [], [], []
            for text in utf8(batch.column(1)):
                found = list(map(count, text.split()))
                missing = found.count(0)
                words.append(len(found))
                tokens.append(sum(found) + missing)
                unknown.append(missing)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

        return work

    return over_texts(docs, ["doc_id", "text"], "doc_id long, n_words long, n_tokens long, n_unknown long", each)
