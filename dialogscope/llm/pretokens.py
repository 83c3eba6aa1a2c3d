"""Token ids of a whole text through memos of its parts.

A space before a character that isn't white space always begins a match of the public pattern, and
a match stands unchanged when it stands alone. So a text falls into parts at its spaces, each part
into matches, and the ids of parts and matches are remembered: words repeat, documents don't.
Engines may disagree on a character's class; a text with characters outside ``SAFE``, which leaves
such characters out, goes to ``whole`` uncut.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable

import regex

from dialogscope.llm.common import Memo

#: Characters with the same class in every Unicode version that the libraries may be built on.
SAFE = r"\t\n\x0b\x0c\r\x20-\x7e¡-¬®-ȠȢ-ȳΑ-ΡΣ-ώА-я–—‘-‚“-„•…€ぁ-ゔァ-ヶ一-龥가-힣"


class PartEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    ``piece`` gives the ids of one match, ``whole`` those of any text.
    """

    def __init__(self, pattern: str, piece: Callable[[str], bytes], whole: Callable[[str], bytes], most: int = 300_000):
        self.find = regex.compile(pattern).findall
        self.whole, self.piece = whole, piece
        own = weakref.proxy(self)  # no cycle: the memos go with the encoder, not at some later collection
        self.pieces, self.parts = Memo(piece, most // 4), Memo(lambda part: own._part(part), most)
        self.unsafe = re.compile(rf"[^{SAFE}]").search
        self.awkward = re.compile(r" (?:\s|\Z)").search

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _part(self, part: str) -> bytes:
        """What follows a space, up to the next one: mostly a word, or a word and a mark."""
        if part.isalpha():
            return self.piece(" " + part)
        if part[:-1].isalpha():
            return self.parts[part[:-1]] + self.pieces[part[-1]]
        return self._matches(" " + part)

    def __call__(self, text: str) -> bytes:
        if self.unsafe(text):
            return self.whole(text)
        if self.awkward(text):
            return self._matches(text)
        first, *rest = text.split(" ")
        return self._matches(first) + b"".join(map(self.parts.__getitem__, rest))
