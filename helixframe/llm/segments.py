"""Exact tokenisation by cached text segments.

A text is cut before spaces where no tokenizer rule or merge can cross, so that its ids are the
concatenation of its segments' ids.  Each distinct segment is encoded once per worker while the
bounded cache lasts; repeated words cost one dictionary lookup.

Where a cut is safe:

* pre-split byte-level BPE (``public_tokenizers.PATTERN``): no alternative of the pattern matches
  a non-space followed by a space, and nothing looks behind.  A cut before a space is safe if
  neither of its neighbours is white space.  Texts where white space touches a space take a slower
  cut, before a space after a non-space only, which is safe without conditions.
* piece models (sentencepiece BPE): safe if no piece of the vocabulary holds a space mark after
  another character, which is checked when the model is loaded; otherwise, or if the text holds
  the mark itself, the whole text is encoded at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Distinct segments kept by one Python worker; beyond it the cache starts anew (memory bound).
CACHE_SEGMENTS = 400_000
#: Longer segments are encoded but not kept.
CACHE_SEGMENT_CHARS = 200

_CUT = re.compile(r"(?<=\S)(?= )")


class _Touching(Exception):
    """White space touches a space: the quick cut is not safe for this text."""


class SpacedSegments(dict):
    """word -> encoded bytes of " " + word, filled on demand."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Touching
        value = self._encode(" " + word)
        if len(word) <= CACHE_SEGMENT_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> bytes:
        """Encoded bytes of the whole text."""
        head, *rest = text.split(" ")
        try:
            if rest and head[-1:].isspace():
                raise _Touching
            return (self._encode(head) if head else b"") + b"".join(map(self.__getitem__, rest))
        except _Touching:
            return b"".join(map(self._encode, _CUT.split(text)))


class BatchedSegments:
    """Values of lists of segments; the distinct new ones of a step are encoded in one call."""

    def __init__(self, encode: Callable[[list[str]], list]) -> None:
        self._encode, self._known = encode, {}

    def of_parts(self, cut: list[list[str]]) -> list[list]:
        known = self._known
        present = set().union(*cut)
        missing = list(present.difference(known))
        local: dict = {}
        if missing:
            if len(known) + len(missing) > CACHE_SEGMENTS:
                # the segments of this step stay at hand; the rest is forgotten
                local = {k: known[k] for k in present if k in known}
                known.clear()
            for k, v in zip(missing, self._encode(missing), strict=True):
                (known if len(k) <= CACHE_SEGMENT_CHARS and len(known) < CACHE_SEGMENTS else local)[k] = v
        if local:
            get = lambda k: local[k] if k in local else known[k]
            return [[get(k) for k in parts] for parts in cut]
        at = known.__getitem__
        return [list(map(at, parts)) for parts in cut]
