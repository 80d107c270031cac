"""Encode texts word by word with a bounded cache: most words of a corpus repeat."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import islice

CACHE_WORDS = 1_000_000
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


class UnitEncoder:
    """``encode_batch`` turns a list of units into byte strings; known units come from the cache.

    A text is cut before every space that follows a character other than white space; the units with their spaces
    concatenate to the text.  When the cache holds ``limit`` units, the later half goes (common words come early); this
    changes no result.
    """

    def __init__(self, encode_batch: Callable[[list[str]], Sequence[bytes]], limit: int = CACHE_WORDS):
        self.encode_batch = encode_batch
        self.limit = limit
        self.known: dict[str, bytes] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """Units without the space that each but the first begins with."""
        if _SPACE_AFTER_SPACE.search(text):
            first, *rest = _BEFORE_SPACE.split(text)
            return [first, *(u[1:] for u in rest)]
        return text.split(" ")

    def encode(self, texts: Sequence[str]) -> list[list[bytes]]:
        """The codes of the units of each text.  The first unit of a text has no space before it."""
        if len(self.known) > self.limit:
            self.known = dict(islice(self.known.items(), self.limit // 2))
        cut = [self.units(t) for t in texts]
        new: set[str] = set()
        for units in cut:
            new.update(units[1:])
        fresh = [u for u in new if u not in self.known]
        heads = [units[0] for units in cut]
        codes = self.encode_batch(heads + [" " + u for u in fresh])
        self.known.update(zip(fresh, codes[len(heads):]))
        known = self.known
        return [[head, *[known[u] for u in units[1:]]] for head, units in zip(codes, cut)]
