"""A bounded memory of words already encoded, kept by each Python worker between tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

#: About what an entry takes besides its characters.
ENTRY = 250


class Memo(dict):
    """word -> value, filled by compute(words).

    Two generations of at most about `limit` bytes each, keys and values counted: a full one becomes the old one, and
    words asked for again move up, so frequent words stay. It only saves work: values depend on the word alone. size:
    what a value takes.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], size: Callable = len, limit: int = 80_000_000):
        super().__init__()
        self.compute, self.size, self.limit, self.held, self.old = compute, size, limit, 0, {}

    def values_of(self, texts: list[list[str]]) -> list[list]:
        """The values of every word of every text; words not known yet are computed in one batch."""
        found = [list(map(self.get, words)) for words in texts]
        gaps = [k for k, values in enumerate(found) if None in values]
        if gaps:
            self._add({w for k in gaps for w, v in zip(texts[k], found[k], strict=True) if v is None})
            for k in gaps:
                found[k] = [self[w] if v is None else v for w, v in zip(texts[k], found[k], strict=True)]
        return found

    def _add(self, absent: set[str]) -> None:
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        again = {w: v for w, v in zip(absent, map(self.old.get, absent), strict=True) if v is not None} if self.old else {}
        new = [w for w in absent if w not in again]
        collects = gc.isenabled()
        gc.disable()  # many small objects without cycles: the collector would only walk through them
        try:
            values = list(self.compute(new))
        finally:
            if collects:
                gc.enable()
        self.update(zip(new, values, strict=True))
        self.update(again)
        for words, found in ((new, values), (again, again.values())):
            self.held += ENTRY * len(words) + sum(map(len, words)) + sum(map(self.size, found))
