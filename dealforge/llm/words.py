"""Words of many texts at once, as places in one byte array and as 64-bit ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd

from .windows import mix, ranges

_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts that a task looks at together, in bytes; a longer text is looked at alone.
PART_BYTES = 1 << 20


class WordArrays:
    """start, end, text_of, ids of each word; counts, first, last word of each text.

    Bytes of UTF-8 above ASCII are never separators, so words of bytes are
    the words of the text. ``lower`` lower-cases A-Z.
    """

    def __init__(self, texts: list[bytes], *, lower: bool = False) -> None:
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        inside = ~SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_of = np.searchsorted(text_end, self.start, side="right")
        self.counts = np.bincount(self.text_of, minlength=len(texts)).astype(np.int64)
        self.last = np.cumsum(self.counts)
        self.first = self.last - self.counts

    @cached_property
    def ids(self) -> np.ndarray:
        at, size = ranges(self.start, self.end - self.start), self.end - self.start
        place = (at - np.repeat(self.start, size)).astype(np.uint64)
        ids = np.add.reduceat(mix(self.data[at].astype(np.uint64) + np.uint64(1) + place * _STEP), np.cumsum(size) - size) if len(size) else np.empty(0, np.uint64)
        return mix(ids)


def parts(batches: Iterator[pd.DataFrame], size: int = PART_BYTES) -> Iterator[pd.DataFrame]:
    """Rows with a binary ``body``, some megabytes at a time."""
    for b in batches:
        n = np.cumsum(b["body"].str.len().to_numpy()) // size
        for _, part in b.groupby(n, sort=False):
            yield part
