"""Array helpers for windows of a fixed number of units (bytes or words).

``ids`` arrays name content: equal ids mean equal runs of units. Ids of
longer runs are made from those of shorter ones at later offsets. A run of
neighbouring windows whose smallest gram id is the same is a *segment*; the
inner segments of a passage are the same wherever the passage stands.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair(ids: np.ndarray, later: int) -> np.ndarray:
    """Ids of the longer runs made of ``ids[i]`` and ``ids[i + later]``.

    The ids must be spread already (results of ``mix`` or of this function):
    in plain bytes the changes of two high bits can cancel each other.
    """
    if len(ids) <= later:
        return np.empty(0, np.uint64)
    return mix(ids[: len(ids) - later] * _A + (ids[later:] ^ _C))


def bytes8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number (shorter by seven)."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        if len(x) <= step:
            return np.empty(0, np.uint64)
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


#: Positions that ``scan_bytes`` looks at together, so that what it makes stays in the processor's cache.
_BLOCK = 1 << 14
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_BASE = 0xD1342543DE82EF95
_POWER, _INVERSE = _powers(_BASE, 2 * _BLOCK), _powers(pow(_BASE, -1, 1 << 64), 2 * _BLOCK)


def checks(data: np.ndarray, length: int) -> np.ndarray:
    """A second id of each window of ``length`` bytes, by other arithmetic than ``pair``: a polynomial over spread bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWER[: len(data)], dtype=np.uint64)])
    return mix((total[length:] - total[:n]) * _INVERSE[:n])


def scan_bytes(data: np.ndarray, length: int, gram: int, *, want_windows: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The least gram id of each window of ``length`` bytes, the windows' ids, and their second ids.

    Ids of depth 8 are the bytes, spread; each next depth joins ids with
    those of later offsets: 16, 24 (the grams), 32, and ``length``.
    """
    if length > _BLOCK:
        raise ValueError(f"length must be {_BLOCK} at most")
    n = max(0, len(data) - length + 1)
    low = np.empty(n, np.uint64)
    ids, second = (np.empty(n, np.uint64), np.empty(n, np.uint64)) if want_windows else (None, None)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        d8 = mix(bytes8(data[a : b + length - 1]))
        d16 = pair(d8, 8)
        d24 = mix(d16[: len(d8) - gram + 8] * _A + (d8[gram - 8 :] ^ _C))
        low[a:b] = sliding_min(d24, length - gram + 1)
        if ids is not None:
            step, depth, d = 16, 16, d16
            while depth < length:
                step = min(depth, length - depth)
                d, depth = pair(d, step), depth + step
            ids[a:b] = d
            second[a:b] = checks(data[a : b + length - 1], length)
    return low, ids, second


def segments(low: np.ndarray, doc_of: np.ndarray, valid: np.ndarray, *windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """first window, number of windows, h (smallest gram), and for each of ``windows`` (an id a window) the sum of these, of each segment.

    low: the least gram of each window; valid: whether a window lies within
    one document.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        e = np.empty(0, np.uint64)
        return np.empty(0, np.int64), np.empty(0, np.int64), e, *([e] * len(windows))
    low, docs = low[at], doc_of[at]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (docs[1:] != docs[:-1])])
    starts = np.flatnonzero(new)
    size = np.diff(np.concatenate([starts, [len(at)]]))
    return at[starts], size, low[starts], *(np.add.reduceat(mix(w[at] ^ _A), starts) for w in windows)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether each of n units lies in ``length`` units from one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers first, first + 1, ... of each range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(firsts, sizes)
