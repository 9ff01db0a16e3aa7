"""Word shingles of whole texts as 64-bit hashes, over UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_LOWER = (_LOWER + _U(1)) * _U(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, _INVERSE):
            out = np.full(n, _U(base), dtype=_U)
            out[:1] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts (A-Z lower-cased, parted by blank and bytes 9 to 13): hash, row, first byte, end."""
    n = len(text)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~_SPACE[text]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_LOWER[text] * power[:n], out=sums[1:])
    h = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U))
    return h, np.searchsorted(offsets, a, side="right") - 1, a, b


def sets(text: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted, on end; and their n+1 offsets.

    A row with fewer than ``size`` words has its whole sequence as one shingle;
    a row without words has none.
    """
    rows = len(offsets) - 1
    if not len(text):
        return np.zeros(0, _U), np.zeros(rows + 1, dtype=np.int64)
    h, row, _, _ = words(text, offsets)
    count = np.bincount(row, minlength=rows)
    n = len(h)
    parts, owner = [], []
    if n >= size:
        g = np.zeros(n - size + 1, dtype=_U)
        for k in range(size):
            g = g * _U(_BASE) + h[k : n - size + 1 + k]
        whole = row[: n - size + 1] == row[size - 1 :]
        parts.append(mix(g[whole] + _U(size)))
        owner.append(row[: n - size + 1][whole])
    begin = np.cumsum(count) - count
    for short in range(1, size):
        some = np.flatnonzero(count == short)
        if len(some):
            g = np.zeros(len(some), dtype=_U)
            for k in range(short):
                g = g * _U(_BASE) + h[begin[some] + k]
            parts.append(mix(g + _U(short)))
            owner.append(some)
    if not parts:
        return np.zeros(0, _U), np.zeros(rows + 1, dtype=np.int64)
    value, of = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[first], of[first]
    return value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])
