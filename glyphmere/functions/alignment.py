"""Restricted Damerau distance and its alignment, for whole batches at once.

The distance matrix of every pair of a batch is filled row by row with numpy over
(pairs, columns): insertions, the only dependence inside a row, are a running
minimum. A traceback that moves all pairs together then visits substitutions;
at each cell it prefers the diagonal, then deletion, insertion, transposition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from glyphmere.functions.tables import Confusables, key_places

#: Cells of the matrices filled at once.
CELLS = 6_000_000
_PLACES = key_places()
MAX_KEY_DISTANCE = np.float32(max(np.float32(np.hypot(np.float32(x[0] - y[0]), np.float32(x[1] - y[1]))) for x in _PLACES.values() for y in _PLACES.values()))
_KEYS = np.full((128, 2), np.nan, np.float32)
for _c, _xy in _PLACES.items():
    _KEYS[ord(_c)] = _xy
    _KEYS[ord(_c.upper())] = _xy


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (pairs, longest), zeros after each end, and lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = max(1, int(lengths.max(initial=1)))
    out = np.zeros((len(strings), wide), np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(wide) < lengths[:, None]] = flat
    return out, lengths


def rows_of(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """(pairs, m + 1): distances of each prefix of ``a``, the empty one first, to all prefixes of ``b``."""
    n, m = a.shape[1], b.shape[1]
    kind = np.int16 if n + m < 1 << 15 else np.int32
    ramp = np.arange(m + 1, dtype=kind)
    before, last = None, np.broadcast_to(ramp, (len(a), m + 1))
    yield last
    for i in range(1, n + 1):
        x = a[:, i - 1, None]
        cand = np.empty((len(a), m + 1), kind)
        cand[:, 0] = i
        cand[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (x != b))
        if i > 1 and m > 1:
            swap = (x == b[:, :-1]) & (a[:, i - 2, None] == b[:, 1:])
            cand[:, 2:] = np.where(swap, np.minimum(cand[:, 2:], before[:, :-2] + 1), cand[:, 2:])
        before, last = last, np.minimum.accumulate(cand - ramp, axis=1) + ramp
        yield last


def matrices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, n + 1, m + 1): distances between prefixes."""
    d = None
    for i, row in enumerate(rows_of(a, b)):
        if d is None:
            d = np.empty((len(a), a.shape[1] + 1, b.shape[1] + 1), row.dtype)
        d[:, i] = row
    return d


def substitutions(d: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, i, j) of substituted characters, from the last to the first, one of a pair at a time."""
    i, j, rows = la.copy(), lb.copy(), np.arange(len(la))
    while len(rows := rows[(i[rows] > 0) | (j[rows] > 0)]):
        x, y = i[rows], j[rows]
        now = d[rows, x, y]
        inner = (x > 0) & (y > 0)
        x1, y1 = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        differ = a[rows, x1] != b[rows, y1]
        diagonal = inner & (d[rows, x1, y1] + differ == now)
        delete = ~diagonal & (x > 0) & (d[rows, x1, y] + 1 == now)
        insert = ~diagonal & ~delete & (y > 0) & (d[rows, x, y1] + 1 == now)
        swap = ~(diagonal | delete | insert)
        sub = diagonal & differ
        if sub.any():
            yield rows[sub], x1[sub], y1[sub]
        i[rows] = x - diagonal - delete - 2 * swap
        j[rows] = y - diagonal - insert - 2 * swap


def _chunks(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """Numbers of pairs of like length, few enough for CELLS."""
    size = np.array([(len(x) + 1, len(y) + 1) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    order = np.lexsort((size[:, 1], size[:, 0]))
    start, n, m = 0, 0, 0
    for k, at in enumerate(order):
        n, m = max(n, int(size[at, 0])), max(m, int(size[at, 1]))
        if k > start and (k + 1 - start) * n * m > CELLS:
            yield order[start:k]
            start, (n, m) = k, size[at].tolist()
    if start < len(order):
        yield order[start:]


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Distances alone: only the last rows are held, so memory is linear in the lengths."""
    out = np.zeros(len(a), np.int64)
    for at in _chunks(a, b):
        (x, lx), (y, ly) = codes([a[k] for k in at]), codes([b[k] for k in at])
        for i, row in enumerate(rows_of(x, y)):
            done = np.flatnonzero(lx == i)
            out[at[done]] = row[done, ly[done]]
    return out


def aligned(a: list[str], b: list[str], table: Confusables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, confusable substitutions, keyboard distance (NaN: undefined) of each pair."""
    dist, count, keys = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.full(len(a), np.nan)
    looks: dict[int, int] = {}
    number: dict[str, int] = {}

    def look(points: np.ndarray) -> np.ndarray:
        uniq, inverse = np.unique(points, return_inverse=True)
        for c in uniq.tolist():
            if c not in looks:
                looks[c] = number.setdefault(table.of(chr(c)), len(number))
        return np.array([looks[c] for c in uniq.tolist()], np.int64)[inverse] if len(uniq) else np.zeros(0, np.int64)

    for at in _chunks(a, b):
        (x, lx), (y, ly) = codes([a[k] for k in at]), codes([b[k] for k in at])
        d = matrices(x, y)
        dist[at] = d[np.arange(len(at)), lx, ly]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        same = np.zeros(len(at), np.int64)
        for rows, i, j in substitutions(d, x, y, lx, ly):
            p, q = x[rows, i], y[rows, j]
            same[rows] += look(p) == look(q)
            near = (p < 128) & (q < 128)
            gap = _KEYS[p[near]] - _KEYS[q[near]]
            steps.append((rows[near], np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1])))
        count[at] = same
        total, seen = np.zeros(len(at), np.float32), np.zeros(len(at), np.float32)
        for rows, gap in reversed(steps):  # first substitution first, in 32 bits
            ok = ~np.isnan(gap)
            total[rows[ok]] += gap[ok]
            seen[rows[ok]] += 1
        mean = np.clip(total / np.maximum(seen, np.float32(1)) / MAX_KEY_DISTANCE, np.float32(0), np.float32(1))
        ascii_pair = np.fromiter((a[k].isascii() and b[k].isascii() for k in at), bool, len(at))
        keys[at] = np.where(ascii_pair, np.where(seen > 0, mean, np.float32(0)).astype(np.float64), np.nan)
    return dist, count, keys
