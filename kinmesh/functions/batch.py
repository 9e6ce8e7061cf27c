"""The kernels of :mod:`kinmesh.functions.kernels` for many pairs at once, in numpy.

A pair's shorter string is a set of bit masks in one machine word, so a step of the common-subsequence recurrence is a few
vector operations over all pairs. Common subsequences of a string with all windows of another, and those of strings that do not fit a word, come
from the strands of a sticky braid (Tiskin 2008), by anti-diagonals. Pairs that no vector form takes are left to the scalar kernels.
"""

from __future__ import annotations

import numpy as np

from kinmesh.functions import kernels as K

WORD = 63
#: Cells of a slice's tables (by the power of a length that they grow as), and the longest string that such tables take.
_CELLS, LONGEST = {1: 250_000, 2: 1_000_000}, 400
_ONE = np.uint64(1)


class Strings:
    """Strings as padded rows of character numbers; 0 is the padding."""

    def __init__(self, *columns: list[str]):
        self.parts = []
        points = [np.frombuffer("".join(c).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for c in columns]
        every = np.concatenate(points)
        met = np.zeros(int(every.max(initial=0)) + 1, dtype=bool)
        met[every] = True
        numbers = np.cumsum(met)[every] - 1
        self.letters = int(met.sum()) + 1
        at = 0
        for c, p in zip(columns, points, strict=True):
            sizes = np.fromiter(map(len, c), dtype=np.int64, count=len(c))
            rows = np.zeros((len(c), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
            row = np.repeat(np.arange(len(c)), sizes)
            rows[row, np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers[at : at + len(p)] + 1
            self.parts.append((rows, sizes))
            at += len(p)


def _masks(rows: np.ndarray, sizes: np.ndarray, letters: int) -> np.ndarray:
    """For each string and letter the bits of the places that have it."""
    masks = np.zeros((len(rows), letters), dtype=np.uint64)
    every = np.arange(len(rows))
    for i in range(min(rows.shape[1], WORD)):
        here = np.where(i < sizes, _ONE << np.uint64(i), np.uint64(0))
        masks[every, rows[:, i]] |= here
    masks[:, 0] = 0
    return masks


def _lcs(masks: np.ndarray, own: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Common subsequence of string own[i] (masks) with row i of ``other``."""
    full = (_ONE << sizes[own].astype(np.uint64)) - _ONE
    state = full.copy()
    for j in range(other.shape[1]):
        u = state & masks[own, other[:, j]]
        state = ((state + u) | (state - u)) & full
    return sizes[own] - np.bitwise_count(state)


def unique(a: list[str], b: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    index: dict[tuple[str, str], int] = {}
    back = np.fromiter((index.setdefault(p, len(index)) for p in zip(a, b, strict=True)), dtype=np.int64, count=len(a))
    pairs = list(index)
    return [p[0] for p in pairs], [p[1] for p in pairs], back


def _batched(scalar, a: list[str], b: list[str], vector, fits, power: int = 1) -> np.ndarray:
    """``vector`` for the pairs that fit, in slices of bounded size; ``scalar`` for the others.

    A pair's tables grow as the ``power`` of its length.
    """
    out = np.zeros(len(a))
    good = np.fromiter(map(fits, a, b), dtype=bool, count=len(a))
    for i in np.flatnonzero(~good):
        out[i] = scalar(a[i], b[i])
    at = np.flatnonzero(good)
    total = np.fromiter(map(len, a), dtype=np.int64, count=len(a))[at] + np.fromiter(map(len, b), dtype=np.int64, count=len(b))[at] + 1
    order = np.argsort(total, kind="stable")
    at, cost, low = at[order], total[order] ** power, 0
    while low < len(at):
        size = max(16, _CELLS[power] // int(cost[low]))
        size = max(16, _CELLS[power] // int(cost[min(low + size, len(at)) - 1]))  # the longest of a slice bounds it
        part = at[low : low + size].tolist()
        out[part] = vector([a[i] for i in part], [b[i] for i in part])
        low += size
    return out


def _strands(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where the strand that ends below each column (axis 0) of ``other`` begins: at that column, or negative for one from the left.

    The strands of a braid of ``rows`` and ``other`` (pairs by places; paddings match nothing): of a string and the columns from i to j, the common
    subsequence is j - i less the strands that begin at i or after and end before j.
    """
    a, b = np.ascontiguousarray(rows.T[::-1]).astype(np.int32), np.ascontiguousarray(other.T).astype(np.int32)
    b[b == 0] = -1
    m, n = len(a), len(b)
    small = np.int16 if m + n < 2**15 else np.int32
    left = np.repeat(np.arange(-m, 0, dtype=small)[:, None], a.shape[1], axis=1)  # by places from the last one
    top = np.repeat(np.arange(n, dtype=small)[:, None], a.shape[1], axis=1)
    for d in range(m + n - 1):
        first, end = max(0, d - m + 1), min(n, d + 1)
        at = slice(first + m - 1 - d, end + m - 1 - d)
        h, v = left[at], top[first:end]
        both = h ^ v
        low = np.minimum(h, v)
        # Strands that meet at equal characters turn, as those do that have crossed before.
        held = low ^ ((v ^ low) & -(a[at] == b[first:end]).astype(small))
        left[at] = held
        np.bitwise_xor(both, held, out=top[first:end])
    return top


def _ends(sizes: np.ndarray, places: int) -> np.ndarray:
    return np.arange(places)[:, None] < sizes


def _short(a: str, b: str) -> bool:
    return min(len(a), len(b)) <= WORD


def _fits(a: str, b: str) -> bool:
    return max(len(a), len(b)) <= LONGEST


def _shorter_first(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    short, long = zip(*(((x, y) if len(x) <= len(y) else (y, x)) for x, y in zip(a, b, strict=True)), strict=True)
    return list(short), list(long)


def _ratio(a: list[str], b: list[str]) -> np.ndarray:
    s = Strings(*_shorter_first(a, b))
    (rows, sizes), (other, n) = s.parts
    if sizes.max() <= WORD:
        common = _lcs(_masks(rows, sizes, s.letters), np.arange(len(rows)), sizes, other)
    else:
        common = n - ((_strands(rows, other) >= 0) & _ends(n, other.shape[1])).sum(axis=0)
    return np.where(sizes + n == 0, 1.0, 2.0 * common / np.maximum(sizes + n, 1))


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    return _batched(K.ratio, a, b, _ratio, _fits)


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Strings of which one fits a word and others apart, as their forms differ."""
    fit = np.fromiter(map(_short, a, b), dtype=bool, count=len(a))
    if fit.all():
        return _ratios(a, b)
    out = np.zeros(len(a))
    for at in (np.flatnonzero(fit), np.flatnonzero(~fit)):
        out[at] = _ratios([a[i] for i in at], [b[i] for i in at])
    return out


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    return ratio([K.sort_words(x) for x in a], [K.sort_words(x) for x in b])


def token_set(a: list[str], b: list[str]) -> np.ndarray:
    """Up to three ratios for each pair, all computed in one go."""
    left, right, owner = [], [], []
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            continue
        common, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if common and (not p or not q):
            out[i] = 1.0
            continue
        asked = [(p, q)] if not common else [(f"{common} {p}", f"{common} {q}"), (common, f"{common} {p}"), (common, f"{common} {q}")]
        for u, v in asked:
            left.append(u)
            right.append(v)
            owner.append(i)
    if owner:
        np.maximum.at(out, owner, ratio(left, right))
    return out


def _partial_one_way(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio with the windows from s to s + m, s from 1 - m to n - 1: a strand from p to e is in those of e - m < s <= p."""
    (rows, m), (other, n) = Strings(short, long).parts
    begin = _strands(rows, other)
    places, every = np.arange(other.shape[1])[:, None], np.arange(len(m))
    last = places - m + 1
    chosen = (begin >= last) & (begin >= 0) & (places < n)
    width = rows.shape[1]
    steps = np.zeros((width + other.shape[1] + 1, len(m)), dtype=np.int32)  # windows by s + width
    pair = np.broadcast_to(every, begin.shape)[chosen]
    np.add.at(steps, (np.broadcast_to(last, begin.shape)[chosen] + width, pair), 1)
    np.add.at(steps, (begin[chosen].astype(np.int64) + 1 + width, pair), -1)
    s = np.arange(-width, other.shape[1] + 1)[:, None]
    size = np.minimum(n, s + m) - np.maximum(s, 0)
    good = (s >= 1 - m) & (s < n)
    found = np.where(good, 2.0 * (size - steps.cumsum(axis=0)) / np.maximum(m + size, 1), 0.0)
    return found.max(axis=0)


def _partial(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    asked = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            out[i] = float(x == y)
        elif len(x) == len(y):
            asked += [(x, y, i), (y, x, i)]
        else:
            asked.append((x, y, i) if len(x) < len(y) else (y, x, i))
    if asked:
        np.maximum.at(out, [i for _, _, i in asked], _partial_one_way([x for x, _, _ in asked], [y for _, y, _ in asked]))
    return out


def partial(a: list[str], b: list[str]) -> np.ndarray:
    return _batched(K.partial, a, b, _partial, _fits)


def partial_sort(a: list[str], b: list[str]) -> np.ndarray:
    return partial([K.sort_words(x) for x in a], [K.sort_words(x) for x in b])


def _meet(s: Strings, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each side that Jaro's rule matches; right strings fit a word."""
    (x, n), (y, m) = s.parts
    masks = _masks(y, m, s.letters)
    free = (_ONE << m.astype(np.uint64)) - _ONE
    hit = np.zeros(x.shape, dtype=bool)
    every = np.arange(len(x))
    for i in range(x.shape[1]):
        low, high = np.maximum(0, i - reach), np.minimum(m, i + reach + 1)
        window = np.where(high > low, ((_ONE << np.maximum(high, 0).astype(np.uint64)) - _ONE) & ~((_ONE << np.minimum(low, WORD).astype(np.uint64)) - _ONE), np.uint64(0))
        found = masks[every, x[:, i]] & window & free
        first = found & (~found + _ONE)
        free &= ~first
        hit[:, i] = first > 0
    taken = (~free[:, None] >> np.arange(y.shape[1], dtype=np.uint64)) & _ONE > 0
    return hit, taken & (np.arange(y.shape[1]) < m[:, None])


def _meet_long(s: Strings, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings of any length."""
    (x, n), (y, m) = s.parts
    x, y = x.astype(np.int32), np.where(y > 0, y, -1).astype(np.int32)
    hit, free, every, reach = np.zeros(x.shape, dtype=bool), np.ones(y.shape, dtype=bool), np.arange(len(x)), reach.astype(np.int32)[:, None]
    places = np.arange(y.shape[1], dtype=np.int32)
    for i in range(x.shape[1]):
        found = (y == x[:, i : i + 1]) & free & (np.abs(places - i) <= reach)
        j = found.argmax(axis=1)
        hit[:, i] = found[every, j]
        free[every, j] &= ~hit[:, i]
    return hit, ~free


def _jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    s = Strings(a, b)
    (x, n), (y, m) = s.parts
    hit, taken = (_meet if m.max() <= WORD else _meet_long)(s, np.maximum(0, np.maximum(n, m) // 2 - 1))
    count = hit.sum(axis=1)
    width = max(1, int(count.max(initial=0)))
    seq = []
    for rows, marks in ((x, hit), (y, taken)):
        order = np.zeros((len(rows), width), dtype=np.int64)
        r, c = np.nonzero(marks)
        order[r, (np.cumsum(marks, axis=1) - 1)[r, c]] = rows[r, c]
        seq.append(order)
    swapped = (seq[0] != seq[1]).sum(axis=1) // 2
    jaro = np.where(count > 0, (count / np.maximum(n, 1) + count / np.maximum(m, 1) + (count - swapped) / np.maximum(count, 1)) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    prefix = np.cumprod((x[:, :k] == y[:, :k]) & (x[:, :k] > 0), axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    return _batched(K.jaro_winkler, a, b, _jaro_winkler, lambda x, y: x and y and _fits(x, y))


def _edit(a: list[str], b: list[str], swaps: bool) -> np.ndarray:
    """Edit distances by rows of the table, all places of all pairs at once; with unrestricted transpositions if asked."""
    (x, n), (y, m) = Strings(a, b).parts
    x, y = np.ascontiguousarray(x.T).astype(np.int32), np.ascontiguousarray(np.where(y > 0, y, -1).T).astype(np.int32)
    (w, p), h, every = x.shape, len(y), np.arange(len(a))
    j = np.arange(h + 1, dtype=np.int32)[:, None]
    d = np.empty((w + 2, h + 2, p), dtype=np.int32)  # place [i + 1, j + 1] is of prefixes i and j, place 0 is out of reach
    d[0], d[:, 0], d[1, 1:] = w + h, w + h, j
    seen = np.zeros((h, p), dtype=np.int32)  # the last row before that has the character of a column
    for i in range(1, w + 1):
        same = y == x[i - 1]
        best = np.empty((h + 1, p), dtype=np.int32)
        best[0] = i
        np.minimum(d[i, 1:-1] + ~same, d[i, 2:] + 1, out=best[1:])
        if swaps:
            match = np.zeros((h, p), dtype=np.int32)  # the last column before that has the character of this row
            np.maximum.accumulate(np.where(same[:-1], j[1:-1], 0), axis=0, out=match[1:])
            moved = d.reshape(-1)[(seen * np.int32(h + 2) + match) * np.int64(p) + every]
            np.minimum(best[1:], moved + (i - seen) + (j[1:] - match) - 1, out=best[1:])
            seen[same] = i
        d[i + 1, 1:] = np.minimum.accumulate(best - j, axis=0) + j
    distance = d[n + 1, m + 1, every]
    longest = np.maximum(n, m)
    return np.where(longest == 0, 1.0, 1.0 - distance / np.maximum(longest, 1))


def levenshtein(a: list[str], b: list[str]) -> np.ndarray:
    return _batched(K.KERNELS["levenshtein"], a, b, lambda x, y: _edit(x, y, False), _fits, 2)


def damerau(a: list[str], b: list[str]) -> np.ndarray:
    return _batched(K.KERNELS["damerau"], a, b, lambda x, y: _edit(x, y, True), _fits, 2)


KERNELS = {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial, "partial_sort": partial_sort, "jaro_winkler": jaro_winkler, "levenshtein": levenshtein, "damerau": damerau}
