"""String similarities in [0, 1] that Spark has no function for, from their published definitions.

The longest common subsequence is computed on whole bit vectors held in Python integers (Hyyrö 2004), so its cost is
one step for each character of the longer string.
:func:`kernel_table` evaluates all kernels of a pair in one Arrow function, each different pair of a batch once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinmesh.cluster import ship


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised Indel similarity."""
    total = len(a) + len(b)
    return 1.0 if not total else 2.0 * lcs(a, b) / total


def sort_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(sort_words(a), sort_words(b))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 1.0
    if not common:
        return ratio(left, right)
    with_left, with_right = f"{common} {left}", f"{common} {right}"
    return max(ratio(with_left, with_right), ratio(common, with_left), ratio(common, with_right))


def _partial(short: str, long: str) -> float:
    m, n = len(short), len(long)
    best = 0.0
    for start in range(1 - m, n):
        best = max(best, ratio(short, long[max(0, start) : min(n, start + m)]))
        if best == 1.0:
            break
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with the windows of its length in the longer one, cut at both ends."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_partial(a, b), _partial(b, a))
    return _partial(a, b) if len(a) < len(b) else _partial(b, a)


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    matched_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched_a.append(c)
                break
    m = len(matched_a)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched_a, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damerau(a: str, b: str) -> int:
    """Edit distance with unrestricted transpositions (Lowrance and Wagner 1975)."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


def normalised(distance: int, a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1.0 - distance / longest


KERNELS = {
    "ratio": ratio,
    "token_sort": token_sort,
    "token_set": token_set,
    "partial": partial,
    "partial_sort": lambda a, b: partial(sort_words(a), sort_words(b)),
    "jaro_winkler": jaro_winkler,
    "levenshtein": lambda a, b: normalised(levenshtein(a, b), a, b),
    "damerau": lambda a, b: normalised(damerau(a, b), a, b),
}


def kernel_table(strings: list[tuple[Column, Column, tuple[str, ...], str]]) -> Column:
    """Kernels of several pairs of string columns (nulls as '') in one Arrow function.

    ``strings`` holds left, right, names of kernels and a prefix; the struct has a field prefix_kernel for each. Whole
    batches are computed in numpy (:mod:`kinmesh.functions.batch`), each different pair of strings once.
    """
    chosen = [(prefix, names) for _, _, names, prefix in strings]
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf(", ".join(f"{prefix}_{n} double" for prefix, names in chosen for n in names))
    def run(*columns: pd.Series) -> pd.DataFrame:
        from kinmesh.functions import batch

        out = {}
        for (prefix, names), a, b in zip(chosen, columns[::2], columns[1::2], strict=True):
            left, right, back = batch.unique(a.fillna("").tolist(), b.fillna("").tolist())
            for n in names:
                out[f"{prefix}_{n}"] = batch.KERNELS[n](left, right)[back]
        return pd.DataFrame(out)

    return run(*[c for left, right, _, _ in strings for c in (left, right)])


def kernel_scores(left: Column, right: Column, names: tuple[str, ...]) -> Column:
    """A struct of the named kernels of two string columns."""
    made = kernel_table([(left, right, names, "k")])
    return F.struct(*[made[f"k_{n}"].alias(n) for n in names])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: both empty 1, one empty 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, by Spark's own function; both empty 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longest)
