"""Votes of a block of queries for a block of targets of one country, added up in one array of numbers.

The targets' postings are kept as arrays by key. A query reads those of its keys and adds their votes into an array with a place for each
target, so that votes never become rows; queries with the same keys are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a row of a block is.
TARGET, QUERY, PRUNED = 0, 1, 2
#: Pairs that leave at once.
OUT_ROWS = 1 << 18


def _coded(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different ids in ascending order, and for each row its place among them."""
    coded = ids.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def best_places(acc: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest positive numbers, higher first, of equal ones the first place first."""
    low, high = 1, int(acc.max(initial=0))
    while low < high:  # the largest limit that k numbers reach, or 1
        middle = (low + high + 1) // 2
        if np.count_nonzero(acc >= middle) >= k:
            low = middle
        else:
            high = middle - 1
    at = np.flatnonzero(acc >= low) if high else np.zeros(0, np.int64)
    score = acc[at]
    if len(at) > 2 * k:  # many have just the limit: no more of them than needed are sorted
        above = np.flatnonzero(score > low)
        chosen = np.concatenate([above, np.flatnonzero(score == low)[: k - len(above)]])
        at, score = at[chosen], score[chosen]
    return at[np.argsort(-score, kind="stable")[:k]]


class Postings:
    """Targets of a block by key."""

    def __init__(self, key: np.ndarray, target: np.ndarray, mult: np.ndarray, keys: int, targets: int):
        order = np.argsort(key * np.int64(max(targets, 1)) + target, kind="stable")
        key, target, mult = key[order], target[order], mult[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (target[1:] != target[:-1])]) if len(key) else np.zeros(0, np.int64)
        mult = np.add.reduceat(mult, first) if len(first) else mult  # of a repeated id
        key, self.target, self.mult = key[first], target[first], mult
        self.start = np.searchsorted(key, np.arange(keys + 1)).tolist()
        plain = np.add.reduceat(np.r_[mult != 1, False], np.minimum(self.start[:-1], len(mult))) == 0 if keys else np.zeros(0, bool)
        self.plain = (plain | (np.diff(self.start) == 0)).tolist()

    def add(self, acc: np.ndarray, keys: list[int], votes: list[int]) -> None:
        for k, v in zip(keys, votes, strict=True):
            at = self.target[self.start[k] : self.start[k + 1]]
            acc[at] += v if self.plain[k] else v * self.mult[self.start[k] : self.start[k + 1]]


def block_votes(block: pa.Table, k: int | None) -> Iterator[pa.Table]:
    """(s1_id, cand_id, score) of a block's rows (kind, id, keys): the best ``k`` of each query, or all pairs that share a key."""
    kind, lists = block.column("kind").to_numpy(), block.column("keys").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    key = flat.field("key").dictionary_encode()
    n_keys, key = len(key.dictionary), key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    weight, mult = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("weight", "mult"))
    row = np.repeat(np.arange(len(kind)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    ids, code = {}, np.zeros(len(kind), np.int64)
    every = block.column("id").combine_chunks()
    every = pa.concat_arrays(every.chunks) if isinstance(every, pa.ChunkedArray) else every
    for x in (TARGET, QUERY):
        ids[x], code[kind == x] = _coded(every.filter(pa.array(kind == x)))
    fine, of = np.ones(n_keys, bool), kind[row]
    fine[key[of == PRUNED]] = False
    asked = np.zeros(n_keys, bool)
    asked[key[of == QUERY]] = True
    chosen = (of == TARGET) & (fine & asked)[key]
    held = Postings(key[chosen], code[row[chosen]], mult[chosen], n_keys, len(ids[TARGET]))
    chosen = np.flatnonzero((of == QUERY) & fine[key])
    q, key, vote = code[row[chosen]], key[chosen], (weight * mult)[chosen]
    order = np.lexsort((vote, key, q))
    q, key, vote = q[order], key[order], vote[order]
    ends = np.searchsorted(q, np.arange(len(ids[QUERY]) + 1))
    most = int(held.mult.max(initial=1)) * int(np.add.reduceat(vote, ends[:-1][np.diff(ends) > 0]).max(initial=0)) if len(vote) else 0
    acc = np.zeros(len(ids[TARGET]), np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
    seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    rows = 0

    def made() -> pa.Table:
        s1 = np.repeat([i for i, _, _ in found], [len(a) for _, a, _ in found]).astype(np.int64)
        return pa.table(
            {
                "s1_id": ids[QUERY].take(pa.array(s1)),
                "cand_id": ids[TARGET].take(pa.array(np.concatenate([a for _, a, _ in found]))),
                "score": pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64)),
            }
        )

    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if a == b:
            continue
        same = key[a:b].tobytes() + vote[a:b].tobytes()
        if same not in seen:
            held.add(acc, key[a:b].tolist(), vote[a:b].tolist())
            at = np.flatnonzero(acc) if k is None else best_places(acc, k)
            result = (at, acc[at])
            acc[:] = 0
            if k is None:
                seen.clear()  # results may be long; only the last one is kept
            seen[same] = result
        at, score = seen[same]
        if len(at):
            found.append((i, at, score))
            rows += len(at)
        if rows >= OUT_ROWS:
            yield made()
            found, rows = [], 0
    if found:
        yield made()
