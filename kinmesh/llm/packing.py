"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are encoded where they lie; a task packs them block by block. A document longer than a window gives whole
windows and a rest; rests and shorter documents stay whole. Within a block every piece begins as a partition of its own
(one window, the rest empty). Again and again the two partitions with the largest imbalance are merged, the
fullest windows of one with the emptiest of the other, until one partition of near-equal windows is left.

Documents may be cut freely, so a block is closed with as many tokens as its windows hold, and what the fullest windows
of the partition have too much is cut off and given to the emptiest: all become full, with about one cut for a window. With
``cut=False`` pieces stay whole: where the fullest window exceeds the capacity, the number of windows rises by one and the block is
packed again. What is left at the end of a task, less than a window, becomes sequences whose lengths are powers of two, which
need no padding. Nothing is shuffled; a task that is run again makes the same sequences.

Defined cases: a null text is an empty text; a document always has its end token, so an empty one is a piece of
length 1. Repeated rows are packed each by itself; ids may be null. An empty table packs into nothing. A very long text gives windows as soon
as it is encoded; its ids are held by one task. Other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import chunks, short_batches, table
from kinmesh.llm.encoding import default_vocabulary, encoder

CAPACITY = 2048
END_ID = 1
#: Pieces of a block.
BLOCK = 512


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by the largest differencing method for ``k`` windows."""
    n = len(sizes)
    window = np.zeros(n, dtype=np.int64)
    if k == 1 or n == 0:
        return window
    # A partition: sums by falling size, with the first and last member of each window's linked list.
    follow = np.full(n, -1, dtype=np.int64)
    empty = np.full(k - 1, -1, dtype=np.int64)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        ends = np.concatenate([[i], empty])
        heap.append((-int(size), i, sums, ends, ends))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        _, order, b, b_first, b_last = heapq.heappop(heap)
        b, b_first, b_last = b[::-1], b_first[::-1], b_last[::-1]
        both = (a_last >= 0) & (b_first >= 0)
        follow[a_last[both]] = b_first[both]
        first, last = np.where(a_first >= 0, a_first, b_first), np.where(b_last >= 0, b_last, a_last)
        sums = a + b
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, first[by], last[by]))
    _, _, _, first, _ = heap[0]
    members, at = first[first >= 0], np.flatnonzero(first >= 0)
    while len(members):
        window[members] = at
        members = follow[members]
        at, members = at[members >= 0], members[members >= 0]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows of at most ``capacity``: their number rises until none exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return window
        k += 1


def level(sizes: np.ndarray, window: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Cuts pieces so that no window exceeds the capacity: (window, piece, from, to), by window.

    The capacity of all windows together has to suffice.
    """
    sums = np.bincount(window, weights=sizes, minlength=int(window.max()) + 1).astype(np.int64)
    parts, spare = [], []
    order = np.lexsort((sizes, window))  # by window, small pieces first
    for i in order.tolist():
        keep, w = int(sizes[i]), int(window[i])
        if sums[w] > capacity and (over := min(keep, int(sums[w]) - capacity)):
            keep -= over
            sums[w] -= over
            spare.append((i, keep, keep + over))
        if keep:
            parts.append((w, i, 0, keep))
    rooms = iter(np.argsort(sums, kind="stable").tolist())
    w = next(rooms)
    for i, low, high in spare:
        while low < high:
            if not (room := capacity - int(sums[w])):
                w = next(rooms)
                continue
            end = min(high, low + room)
            parts.append((w, i, low, end))
            sums[w] += end - low
            low = end
    return sorted(parts)


class _Packer:
    """Collects pieces (doc index, start, ids, tokens of the document) of one task and packs them block by block."""

    def __init__(self, partition: int, capacity: int, piece: int, block: int, cut: bool):
        self.next_id = partition << 32
        self.capacity, self.piece, self.block, self.cut = capacity, min(piece, capacity), block, cut
        self.pieces: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.piece):
            part = ids[start : start + self.piece]
            if len(part) == self.capacity:
                self._emit([(doc_id, start, part, len(ids))], np.zeros(1, dtype=np.int64))
                continue
            self.pieces.append((doc_id, start, part, len(ids)))
            self.total += len(part)
            if len(self.pieces) >= self.block:
                self.close()

    def _take(self, want: int) -> list[tuple]:
        """Takes pieces of ``want`` tokens together out of those collected, cutting one if need be."""
        taken, held = [], 0
        while held < want:
            doc_id, start, part, n = self.pieces.pop()
            if held + len(part) > want:
                self.pieces.append((doc_id, start + want - held, part[want - held :], n))
                part = part[: want - held]
            taken.append((doc_id, start, part, n))
            held += len(part)
        self.total -= held
        return taken

    def _emit(self, pieces: list[tuple], window: np.ndarray) -> None:
        order = np.argsort(window, kind="stable")
        offset, before = 0, -1
        for i in order:
            doc_id, start, part, n = pieces[i]
            if window[i] != before:
                offset, before = 0, window[i]
                self.next_id += 1
            self.rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), n, self.next_id - 1, offset))
            offset += len(part)

    def close(self) -> None:
        """Packs as many pieces as fill whole windows; if pieces stay whole, all of them."""
        if not self.cut:
            taken, self.pieces, self.total = self.pieces, [], 0
            if taken:
                self._emit(taken, windows(np.array([len(p[2]) for p in taken]), self.capacity))
        elif k := self.total // self.capacity:
            taken = self._take(k * self.capacity)
            sizes = np.array([len(p[2]) for p in taken])
            parts = level(sizes, differencing(sizes, k), self.capacity)
            held = [(taken[i][0], taken[i][1] + low, taken[i][2][low:high], taken[i][3]) for _, i, low, high in parts]
            self._emit(held, np.array([w for w, _, _, _ in parts]))

    def finish(self) -> None:
        """Packs the rest: whole windows first, then sequences of falling powers of two."""
        self.close()
        while self.total:
            taken = self._take(1 << (self.total.bit_length() - 1))
            self._emit(taken, np.zeros(len(taken), dtype=np.int64))

    def drain(self, schema: pa.Schema):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, piece: int = CAPACITY, block: int = BLOCK, cut: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Parts longer than ``piece`` are cut beforehand.
    """
    short_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COLUMNS]])

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId(), capacity, piece, block, cut)
        encode = encoder(path).ids
        for batch in chunks(batches):
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.add(key, np.array([*(encode(t) if t else ()), END_ID], dtype="<u4"))
            if len(packer.rows) >= 4096:
                yield packer.drain(schema)
        packer.finish()
        if packer.rows:
            yield packer.drain(schema)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *_COLUMNS)))


def op8_packing(spark, sf_dir):
    """Packs all of ``documents`` into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
