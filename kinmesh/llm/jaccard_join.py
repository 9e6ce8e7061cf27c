"""Similarity join of documents on five-word shingles (Jaccard), by a MinHash LSH forest.

Each of :data:`TREES` trees is a trie of signatures of :data:`DEPTH` MinHash values; sorted signatures are the trie. A
document starts with its full signatures and is met, in a tree, by the documents with the same prefix of the length
it has there. Its prefixes are then shortened, one value in one tree at a time, always where that lets in the fewest
documents, until it is met by a document at the threshold with the target recall: a prefix of d values finds one of
similarity s with probability s**d, in each tree anew. So prefixes stay long in crowded parts of a trie and become short in
sparse ones, down to :data:`SHORTEST`. How crowded a part is steers only this choice, never what is found.

Documents that meet are joined into candidate clusters if a longer sketch says that they may be linked. All pairs of a cluster are
then verified exactly on the sets of 64-bit shingles of the whole texts.

Copies with the same words are one representative throughout. A part of a trie, or a cluster, of up to :data:`WHOLE`
members is one group; the members of larger ones (or of more than :data:`WHOLE_BYTES` of shingles) are dealt into blocks of about that
size, and each pair of blocks is a group of its own, so no task holds more and no pair is lost. Pairs are counted inside
the tasks and never become rows; what leaves is a number of links for each representative and at most one link for each
member of a group, which suffices for classes (connected components of links).

Defined cases: words are white-space separated, lower-cased in A-Z. A text of one to four words has one shingle, all
its words. Null and empty texts, and those of white space, are linked to nothing. A repeated row is a copy. An id
may be null; such rows are classed under the least id of their class, or null if there is none. A very long text is
signed in slices; verification holds its set of shingles. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.llm.common import CHUNK_BYTES, SPACES, chunks, discard, materialise, short_batches, table, word_slices
from kinmesh.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, SHORTEST, RECALL = 32, 8, 4, 0.9999
#: Values of the sketch from which similarity is estimated (the first four of each tree), and how far below the
#: threshold an estimate may lie: four and a half standard errors at the threshold.
SKETCH = 4 * TREES
_MARGIN = 4.5 * (THRESHOLD * (1 - THRESHOLD) / SKETCH) ** 0.5
#: Members and bytes of shingles up to which a part of a trie or a cluster is one group.
WHOLE, WHOLE_BYTES = 1024, 24 << 20
#: Rows in which the crowding of a trie is looked at together.
_LOOK = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[1], np.full((1 << 16) - 1, 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: What a prefix of DEPTH, DEPTH - 1, ... SHORTEST values adds to -log(1 - recall) at the threshold.
GAINS = np.array([-math.log(1 - THRESHOLD**d) for d in range(DEPTH, SHORTEST - 1, -1)])


def prefix_lengths(crowding: np.ndarray) -> np.ndarray:
    """The prefix length of each document in each tree.

    ``crowding`` (documents, trees, lengths from DEPTH down to SHORTEST): how many documents share a prefix, in any increasing scale.
    """
    n = len(crowding)
    at = np.zeros((n, TREES), dtype=np.int64)
    cost = np.concatenate([crowding.astype(np.float64), np.full((n, TREES, 1), np.inf)], axis=2)
    need = -math.log(1 - RECALL) - np.full(n, GAINS[0] * TREES)
    row = np.arange(n)
    while len(row := row[need[row] > 0]):
        following = np.take_along_axis(cost[row], at[row][:, :, None] + 1, axis=2)[:, :, 0]
        tree = following.argmin(axis=1)
        open_ = np.isfinite(following[np.arange(len(row)), tree])
        row, tree = row[open_], tree[open_]
        now = at[row, tree]
        need[row] -= GAINS[np.minimum(now + 1, DEPTH - SHORTEST)] - GAINS[now]
        at[row, tree] = now + 1
    return DEPTH - at


def word_lists(text: bytes | None) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in slices; each but the first begins with the last words of the one before, whose number is given too."""
    words, old = [], 0
    for part in word_slices(text):
        words += part
        if len(words) >= SHINGLE:
            yield words, old
            words = words[1 - SHINGLE :]
            old = len(words)
    if len(words) > old:
        yield words, old


def shingles(words: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of all word lists in order (repeats included), and the number of them in each list."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(0, np.uint64), n
    data = np.frombuffer(b"".join(flat), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    h = np.add.reduceat(data * _POWERS[place & 0xFFFF], starts)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    made = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    # A shingle hashes the words from its first on: as many as it has, in order.
    first_word = np.cumsum(n) - n
    first = np.repeat(first_word, made) + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    length = np.repeat(np.minimum(n, size), made)
    total = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        at = np.minimum(first + k, len(h) - 1)
        total = np.where(k < length, (total + h[at]) * _STEP, total)
    total = (total ^ (total >> np.uint64(31))) * _MIX
    return total ^ (total >> np.uint64(33)), made


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def signatures(values: np.ndarray, made: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values for each text that has shingles (in order)."""
    made = made[made > 0]
    starts = np.cumsum(made) - made
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(made), count), dtype=np.uint32)
    for i, (a, b) in enumerate(zip(*_functions(count), strict=True)):
        x = (low ^ b) * a
        x ^= high
        x *= np.uint32(0x85EBCA6B)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _sign(texts: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """For each text the 128-bit name of its words (None without words), its number of shingles and its MinHash values."""
    names, made, sig = [], np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), TREES * DEPTH), dtype=np.uint32)
    short = [t if t is None or len(t) <= CHUNK_BYTES else None for t in texts]
    words = [next(word_lists(t), ([], 0))[0] for t in short]
    values, n = shingles(words)
    made[:] = n
    if len(values):
        sig[n > 0] = signatures(values, n, TREES * DEPTH)
    for i, t in enumerate(texts):
        if t is None or short[i] is not None:
            names.append(xxhash.xxh128_digest(b" ".join(words[i])) if words[i] else None)
            continue
        name, least = xxhash.xxh128(), None
        for part, old in word_lists(t):
            name.update((b" " if least is not None else b"") + b" ".join(part[old:]))
            values, n = shingles([part])
            found = signatures(values, n, TREES * DEPTH)
            least = found if least is None else np.minimum(least, found)
            made[i] += n[0]
        names.append(None if least is None else name.digest())
        if least is not None:
            sig[i] = least[0]
    return names, made, sig


def _signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, w1 and w2 (which name the word sequence), size (shingles), trees (a signature each, a byte for a value) and sketch; nulls for texts without words."""

    def run(batches):
        for batch in chunks(batches):
            names, made, sig = _sign(batch.column("text").cast(pa.binary()).to_pylist())
            values = (sig >> np.uint32(7)).astype(np.uint8).reshape(-1, TREES, DEPTH)
            trees = values.reshape(-1, DEPTH).view(">u8").astype(np.uint64).reshape(-1, TREES).view(np.int64)
            sketches = np.ascontiguousarray(values[:, :, : SKETCH // TREES]).reshape(len(sig), SKETCH)
            halves = [(None, None) if k is None else tuple(np.frombuffer(k, dtype=np.int64)) for k in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([x for x, _ in halves], pa.int64()), pa.array([y for _, y in halves], pa.int64()), pa.array(made)]
                + [pa.array([x if k else None for x, k in zip(trees, names, strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() if k else None for x, k in zip(sketches, names, strict=True)], pa.binary())],
                names=["doc_id", "text_hash", "w1", "w2", "size", "trees", "sketch"],
            )

    return _source(docs, text, doc_id).mapInArrow(run, "doc_id long, text_hash long, w1 long, w2 long, size long, trees array<long>, sketch binary")


def _crowding(batches):
    """Of sorted signatures, how many rows share each prefix: (rep, code), a code holding the tree and four bits for each length from DEPTH down.

    Four bits are the logarithm of the number. Rows are looked at in runs, so a number may be too small; rows that share no
    prefix of the shortest length are left out.
    """
    held: list[pa.RecordBatch] = []

    def out():
        rows = pa.Table.from_batches(held)
        held.clear()
        tree, rep = rows.column("tree").to_numpy().astype(np.int64), rows.column("rep").to_numpy()
        s = rows.column("s").to_numpy().view(np.uint64)
        code = tree << 20
        for k, d in enumerate(range(DEPTH, SHORTEST - 1, -1)):
            prefix = s >> np.uint64(8 * (DEPTH - d))
            starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])]))
            sizes = np.diff(np.append(starts, len(s)))
            each = np.repeat(sizes, sizes)
            code |= np.minimum(15, np.ceil(np.log2(each))).astype(np.int64) << (4 * k)
        near = each > 1  # of the shortest length
        return pa.RecordBatch.from_arrays([pa.array(rep[near]), pa.array(code[near].astype(np.int32))], names=["rep", "code"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _LOOK:
            yield out()
    if held:
        yield out()


def _lengths(batches):
    """(rep, lengths): the prefix length in each tree, a byte for each; trees without a code are empty there."""
    shift = 4 * np.arange(DEPTH - SHORTEST + 1)
    for batch in batches:
        codes = batch.column("codes")
        n = np.diff(codes.offsets.to_numpy())
        code = codes.flatten().to_numpy().astype(np.int64)
        crowding = np.zeros((batch.num_rows, TREES, len(shift)), dtype=np.int64)
        crowding[np.repeat(np.arange(batch.num_rows), n), code >> 20] = (code[:, None] >> shift) & 15
        lengths = prefix_lengths(crowding).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([x.tobytes() for x in lengths], pa.binary())], names=["rep", "lengths"])


def _dealt(rows: DataFrame, key: str, blocks, member: str) -> DataFrame:
    """Deals the members of each ``key`` into groups: all in one, or, of several ``blocks``, the pairs of blocks.

    Adds group, block and other: a row stands in its block's pairs with every block.
    """
    rows = rows.withColumn("__n", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(member), F.col("__n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumn("group", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("__n")


def _groups(batches, columns: list[str]):
    """The rows of each group as lists by column; rows come sorted by group, the first column."""
    held: dict[str, list] = {c: [] for c in columns}
    current = None
    for batch in batches:
        data = [batch.column(c).to_pylist() for c in columns]
        group = batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if current is not None and group[a] != current:
                yield held
                held = {c: [] for c in columns}
            current = group[a]
            for c, values in zip(columns, data, strict=True):
                held[c] += values[a:b]
    if current is not None:
        yield held


def _roots(n: int, near) -> np.ndarray:
    """The least member of each member's component; ``near`` gives pairs of a member and the array of those it is linked to."""
    root = np.arange(n)
    for i, linked in near:
        old = np.unique(np.append(root[linked], root[i]))
        if len(old) > 1:
            root[np.isin(root, old)] = old[0]
    return root


def _meetings(s: np.ndarray, length: np.ndarray, sketch: np.ndarray):
    """Of the members of a part of a trie (sorted signatures): each member that has a prefix length, with those that share its prefix and may be linked."""
    least = (THRESHOLD - _MARGIN) * SKETCH
    for d in np.unique(length):
        prefix = s >> np.uint64(8 * (DEPTH - int(d)))
        for i in np.flatnonzero(length == d):
            low, high = np.searchsorted(prefix, prefix[i]), np.searchsorted(prefix, prefix[i], side="right")
            if high - low > 1:
                yield i, low + np.flatnonzero((sketch[low:high] == sketch[i]).sum(axis=1) >= least)


def _candidate_links(batches):
    """At most one link for each member of a group: to the first member of its component of likely links."""
    us, vs = [], []
    for held in _groups(batches, ["rep", "s", "length", "sketch"]):
        if len(held["rep"]) == 1:
            continue
        s = np.array(held["s"], dtype=np.int64).view(np.uint64)
        order = np.argsort(s, kind="stable")
        reps, length = np.array(held["rep"], dtype=np.int64)[order], np.array(held["length"])[order]
        sketch = np.frombuffer(b"".join(held["sketch"]), dtype=np.uint8).reshape(len(reps), SKETCH)[order]
        root = _roots(len(reps), _meetings(s[order], length, sketch))
        far = np.flatnonzero(root != np.arange(len(reps)))
        us += reps[far].tolist()
        vs += reps[root[far]].tolist()
        if len(us) > 50_000:
            yield pa.RecordBatch.from_pydict({"u": us, "v": vs}, schema=_LINK)
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_pydict({"u": us, "v": vs}, schema=_LINK)


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_VERIFIED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _sets(batches):
    """(rep, cluster, copies, blocks, shingles): the different shingles of each text as bytes."""
    for batch in chunks(batches):
        made = []
        for t in batch.column("text").cast(pa.binary()).to_pylist():
            own = np.zeros(0, np.uint64)
            for words, _ in word_lists(t):
                own = np.union1d(own, shingles([words])[0])
            made.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "cluster", "copies", "blocks")), pa.array(made, pa.binary())], names=["rep", "cluster", "copies", "blocks", "shingles"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share.

    Shingles of many sets are multiplied as columns of ones, a slice at a time; those of few are counted pair by pair.
    """
    n = len(sets)
    common = np.zeros((n, n), dtype=np.int32)
    if n <= 24:
        own = [set(s.tolist()) for s in sets]
        for i in range(n):
            for j in range(i):
                if min(len(own[i]), len(own[j])) >= THRESHOLD * max(len(own[i]), len(own[j])):
                    common[i, j] = common[j, i] = len(own[i] & own[j])
        return common
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    held_by = np.diff(np.append(starts, len(values)))
    each = np.repeat(held_by, held_by)
    few = max(16, n // 64)
    light, heavy = (each > 1) & (each <= few), each > few
    r, column = row[light], values[light]
    for step in range(1, few):
        same = np.flatnonzero(column[step:] == column[:-step])
        if not len(same):
            break
        found = np.bincount(r[same] * n + r[same + step], minlength=n * n).reshape(n, n).astype(np.int32)
        common += found + found.T
    r, column = row[heavy], np.repeat(np.arange(int((held_by > few).sum())), held_by[held_by > few])
    for low in range(0, int((held_by > few).sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        held = np.zeros((n, 2048), dtype=np.float32)
        held[r[a:b], column[a:b] - low] = 1
        common += (held @ held.T).astype(np.int32)
    return common


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is at least the threshold."""
    sizes, common = np.array([len(s) for s in sets], dtype=np.int32), _common(sets)
    linked = common >= THRESHOLD * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verified_links(batches):
    """For each representative of a group the documents it is linked to (n), and links that join components (u, v)."""
    us, vs, ns = [], [], []
    for held in _groups(batches, ["rep", "copies", "block", "shingles"]):
        reps, order = np.unique(np.array(held["rep"], dtype=np.int64), return_index=True)  # a repeated row comes again
        sets = [np.frombuffer(held["shingles"][i], dtype=np.uint64) for i in order]
        copies, block = np.array(held["copies"], dtype=np.int64)[order], np.array(held["block"])[order]
        linked = _linked(sets)
        if len(np.unique(block)) > 1:
            linked &= block[:, None] != block[None, :]  # pairs within a block belong to the group of that block alone
        count = linked @ copies
        root = _roots(len(reps), ((i, np.flatnonzero(linked[i])) for i in range(len(reps))))
        for i in np.flatnonzero(count):
            us.append(int(reps[i]))
            vs.append(int(reps[root[i]]))
            ns.append(int(count[i]))
        if len(us) > 50_000:
            yield pa.RecordBatch.from_pydict({"u": us, "v": vs, "n": ns}, schema=_VERIFIED)
            us, vs, ns = [], [], []
    if us:
        yield pa.RecordBatch.from_pydict({"u": us, "v": vs, "n": ns}, schema=_VERIFIED)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, n_links and chosen; a written table.

    class_id is the least doc_id of the class (connected component of links). n_links counts the other rows of
    similarity 0.8 or more, copies included. chosen holds for the row that may stand for its class (and its repeats).
    """
    short_batches(docs.sparkSession)
    signed = materialise(_signed(docs, text, doc_id), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    own = signed.filter("w1 is not null").groupBy("w1", "w2")
    # One representative of each sequence of words; its number is given once, as the table is written.
    reps = own.agg(F.min(row).alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("trees").alias("trees"), F.first("sketch").alias("sketch"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    # The forest: sorted signatures, what is near in them, and prefix lengths from that.
    entries = reps.select("rep", F.posexplode("trees").alias("tree", "s"))
    crowded = entries.repartitionByRange("tree", "s", "rep").sortWithinPartitions("tree", "s", "rep").mapInArrow(_crowding, "rep long, code int")
    lengths = crowded.groupBy("rep").agg(F.collect_list("code").alias("codes")).mapInArrow(_lengths, "rep long, lengths binary")
    lengths = materialise(lengths, "lengths")
    # Parts of the forest below a shortest prefix that several representatives share, and in them the links that are likely.
    part = (F.col("tree").cast("long") * (1 << 32) + F.shiftrightunsigned("s", 8 * (DEPTH - SHORTEST))).alias("part")
    entries = entries.select("rep", "tree", "s", part)
    shared = entries.groupBy("part").agg(F.count("*").alias("members")).filter("members > 1")
    met = entries.join(shared, "part").join(reps.select("rep", "sketch").join(lengths, "rep", "left"), "rep")
    met = met.withColumn("length", F.coalesce(F.conv(F.hex(F.expr("substring(lengths, tree + 1, 1)")), 16, 10).cast("int"), F.lit(SHORTEST)))
    met = _dealt(met.drop("lengths"), "part", F.ceil(F.col("members") / WHOLE), "rep").select("group", "rep", "s", "length", "sketch")
    likely = met.repartition("group").sortWithinPartitions("group").mapInArrow(_candidate_links, "u long, v long")
    joined = components(likely)
    clusters = joined.select(F.col("u").alias("rep"), F.col("v").alias("cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct())
    # Shingles of the clustered representatives, and all pairs of a cluster verified on them.
    inside = materialise(clusters.join(reps.select("rep", "row", "copies", "size"), "rep"), "clusters")
    discard(joined, lengths)
    held = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / WHOLE), F.ceil(F.sum("size") * 8 / WHOLE_BYTES)).alias("blocks"))
    asked = inside.join(held, "cluster").select("rep", "cluster", "copies", "blocks", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))
    texts = _source(docs, text, doc_id)
    # Merged at every size: which texts are asked for is not bounded, so it is never broadcast.
    met = asked.hint("merge").join(texts, asked["doc_id"].eqNullSafe(texts["doc_id"]) & (asked["text_hash"] == texts["text_hash"])).select("rep", "cluster", "copies", "blocks", "text")
    met = met.mapInArrow(_sets, "rep long, cluster long, copies long, blocks long, shingles binary")
    met = _dealt(met, "cluster", F.col("blocks"), "rep").select("group", "rep", "copies", "block", "shingles")
    verified = materialise(met.repartition("group").sortWithinPartitions("group").mapInArrow(_verified_links, "u long, v long, n long"), "verified")
    joined = components(verified.select("u", "v"))
    counts = verified.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    found = reps.select("rep", "w1", "w2", "row", "copies").join(joined.select(F.col("u").alias("rep"), F.col("v").alias("class")), "rep", "left").join(counts, "rep", "left")
    found = found.select("w1", "w2", "row", F.coalesce("class", "rep").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = materialise(found, "found")
    least = materialise(found.groupBy("class").agg(F.min("row").alias("least")), "least")
    found_all = found.join(least, "class").select("w1", "w2", "n_links", "least")
    worded = signed.filter("w1 is not null").select("doc_id", "text_hash", "w1", "w2").join(found_all, ["w1", "w2"]).select(
        "doc_id",
        "text_hash",
        F.col("least.doc_id").alias("class_id"),
        "n_links",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("chosen"),
    )
    alone = signed.filter("w1 is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("chosen"))
    result = materialise(worded.unionByName(alone), "classes")
    discard(signed, reps, inside, verified, joined, found, least)
    return result


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does; rows without words all stay."""
    chosen = classes(docs, text, doc_id).filter("chosen").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    t = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    key = F.col(f"`{doc_id}`").cast("long")
    rows = docs.withColumn("__hash2", t).join(chosen, key.eqNullSafe(F.col("__id")) & (F.col("__hash2") == F.col("__hash")))
    worded = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES, "") != ""
    rank = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, doc_id)] or [F.lit(0)]))
    return rows.withColumn("__rank", rank).filter((F.col("__rank") == 1) | ~worded).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_jaccard_join(spark, sf_dir):
    """Class and number of links of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: The same by exact counting of shared shingles. The forest may miss a pair at the threshold with a probability below 1 - RECALL.
ORACLE = rf"""
with recursive t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as g from t),
n as (select r, count(*) as n from s group by r),
c as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by all),
l as materialized (select x, y from c join n p on p.r = x join n q on q.r = y where c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9),
reach as (select r as x, r as y from t union select reach.x, l.y from reach join l on reach.y = l.x),
classes as (select x, min(doc_id) as class_id from reach join t on t.r = reach.y group by x),
links as (select x, count(*) as n_links from l group by x)
select doc_id, class_id, coalesce(n_links, 0) as n_links from t join classes on classes.x = t.r left join links on links.x = t.r
"""
