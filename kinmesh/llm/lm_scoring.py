"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The model is a word bigram with Katz back-off. After a history h (a word or the start of a text), a token w (a word or the end) whose
pair with h is in the filter has probability (count - :data:`DISCOUNT`) / (c(h) + :data:`KAPPA`); the mass that is
left goes to the other tokens in proportion to their unigram probability (c(w) + 1) / (N + V + 1), in which one unit is for unknown words
as a kind. The probabilities of all known words, the unknown kind and the end sum to 1.

Pairs and words that training has seen twice or more are in the filter, at every size. A count is quantised downwards on a
logarithmic scale (two levels for each power of two), and a key of level q is in the filter as (key, 1) to (key, q).
Probing (key, 1), (key, 2), ... until one is missing gives the level back, never too low (Talbot and Osborne, 2007);
a pair's level is held to those of its words, which undoes most false positives. The filter is built in segments by many tasks and grows with its
items; building raises an error if the share of false positives exceeds :data:`FALSE_POSITIVES`. It is broadcast as a file that
Spark fetches once to each executor and that its workers map, so it takes page cache and no memory of their own. At most :data:`MOST_BITS` bits
are broadcast at once: a larger filter is dealt by key into parts, and the texts are scored in one pass for each part, which
counts the tokens whose pairs lie there.

What a word adds to a score apart from the filter (c(w), and as a history c(h) and the back-off weight) is a table that grows with the corpus.
A bounded number of the most frequent words is broadcast, which covers most occurrences and takes the hot keys out of the join;
of other words a document's occurrences are added up and joined with the table.

Defined cases: a null text is an empty one, which has only the end token. Repeated rows count each time and are
scored each. With no training documents every count is 0 and every score too. Words are told apart by 64-bit hashes. A very long
text is taken in slices. Columns that are carried and have the name of a result are replaced by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.cluster import shared_folder
from kinmesh.llm.common import CHUNK_BYTES, chunks, discard, fold, materialise, short_batches, table

DISCOUNT, KAPPA = 0.75, 2
#: Least count of what is in the filter.
LEAST = 2
#: Bits of the filter that are broadcast at once, at most (a power of two): a file of 1 GB.
MOST_BITS = 1 << 33
LEAST_BITS = 1 << 20
BITS_PER_ITEM = 14
#: Share of absent keys that may seem present, at most.
FALSE_POSITIVES = 0.005
#: Segments of a part of the filter (a power of two), each built by one group.
SEGMENTS = 512
#: Most frequent words that are broadcast, at most.
HOT_WORDS = 1 << 19
#: Bytes of text that are looked at together, and different pairs that a task counts before it passes them on.
TOGETHER, FLUSH = 3 << 20, 1 << 21

#: No word holds a space, so these stand for the start and the end of a text.
START, END = b"  ", b" "
#: The history under which single words are counted.
_ALONE = np.int64(0)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: A factor for each hash function of the filter.
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest  # seed 42 as in Spark's xxhash64
    return np.array([digest(w, 42) for w in words], dtype=np.uint64).view(np.int64)


_START_HASH, _END_HASH = (int(_hashes([w])[0]) for w in (START, END))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def keys_of(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The filter key of each pair of hashes."""
    return _mix(_mix(h.view(np.uint64)) * _MULT + w.view(np.uint64))


#: Least count of each level from 1 on: 2, 3, 4, 6, 8, 12, ...
LEVELS = np.array([(2 + m) << e for e in range(50) for m in (0, 1)], dtype=np.int64)


def quantise(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 below :data:`LEAST`."""
    return np.searchsorted(LEVELS, counts, side="right")


def _floor(c: str) -> Column:
    """The least count of the level of a count of two or more, as a column."""
    return F.expr(f"shiftleft(shiftright({c}, cast(length(bin({c})) - 2 as int)), cast(length(bin({c})) - 2 as int))")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the filter that holds each key."""
    return (keys >> np.uint64(20) & np.uint64(0xFFFFF)) % np.uint64(parts)


@dataclass
class LogFrequencyFilter:
    bits: np.ndarray  # bytes of all segments of the part
    segment_bits: int
    hashes: int
    part: int = 0
    parts: int = 1

    def _has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The numbers of the keys that are in the filter with this level; one that misses a bit is not asked for the next."""
        alive = np.arange(len(keys))
        segment, h, shift = _placed(keys, level, self.segment_bits)
        base = segment * (self.segment_bits >> 3)
        for f in _FACTORS[: self.hashes]:
            p = (h * f >> shift).astype(np.int64)
            found = (self.bits[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 > 0
            alive, h, base = alive[found], h[found], base[found]
        return alive

    def levels(self, keys: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The level of each key, ``most`` at most, by membership probes from level 1 upwards."""
        level = np.zeros(len(keys), dtype=np.uint8)
        alive = np.arange(len(keys))
        for q in range(1, len(LEVELS) + 1):
            if most is not None:
                alive = alive[most[alive] >= q]
            alive = alive[self._has(keys[alive], q)]
            if not len(alive):
                break
            level[alive] = q
        return level


def _placed(keys: np.ndarray, level: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """The segment of each key, and what gives its places there: a hash times a factor, shifted."""
    h = _mix(keys + np.array([level], dtype=np.uint64) * _MULT)
    return (keys % np.uint64(SEGMENTS)).astype(np.int64), h, np.uint64(65 - segment_bits.bit_length())


def _fill(keys: np.ndarray, levels: np.ndarray, segment_bits: int, hashes: int) -> bytes:
    """The bytes of one segment that holds each key up to its level."""
    bits = np.zeros(segment_bits, dtype=bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        _, h, shift = _placed(keys[levels >= q], q, segment_bits)
        for f in _FACTORS[:hashes]:
            bits[(h * f >> shift).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _slices(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about :data:`CHUNK_BYTES` that end between words; the last one is marked."""
    at = 0
    while len(text) - at > CHUNK_BYTES and (end := _SPACE.search(text, at + CHUNK_BYTES)):
        yield text[at : end.start()], False
        at = end.start()
    yield text[at:], True


def runs(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of texts, about :data:`TOGETHER` bytes at a time: different words, and for each token its history, itself and its text by number.

    Arrow lower-cases and splits by ASCII rules only, as the word definition has it.
    """
    last_word, held, size = START, [], 0

    def out():
        nonlocal last_word, size
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([s for _, s, _ in held], pa.binary()).cast(pa.string())))
        flat = split.flatten()
        worded = pc.greater(pc.binary_length(flat), 0)
        n = np.diff(np.concatenate([[0], np.cumsum(worded.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()])
        coded = flat.filter(worded).dictionary_encode()
        words = [*coded.dictionary.cast(pa.binary()).to_pylist(), START, END, last_word]
        start, end, carried = range(len(words) - 3, len(words))
        ends = np.array([last for _, _, last in held])
        sizes = n + ends
        token = np.full(int(sizes.sum()), end, dtype=np.int64)
        own = np.ones(len(token), dtype=bool)
        own[(np.cumsum(sizes) - 1)[ends]] = False
        token[own] = coded.indices.to_numpy()
        text = np.repeat(np.array([i for i, _, _ in held], dtype=np.int64), sizes)
        history = np.concatenate([[carried], token[:-1]])
        history[1:][text[1:] != text[:-1]] = start
        last_word = START if ends[-1] else words[token[-1]] if len(token) and text[-1] == held[-1][0] else last_word
        held.clear()
        size = 0
        return words, history[: len(token)], token, text

    for i, t in enumerate(texts):
        for part, last in _slices(t or b""):
            held.append((i, part, last))
            size += len(part)
            if size >= TOGETHER:
                yield out()
    if held:
        yield out()


def _binary(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _added(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums c by pairs (h, w); a few may stay apart. Rows of a history come together, which packs well."""
    order = np.argsort((h & ~np.int64(0xFFFFFF)) | (w >> 40 & 0xFFFFFF))
    h, w, c = h[order], w[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
    return h[first], w[first], np.add.reduceat(c, first)


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, w, c): how often token w follows h, as hashes, and how often it occurs at all (h 0); pairs from :data:`LEAST` on. A written table."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("c", pa.int64())])

    def run(batches):
        held = []

        def out():
            h, w, c = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for low in range(0, len(h), 1 << 16):
                s = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(w[s]), pa.array(c[s])], schema=schema)

        for batch in chunks(batches, limit=TOGETHER):
            for words, history, token, _ in runs(_binary(batch)):
                hashes, n = _hashes(words), len(words)
                pair, c = np.unique(history * n + token, return_counts=True)
                once = np.bincount(token, minlength=n)
                own = np.flatnonzero(once)
                held.append((np.concatenate([hashes[pair // n], np.full(len(own), _ALONE)]), np.concatenate([hashes[pair % n], hashes[own]]), np.concatenate([c, once[own]])))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from out()
        if held:
            yield from out()

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))
    return materialise(found.filter((F.col("h") == int(_ALONE)) | (F.col("c") >= LEAST)), "counts")


@dataclass
class Model:
    tokens: int  # in training, N
    kinds: int  # different ones, V
    docs: int
    segment_bits: int
    hashes: int
    parts: int

    @property
    def unit(self) -> float:
        """log10 of one unit of the unigram probability."""
        return -math.log10(self.tokens + self.kinds + 1)


def train(counts: DataFrame, n_docs: int, bits_per_item: float = BITS_PER_ITEM) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the filter's segments (part, segment, bytes) and the words (w, c, alpha, d), both written tables.

    alpha is log10 of a word's back-off weight and d that of its denominator as a history.
    """
    alone = counts.filter(F.col("h") == int(_ALONE)).select("w", "c")
    pairs = counts.filter(F.col("h") != int(_ALONE))
    stats = alone.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    whole = stats["n"] + stats["v"] + 1
    # What a history has given to its own followers, in its own measure and in that of unigrams.
    given = pairs.join(alone.withColumnRenamed("c", "cw"), "w").groupBy("h").agg(F.sum(_floor("c") - DISCOUNT).alias("own"), (F.sum(F.col("cw") + 1.0) / whole).alias("all"))
    start = counts.sparkSession.range(1).select(F.lit(_START_HASH).alias("w"), F.lit(n_docs).cast("long").alias("c"))
    words = alone.unionByName(start).join(given.withColumnRenamed("h", "w"), "w", "left").na.fill(0.0, ["own", "all"])
    d = F.col("c") + KAPPA
    words = words.select("w", "c", F.log10((1 - F.col("own") / d) / (1 - F.col("all"))).alias("alpha"), F.log10(d.cast("double")).alias("d"))
    words = materialise(words, "words")
    items_of = counts.filter(F.col("c") >= LEAST)
    items = items_of.agg(F.coalesce(F.sum(2 * F.length(F.bin("c")) - 3), F.lit(0))).first()[0]  # levels, or one more
    parts = max(1, math.ceil(items * bits_per_item / MOST_BITS))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, (int(items * bits_per_item) - 1).bit_length())))  # of a part
    if bits_per_item < BITS_PER_ITEM:
        parts, bits = 1, max(SEGMENTS * 8, 1 << max(0, int(items * bits_per_item).bit_length() - 1))
    segment_bits = bits // SEGMENTS
    hashes = int(min(10, max(1, round(parts * bits / max(items, 1) * math.log(2)))))

    def fill(batches):
        """Rows come sorted by part and segment."""
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("bytes", pa.binary()), ("ones", pa.int64())])
        held, current = [], None

        def out():
            keys, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            made = _fill(keys, quantise(c), segment_bits, hashes)
            ones = int(np.unpackbits(np.frombuffer(made, dtype=np.uint8)).sum())
            return pa.RecordBatch.from_pydict({"part": [current // SEGMENTS], "segment": [current % SEGMENTS], "bytes": [made], "ones": [ones]}, schema=schema)

        for batch in batches:
            place = batch.column("place").to_numpy()
            keys, c = batch.column("key").to_numpy().view(np.uint64), batch.column("c").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and place[a] != current:
                    yield out()
                current = int(place[a])
                held.append((keys[a:b], c[a:b]))
        if held:
            yield out()

    def keyed(batches):
        for batch in batches:
            keys = keys_of(batch.column("h").to_numpy(), batch.column("w").to_numpy())
            place = part_of(keys, parts).astype(np.int64) * SEGMENTS + (keys % np.uint64(SEGMENTS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(keys.view(np.int64)), batch.column("c")], names=["place", "key", "c"])

    dealt = items_of.mapInArrow(keyed, "place long, key long, c long").repartition("place").sortWithinPartitions("place")
    filled = materialise(dealt.mapInArrow(fill, "part int, segment int, bytes binary, ones long"), "filter")
    ones = filled.agg(F.coalesce(F.sum("ones"), F.lit(0))).first()[0]
    if (ones / (parts * bits)) ** hashes > FALSE_POSITIVES:
        raise ValueError(f"the filter is too small for its {items} items: {ones} of {parts * bits} bits are set")
    return Model(stats["n"], stats["v"], n_docs, segment_bits, hashes, parts), filled, words


def publish(model: Model, filled: DataFrame, part: int) -> str:
    """Broadcasts one part of the filter as a file: its segments in order. Returns the file's name."""
    context = filled.sparkSession.sparkContext
    folder, size, at = shared_folder(filled.sparkSession), model.segment_bits >> 3, 0
    name = f"{folder.rsplit('/', 1)[-1]}.filter"
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path)
    for row in filled.filter(F.col("part") == part).orderBy("segment").toLocalIterator():  # one segment at a time
        for _ in range(at, row["segment"]):
            out.write(bytes(size))
        out.write(bytes(row["bytes"]))
        at = row["segment"] + 1
    for _ in range(at, SEGMENTS):
        out.write(bytes(size))
    out.close()
    context.addFile(path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString())
    return name


def opened(model: Model, name: str, part: int = 0) -> LogFrequencyFilter:
    """A part of the filter, mapped from the file that was broadcast."""
    return LogFrequencyFilter(np.asarray(np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r")), model.segment_bits, model.hashes, part, model.parts)


@dataclass
class FrequentWords:
    w: np.ndarray  # sorted hashes
    c: np.ndarray
    alpha: np.ndarray
    d: np.ndarray

    def of(self, hashes: np.ndarray):
        """Which words are held, and their c, alpha and d (0 for others)."""
        at = np.minimum(np.searchsorted(self.w, hashes), len(self.w) - 1)
        held = self.w[at] == hashes
        return held, *(np.where(held, x[at], 0) for x in (self.c, self.alpha, self.d))


def frequent(words: DataFrame) -> FrequentWords:
    """The start, the end and the most frequent words: a histogram of counts says from which count on there are :data:`HOT_WORDS` at most."""
    special = F.col("w").isin(_START_HASH, _END_HASH)
    at, least = 0, None
    for row in words.filter(~special).groupBy(_floor("c + 1").alias("q")).agg(F.count("*").alias("k"), F.min("c").alias("c")).orderBy(F.desc("q")).collect():
        at += row["k"]
        if at > HOT_WORDS:
            break
        least = row["c"]
    held = words.filter(special if least is None else special | (F.col("c") >= least)).toArrow()
    if not held.num_rows:
        return FrequentWords(*(np.zeros(1, t) for t in (np.int64, np.int64, float, float)))
    order = np.argsort(held.column("w").to_numpy())
    return FrequentWords(*(held.column(c).to_numpy()[order] for c in ("w", "c", "alpha", "d")))


#: What a token whose pair has a level adds besides its history's denominator.
_SEEN = np.concatenate([[0.0], np.log10(LEVELS - DISCOUNT)])


def _look_up(texts: list[bytes | None], model: Model, held: LogFrequencyFilter, hot: FrequentWords):
    """What texts get from frequent words and the part ``held`` of the filter.

    Arrays n_words (tokens of pairs of this part), known, base and lm, and for words that are not frequent columns (text, hash,
    occurrences, those with no pair, as a history with no pair and with one).
    """
    sums = np.zeros((4, len(texts)))
    rare = []
    for words, history, token, text in runs(texts):
        hashes = _hashes(words)
        is_hot, c, alpha, d = hot.of(hashes)
        level = quantise(c).astype(np.uint8)
        level[hashes == _START_HASH] = 255
        cold = np.flatnonzero(~is_hot)
        keys = keys_of(np.full(len(cold), _ALONE), hashes[cold])
        mine = part_of(keys, model.parts) == held.part
        # of a word that lies in another part the level is not known here: it bounds nothing
        level[cold] = 255
        level[cold[mine]] = held.levels(keys[mine])
        pairs, back = np.unique(history * len(words) + token, return_inverse=True)
        first, second = pairs // len(words), pairs % len(words)
        keys = keys_of(hashes[first], hashes[second])
        if model.parts > 1:
            here = part_of(keys, model.parts) == held.part
            own = np.flatnonzero(here[back])
            history, token, text, back = history[own], token[own], text[own], (np.cumsum(here) - 1)[back[own]]
            first, second, keys = first[here], second[here], keys[here]
        q = held.levels(keys, np.minimum(level[first], level[second]))[back]
        seen = q > 0
        n, log_c = len(texts), np.log10(c + 1.0)
        sums[0] += np.bincount(text, minlength=n)
        sums[1] += np.bincount(text, weights=(is_hot & (c > 0))[token], minlength=n)
        sums[2] += np.bincount(text, weights=log_c[token] + model.unit, minlength=n)
        sums[3] += np.bincount(text, weights=np.where(seen, _SEEN[q] - d[history], log_c[token] + model.unit + alpha[history]), minlength=n)
        t, h = np.flatnonzero(~is_hot[token]), np.flatnonzero(~is_hot[history])
        place, back = np.unique(np.concatenate([text[t] * len(words) + token[t], text[h] * len(words) + history[h]]), return_inverse=True)
        add = lambda x, at: np.bincount(at, weights=x, minlength=len(place)).astype(np.int64)
        as_token, as_history = back[: len(t)], back[len(t) :]
        rare.append((place // len(words), hashes[place % len(words)], add(None, as_token), add(~seen[t], as_token), add(~seen[h], as_history), add(seen[h], as_history)))
    return sums, [np.concatenate(x) for x in zip(*rare, strict=True)] if rare else [np.zeros(0, np.int64)] * 6


_RARE = ("w", "k", "b", "a", "s")


def score(docs: DataFrame, training: Column, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    Rows for which ``training`` holds are learned from. A written table.
    """
    spark = docs.sparkSession
    short_batches(spark)
    results = {"row_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    own = [c for c in carry if c.lower() not in results]
    counts = count(docs.filter(training), text)
    n_docs = counts.filter((F.col("h") == int(_ALONE)) & (F.col("w") == _END_HASH)).select("c").first()
    model, filled, words = train(counts, n_docs["c"] if n_docs else 0)
    discard(counts)
    hot = frequent(words)
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), *[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias("text"))
    if model.parts > 1:
        source = materialise(source, "numbered")  # each pass meets the same numbers
    rare_type = pa.struct([(c, pa.int64()) for c in _RARE])
    made = T._parse_datatype_string("n_tokens long, known long, base double, lm double, rare array<struct<w: long, k: long, b: long, a: long, s: long>>")

    def passed(sent, name, number):
        def run(batches):
            m, frequent_words = sent.value
            part = opened(m, name, number)
            for batch in chunks(batches, limit=TOGETHER):
                sums, rare = _look_up(_binary(batch), m, part, frequent_words)
                order = np.argsort(rare[0], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rare[0], minlength=batch.num_rows))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x[order]) for x in rare[1:]], fields=list(rare_type)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), listed], names=["row_id", *own, *made.names])

        return run

    rows = []
    sent = spark.sparkContext.broadcast((model, hot))
    for number in range(model.parts):
        name = publish(model, filled, number)
        rows.append(materialise(source.mapInArrow(passed(sent, name, number), T.StructType([*source.schema.fields[:-1], *made.fields])), "rows"))
    sent.unpersist()
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    rare = both.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.*").join(words, "w", "left")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)
    seen_after = F.coalesce(F.col("d"), F.lit(math.log10(KAPPA)))
    rare = rare.groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * log_c).alias("rare_base"),
        F.sum(F.col("b") * log_c + F.col("a") * F.coalesce("alpha", F.lit(0.0)) - F.col("s") * seen_after).alias("rare_lm"),
    )
    both = both.drop("rare")
    if model.parts > 1:
        both = rows[0].select("row_id", *own).join(both.groupBy("row_id").agg(*[F.sum(c).alias(c) for c in made.names[:4]]), "row_id")
    sure = lambda c: F.coalesce(F.col(c), F.lit(0))
    result = both.join(rare, "row_id", "left").select(
        *[F.col(f"`{c}`") for c in own],
        "n_tokens",
        (F.col("known") + sure("rare_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + sure("rare_base")).alias("base_score"),
        (F.col("lm") + sure("rare_lm")).alias("score"),
    )
    result = materialise(result, "scores")
    discard(filled, words, *rows, *([source] if model.parts > 1 else []))
    return result


def op2_lm_scoring(spark, sf_dir):
    """Scores every whole text of ``documents`` by models of the rows whose crc32(doc_id) modulo 7 is not 2."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score(docs, ~F.col("held_out"), carry=("doc_id", "held_out"))
