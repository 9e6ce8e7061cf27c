"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of :data:`PASSAGE_WORDS` words. Every passage is encoded as a fixed vector: the
shares of pairs of byte classes, of hashed words, and a few word statistics. A small network maps it to a
hidden vector; gated attention (tanh times sigmoid) weighs the passages of a document; the weighted passage
vector is scored by a logistic unit. Only document labels are known in training, so the attention learns
by itself which passages matter (Ilse, Tomczak and Welling, 2018).

The network is learned from a bounded, hashed sample of labelled documents and has a fixed size, whatever the
corpus. Scoring is one pass over whole texts; nothing is shuffled.

Defined cases: a null or empty text is a bag with one passage without words. Without labels of both values every score
is the share of label 1 (0 if there are no labels). Repeated rows are scored alike. A very long text is encoded and scored in slices.
Columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import CHUNK_BYTES, annotate, chunks, fold, labelled_sample, short_batches, table

PASSAGE_WORDS = 64
#: Labelled documents of each value that are learned from, about.
TRAIN_PER_CLASS = 1200
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 14, 32, 3e-3
THRESHOLD = 0.7

_GROUPS = (" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?!", "\"'()[]", "#", "*", "$%", "&", "|", "<>", "-_/=+~^@\\`{}")
_CLASSES = len(_GROUPS) + 2
_WORD_BUCKETS = 64
_STATS = 6
WIDTH = _CLASSES * _CLASSES + _WORD_BUCKETS + _STATS


def _class_table() -> np.ndarray:
    classes = np.full(256, _CLASSES - 1, dtype=np.int64)  # control bytes, bytes within a character
    classes[0xC0:] = _CLASSES - 2  # first bytes of characters beyond ASCII
    for i, group in enumerate(_GROUPS):
        classes[list(group.encode())] = i
    return classes


_CLASS = _class_table()
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Random numbers by byte and place in the word; their sum is a word's hash.
_HASH = np.random.default_rng(20).integers(0, 1 << 63, size=(256, 32), dtype=np.uint64)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of all texts, and the index of each text's first passage."""
    return _encode([(t or "").encode("utf-8", "replace") + b"\n" for t in texts])


def slices(text: str) -> Iterator[np.ndarray]:
    """The passage vectors of a long text, slice by slice; together they are those of the whole text."""
    raw = text.encode("utf-8", "replace") + b"\n"
    total = sum(np.count_nonzero(~(b := _SPACE[np.frombuffer(raw[low : low + CHUNK_BYTES], dtype=np.uint8)])[1:] & b[:-1]) + (not b[0] and (low == 0 or _SPACE[raw[low - 1]])) for low in range(0, len(raw), CHUNK_BYTES))
    low = 0
    while low < len(raw):
        size = CHUNK_BYTES
        while True:  # up to the last word that begins a passage; a passage of very long words needs a longer slice
            part = np.frombuffer(raw[low : low + size], dtype=np.uint8)
            if low + size >= len(raw):
                end = len(part)
                break
            blank = _SPACE[part]
            begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            if (n := (len(begins) - 1) // PASSAGE_WORDS * PASSAGE_WORDS) > 0:
                end = int(begins[n])
                break
            size *= 2
        yield _encode([raw[low : low + end]], raw[low + end : low + end + 1] or b"\n", int(total))[0]
        low += end


def _encode(raw: list[bytes], next_byte: bytes = b"\n", total_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that end in a line break; or of one part of a text, with the byte after it and the words of the whole."""
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    doc_start = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=doc_start[1:])
    blank = _SPACE[data]
    before = np.concatenate([[True], blank[:-1]])
    word_at = np.flatnonzero(~blank & before)
    word_doc = np.searchsorted(doc_start, word_at, side="right") - 1
    words = np.bincount(word_doc, minlength=len(raw))
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(passages)[:-1]])
    total = int(passages.sum())
    word_passage = first[word_doc] + (np.arange(len(word_at)) - first_word[word_doc]) // PASSAGE_WORDS
    # A byte belongs to the passage of the last word that began before it in its text.
    step = np.zeros(len(data), dtype=np.int64)
    step[doc_start[:-1]] = np.diff(np.concatenate([[0], first]))
    opens = np.flatnonzero(np.diff(word_passage, prepend=-1) > 0)
    inner = opens[word_passage[opens] > first[word_doc[opens]]]
    np.add.at(step, word_at[inner], 1)
    last = first + passages - 1
    step[doc_start[1:-1]] -= (last - first)[:-1]
    passage = np.cumsum(step)
    vectors = np.zeros((total, WIDTH), dtype=np.float32)
    classes = _CLASS[data]
    after = np.append(classes[1:], 1)
    after[doc_start[1:] - 1] = _CLASS[next_byte[0]]  # a text ends in a line break, whatever text comes next
    n_pairs = _CLASSES * _CLASSES
    vectors[:, :n_pairs] = np.bincount(passage * n_pairs + classes * _CLASSES + after, minlength=total * n_pairs).reshape(total, n_pairs)
    vectors[:, :n_pairs] /= np.maximum(np.bincount(passage, minlength=total), 1)[:, None]
    if len(word_at):
        solid = np.flatnonzero(~blank)
        word_of = np.cumsum(~blank & before)[solid] - 1
        place = np.minimum(solid - word_at[word_of], 31)
        hashes = np.add.reduceat(_HASH[data[solid], place], np.searchsorted(word_of, np.arange(len(word_at))))
        sizes = np.bincount(word_of, minlength=len(word_at)).astype(np.float64)
        held = np.maximum(np.bincount(word_passage, minlength=total), 1)
        buckets = (hashes >> np.uint64(40)).astype(np.int64) % _WORD_BUCKETS
        vectors[:, n_pairs : n_pairs + _WORD_BUCKETS] = np.bincount(word_passage * _WORD_BUCKETS + buckets, minlength=total * _WORD_BUCKETS).reshape(total, _WORD_BUCKETS) / held[:, None]
        mean = np.bincount(word_passage, weights=sizes, minlength=total) / held
        together = word_passage[1:] == word_passage[:-1]
        same = together & (hashes[1:] == hashes[:-1])
        key = np.sort((word_passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)
        stats = (
            mean / 8,
            np.sqrt(np.maximum(np.bincount(word_passage, weights=sizes**2, minlength=total) / held - mean**2, 0)) / 8,
            np.bincount(word_passage[1:][same], minlength=total) / held,
            distinct / held,
            np.bincount(word_passage, minlength=total) / PASSAGE_WORDS,
            np.log1p(np.repeat(words, passages) if total_words is None else np.full(total, total_words)) / 10,
        )
        for i, s in enumerate(stats):
            vectors[:, n_pairs + _WORD_BUCKETS + i] = s
    return vectors, first


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]
    shift: float


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    sizes = np.diff(np.append(first, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    a = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return h, t, s, a, z, z @ p["c"] + p["d"][0], sizes


def _forward_slices(p: dict[str, np.ndarray], slices_of: Iterable[np.ndarray]) -> float:
    """The logit of one document, slice by slice: sums of the attention are carried along and scaled by their largest exponent."""
    most, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in slices_of:
        h = np.tanh(x @ p["W"] + p["b"])
        e = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
        now = max(most, float(e.max()))
        w = np.exp(e - now)
        total, z = total * np.exp(most - now) + w.sum(), z * np.exp(most - now) + w @ h
        most = now
    return float(z / total @ p["c"] + p["d"][0])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the documents, by backward propagation."""
    h, t, s, a, z, logit, sizes = _forward(p, x, first)
    g = (1 / (1 + np.exp(-logit)) - y) / len(y)
    gz = np.repeat(g[:, None] * p["c"], sizes, axis=0)
    ga = (gz * h).sum(axis=1)
    ge = a * (ga - np.repeat(np.add.reduceat(a * ga, first), sizes))
    gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
    gh = (a[:, None] * gz + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ gh, "b": gh.sum(axis=0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": np.array([g.sum()])}


def fit(bags: list[np.ndarray], labels: list[int], totals: dict[int, int], seed: int = 7) -> AttentionModel:
    """Learns the network by Adam from bags of passage vectors with one label each."""
    n_all, n_1 = sum(totals.values()), totals.get(1, 0)
    y = np.array(labels, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        share = n_1 / n_all if n_all else 0.0
        logit = float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share else -700.0)
        return AttentionModel(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {}, logit)
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(bags).astype(np.float32)
    mean, scale = stacked.mean(axis=0), np.sqrt(stacked.var(axis=0) + 1e-6)
    bags = [np.clip((b.astype(np.float32) - mean) / scale, -6, 6) for b in bags]
    p = {"W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]])
            grads = _gradients(p, x, first, y[chosen])
            grads["W"] += 1e-4 * p["W"]
            step += 1
            for k, v in grads.items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.999 * m2[k] + 0.001 * v * v
                p[k] = (p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    prior = np.log(n_1 / (n_all - n_1)) - np.log(y.mean() / (1 - y.mean()))
    return AttentionModel(mean, scale, p, float(prior))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, left_out: int = 2, per_class: int = TRAIN_PER_CLASS) -> AttentionModel:
    short_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, per_class, folds, left_out)

    def bags(batches):
        for batch in chunks(batches):
            vectors, first = encode(batch.column("text").to_pylist())
            parts = [v.astype(np.float16).tobytes() for v in np.split(vectors, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column("label")], names=["bag", "label"])

    rows = sorted((bytes(r["bag"]), r["label"]) for r in sample.mapInArrow(bags, "bag binary, label int").toLocalIterator())
    return fit([np.frombuffer(b, dtype=np.float16).reshape(-1, WIDTH) for b, _ in rows], [k for _, k in rows], totals)


def score_texts(model: AttentionModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """score and predicted for each text."""
    if not texts:
        return np.zeros(0), np.zeros(0, np.int32)
    logit = np.zeros(len(texts))
    if model.params:
        scaled = lambda vectors: np.clip((vectors - model.mean) / model.scale, -6, 6)
        long = [i for i, t in enumerate(texts) if t and len(t) > CHUNK_BYTES]
        vectors, first = encode([None if i in long else t for i, t in enumerate(texts)])
        logit = _forward(model.params, scaled(vectors), first)[5].astype(np.float64)
        for i in long:
            logit[i] = _forward_slices(model.params, map(scaled, slices(texts[i])))
    score = 1 / (1 + np.exp(-np.clip(logit + model.shift, -700, 700)))
    return score, (score >= THRESHOLD).astype(np.int32)


def classify(docs: DataFrame, model: AttentionModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carry``) with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, {"score": "double", "predicted": "int"}, lambda texts: score_texts(sent.value, texts), text, carry)


def op10_quality_classifier(spark, sf_dir):
    """Scores every whole text of ``documents`` for quality, as ``labels.quality`` marks it."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
