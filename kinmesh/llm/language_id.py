"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every character that is no letter becomes a space; n-grams of one to three
characters fall into a fixed number of buckets. A matrix of log probabilities (bucket x language) is
broadcast and texts are scored in numpy: a text is a sparse row, the buckets that occur with their counts, which is
multiplied with the rows of the matrix. The matrix has ``languages * BUCKETS`` numbers whatever the size of the corpus;
:data:`MOST_LANGUAGES` bounds it, and more languages are refused with an error. Long texts are taken in slices of :data:`SLICE`
characters, so memory beyond a text and its lower-cased copy does not grow with its length.

Defined cases: a null text or one without a letter is ``und`` with score and likeness 0; so is every text if no
document could be learned from. Rows with a null language teach nothing. Repeated rows are judged alike; of languages with the
same probability the first by name is taken. Columns named like a result are replaced by it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import annotate, chunks, fold, short_batches, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 256
#: About so many documents of each language are learned from: a bounded, hashed sample.
TRAIN_DOCS_PER_LANGUAGE = 4000
#: Characters that are looked at together.
SLICE = 1 << 18
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def _slices(text: str | None) -> Iterator[tuple[str, str]]:
    """A lower-cased text, ended by two spaces, in slices, each with the two characters before it (spaces at the start)."""
    lowered = (text or "").lower() + "  "
    for low in range(0, len(lowered), SLICE):
        yield lowered[low - 2 : low] if low else "  ", lowered[low : low + SLICE]


def _grams(before: str, characters: str) -> tuple[np.ndarray, bool]:
    """The buckets of all n-grams that end in ``characters`` and are not only spaces, and whether there is a letter."""
    points = _letters()[np.frombuffer((before + characters).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = points == 32
    shift = BUCKETS.bit_length() - 1
    total = np.zeros(len(points) - 2, dtype=np.uint32)
    found = []
    for n in ORDERS:
        back = points[3 - n : len(points) + 1 - n]
        total = total * _MIX[0] + (back + np.uint32(n)) * _MIX[1]
        bucket = ((total ^ (total >> np.uint32(15))) * _MIX[2]) >> np.uint32(32 - shift)
        found.append(bucket[~(space[2:] if n == 1 else space[2:] & space[1:-1])])
    return np.concatenate(found), not space[2:].all()


def sparse_row(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The buckets that occur in a text, by number, their counts, and whether it has a letter."""
    counts, lettered, buckets = None, False, None
    for before, characters in _slices(text):
        buckets, own = _grams(before, characters)
        lettered |= own
        if len(characters) < SLICE and counts is None and len(buckets) < BUCKETS // 16:
            return *np.unique(buckets, return_counts=True), lettered
        held = np.bincount(buckets, minlength=BUCKETS)
        counts = held if counts is None else counts + held
    at = np.flatnonzero(counts)
    return at, counts[at], lettered


@dataclass
class LanguageModel:
    languages: list[str]
    log_probs: np.ndarray  # (BUCKETS, languages)
    log_priors: np.ndarray
    #: Mean log probability of an n-gram of each language in training, under its own language.
    typical: np.ndarray | None = None


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> LanguageModel:
    """Learns from a hashed sample of about ``per_language`` documents of each language."""
    spark = docs.sparkSession
    short_batches(spark)
    known = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_language / n))])
    sample = known.filter((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    index = {k: i for i, k in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in chunks(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for t, k in zip(texts, langs, strict=True):
                at, n, _ = sparse_row(t)
                counts[index[k], at] += n
        for k in languages:
            if counts[index[k]].any():
                yield pa.RecordBatch.from_pydict({"lang": [k], "counts": [counts[index[k]].tobytes()]})

    # The sample is bounded, so it is gathered into a few tasks and their counts are summed here.
    counts = np.zeros((len(languages), BUCKETS))
    for row in sample.repartition(6).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        counts[index[row["lang"]]] += np.frombuffer(row["counts"], dtype=np.int64)
    smoothed = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    priors = np.array([totals[k] for k in languages], dtype=float)
    typical = (counts * smoothed).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
    return LanguageModel(languages, np.ascontiguousarray(smoothed.T), np.log(priors / priors.sum()), typical)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The most probable language of each text, its posterior probability, and its likeness.

    Likeness is the mean log probability of the text's n-grams under that language, less that of its training texts. A posterior only
    compares the languages that were learned; a text in another language is told by its likeness, whatever its length.
    """
    if not model.languages or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    total = np.tile(model.log_priors, (len(texts), 1))
    lettered, size = np.zeros(len(texts), dtype=bool), np.ones(len(texts))
    for i, t in enumerate(texts):
        at, n, lettered[i] = sparse_row(t)
        total[i] += n @ model.log_probs[at]
        size[i] = max(n.sum(), 1)
    best = total.argmax(axis=1)
    own = total[np.arange(len(texts)), best]
    likeness = (own - model.log_priors[best]) / size - (0 if model.typical is None else model.typical[best])
    score = 1.0 / np.exp(total - own[:, None]).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), np.where(lettered, likeness, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carry``) with lang_pred, score and likeness."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, {"lang_pred": "string", "score": "double", "likeness": "double"}, lambda texts: score_texts(sent.value, texts), text, carry)


def op1_language_id(spark, sf_dir):
    """Predicts the language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    docs = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return identify(docs, model, carry=["doc_id", "held_out"])
