"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A writer who hides a word writes other signs for its letters (leetspeak), puts signs between them (spacing)
or repeats them. A token that may hide one is a lattice: each sign may stand for several letters, may repeat
the letter before, or may be a filler. The Viterbi path under a character n-gram model and the channel's
costs is the restored word. A token with a filler inside or a doubled letter may be plain as well: known words
stand for themselves, and its reading counts only if all its words are known. Other tokens have no reading but
themselves. A word cut by white space is found among the telling words by joining neighbours of which one is
unknown; its parts have to be plain.

The restored text is scored by logistic regression over the words and word beginnings that the labels tell
apart (by likelihood ratio). Both models are learned from all labelled documents outside the held-out fold: words, contexts and features are
counted in tasks, and each step of the regression is a pass over their chosen features, of which a value and a gradient for each task come back. What is broadcast is bounded by :data:`MOST_FEATURES`, :data:`MOST_CONTEXTS`, :data:`MOST_WORDS` and :data:`BUCKETS`.

Defined cases: null and empty texts get the score of a text without any such word. Without labels of both
values every score is the share of label 1 (0 if there are no labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kinmesh.llm.common import annotate, chunks, discard, fold, labelled_sample, labelled_texts, materialise, short_batches, table

MOST_FEATURES = 20_000
MOST_CONTEXTS = 200_000
#: Known words, the most frequent of the labelled texts.
MOST_WORDS = 200_000
PREFIXES = range(4, 10)
#: Standard errors of the bound on what a feature tells by itself.
CONFIDENCE = 3.3
#: A feature counts by itself only if the bound's logit is at least this.
SURE = 1.5
#: Hash buckets of the features that label 1 has often enough to be told by; other documents count features of these buckets alone.
BUCKETS = 1 << 22
ORDER = 4
#: Weight of half the squared weights, and steps of the regression at most.
PENALTY, MOST_STEPS = 5e-6, 60
#: Different keys that a task counts before it sends its counts on.
COUNTED = 400_000
#: Tokens whose features a worker remembers.
CACHE = 400_000

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Signs that may be put between letters.
FILLERS = " .-_*~"
SAME, LEETED, FILLER, REPEATED, MARKED = -0.05, -1.5, -0.7, -0.9, -3.0

_TRIM = "\"'.,;:?!()[]{}<>#*%&|=/\\~^`«»“”„¿¡-_+"
_SIGN = "".join(map(re.escape, LEET))
_HIDDEN = re.compile(rf"[{_SIGN}]\w|\w[@$!|+€(]\w|([^\W\d_])\1\1|^\w(?:[.\-_*~]\w){{2,}}$")
_LETTER = re.compile(r"[^\W\d_]")
_FINAL = re.compile(rf"[^\W\d_][{_SIGN}]+$")
_DOUBTFUL = re.compile(r"[^\W_][.\-_*~]+[^\W_]|([^\W\d_])\1")
_THRICE = re.compile(r"(.)\1\1")
#: Doubled letters of a token whose readings are looked up one by one.
MOST_DOUBLED = 6
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.\-_*~]+[^\W_]){2,}(?!\w)")


@dataclass
class CharacterModel:
    """Interpolated character n-grams of words; a space is the border of a word."""

    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    words: frozenset[str] = frozenset()
    #: Probabilities asked for before; each worker process has its own.
    asked: dict[tuple[str, str], float] = field(default_factory=dict, repr=False, compare=False)
    #: Readings of recent tokens, likewise.
    read: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"asked": {}, "read": {}}

    @classmethod
    def learn(cls, words: Counter) -> CharacterModel:
        letters, totals = defaultdict(dict), Counter()
        for (context, letter), n in letter_counts(words.items()).items():
            letters[context][letter] = n
            totals[context] += n
        least = least_kept(Counter(totals.values()), MOST_CONTEXTS)
        often = least_kept(Counter(n for n in words.values() if n > 1), MOST_WORDS)  # a spelling met once may hide a word
        return cls({k: v for k, v in letters.items() if totals[k] >= least}, frozenset(w for w, n in words.items() if n > 1 and n >= often))

    def log_prob(self, context: str, letter: str) -> float:
        """By Witten-Bell interpolation of all orders."""
        known = self.asked.get((context, letter))
        if known is not None:
            return known
        p = 1e-4
        for m in range(min(len(context), ORDER - 1) + 1):
            seen = self.counts.get(context[len(context) - m :] if m else "")
            if seen:
                total = sum(seen.values())
                p = (seen.get(letter, 0) + len(seen) * p) / (total + len(seen))
        if len(self.asked) >= CACHE:
            self.asked.clear()
        self.asked[context, letter] = math.log(p)
        return self.asked[context, letter]


def letter_counts(words: Iterable[tuple[str, int]]) -> Counter:
    """How often each letter follows each context of up to three letters, from words and how often they occur."""
    grams: Counter = Counter()
    for word, n in words:
        padded = " " * (ORDER - 1) + word + " "
        for i in range(len(word) + 1):
            grams[padded[i : i + ORDER]] += n
    counts: Counter = Counter()
    for gram, n in grams.items():  # shorter contexts are the ends of the longest ones
        for m in range(ORDER):
            counts[gram[ORDER - 1 - m : ORDER - 1], gram[-1]] += n
    return counts


def least_kept(sizes: dict[int, int], most: int) -> int:
    """The least count such that no more than ``most`` things have as much, from how many things have each count."""
    held, least = 0, 0
    for n in sorted(sizes, reverse=True):
        held += sizes[n]
        if held > most:
            return least if least else n + 1
        least = n
    return 0


def decode(model: CharacterModel, token: str) -> str:
    """The most probable reading of an obfuscated stretch, words of it parted by single spaces.

    It is one lattice whatever its length, and no state is dropped: signs have few letters, so the last letters of a
    reading are few. Readings are chains of letters that survivors share, so memory is linear, as time is.
    """
    start = " " * (ORDER - 1)
    # state: the last letters of the reading; value: (score, (chain before, letter))
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    before = ""
    for sign in token:
        options = []
        if sign in FILLERS:
            options.append(("", FILLER))
            if sign == " ":
                options.append((" ", FILLER))
        else:
            options.append((sign, SAME if sign.isalpha() else MARKED))
            options += [(letter, LEETED) for letter in LEET.get(sign, "")]
            if sign == before:
                options.append(("", REPEATED))
        before = sign
        reached: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, chain) in states.items():
            for letter, cost in options:
                now = score + cost
                to = state
                if letter:
                    now += model.log_prob(state, letter)
                    to = (state + letter)[1 - ORDER :]
                if to not in reached or now > reached[to][0]:
                    reached[to] = (now, (chain, letter) if letter else chain)
        states = reached
    chain = max(states.items(), key=lambda x: (x[1][0] + model.log_prob(x[0], " "), x[0]))[1][1]
    letters = []
    while chain is not None:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters)).strip()


@dataclass
class ToxicityModel:
    letters: CharacterModel
    features: dict[str, int]
    weights: np.ndarray
    intercept: float
    #: What a feature tells by itself: the lower confidence bound of label 1 among documents that have it, as a logit.
    alone: np.ndarray
    #: Beginnings of the words among the features.
    heads: frozenset[str] = field(init=False, repr=False, compare=False)
    #: First letters of the word beginnings among the features, as many as the shortest beginning has.
    begun: frozenset[str] = field(init=False, repr=False, compare=False)
    #: Features of recent tokens, and what a cut word would begin with there; each worker process has its own for each model.
    seen: dict[str, tuple[tuple[int, ...], str]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self.heads = frozenset(w[:n] for w in self.features if w[-1:] != "~" for n in range(1, len(w)))
        self.begun = beginnings(self.features)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}


def _plain(word: str) -> bool:
    return not (_HIDDEN.search(word) or _FINAL.search(word))


def _may_be_known(words: frozenset[str], token: str) -> bool:
    """Whether any reading of a plain token is a known word: without its fillers, each doubled letter written twice or once."""
    if any(c in LEET or c.isspace() for c in token):
        return True  # signs that stand for letters are for the lattice
    parts, before = [], ""
    for c in token:
        if c not in FILLERS:
            parts.append((c, "") if c == before else (c,))
        before = c
    return sum(len(x) > 1 for x in parts) > MOST_DOUBLED or any("".join(x) in words for x in product(*parts))


def restore_token(model: CharacterModel, token: str) -> list[str]:
    """The words that a token of the lower-cased text stands for."""
    core = token.strip(_TRIM)
    if not core:
        return []
    if core in model.words and token[0] not in "$@":
        return [core]  # known words are plain
    if not _LETTER.search(core):
        return [core]
    if _plain(token if token[0] in "$@" else core):
        if core in model.words or not _DOUBTFUL.search(core):
            return [core]
        composed = unicodedata.normalize("NFC", core)
        if not _may_be_known(model.words, composed):
            return [core]
        found = decode(model, composed).split()
        return found if found and all(w in model.words for w in found) else [core]
    hidden = token.rstrip(_TRIM) if token[0] in "$@" else core
    hidden = unicodedata.normalize("NFC", hidden)
    return decode(model, hidden).split() or [core]


def _spelled(model: CharacterModel, stretch: str) -> str:
    return decode(model, re.sub(r"\s+", " ", stretch))


def _beginning(heads: frozenset[str], token: str) -> str:
    """What a word that white space cuts would begin with at a token; '' if none begins so."""
    joined = token if token in heads else token.lstrip(_TRIM)
    return joined if joined in heads else ""


def restore_cut(words: frozenset[str], features: dict[str, int], heads: frozenset[str], tokens: list[str], begins: dict[str, str] | None = None) -> list[str]:
    """Words among the features that white space cuts into neighbouring tokens, not all of them known words. ``begins``: what :func:`_beginning` is for the tokens that have one."""
    found = []
    if begins is None:
        begins = {t: b for t in set(tokens) if (b := _beginning(heads, t))}
    if not begins:
        return found
    for i, token in enumerate(tokens):
        if token not in begins:
            continue
        joined = begins[token]
        unknown = joined not in words
        for k in range(i + 1, len(tokens)):  # ends soon: each step needs a longer beginning
            after = tokens[k]
            if (first := joined + after[0]) not in heads and first not in features:
                break
            core = after.rstrip(_TRIM)
            unknown = unknown or core not in words
            if core and unknown and joined + core in features:
                found.append(joined + core)
            joined += after
            if joined not in heads:
                break
    return found


def restore_spaced(model: CharacterModel, text: str) -> list[str]:
    """The words spelled out letter by letter in a lower-cased text."""
    return [w for m in _SPACED.finditer(text) for w in _spelled(model, m[0]).split()]


def restore(model: CharacterModel, text: str | None) -> str:
    """The whole text, lower-cased, with obfuscated stretches replaced by their readings."""
    lowered = _SPACED.sub(lambda m: _spelled(model, m[0]), (text or "").lower())
    return " ".join(w for t in lowered.split() for w in restore_token(model, t))


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if n <= len(word))]


def beginnings(features: Iterable[str]) -> frozenset[str]:
    """First letters of the word beginnings among features, as many as the shortest beginning has."""
    return frozenset(f[: PREFIXES[0]] for f in features if f[-1:] == "~")


def _among(word: str, features: dict[str, int], begun: frozenset[str]) -> list[int]:
    """The numbers of a word's features; ``begun`` are their :func:`beginnings`."""
    if word[: PREFIXES[0]] in begun:
        return [features[f] for f in _features(word) if f in features]
    return [features[word]] if word in features else []


def _held(word: str, held: bytes) -> list[str]:
    """Those features of a word that may be often, by the buckets of features that are. No document has a longer beginning, or the word, without the shorter ones."""
    found = []
    for n in PREFIXES:
        if n > len(word):
            break
        if not held[_bucket(f := f"{word[:n]}~")]:
            return found
        found.append(f)
    return [word, *found] if held[_bucket(word)] else found


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & (BUCKETS - 1)


def _ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Likelihood ratio of document counts a of n_a and b of n_b, signed by where the feature is commoner."""
    total = 0.0
    for seen, n, in ((a, n_a), (b, n_b)):
        p = (a + b) / (n_a + n_b)
        for x, e in ((seen, n * p), (n - seen, n * (1 - p))):
            total = total + 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return np.where(a / max(n_a, 1) > b / max(n_b, 1), total, -total)


def plain_words(texts: Iterable[str | None]) -> Iterator[set[str]]:
    """Of each text the different words that hide nothing."""
    known: dict[str, str] = {}
    for t in texts:
        found = set()
        for token in set((t or "").lower().split()):
            word = known.get(token)
            if word is None:
                word = token.strip(_TRIM)
                word = word if word.isalpha() and not _THRICE.search(word) else ""  # letters alone hide nothing else
                if len(known) >= CACHE:
                    known.clear()
                known[token] = word
            found.add(word)
        found.discard("")
        yield found


def restored_words(model: CharacterModel, text: str | None) -> list[str]:
    """The different words of the restored text."""
    lowered = _SPACED.sub(lambda m: _spelled(model, m[0]), (text or "").lower())
    words: set[str] = set()
    for token in set(lowered.split()):
        found = model.read.get(token)
        if found is None:
            found = tuple(restore_token(model, token))
            if len(model.read) >= CACHE:
                model.read.clear()
            model.read[token] = found
        words.update(found)
    return sorted(words)


def features_of(restored: Iterable[list[str]]) -> Iterator[set[str]]:
    """The features of each document."""
    return ({f for w in words for f in _features(w)} for words in restored)


def bags(restored: Iterable[list[str]], chosen: dict[str, int]) -> Iterator[bytes]:
    """The chosen features of each document, as ascending 32-bit places."""
    for found in features_of(restored):
        yield np.array(sorted(chosen[f] for f in found if f in chosen), dtype="<i4").tobytes()


def _least(n_often: int) -> float:
    """The likelihood ratio that about one feature in all should pass by chance alone, from how many there are."""
    return 2 * math.log(max(n_often, 2))


def fewest(least: float, n_one: int, n_zero: int) -> int:
    """In how many documents of label 1 a feature has to be for a ratio of ``least``, even if no other document has it."""
    seen = np.arange(1, n_one + 1, dtype=float)
    reached = np.flatnonzero(_ratio(seen, np.zeros(n_one), n_one, n_zero) >= least)
    return int(reached[0]) + 1 if len(reached) else n_one + 1


def fit(texts: list[str], labels: list[int], totals: dict[int, int]) -> ToxicityModel:
    """Learns both models from texts; ``totals`` are the label counts that they stand for."""
    letters = CharacterModel.learn(Counter(w for words in plain_words(texts) for w in words))
    restored = [restored_words(letters, t) for t in texts]
    n_one, n_zero = sum(labels), len(labels) - sum(labels)
    ones, zeros = Counter(), Counter()
    for k, found in zip(labels, features_of(restored), strict=True):
        (ones if k else zeros).update(found)
    least = _least(sum(n >= 3 for n in ones.values()))
    told = []
    if n_one and n_zero:
        often = sorted(ones)
        ratio = _ratio(np.array([ones[f] for f in often], dtype=float), np.array([zeros[f] for f in often], dtype=float), n_one, n_zero)
        told = [(often[i], ones[often[i]], zeros[often[i]]) for i in np.argsort(-ratio, kind="stable")[:MOST_FEATURES] if ratio[i] >= least]
    held = [np.frombuffer(x, dtype="<i4") for x in bags(restored, {f: i for i, (f, _, _) in enumerate(told)})]
    part = (np.concatenate([*held, np.zeros(0, "<i4")]), np.array([len(x) for x in held]), np.array(labels))
    return finish(letters, told, n_one, n_zero, totals, lambda x: losses([part], x))


def losses(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed logistic loss of documents and its gradient at weights and intercept ``x``; a part has their features, how many each has and their labels."""
    w, c = x[:-1], x[-1]
    loss, slope = 0.0, np.zeros(len(x))
    for cols, sizes, y in parts:
        at = np.repeat(np.arange(len(sizes)), sizes)
        z = c + np.bincount(at, weights=w[cols], minlength=len(sizes))
        loss += float((np.logaddexp(0, z) - y * z).sum())
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        slope[:-1] += np.bincount(cols, weights=error[at], minlength=len(w))
        slope[-1] += error.sum()
    return loss, slope


def descend(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where a convex function of which ``at`` tells value and gradient is least, by L-BFGS; each look is a pass over the documents."""
    value, slope = at(x)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(slope).max() < 1e-7:
            break
        way, parts = -slope, []
        for s, y in reversed(held):
            parts.append((s @ way) / (s @ y))
            way = way - parts[-1] * y
        way = way * (held[-1][0] @ held[-1][1] / (held[-1][1] @ held[-1][1]) if held else 1 / np.linalg.norm(slope))
        for (s, y), a in zip(held, reversed(parts), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        step, falls = 1.0, slope @ way
        found, then = at(x + way)
        while found > value + 1e-4 * step * falls and step > 1e-6:
            step /= 2
            found, then = at(x + step * way)
        if found >= value:
            break
        if (s := step * way) @ (y := then - slope) > 0:
            held = [*held, (s, y)][-10:]
        done = value - found < 1e-7 * value
        x, value, slope = x + s, found, then
        if done:
            break
    return x


def finish(letters: CharacterModel, told: list[tuple[str, int, int]], n_one: int, n_zero: int, totals: dict[int, int], at: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> ToxicityModel:
    """Weighs the features ``told`` (with how many documents of label 1 and of label 0 have them); ``at`` gives what :func:`losses` does over the documents."""
    n_all, n_1 = sum(totals.values()), totals.get(1, 0)
    if not (n_one and n_zero):
        share = n_1 / n_all if n_all else 0.0
        return ToxicityModel(letters, {}, np.zeros(0), math.log(share / (1 - share)) if 0 < share < 1 else (700.0 if share else -700.0), np.zeros(0))
    docs, start = n_one + n_zero, np.append(np.zeros(len(told)), math.log(n_one / n_zero))

    def penalised(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = at(x)
        return loss / docs + PENALTY / 2 * float(x[:-1] @ x[:-1]), slope / docs + PENALTY * np.append(x[:-1], 0.0)

    x = descend(penalised, start) if told else start
    prior = math.log(n_1 / (n_all - n_1)) - math.log(n_one / n_zero)
    a, b = np.array([x for _, x, _ in told], dtype=float), np.array([x for _, _, x in told], dtype=float)
    k = np.maximum(a + b, 1)
    low = (a / k + CONFIDENCE**2 / (2 * k) - CONFIDENCE * np.sqrt(a * b / k**3 + CONFIDENCE**2 / (4 * k**2))) / (1 + CONFIDENCE**2 / k)
    low = np.clip(low, 1e-9, 1 - 1e-9)
    alone = np.log(low / (1 - low)) + prior
    return ToxicityModel(letters, {f: i for i, (f, _, _) in enumerate(told)}, x[:-1], float(x[-1] + prior), np.where(alone >= SURE, alone, -700.0))


class Incidence:
    """Which features the documents of a batch of restored words have, by arrays. Features get numbers as they are met, or those given."""

    def __init__(self, numbers: dict[str, int] | None = None, held: np.ndarray | None = None):
        self.fixed, self.held = numbers is not None, None if held is None else held.tobytes()
        self.numbers: dict[str, int] = {} if numbers is None else numbers
        self.begun = beginnings(self.numbers)
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        of = self.known.get(word)
        if of is None:
            if self.fixed:
                of = tuple(_among(word, self.numbers, self.begun))
            else:
                of = tuple(self.numbers.setdefault(f, len(self.numbers)) for f in (_features(word) if self.held is None else _held(word, self.held)))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = of
        return of

    def pairs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of a list column, each once, in this order."""
        coded = words.flatten().dictionary_encode()
        of = [self._of(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, of), np.int64, len(of))
        flat, first = np.fromiter((f for x in of for f in x), np.int64), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(words)), pa.compute.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        n = sizes[at]
        place = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        most = max(len(self.numbers), 1)
        both = np.sort(np.repeat(doc, n) * most + flat[place])
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        return both // most, both % most


def count_features(batches: Iterable[pa.RecordBatch], held: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """How many documents have each feature (of buckets ``held``), in parts whenever a task has met :data:`COUNTED` of them."""
    incidence, counts = Incidence(held=held), np.zeros(0, np.int64)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(incidence.numbers), pa.string()), pa.array(counts)], names=["feature", "n"])

    for batch in batches:
        _, found = incidence.pairs(batch.column("words"))
        now = np.bincount(found, minlength=len(incidence.numbers)).astype(np.int64)
        now[: len(counts)] += counts
        counts = now
        if len(counts) >= COUNTED:
            yield made()
            incidence, counts = Incidence(held=held), np.zeros(0, np.int64)
    if len(counts):
        yield made()


def _counted(sets: Iterable[Iterable[str]], name: str) -> Iterator[pa.RecordBatch]:
    """In how many of the sets each string is, in parts whenever a task has met :data:`COUNTED` of them."""
    counts: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])

    for found in sets:
        counts.update(found)
        if len(counts) >= COUNTED:
            yield made()
            counts.clear()
    if counts:
        yield made()


def _column(batches: Iterable[pa.RecordBatch], name: str) -> Iterator:
    return (x for batch in batches for x in batch.column(name).to_pylist())


def learn_letters(texts: DataFrame) -> CharacterModel:
    """:meth:`CharacterModel.learn` of the plain words of ``texts``, counted in tasks; only what the model keeps comes back."""
    words = texts.mapInArrow(lambda batches: _counted(plain_words(_column(chunks(batches), "text")), "word"), "word string, n long")
    words = materialise(words.groupBy("word").agg(F.sum("n").alias("n")), "words")

    def letters(batches):
        found: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["context", "letter", "n"])

        for batch in batches:
            found.update(letter_counts(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)))
            if len(found) >= COUNTED:
                yield made()
                found.clear()
        yield made()

    spelled = words.mapInArrow(letters, "context string, letter string, n long").groupBy("context", "letter").agg(F.sum("n").alias("n"))
    spelled = spelled.groupBy("context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("letter", "n")).alias("letters"))
    spelled = materialise(spelled, "contexts")
    sizes = lambda df, n: {r["n"]: r["k"] for r in df.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("k")).collect()}
    least, often = least_kept(sizes(spelled, "total"), MOST_CONTEXTS), least_kept(sizes(words.filter("n > 1"), "n"), MOST_WORDS)
    kept = spelled.filter(F.col("total") >= least).select("context", "letters").toArrow()
    counts = {c: {x["letter"]: x["n"] for x in found} for c, found in zip(kept.column("context").to_pylist(), kept.column("letters").to_pylist(), strict=True)}
    known = words.filter((F.col("n") > 1) & (F.col("n") >= often)).select("word").toArrow()
    discard(words, spelled)
    return CharacterModel(counts, frozenset(known.column("word").to_pylist()))


def telling(restored: DataFrame, n_one: int, n_zero: int) -> list[Row]:
    """The features (feature, ones, zeros) that the labels tell apart, best first.

    Features are counted in documents of label 1 first; those too rare there to be told even if no other document had them need no more counting.
    """
    ones = restored.filter("label = 1").mapInArrow(lambda batches: count_features(batches), "feature string, n long")
    ones = materialise(ones.groupBy("feature").agg(F.sum("n").alias("ones")), "ones")
    least = _least(ones.filter("ones >= 3").count())
    often = ones.filter(F.col("ones") >= fewest(least, n_one, n_zero))

    def buckets(batches):
        found = np.unique(np.fromiter((_bucket(f) for f in _column(batches, "feature")), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["bucket"])

    held = np.zeros(BUCKETS, dtype=bool)
    held[often.mapInArrow(buckets, "bucket long").distinct().toArrow().column("bucket").to_numpy()] = True
    sent = restored.sparkSession.sparkContext.broadcast(held)
    zeros = restored.filter("label = 0").mapInArrow(lambda batches: count_features(batches, sent.value), "feature string, n long")
    both = often.join(zeros.groupBy("feature").agg(F.sum("n").alias("zeros")), "feature", "left").fillna(0, ["zeros"]).select("feature", "ones", "zeros")

    def judged(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(float) for c in ("ones", "zeros"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_ratio(a, b, n_one, n_zero))], names=["feature", "ones", "zeros", "ratio"])

    both = both.mapInArrow(judged, "feature string, ones long, zeros long, ratio double").filter(F.col("ratio") >= least)
    found = both.orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).collect()
    discard(ones)
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, left_out: int = 0, per_class: int | None = None) -> ToxicityModel:
    """As :func:`fit`, of all labelled documents outside the fold ``left_out``, or of a bounded sample of ``per_class`` of each value.

    Texts are counted, decoded and reduced to bags of telling features in tasks.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts, totals = labelled_texts(docs, labels, label, folds, left_out) if per_class is None else labelled_sample(docs, labels, label, per_class, folds, left_out)
    texts = materialise(texts, "labelled")
    letters = learn_letters(texts)
    sent = spark.sparkContext.broadcast(letters)

    def restore_all(batches):
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([restored_words(sent.value, t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["label", "words"])

    restored = materialise(texts.select("label", "text").mapInArrow(restore_all, "label int, words array<string>"), "restored")
    discard(texts)
    sizes = {r["label"]: r["n"] for r in restored.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_one, n_zero = sizes.get(1, 0), sizes.get(0, 0)
    told = [(r["feature"], r["ones"], r["zeros"]) for r in telling(restored, n_one, n_zero)] if n_one and n_zero else []
    chosen = {f: i for i, (f, _, _) in enumerate(told)}

    def bagged(batches):
        incidence = Incidence(chosen)
        for batch in batches:
            doc, cols = incidence.pairs(batch.column("words"))
            sizes, y = np.bincount(doc, minlength=batch.num_rows), batch.column("label").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (cols, sizes, y)], names=["cols", "sizes", "labels"])

    packed = materialise(restored.mapInArrow(bagged, "cols binary, sizes binary, labels binary"), "bags")
    discard(restored)

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            rows = ([np.frombuffer(v, dtype="<i4") for v in row] for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
            loss, slope = losses(rows, x)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

        rows = packed.mapInArrow(run, "loss double, slope binary").collect()
        return sum(r["loss"] for r in rows), sum(np.frombuffer(r["slope"]) for r in rows)

    model = finish(letters, told, n_one, n_zero, totals, at)
    discard(packed)
    return model


def score_texts(model: ToxicityModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """score and predicted for each text."""
    cache = model.seen
    features, begun, nothing = model.features, model.begun, ((), "")
    z = np.full(len(texts), model.intercept)
    for i, text in enumerate(texts):
        if not text:
            continue
        lowered = text.lower()
        tokens = lowered.split()
        hit: set[int] = set()
        begins: dict[str, str] = {}
        for token in set(tokens):
            found = cache.get(token)
            if found is None:
                own, begin = tuple({x for w in restore_token(model.letters, token) for x in _among(w, features, begun)}), _beginning(model.heads, token)
                found = (own, begin) if own or begin else nothing
                if len(cache) >= CACHE:
                    cache.clear()
                cache[token] = found
            if found is not nothing:
                own, begin = found
                hit.update(own)
                if begin:
                    begins[token] = begin
        hit.update(x for w in restore_spaced(model.letters, lowered) for x in _among(w, features, begun))
        hit.update(x for w in restore_cut(model.letters.words, features, model.heads, tokens, begins) for x in _among(w, features, begun))
        if hit:
            at = list(hit)
            z[i] = max(z[i] + model.weights[at].sum(), model.alone[at].max())
    score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return score, (score >= 0.5).astype(np.int32)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carry``) with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, {"score": "double", "predicted": "int"}, lambda texts: score_texts(sent.value, texts), text, carry)


def op5_toxicity(spark, sf_dir):
    """Scores every whole text of ``documents`` as ``labels.toxic`` marks it."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
