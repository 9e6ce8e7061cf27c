"""SentencePiece encoding and decoding by a streaming Viterbi over a lattice of pieces.

The model is a BPE vocabulary with scores. A segmentation is the one that merging by score gives exactly if
every two neighbouring pieces are compatible: merging their joint text would leave just these two. So a path
of the lattice survives at a position only if its last piece is compatible with the piece before, and
every position has one survivor with one backpointer. No piece is longer than ``Vocabulary.longest``, so only
the survivors of that many last positions can be continued. Whenever all their backpointer paths meet in one
boundary, the ids before it are committed and forgotten; a stretch of any length needs a bounded window.

No piece reaches over a line break or from a letter into a following space mark, so paths always meet there; the
stretches between (mostly words) recur, and a worker remembers the ids of the recent ones.

Defined cases: a null or empty text has no ids. Characters without a piece become byte pieces. A text that itself
holds the space mark is decoded with spaces, as the format has it. Repeated rows are encoded alike.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import annotate, table

SPACE_MARK = "▁"
#: Stretches up to this length are remembered, so many of them in a worker at most.
REMEMBERED, CACHE = 48, 1_000_000
_STRETCH = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+")
_NONE = -1
#: Remembered pairs of neighbours, at most; then they are forgotten.
MOST_FITS = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, ranks and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.surface))]
        self.byte_ids = {int(self.surface[i][3:-1], 16): i for i in range(len(self.surface)) if model.is_byte(i)}
        self.pieces = {p: i for i, p in enumerate(self.surface) if not special[i] and not model.is_byte(i)}
        self.longest = max(map(len, self.pieces), default=1)
        order = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: (-model.get_score(self.pieces[p]), self.pieces[p]))
        self.rank = dict.fromkeys(self.pieces.values(), -1) | {self.pieces[p]: r for r, p in enumerate(order)}
        self.bytes_of = [p.replace(SPACE_MARK, " ").encode() for p in self.surface]
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        for i, s in enumerate(special):
            if s:
                self.bytes_of[i] = b""
        #: Neighbouring characters that some piece holds; between any others all paths meet.
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self._splits: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self.recent: dict[str, tuple[int, ...]] = {}

    def split(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge makes a piece of several characters: the last step of merging its text."""
        if piece not in self._splits:
            parts = [self.pieces.get(c, _NONE) for c in self.surface[piece]]
            while len(parts) > 2:
                best = None
                for i in range(len(parts) - 1):
                    if _NONE not in parts[i : i + 2]:
                        made = self.pieces.get(self.surface[parts[i]] + self.surface[parts[i + 1]])
                        if made is not None and made != piece and (best is None or self.rank[made] < self.rank[best[1]]):
                            best = (i, made)
                if best is None:
                    break
                parts[best[0] : best[0] + 2] = [best[1]]
            self._splits[piece] = (parts[0], parts[-1])
        return self._splits[piece]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joint text of pieces a and b would leave just a and b.

        The later merge of the two is undone again and again at the seam; what then lies at the seam must not merge
        before the merge that was undone.
        """
        key = a << 20 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        rank, surface, pieces = self.rank, self.surface, self.pieces
        limit, good = len(surface) + 1, True
        while True:
            made = pieces.get(surface[a] + surface[b])
            if made is not None and rank[made] < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split(a)[1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.split(b)[0]
            else:
                break
        if len(self._fits) >= MOST_FITS:
            self._fits.clear()
        self._fits[key] = good
        return good


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path)


class Stream:
    """Streaming Viterbi over one stretch: ``feed`` characters, collect committed ids in ``ids``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.text = ""  # of the window; its first character follows the last committed boundary
        self.last: list[int] = [_NONE - 1]  # survivor's last piece at each position of the window
        self.length: list[int] = [0]
        self.ids: list[int] = []
        self.before = _NONE  # last committed piece
        self.widest = 0

    def feed(self, text: str) -> None:
        longest = self.vocab.longest
        for low in range(0, len(text), longest):
            self._extend(text[low : low + longest])
            self.widest = max(self.widest, len(self.text))
            if len(self.text) > 2 * longest:
                self._commit(len(self.text) - longest + 1)

    def _extend(self, more: str) -> None:
        """Finds the survivor at each new position."""
        vocab, last, length = self.vocab, self.last, self.length
        get, known, fits, longest, border = vocab.pieces.get, vocab._fits.get, vocab.fits, vocab.longest, self.before
        known_end = len(self.text)
        text = self.text = self.text + more
        for end in range(known_end + 1, len(text) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = get(text[start:end])
                if piece is not None:
                    before = last[start] if start else border
                    if before < 0:
                        break
                    good = known(before << 20 | piece)
                    if good or (good is None and fits(before, piece)):
                        break
            else:
                piece, start = _NONE, end - 1
            last.append(piece)
            length.append(end - start)

    def _boundaries(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(end)
            end -= self.length[end]
        return out[::-1]

    def _commit(self, frontier: int) -> None:
        """Commits what lies before the last boundary that all survivors from ``frontier`` on share."""
        ends = set(range(frontier, len(self.text) + 1))
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(latest - self.length[latest])
        self._emit(ends.pop())

    def _emit(self, until: int) -> None:
        if not until:
            return
        for end in self._boundaries(until):
            piece = self.last[end]
            if piece >= 0:
                self.ids.append(piece)
            else:
                self.ids += [self.vocab.byte_ids[b] for b in self.text[end - 1].encode("utf-8", "replace")]
            self.before = piece
        self.text = self.text[until:]
        self.last, self.length = [_NONE - 1, *self.last[until + 1 :]], [0, *self.length[until + 1 :]]

    def finish(self) -> list[int]:
        self._emit(len(self.text))
        return self.ids


def _look(vocab: Vocabulary, stretch: str) -> tuple[int, ...]:
    """Ids of a stretch that is not remembered; a short one is from now on."""
    stream = Stream(vocab)
    stream.feed(stretch)
    found = tuple(stream.finish())
    if len(stretch) <= REMEMBERED:
        if len(vocab.recent) >= CACHE:
            vocab.recent.clear()
        vocab.recent[stretch] = found
    return found


def encode(vocab: Vocabulary, text: str | None) -> list[int]:
    """Ids of a whole text."""
    if not text:
        return []
    ids: list[int] = []
    recent = vocab.recent
    for stretch in _STRETCH.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)):
        found = recent.get(stretch)
        if found is None:
            if len(stretch) > 1 and stretch[-2:] not in vocab.pairs and stretch[-1] in vocab.pieces:
                # a final mark that no piece joins to a letter stands alone
                ids += recent.get(stretch[:-1]) or _look(vocab, stretch[:-1])
                found = (vocab.pieces[stretch[-1]],)
            else:
                found = _look(vocab, stretch)
        ids += found
    return ids


def decode(vocab: Vocabulary, ids) -> str:
    """The text of ids; the space put before a text by encoding is taken away."""
    text = b"".join([vocab.bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_column(docs: DataFrame, model: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``ids``, an array of int."""
    path = model or default_model()
    return annotate(docs, {"ids": "array<int>"}, lambda texts: [[encode(vocabulary(path), t) for t in texts]], text, carry)


def decode_column(coded: DataFrame, model: str | None = None, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``, the text of an array of ids (null for null)."""
    path = model or default_model()
    joined = coded.withColumn("__ids", F.array_join(ids, " "))
    own = carry if carry is not None else coded.columns
    return annotate(joined, {"decoded": "string"}, lambda rows: [[None if r is None else decode(vocabulary(path), map(int, r.split())) for r in rows]], "__ids", own)


def digest(docs: DataFrame, model: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and round_trip (decoding the ids gives the text)."""
    path = model or default_model()

    def run(texts):
        vocab = vocabulary(path)
        n, crc, same = [], [], []
        for t in texts:
            ids = encode(vocab, t)
            n.append(len(ids))
            crc.append(zlib.crc32(array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()))
            same.append(decode(vocab, ids) == (t or ""))
        return n, crc, same

    return annotate(docs, {"n_ids": "long", "ids_crc32": "long", "round_trip": "boolean"}, run, text, carry)


def op9_piece_codec(spark, sf_dir):
    """Encodes and decodes every whole text of ``documents``."""
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
