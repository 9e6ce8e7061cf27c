"""Ids of texts under a byte-level BPE vocabulary of the ``tokenizers`` library.

``tiktoken`` merges the same vocabulary several times faster and gives the same ids, so it takes the
common texts. Texts for which the two libraries' pattern engines might differ (characters beyond the
Latin blocks and general punctuation) or that hold a very long run without a break go to ``tokenizers``.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import functools
import json
import re

_FAR = re.compile("[^\x00-ɏ‐-‧]")
_LONG_BLANK = re.compile(r"\s{1000}")
_LONG_WORD = 1000
#: The pattern that byte-level BPE splits a text by before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if all(c in letters for c in piece) and not piece.startswith("<|endof")}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if (not text.isascii() and _FAR.search(text)) or _LONG_BLANK.search(text) or max(map(len, text.split()), default=0) >= _LONG_WORD:
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
