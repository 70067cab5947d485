"""Token ids of whole texts, with a bounded memory of words met before.

The vocabulary drops white space between words, so the ids of a text are the ids
of its white-space separated chunks in order.  A chunk is encoded once per
Python worker and then looked up; the memory is bounded, which changes speed and
never ids.
"""

from __future__ import annotations

from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

#: Appended to every document.
END_ID = 2
VOCABULARY = "word_bpe_49k.json"


class ChunkTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids.

    The strings of special tokens inside a text are ordinary text.  A null text
    counts as empty.
    """

    def __init__(self, path: str, capacity: int = 500_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.merges = self.model.model
        self.capacity = capacity
        # Two generations: a full one ages, and what is met again moves up.
        self.known: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text given in UTF-8."""
        # bytes.split knows ASCII white space only: any other kind stays inside
        # a chunk and is treated there by the vocabulary's own rules.
        # The vocabulary ignores case, so lower ASCII letters first: fewer chunks differ.
        chunks = (text or b"").lower().split()
        found = list(map(self.known.get, chunks))
        if None in found:
            self._learn(chunks, found)
        return b"".join(found)

    def _learn(self, chunks: list[bytes], found: list[bytes | None]) -> None:
        gaps = [k for k, x in enumerate(found) if x is None]
        new, cut, aged = {}, {}, self.aged
        for c in {chunks[k] for k in gaps}:
            if c in aged:
                new[c] = aged[c]
            else:
                cut[c] = _parts(c)
        need = {p for ps in cut.values() for p in ps if p not in new}
        # A run of letters is one word to the vocabulary; where normalising would
        # not change it, its merges can be asked for directly.
        other = []
        for p in need:
            if (ids := self.known.get(p) or aged.get(p)) is not None:
                new[p] = ids
            elif (word := _plain_word(p)) is not None:
                new[p] = np.array([t.id for t in self.merges.tokenize(word)], "<u4").tobytes()
            else:
                other.append(p)
        coded = self.model.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)
        new.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(other, coded))
        for c, ps in cut.items():
            if len(ps) > 1:
                new[c] = b"".join([new[p] for p in ps])
        for k in gaps:
            found[k] = new[chunks[k]]
        if len(self.known) + len(new) > self.capacity:
            self.aged, self.known = self.known, {}
        self.known.update(new)


#: The vocabulary spells bytes as printable characters: themselves where they are
#: printable, else the next free ones from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def printable_bytes() -> dict[str, int]:
    """The byte that each printable character spells."""
    return {chr(b): b for b in _SHOWN} | {chr(c): b for b, c in _SPELLING.items()}


def _plain_word(chunk: bytes) -> str | None:
    """The spelling of a chunk of unchanged lower-case letters, else None."""
    if chunk.isalpha():
        return chunk.decode()
    text = chunk.decode()
    if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
        return chunk.decode("latin-1").translate(_SPELLING)
    return None


#: ASCII marks that may follow a word; the vocabulary cuts between a letter and them.
_MARKS = b"!#$%&*|.,;:?"


def _parts(chunk: bytes) -> tuple[bytes, ...]:
    """Pieces whose ids joined are the ids of the chunk."""
    stem = chunk.rstrip(_MARKS)
    if len(stem) < len(chunk) and (97 <= (stem or b" ")[-1] <= 122 or stem.decode()[-1:].isalpha()):
        return stem, chunk[len(stem) :]
    return (chunk,)


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> ChunkTokenizer:
    """One per Python worker; ``path`` defaults to the public vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return ChunkTokenizer(path)
