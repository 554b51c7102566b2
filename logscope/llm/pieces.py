"""Whole-token shortcut for BPE tokenizers that drop white space.

``WholeTokens`` proves once, when it is built, which vocabulary strings encode
alone as exactly one token: every vocabulary entry is turned back into its string
and given to the library.  At run time a text is cut into chunks at white space;
a chunk seen before costs one dictionary lookup.  A new chunk is cut into
pre-tokens; those in the proven set are one token each, and only the others go
through the library's merges.

The cut at white space is valid only for tokenizers whose normalizer folds white
space and whose pre-tokenizer removes it.  ``WholeTokens`` checks this against
the library for every character that ``str.split`` cuts at; a text that holds one
the library treats otherwise is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Pre-token pattern of the tokenizer, for texts below U+0250 (fixed value of the
#: vocabulary file, with Python spellings of the two Unicode classes).
LATIN_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
#: Longer chunks are encoded but not remembered.
MAX_CACHED = 48
#: Remembered chunks per Python worker; the memory is emptied when it is full.
MAX_CHUNKS = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return table


class WholeTokens:
    """Encoder of one vocabulary file; one per Python worker (see ``coder``)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._merge = self.lib.model.tokenize
        self._letters = byte_letters()
        self.whole = self._prove()
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        gap = self.lib.encode("a b", add_special_tokens=False).ids
        self.odd_spaces = [c for c in spaces if self.lib.encode(f"a{c}b", add_special_tokens=False).ids != gap]
        self.special = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        size = self.dtype.itemsize
        self.ids = _Memory(self.chunk)
        self.counts = _Memory(lambda chunk: len(self.chunk(chunk)) // size)
        self._parts: dict[str, bytes] = {}

    def _prove(self) -> dict[str, bytes]:
        """Strings that the library encodes alone as one token, with its id."""
        back = {v: k for k, v in self._letters.items()}
        strings = []
        for token in self.lib.get_vocab(with_added_tokens=False):
            if not token.endswith("</w>"):
                continue
            try:
                strings.append(bytes(back[c] for c in token[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        proven = {}
        for at in range(0, len(strings), 4096):
            some = strings[at : at + 4096]
            for s, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False), strict=True):
                if len(e.ids) == 1 and "".join(s.split()) == s:
                    proven[s] = np.array(e.ids, self.dtype).tobytes()
        return proven

    def _library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token: proven as one token, remembered, or merged."""
        got = self.whole.get(piece) or self._parts.get(piece)
        if got is None:
            spelled = piece if piece.isascii() and piece.isprintable() else "".join(map(self._letters.__getitem__, piece.encode()))
            got = array(self._code, [t.id for t in self._merge(spelled)]).tobytes()
            if len(piece) <= MAX_CACHED:
                self._parts[piece] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk without white space."""
        if chunk.isascii():
            folded = chunk.lower()
            if folded.isalpha():
                return self._piece(folded)
            if folded[-1] in ".,":
                body = folded[:-1]
                if body.isalpha():
                    return self._piece(body) + self.whole[folded[-1]]
            if "<" in chunk and any(s in chunk for s in self.special):
                return self._library(chunk)
        elif max(chunk) < "ɐ" and "İ" not in chunk and not any(s in chunk for s in self.special):
            folded = unicodedata.normalize("NFC", chunk).lower()
        else:
            return self._library(chunk)
        return b"".join(map(self._piece, LATIN_PRETOKEN.findall(folded)))

    def _whole_text(self, text: str) -> bool:
        """Whether only the library can cut the text; also keeps the memories small."""
        for memory in (self.ids, self.counts, self._parts):
            if len(memory) > MAX_CHUNKS:
                memory.clear()
        return any(c in text for c in self.odd_spaces)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as packed little-endian integers of ``dtype``."""
        if not text:
            return b""
        if self._whole_text(text):
            return self._library(text)
        return b"".join(map(self.ids.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        if self._whole_text(text):
            return len(self._library(text)) // self.dtype.itemsize
        return sum(map(self.counts.__getitem__, text.split()))


class _Memory(dict):
    """What ``make`` gives for a chunk, remembered unless the chunk is long."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, chunk: str):
        got = self.make(chunk)
        if len(chunk) <= MAX_CACHED:
            self[chunk] = got
        return got


@lru_cache(maxsize=2)
def coder(path: str) -> WholeTokens:
    return WholeTokens(path)
