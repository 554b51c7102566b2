"""SentencePiece encoding and decoding for merge-type vocabularies.

``Agenda`` holds one model.  A text is escaped (a leading space, spaces as U+2581) and cut into
words at places that no merge can cross; each word is one symbol a character, and an agenda of
adjacent pairs, ordered by the score of what they would form and then by place, is worked off
until no pair is left.  Symbols that are no piece become their UTF-8 bytes as byte pieces.

Every word is checked against the sentencepiece library, all new words of an Arrow batch in one
call, both ways (its ids, and its text from the ids).  What was checked is remembered, up to a
bound, so a word is worked out once per worker and not once per occurrence.  A text with a word
on which the two disagree takes the library's ids and text; ``agreed`` says so.

The cut is proven when a model is opened: a merge forms a piece of the vocabulary, so none
reaches across the border before a character that no piece holds behind another one (runs of
U+2581 apart).  Texts are cut before such white space, where what comes before is none.

Nulls: a null text counts as empty (only the end id), a null id stays null.  Repeated rows are
encoded row by row.  Very long texts are encoded whole: the agenda takes n log n steps for a
word of n characters.  Ties between pairs of one score go to the leftmost.  An empty table
gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a space in pieces.
SPACE = "▁"
#: White space, and what stands for it.
BLANK = rf"\s{SPACE}"
#: Words of up to so many characters have their agenda in a list.
SHORT = 24
#: Rank of what is no piece.
NEVER = float("inf")
#: Longer words are encoded, and checked, but not remembered.
MAX_KEPT = 64
#: Remembered words per Python worker; the memory is emptied when it is full.
MAX_WORDS = 1_000_000


class Agenda:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
        piece = type(model.pieces.add())
        kinds = {p.type for p in model.pieces[:-1]}
        if train.model_type != train.BPE or not train.byte_fallback or not plain or kinds & {piece.USER_DEFINED, piece.UNUSED}:
            raise ValueError(f"{path} is no merge-type model with byte fallback and unchanged text")
        self.rank, self.id, self.bytes, self.byte = {}, {}, [], [0] * 256
        for i, p in enumerate(model.pieces[:-1]):
            if p.type == piece.NORMAL:
                # the agenda pops the least: a higher score first
                self.rank[p.piece], self.id[p.piece] = -p.score, i
                self.bytes.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == piece.BYTE:
                self.byte[int(p.piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(p.piece[3:-1], 16)]))
            else:
                self.bytes.append(b"" if p.type == piece.CONTROL else None)
        self.end = self.lib.eos_id()
        inside = {c for x in self.rank if x.strip(SPACE) for c in x[1:]}
        self.glued = [c for c in map(chr, range(0x3001)) if c.isspace() and c in inside]
        self.plain = re.compile(rf"[{BLANK}]+[^{BLANK}]*" if SPACE not in inside else "(?s).+")
        glue = re.escape("".join(self.glued)) or "^\\s\\S"
        self.word = re.compile(rf"[{BLANK}]+[^{BLANK}]*(?:[{glue}][{BLANK}]*[^{BLANK}]*)*" if SPACE not in inside else "(?s).+")
        self.words: dict[str, bytes] = {}
        self.doubted: set[str] = set()

    def escaped(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def cut(self, text: str) -> list[str]:
        """The words of a text that isn't empty, with the white space before them."""
        by = self.word if any(c in text for c in self.glued) else self.plain
        return by.findall(self.escaped(text))

    def merge(self, word: str) -> list[str]:
        """The symbols of a word when no two neighbours form a piece any more."""
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: str) -> list[str]:
        """The agenda as a plain list: for a few symbols, its least entry is found fastest so."""
        rank = self.rank.get
        sym = list(word)
        agenda = [rank(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            del agenda[i]
            sym[i] += sym.pop(i + 1)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + sym[i], NEVER)
            if i < len(agenda):
                agenda[i] = rank(sym[i] + sym[i + 1], NEVER)
        return sym

    def _long(self, word: str) -> list[str]:
        """The agenda as a heap, over symbols linked to their neighbours."""
        n, rank = len(word), self.rank
        sym: list[str | None] = list(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := word[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, formed = heapq.heappop(agenda)
            # an entry is void once one of its two symbols has grown or gone
            if sym[i] is None or (j := right[i]) >= n or len(sym[i]) + len(sym[j]) != len(formed) or sym[i] + sym[j] != formed:
                continue
            sym[i], sym[j] = formed, None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (pair := formed + sym[after]) in rank:
                    heapq.heappush(agenda, (rank[pair], i, pair))
            if (before := left[i]) >= 0 and (pair := sym[before] + formed) in rank:
                heapq.heappush(agenda, (rank[pair], before, pair))
        return [s for s in sym if s is not None]

    def ids(self, word: str) -> tuple[int, ...]:
        """Ids of one word by the agenda."""
        out = []
        for s in self.merge(word):
            if (i := self.id.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in s.encode()]
        return tuple(out)

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words that aren't remembered, checked against the library in one call.

        The library puts a space before what it is given: a word that begins with one goes
        without it, any other is compared after the space's own id.
        """
        new = {w: self.ids(w) for w in words}
        own = [w.startswith(SPACE) for w in new]
        given = [w[1:] if o else w for w, o in zip(new, own, strict=True)]
        space = self.id[SPACE]
        for w, o, ids, theirs in zip(new, own, new.values(), self.lib.encode(given, num_threads=1), strict=True):
            if list(ids) != (theirs if o or theirs[:1] != [space] else theirs[1:]) and w != SPACE:
                self.doubted.add(w)
        for w, ids, back in zip(new, new.values(), self.lib.decode([[space, *ids] for ids in new.values()], num_threads=1), strict=True):
            if self.decode(ids, first=False) != back:
                self.doubted.add(w)
        return new

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """The text of ids; the space before a text's first word is the encoder's own."""
        got = b"".join(map(self.bytes.__getitem__, ids))
        return (got.removeprefix(b" ") if first else got).decode()

    def text_of(self, ids: list[int]) -> str:
        """``decode``, or the library's reading of ids that are unknown or no UTF-8."""
        try:
            return self.decode(ids)
        except (TypeError, UnicodeDecodeError):
            return self.lib.decode(ids)

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[list[int], bool]]:
        """Ids of each text, without an end id, and whether agenda and library agree on them."""
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        new = self.learn(set(chain.from_iterable(cut)).difference(known))
        known.update((w, array("i", ids).tobytes()) for w, ids in new.items())
        for text, words in zip(texts, cut, strict=True):
            agreed = not self.doubted or self.doubted.isdisjoint(words)
            yield (np.frombuffer(b"".join(map(known.__getitem__, words)), np.intc).tolist(), True) if agreed else (self.lib.encode(text), False)
        for w in new:
            if len(w) > MAX_KEPT:
                del known[w]


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def _slices(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """``id_col``, ids (array of int), agreed for every row of ``docs``: one scan, no shuffle.

    ``model`` is the path of the model file, opened by each Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = agenda(model)
        tail = [code.end] if end else []
        for b in batches:
            for part in _slices(b):
                got = list(code.encode_batch(part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array([ids + tail for ids, _ in got], pa.list_(pa.int32())), pa.array([a for _, a in got])], names=["id", "ids", "agreed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, agreed boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text for every row of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = agenda(model)
        for b in batches:
            for part in _slices(b):
                yield pa.record_batch([part.column(0), pa.array([None if x is None else code.text_of(x) for x in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256, agreed: ids with the end id, and the text
    that they give when decoded, as digests, in one pass so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = agenda(model)
        shown = [str(i) for i in range(len(code.bytes))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            for part in _slices(b):
                n, of_ids, of_text, agreed = [], [], [], []
                for ids, same in code.encode_batch(part.column(1).to_pylist()):
                    ids.append(code.end)
                    n.append(len(ids))
                    of_ids.append(sha(" ".join(map(shown.__getitem__, ids))))
                    of_text.append(sha(code.text_of(ids) if same else code.lib.decode(ids)))
                    agreed.append(same)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array(agreed, pa.bool_())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean").withColumnRenamed("id", id_col)
