"""Token ids as a static range asymmetric numeral system.

Every document is tokenized and ended with ``end_id``; one frequency table,
counted over all documents, is shared by every block.  Documents are ordered by
id, cut into independent blocks of whole documents, and each block is coded by up
to ``LANES`` interleaved coders.  A block holds checkpoints (the coders' states
and the position in the words every ``CHECK_STEPS`` steps), so that one block can
be decoded by several readers, and a checksum of all its bytes.

Block layout, little-endian: ``HEADER``; presence flags and ids of the documents
(u1, i8); their token counts (u8); the words' positions at the checkpoints (u8) and
the states there (u8 each lane); the words (u4); crc32 of all before it (u4).

The file format is two tables that Spark writes and commits, so any store it reaches can hold
them: the blocks (part, seq, n_docs, n_tokens, blob), and the shared frequencies (token, freq),
whose checksum every block carries.  Both are read back from there; nothing else is needed.
``read_range`` starts at the last checkpoint before what is asked for.

Nulls: a null text is empty (only the end id); a null id sorts first.  Rows with
the same id are ordered by a hash of the text, rows alike in both are alike in
the result.  An empty table gives an empty file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import table
from logscope.llm.pieces import coder

PRECISION = 20
LANES = 1024
BLOCK_TOKENS = 1 << 20
CHECK_STEPS = 256
LOW = 1 << 31
HEADER = struct.Struct("<4sIQIIQI")
MAGIC = b"rANb"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2**PRECISION, none of them zero."""
    size, total = len(counts), int(counts.sum())
    free = (1 << PRECISION) - size
    if free <= 0:
        raise ValueError("vocabulary too large for the table's precision")
    f = np.ones(size, np.uint64)
    if total:
        f += (counts.astype(object) * free // total).astype(np.uint64)
    f[int(np.argmax(counts)) if total else 0] += np.uint64((1 << PRECISION) - int(f.sum()))
    return f


class Table:
    """Frequencies with what coding and decoding look up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u8").tobytes())


def encode_block(ids: np.ndarray, t: Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, words, and positions and states at the checkpoints of ``ids``."""
    lanes = max(1, min(LANES, len(ids) // 256))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, at, states, shift = [], [], [], np.uint64(63 - PRECISION)
    emitted = 0
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        f, c, v = t.freq[sym], t.start[sym], x[: len(sym)]
        full = v >= f << shift
        if full.any():
            out = v[full]
            words.append(out.astype(np.uint32))
            emitted += len(out)
            v[full] = out >> np.uint64(32)
        q = v // f
        x[: len(sym)] = (q << np.uint64(PRECISION)) + (v - q * f) + c
        if s % CHECK_STEPS == 0:
            at.append(emitted)
            states.append(x.copy())
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    # a reader that starts at a checkpoint has still to read what was emitted before it
    where = len(stream) - np.array(at[::-1], np.int64)
    return lanes, stream, where.astype(np.uint64), np.array(states[::-1], np.uint64).reshape(len(at), lanes)


def decode_steps(x: np.ndarray, words: np.ndarray, n: int, t: Table) -> np.ndarray:
    """``n`` ids from the states ``x`` and the words that follow."""
    lanes, pos, out = len(x), 0, np.empty(n, np.uint32)
    mask, x = np.uint64((1 << PRECISION) - 1), x.copy()
    for i in range(0, n, lanes):
        v = x[: min(lanes, n - i)]
        slot = v & mask
        sym = t.symbol[slot.astype(np.int64)]
        out[i : i + len(v)] = sym
        v = t.freq[sym] * (v >> np.uint64(PRECISION)) + slot - t.start[sym]
        low = np.flatnonzero(v < LOW)
        if len(low):
            v[low] = (v[low] << np.uint64(32)) | words[pos : pos + len(low)].astype(np.uint64)
            pos += len(low)
        x[: len(v)] = v
    return out


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray, t: Table) -> bytes:
    lanes, words, at, states = encode_block(ids, t)
    body = b"".join((
        HEADER.pack(MAGIC, len(doc_ids), len(ids), lanes, len(at), len(words), t.crc),
        np.array([d is not None for d in doc_ids], "<u1").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        at.astype("<u8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A packed block, checked; ``ids`` decodes any run of checkpoints."""

    def __init__(self, blob: bytes, t: Table):
        if zlib.crc32(memoryview(blob)[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("block checksum differs")
        magic, docs, self.n, self.lanes, checks, words, crc = HEADER.unpack_from(blob)
        if magic != MAGIC or crc != t.crc:
            raise ValueError("block of another format or frequency table")
        self.table, at = t, HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, count, at)
            at += got.nbytes
            return got

        there, ids = take("<u1", docs), take("<i8", docs)
        self.doc_ids = [int(i) if ok else None for ok, i in zip(there, ids, strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.at = take("<u8", checks).astype(np.int64)
        self.states = take("<u8", checks * self.lanes).reshape(checks, self.lanes)
        self.words = take("<u4", words)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last`` (the end if none)."""
        if not self.n:
            return np.zeros(0, np.uint32)
        span = CHECK_STEPS * self.lanes
        end = self.n if last is None or last >= len(self.at) else last * span
        # the states were taken before the words of earlier steps were emitted
        return decode_steps(self.states[first], self.words[self.at[first] :], end - first * span, self.table)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, tie, n, ids (packed) for every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [code.encode(x.as_py()) + end for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([len(x) // code.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "tie", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "id long, tie long, n long, ids binary")


def shared_counts(tokens: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id occurs in all documents; one row an id reaches the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        sums, held = np.zeros(code.vocab, np.int64), []
        for b in batches:
            for x in b.column(0):
                held.append(x.as_py())
                if len(held) == 500:
                    sums += np.bincount(np.frombuffer(b"".join(held), code.dtype), minlength=code.vocab)
                    held.clear()
        sums += np.bincount(np.frombuffer(b"".join(held), code.dtype), minlength=code.vocab)
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(sums[used])], names=["token", "n"])

    got = tokens.select("ids").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(coder(tokenizer).vocab, np.int64)
    for token, n in got:
        counts[token] = n
    return counts


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written blocks (part, seq, n_docs, n_tokens, blob) and frequencies (token, freq)."""
    tokens = table(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    freq = frequencies(shared_counts(tokens, tokenizer))
    stored = docs.sparkSession.createDataFrame(list(enumerate(freq.tolist())), "token long, freq long")
    stored = table(stored.coalesce(1), "frequencies")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, dtype, part = Table(freq), coder(tokenizer).dtype, TaskContext.get().partitionId()
        seq, doc_ids, lengths, ids, held = 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(ids), dtype)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(every)], pa.int64()), pa.array([pack(doc_ids, lengths, every, t)], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "blob"])

        for b in batches:
            for d, n, x in zip(*(b.column(k) for k in (0, 2, 3)), strict=True):
                doc_ids.append(d.as_py())
                lengths.append(n.as_py())
                ids.append(x.as_py())
                held += lengths[-1]
                if held >= BLOCK_TOKENS:
                    yield block()
                    seq, doc_ids, lengths, ids, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield block()

    ordered = tokens.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    written = ordered.mapInArrow(blocks, "part int, seq int, n_docs long, n_tokens long, blob binary")
    return table(written, "rans", compression="none"), stored


def stored_table(frequencies: DataFrame) -> np.ndarray:
    """The frequencies from their table: one row a token of the vocabulary, never more."""
    rows = frequencies.orderBy("token").collect()
    if [r["token"] for r in rows] != list(range(len(rows))) or sum(r["freq"] for r in rows) != 1 << PRECISION:
        raise ValueError("not a whole frequency table")
    return np.array([r["freq"] for r in rows], np.uint64)


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, seq, start: ids of all blocks before each."""
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq")
    return blocks.select("part", "seq", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("start"))


def read_range(blocks: DataFrame, frequencies: DataFrame, first: int, last: int) -> DataFrame:
    """at, id: the ids at the places from ``first`` up to ``last``.

    A row is made of each stretch between checkpoints that holds some of them, so several tasks
    read one block, each from its own checkpoint, and no other part of it is decoded.
    """
    freq = stored_table(frequencies)
    # blocks hold as many coders as they have ids for; see encode_block
    lanes = F.greatest(F.lit(1), F.least(F.lit(LANES), F.floor(F.col("n_tokens") / 256)))
    some = blocks.join(block_starts(blocks), ["part", "seq"]).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    some = some.withColumn("span", (lanes * CHECK_STEPS).cast("long"))
    inside = F.sequence(F.floor(F.greatest(F.lit(0), F.lit(first) - F.col("start")) / F.col("span")), F.floor((F.least(F.col("n_tokens"), F.lit(last) - F.col("start")) - 1) / F.col("span")))
    stretches = some.select("part", "seq", "start", "span", "blob", F.explode(inside).alias("check"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(freq)
        for b in batches:
            for start, span, blob, check in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = Block(blob, t).ids(check, check + 1)
                at = start + check * span + np.arange(len(ids))
                keep = (at >= first) & (at < last)
                yield pa.record_batch([pa.array(at[keep]), pa.array(ids[keep].astype(np.int64))], names=["at", "id"])

    return stretches.repartition("part", "seq", "check").select("start", "span", "blob", "check").mapInArrow(decode, "at long, id long")


def read_blocks(blocks: DataFrame, frequencies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens and ids_crc32, all from the stored tables."""
    freq, starts = stored_table(frequencies), block_starts(blocks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(freq)
        for b in batches:
            for part, seq, blob in zip(*b.columns, strict=True):
                block = Block(blob.as_py(), t)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.lengths)
                begins = ends - block.lengths
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(begins, ends, strict=True)]
                yield pa.record_batch([pa.array([part.as_py()] * len(begins), pa.int32()), pa.array([seq.as_py()] * len(begins), pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(begins), pa.array(block.lengths), pa.array(crcs, pa.int64())], names=["part", "seq", "id", "begin", "n_tokens", "ids_crc32"])

    # one small row a block, joined with small rows; the blocks themselves aren't moved
    decoded = blocks.select("part", "seq", "blob").mapInArrow(decode, "part int, seq int, id long, begin long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
