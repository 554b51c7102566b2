"""Alignment of the tokens of two vocabularies over the same bytes.

Python tokenises (``tokenised``): ids and byte ends of both sides.  How tokens align depends on
their lengths alone, so the different pairs of lengths of a block's words, their shapes, are laid
end to end and aligned by higher-order functions (``aligned``):

* ``array_intersect`` of the ends gives the places where both sides end: they cut groups.
* ``flatten`` of ``array_repeat`` names for each byte the token that covers it.  A group is a
  ``sequence`` of tokens of either side.  Each end of either side closes a stretch of bytes that
  one token of each side covers, so ``transform`` over all ends, each once, gives the links of all
  tokens that overlap: the steps grow with bytes and tokens, however long a group is.

An Arrow pass (``_laid``) then puts the words' ids in their shapes' places and lays words out as
texts.  An id pair's count is the number of texts that hold it (``pair_counts``).

Neither side joins anything across the border before white space (proven when the files are
opened), so a text is its words' alignments one after another.

A text without tokens (null, empty, or one whose joined bytes on a side aren't the text's own,
such as with a U+2581 of its own) counts zeros and has an empty digest.  Ids of rows may be null
or repeat: rows are told apart by a key of their own.  Repeated texts count once a row.  Ties for
the highest count all count.  Very long texts are one row of arrays.  An empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import table
from logscope.llm.op12_pieces import BLANK, SPACE, Agenda
from logscope.llm.pieces import byte_letters
from logscope.sources.store import settings

#: How byte-level vocabularies part a text before their merges (fixed value of that kind of file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words given to the libraries as one text, and characters of a word that goes alone.
TOGETHER, LONG = 4096, 256
#: Pairs with the highest counts, which are broadcast: 24 bytes each, so some 5 MB at most.
HEAD = 200_000
#: Characters of the texts whose different words are aligned together.
BLOCK = 1_000_000
#: Characters of words that a Python worker remembers: some 30 MB with their ids.
KEPT = 1_000_000
#: Size of what goes to Python at once, be it texts or blocks of some megabytes.
BATCH = "8m"


def _sums(counts) -> np.ndarray:
    """0, and the sums up to each of ``counts``."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0]``, the ``counts[0] - 1`` numbers after it, ``starts[1]`` and so on."""
    return np.arange(counts.sum()) + np.repeat(starts - _starts(counts), counts)


class Both:
    """Ids of words by both tokenizers, and their shapes; one per Python worker.

    Words are remembered from block to block, until they have more than ``KEPT`` characters.

    Words that end in no white space are laid end to end and read as one text.  The byte side's
    merges are read from its file; where their order is that of its ids, as checked, tiktoken
    reads them, which is several times faster, and else, and for long words, tokenizers.
    """

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_file, encoding="utf-8") as f:
            asked = json.load(f)
        pre = asked.get("pre_tokenizer") or {}
        if asked.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError(f"{byte_file} is no plain byte-level vocabulary")
        self.a, self.b = Tokenizer.from_file(byte_file), Agenda(piece_file)
        self.a.encode_special_tokens = True
        back, vocab = {v: k for k, v in byte_letters().items()}, self.a.get_vocab(with_added_tokens=False)
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        formed = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in asked["model"]["merges"]]
        single = {i for x, i in ranks.items() if len(x) == 1}
        plain = all(i < j for i, j in zip(formed, formed[1:])) and len(single) == 256 and max(single) < formed[0] and len(formed) + 256 == len(ranks)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.a_size = np.zeros(self.a.get_vocab_size(with_added_tokens=True), np.int64)
        for x, i in ranks.items():
            self.a_size[i] = len(x)
        self.b_size = np.array([len(x or b"") for x in self.b.bytes], np.int64)
        self.kind = np.min_scalar_type(max(self.a_size.max(), self.b_size.max()))
        # neither side joins anything across the border before white space, but before these
        split = self.a.pre_tokenizer.pre_tokenize_str
        glued = {c for c in map(chr, range(0x3001)) if c.isspace() and split(f"!{c}!")[0][1][1] != 1} | set(self.b.glued)
        self.glued = sorted(glued)
        glue = re.escape("".join(self.glued)) or r"^\s\S"
        self.plain = re.compile(rf"[{BLANK}]+[^{BLANK}]*")
        self.word = re.compile(rf"[{BLANK}]+[^{BLANK}]*(?:[{glue}][{BLANK}]*[^{BLANK}]*)*")
        self.whole = self.b.plain.pattern == "(?s).+"
        self._forget()

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [" " + text]
        return (self.word if any(c in text for c in self.glued) else self.plain).findall(" " + text)

    def _ids(self, text: str, alone: bool) -> tuple[list[int], list[int]]:
        """Ids of both sides of a text that begins with white space.

        The second library puts a space before what it is given: a text that begins with one
        goes without it, of any other the ids after the space's own are kept.
        """
        a = self.fast.encode_ordinary(text) if self.fast and not alone else self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return a, [self.b.id[SPACE]]
        return a, self.b.lib.encode(text[1:]) if text[0] == " " else self.b.lib.encode(text)[1:]

    def _forget(self) -> None:
        """Empty the memory: numbers of words (-1: no tokens), characters held, numbers of shapes
        (lengths of the tokens of both sides, packed), and by word its ids, their counts and shape."""
        self.number: dict[str, int] = {}
        self.shapes: dict[tuple[bytes, bytes], int] = {}
        self.held = 0
        self.a_ids, self.b_ids, self.a_count, self.b_count, self.shape = (np.zeros(0, np.intc) for _ in range(5))

    def _read(self, words: list[str], alone: bool) -> tuple[np.ndarray, ...] | None:
        """Ids of both sides of words end to end, and how many each word has; null where a side's
        bytes aren't the words' own or a word's end is no token's."""
        ids = [np.array(x, np.intc) for x in self._ids("".join(words), alone)]
        ends = np.cumsum([len(w.encode()) for w in words])
        made = [np.cumsum(size[x]) for size, x in zip((self.a_size, self.b_size), ids, strict=True)]
        counts = [np.searchsorted(own, ends, "right") for own in made]
        # byte-level tokens and pieces with byte fallback lose nothing but a U+2581, which no
        # word holds: where the lengths agree the bytes do
        good = all(len(own) and own[-1] == ends[-1] and (own[n - 1] == ends).all() for own, n in zip(made, counts, strict=True))
        return (*ids, *(np.diff(n, prepend=0) for n in counts)) if good else None

    def _learn(self, new: list[str]) -> None:
        """Remember words, in the order in which they are read."""
        odd = [w for w in new if len(w) > LONG or w[-1].isspace()]
        rest = [w for w in new if len(w) <= LONG and not w[-1].isspace()]
        parts, words = [], []
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            if (got := self._read(some, False)) is not None:
                parts.append(got)
                words += some
            else:
                odd += some
        for w in odd:
            if (got := self._read([w], True)) is not None:
                parts.append(got)
                words.append(w)
            else:
                self.number[w] = -1
        self.held += sum(map(len, new))
        if not words:
            return
        a, b, n_a, n_b = (np.concatenate([p[k] for p in parts]) for k in range(4))
        width, shapes = self.kind.itemsize, self.shapes
        sizes = [size[x].astype(self.kind).tobytes() for size, x in ((self.a_size, a), (self.b_size, b))]
        i, j = (_sums(n * width).tolist() for n in (n_a, n_b))
        shape = [shapes.setdefault((sizes[0][i[w] : i[w + 1]], sizes[1][j[w] : j[w + 1]]), len(shapes)) for w in range(len(words))]
        self.number.update(zip(words, range(len(self.shape), len(self.shape) + len(words))))
        for name, x in (("a_ids", a), ("b_ids", b), ("a_count", n_a), ("b_count", n_b), ("shape", shape)):
            setattr(self, name, np.concatenate([getattr(self, name), np.array(x, np.intc)]))

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of some texts: the ids of both sides of their different words end to end, each word's
        shape by number, the ends of both sides and of shapes of their different shapes end to
        end, each text's number of words (none: no tokens), of ids of both sides, and its words by number."""
        if self.held > KEPT:
            self._forget()
        cut = [self.cut(t) if t and SPACE not in t else [] for t in texts]
        words, own = list(chain.from_iterable(cut)), np.array([len(x) for x in cut], np.int64)
        self._learn(list(dict.fromkeys(w for w in words if w not in self.number)))
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if (number < 0).any():
            text = np.repeat(np.arange(len(own)), own)
            bad = np.isin(text, text[number < 0])
            own[text[bad]], number = 0, number[~bad]
        here = np.zeros(len(self.shape), bool)
        here[number] = True
        used = np.flatnonzero(here)
        at, sums = _sums(own), lambda n: np.diff(_sums(n[number])[at])
        ids = [x[_ranges(_starts(n)[used], n[used])] for x, n in ((self.a_ids, self.a_count), (self.b_ids, self.b_count))]
        kinds, shape = np.unique(self.shape[used], return_inverse=True)
        every = list(self.shapes)
        some = [every[k] for k in kinds.tolist()]
        ends = [np.cumsum(np.frombuffer(b"".join(x[side] for x in some), self.kind), dtype=np.int64) for side in (0, 1)]
        last = np.cumsum([len(x[0]) // self.kind.itemsize for x in some], dtype=np.int64) - 1
        return *ids, shape, *ends, ends[0][last], own, sums(self.a_count), sums(self.b_count), (np.cumsum(here) - 1)[number]


@lru_cache(maxsize=2)
def both(byte_file: str, piece_file: str) -> Both:
    return Both(byte_file, piece_file)


def _one(items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)


def _slices(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have up to ``most`` characters; a longer text is one alone."""
    sizes = pc.fill_null(pc.utf8_length(b.column(2)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < b.num_rows:
        yield b.slice(start)


def tokenised(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each block of texts: a, b (the ids of both sides of its different words, end to
    end), shape (of each word, by number), a_ends, b_ends, word_ends (where each token and each
    shape ends, in bytes of the different shapes end to end), and docs (row, id, n_a, n_b, words:
    each text's words by number).

    ``byte_file`` is a byte-level vocabulary, which reads a space and the text, ``piece_file`` a
    merge-type one, which adds that space itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = both(byte_file, piece_file)
        ints = lambda x: pa.array(x.astype(np.intc))
        for b in batches:
            for part in _slices(b, block):
                *columns, own, n_a, n_b, words = code.block(part.column(2).to_pylist())
                of = pa.ListArray.from_arrays(ints(_sums(own)), ints(words))
                docs = pa.StructArray.from_arrays([part.column(0), part.column(1), pa.array(n_a), pa.array(n_b), of], ["row", "id", "n_a", "n_b", "words"])
                yield pa.record_batch([*map(_one, map(ints, columns)), _one(docs)], names=["a", "b", "shape", "a_ends", "b_ends", "word_ends", "docs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a array<int>, b array<int>, shape array<int>, a_ends array<int>, b_ends array<int>, word_ends array<int>, docs array<struct<row: bigint, id: {kind}, n_a: bigint, n_b: bigint, words: array<int>>>")


def _start(ends: str | Column, k: Column) -> Column:
    """Where the stretch begins that the k-th end (from 0) closes."""
    return F.when(k == 0, 0).otherwise(F.get(ends, k - 1))


def _cover(ends: str) -> Column:
    """For each byte the number (from 0) of the stretch that covers it."""
    return F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - _start(ends, k))))


@lru_cache(maxsize=2)
def _spelled(ids: int) -> pa.StringArray:
    """Each id with what may come after it: the next of its side, the other side, the next group."""
    return pa.array([f"{i}{mark}" for i in range(ids) for mark in ",|;"])


def _joined(items: pa.Array, counts: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_sums(counts), pa.int32()), items), "")


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts from blocks whose shapes are aligned: the ids of each word go where its shape has
    tokens, and a text is its words in their order."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column("docs")[i].values
            a, b, shape, a_ends, b_ends, ends, slots, links = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("a", "b", "shape", "a_ends", "b_ends", "word_ends", "slots", "links"))
            # tokens of each shape, and where the ids of each word lie from those of its shape
            n_a, n_b = (np.diff(np.searchsorted(side, ends, "right"), prepend=0) for side in (a_ends, b_ends))
            off_a, off_b = (_starts(n[shape]) - _starts(n)[shape] for n in (n_a, n_b))

            # of shapes: is a place of the second side, and what comes after it
            second = slots < 0
            after = np.append(second[1:], False)
            mark = np.where(second == after, 0, np.where(second, 2, 1))
            n = (n_a + n_b)[shape]
            at = _ranges(_starts(n_a + n_b)[shape], n)
            of_b, place = second[at], slots[at]
            ids = np.where(of_b, len(a) - 1 - place + np.repeat(off_b, n), place + np.repeat(off_a, n))
            code = np.concatenate([a, b])[ids] * 3 + mark[at]
            words = _joined(_spelled(1 << max(16, int(code.max(initial=0) // 3).bit_length())).take(pa.array(code)), n)
            groups = np.diff(_sums(mark == 2)[_sums(n_a + n_b)])[shape]

            of_link = links >> 32
            n_links = np.diff(np.searchsorted(of_link, np.cumsum(n_a)), prepend=0)
            n = n_links[shape]
            at = _ranges(_starts(n_links)[shape], n)
            pairs = (a[of_link[at] + np.repeat(off_a, n)] << 32) + b[(links & 0xFFFFFFFF)[at] + np.repeat(off_b, n)]

            lists = docs.field("words")
            own, number = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            text_ends = _sums(own)
            sums = lambda x: _sums(x[number])[text_ends]
            all_links = pairs[_ranges(_starts(n)[number], n[number])]
            texts = pc.utf8_slice_codeunits(_joined(words.take(pa.array(number)), own), 0, -1)
            yield pa.record_batch(
                [*(docs.field(c) for c in ("row", "id", "n_a", "n_b")), pa.array(np.diff(sums(groups)), pa.int32()), texts, pa.ListArray.from_arrays(pa.array(sums(n), pa.int32()), pa.array(all_links))],
                names=["row", "id", "n_a", "n_b", "n_groups", "groups", "links"],
            )


def aligned(blocks: DataFrame) -> DataFrame:
    """row, id, n_a, n_b, n_groups, groups, links of each text of ``tokenised`` blocks.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of both sides between two common ends.  A link
    is a long, the first side's id above the second's.  Each different shape of a block is aligned
    once, by numbers of its tokens: ``slots`` are the groups, those of the second side as -1 and
    below.  Blocks without ``shape`` have each word laid out itself.  (Every array that a lambda
    reads is named twice or more in its projection, as the optimizer would put what is named once
    into the lambda, to be made again and again.)
    """
    if "shape" not in blocks.columns:
        blocks = blocks.withColumn("shape", F.when(F.size("word_ends") > 0, F.sequence(F.lit(0), F.size("word_ends") - 1)).otherwise(F.array().cast("array<int>")))
    cuts = blocks.withColumns({"common": F.array_intersect("a_ends", "b_ends"), "all_ends": F.sort_array(F.array_union("a_ends", "b_ends"))})
    over = cuts.withColumns({"of_a": _cover("a_ends"), "of_b": _cover("b_ends")})

    def group(end: Column, k: Column) -> Column:
        start = _start("common", k)
        side = lambda of, sign: F.sequence(sign(F.get(of, start)), sign(F.get(of, end - 1)))
        return F.concat(side("of_a", lambda x: x), side("of_b", lambda x: -1 - x))

    # an end of either side closes a stretch of bytes that one token of each side covers
    link = lambda end: F.shiftleft(F.get("of_a", end - 1).cast("long"), 32) + F.get("of_b", end - 1)
    made = over.select("a", "b", "shape", "a_ends", "b_ends", "word_ends", "docs", F.flatten(F.transform("common", group)).alias("slots"), F.transform("all_ends", link).alias("links"))
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    return made.mapInArrow(_laid, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups int, groups string, links array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count, best: in how many texts each id pair is linked, and whether no pair of its
    first id is in more."""
    counted = table(links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    first = F.shiftright("pair", 32)
    # one row for each id of the first vocabulary
    highest = counted.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))
    return counted.withColumn("first", first).join(F.broadcast(highest), "first").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Blocks are written before they are aligned, so that a core has one Python worker at a time
    (two in a row swap roles, and each then holds the vocabularies).  The alignments are written once.  The ``head`` pairs with the highest counts, a table of
    fixed size, are broadcast, and what they give is summed where the links are; links of
    rarer pairs, by then one row for each text and pair, meet their counts in a shuffle.
    """
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH):
        blocks = table(tokenised(docs, byte_file, piece_file, id_col, text_col, block), "blocks")
        # a row is a block of some megabytes
        with settings(spark, spark__sql__parquet__columnarReaderBatchSize="4"):
            rows = table(aligned(blocks).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = table(pair_counts(rows), "counts")
    most = table(counts.orderBy(F.desc("count"), "pair").limit(head), "head")
    links = rows.select("row", F.explode("links").alias("pair")).join(F.broadcast(most), "pair", "left")
    # pairs of the head need no key any more: a negative one for each row, which no pair has
    key = F.when(F.col("count").isNull(), F.col("pair")).otherwise(-F.col("row") - 1)
    known = links.groupBy("row", key.alias("pair")).agg(F.count("*").alias("n"), F.sum("count").alias("count_sum"), F.count(F.when(F.col("best"), 1)).alias("n_best"))
    rest = counts.join(most, "pair", "left_anti")
    summed = known.join(rest, "pair", "left").groupBy("row").agg(
        F.sum(F.coalesce("count_sum", F.col("n") * F.col("count"))).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.col("n_best"))).alias("n_best"),
    )
    out = rows.select("row", "id", "n_a", "n_b", "n_groups", F.size("links").alias("n_links"), "groups_sha256").join(summed, "row", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), *map(whole, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")
