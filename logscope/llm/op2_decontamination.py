"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``min_match`` words in a row) are
tiled: the longest common runs of words that do not overlap earlier tiles are marked,
again and again, down to ``min_match`` words.  Matches are found by running Karp-Rabin:
hashes of ``k`` words roll over both sides, k falls from the longest length still
possible, and equal hashes are checked word by word and extended.  As tiles may lie in
any order, moved passages count.  A document is contaminated by an item when its tiles
cover at least ``coverage`` of the item's words.

The items form the query set.  They are dealt into blocks of at most ``BLOCK_WORDS`` words
(an item longer than that is a block of its own), each block goes to the tasks once,
and every block meets all documents: one block for an ordinary benchmark, more passes for
a larger one.  Inside a task seeds are joined by hash, so documents that share nothing
cost one dictionary lookup a word.

Nulls: a document without text holds nothing; an item without text or with fewer than
``min_match`` words is compared as one run of all its words, an item without words never
matches.  Items that repeat are reported under each id, null ids as null.  Empty tables
give empty results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm.common import word_count

MIN_MATCH, COVERAGE = 5, 0.5
BLOCK_WORDS = 2_000_000
FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "words")])))]))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z folded, cut at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``k`` ids (modulo 2**64).

    Prefix sums of ids times powers give every window at once; a window is scaled by
    the inverse power of its place, as the rolling update would.
    """
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(ids))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)])])
    return (prefix[k:] - prefix[:-k]) * inverse[:n]


_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWER[0]) < n:
        size, odd = max(n, 4096), int(BASE)
        for k, base in enumerate((odd, pow(odd, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWER[k] = np.cumprod(steps)
    return _POWER


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words) of each tile.

    Among matches of one length the one first in the item, then first in the document,
    is marked first.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while length >= min_match:
        # the longest length at which unmarked runs still share a hash
        lo, hi, at_length = min_match, length, []
        while lo <= hi:
            k = (lo + hi) // 2
            got = _matches(doc, item, free_d, free_i, k)
            if got:
                at_length, best, lo = got, k, k + 1
            else:
                hi = k - 1
        if not at_length:
            break
        for i, d in at_length:
            if free_d[d : d + best].all() and free_i[i : i + best].all():
                free_d[d : d + best] = False
                free_i[i : i + best] = False
                tiles.append((d, i, best))
        length = best
        if length == min_match:
            break
        length -= 1
    return tiles


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Places (item, doc) of equal, unmarked runs of ``k`` ids."""
    open_d, open_i = _runs(free_d, k), _runs(free_i, k)
    if not len(open_d) or not len(open_i):
        return []
    of_item = defaultdict(list)
    for i, h in zip(open_i.tolist(), rolling(item, k)[open_i].tolist(), strict=True):
        of_item[h].append(i)
    hashes = rolling(doc, k)[open_d]
    hit = np.isin(hashes, np.fromiter(of_item, np.uint64, len(of_item)))
    found = []
    for d, h in zip(open_d[hit].tolist(), hashes[hit].tolist(), strict=True):
        found += [(i, d) for i in of_item[h] if (doc[d : d + k] == item[i : i + k]).all()]
    return sorted(found)


def _runs(free: np.ndarray, k: int) -> np.ndarray:
    """Places where ``k`` unmarked words begin."""
    if len(free) < k:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[k:] - sums[:-k] == k)


class Items:
    """One block of benchmark items, with the seeds that find them."""

    def __init__(self, rows: list[tuple[int | None, str | None]], min_match: int):
        self.min_match, self.ids, self.word, self.items, seeds = min_match, [], {}, [], defaultdict(set)
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.word.setdefault(w, len(self.word)) for w in words], np.int64)
            for h in rolling(ids, min(min_match, len(ids))).tolist():
                seeds[min(min_match, len(ids)), h].add(len(self.ids))
            self.ids.append(item_id)
            self.items.append(ids)
        self.seeds = {n: {h: sorted(v) for (m, h), v in seeds.items() if m == n} for n in {m for m, _ in seeds}}
        self.hashes = {n: np.sort(np.fromiter(s, np.uint64, len(s))) for n, s in self.seeds.items()}

    def find(self, text: str | None, coverage: float) -> list[tuple]:
        words = words_of(text)
        known = np.fromiter((self.word.get(w, -1) for w in words), np.int64, len(words))
        near: set[int] = set()
        for n, hashes in self.hashes.items():
            starts = _runs(known >= 0, n)
            if len(starts):
                h = rolling(known, n)[starts]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for x in set(h[hashes[at] == h].tolist()):
                    near.update(self.seeds[n][x])
        out = []
        for k in sorted(near):
            item = self.items[k]
            tiles = tile(known, item, min(self.min_match, len(item)))
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                out.append((self.ids[k], covered, len(item), tiles))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH):
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    count = -(-total // (BLOCK_WORDS // 2)) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    for k in range(count):
        rows = dealt.where(F.col("block") == k).select("id", "text").collect()
        yield Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), min_match)


def contamination(docs: DataFrame, items: Items, coverage: float = COVERAGE, text_col: str = "text") -> Column:
    """Array of (item_id, covered, item_words, tiles) for the items a text contains."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.find(t, coverage) for t in texts])

    return found(F.col(text_col))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, covered, item_words, coverage, tiles: one row a document and item."""
    out = None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for items in blocks(benchmark, min_match=min_match):
        part = rows.select("id", F.explode(contamination(rows, items, coverage, "text")).alias("f")).select("id", "f.*")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "item_id", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that no item contaminates."""
    for items in blocks(benchmark, min_match=min_match):
        docs = docs.where(F.size(contamination(docs, items, coverage, text_col)) == 0)
    return docs
