"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct ``width``-word shingles.  Documents with equal sets
are one node.  Each node's MinHash signature is cut into bands; nodes that share a
band are candidates.  A candidate pair is compared batch by batch on two bits of each
signature value, and dropped as soon as the posterior probability that its similarity
reaches the threshold falls below ``miss``.  What survives is confirmed on the full sets.

Pairs are never listed within a group of copies.  First the nodes of a band bucket are
compared with its most connected node; confirmed links give components.  Then only
pairs of one bucket whose nodes lie in different components are compared, all of them,
on longer signatures too, so no candidate is left out; full sets are read first for one pair of every two
components and then for the pairs that are still apart.

Nulls: a null or empty text, or one without words, has no shingles and is linked with
nothing (its component is its own id).  Rows with a null id take part; their
component_id is the group's smallest id, null if no row of the group has one, and they
are kept only in that case.  Repeated rows are copies of one another.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm.common import table
from logscope.llm.components import components

BANDS, ROWS = 32, 4
#: Values of the longer signature with which the pairs left apart are compared again.
DEEP = 2048
BATCHES, BATCH = 4, 32  # sketch words of 64 bits: 32 signature values of two bits each
#: Most keys that are broadcast: 2 million of 16 bytes are 32 MB.
BROADCAST_KEYS = 2_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        got = xxh3_64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHash:
    return _WordHash()


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    bytes.lower() folds A-Z only and bytes.split() cuts at ASCII white space.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        out = (out + h[k : k + n]) * GOLD
        out ^= out >> np.uint64(29)
    return np.unique(_stir(out))


@lru_cache(maxsize=2)
def _seeds(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607 + size))
    return rng.integers(0, 1 << 32, size, np.uint32)[:, None], (rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(s: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of a set: the least of each seeded permutation of 32 bits."""
    flip, odd = _seeds(size)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    x, step = (s >> np.uint64(32)).astype(np.uint32), max(1, (1 << 17) // size)
    for at in range(0, len(x), step):
        low = np.minimum(low, ((x[None, at : at + step] ^ flip) * odd).min(axis=1))
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = _stir(h * GOLD + sig.reshape(BANDS, ROWS)[:, r])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values to a word.

    Every word takes one value in four of each band, in turn, so a shared band does
    not decide the first comparison.
    """
    mixed = _stir(sig.astype(np.uint64)) & np.uint64(3)
    dealt = mixed.reshape(BATCH, -1).T
    return (dealt << (np.arange(BATCH, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, sizes: tuple[int, ...] = tuple(BATCH * (k + 1) for k in range(BATCHES))) -> tuple[int, ...]:
    """Fewest matches after each batch (``sizes``: values compared so far) with which a
    pair stays.

    Two bits agree with probability (1 + 3 s) / 4 at similarity s.  With a uniform
    prior on s, the posterior after m matches of n is integrated on a grid; a pair goes
    when P(s >= threshold) < miss.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    p = (1 + 3 * grid) / 4
    out = []
    for n in sizes:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[grid >= threshold].sum() >= miss * w.sum():
                out.append(m)
                break
    return tuple(out)


def _stays(threshold: float, miss: float, a: str, b: str) -> Column:
    """Sequential comparison of the sketches of two sides of a join, and of the sizes."""
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    keep, seen = small >= large * F.lit(threshold), F.lit(0)
    for i, least in enumerate(least_matches(threshold, miss)):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        odd = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        seen = seen + (F.lit(BATCH) - F.bit_count(odd))
        keep = keep & (seen >= F.lit(least))
    return keep


def _stays_deep(threshold: float, miss: float, a: str, b: str) -> Column:
    """The same on the longer signatures, in the column ``deep`` of both sides."""
    (least,) = least_matches(threshold, miss, (DEEP,))

    def odd(x: Column, y: Column) -> Column:
        x = x.bitwiseXOR(y)
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    differ = F.aggregate(F.zip_with(F.col(f"{a}.deep"), F.col(f"{b}.deep"), odd), F.lit(0), lambda n, x: n + x)
    return F.lit(DEEP) - differ >= F.lit(least)


NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(f"s{i}", T.LongType()) for i in range(BATCHES))])


def described(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """For every row its id, set size, node (a hash of the whole set; null without
    words), bands and sketch; ``text_key`` finds the text again."""
    from xxhash import xxh3_64_intdigest

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, node, bands, sketches = [], [], [], []
                for text in part.column(2):
                    s = shingles(text.as_py(), width)
                    sig = signature(s) if len(s) else None
                    n.append(len(s))
                    node.append(None if sig is None else xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    bands.append(None if sig is None else band_keys(sig))
                    sketches.append([None] * BATCHES if sig is None else sketch(sig).tolist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array([k[i] for k in sketches], pa.int64()) for i in range(BATCHES))], names=NODE.fieldNames())

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(describe, NODE)


def _texts(asked: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node, text of the nodes asked for, found by hash in one scan of the documents.

    The keys are broadcast only up to ``BROADCAST_KEYS`` rows of 16 bytes; beyond that they
    are joined by shuffle.
    """
    keys = table(nodes.select("node", "text_key").join(asked, "node"), "asked")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return texts.join(keys, "text_key").groupBy("node").agg(F.first("text").alias("text"))


def _deep(asked: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, text_col: str) -> DataFrame:
    """node, deep: sketches of longer signatures."""

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longer = [sketch(signature(shingles(t.as_py(), width), DEEP)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(longer, pa.list_(pa.int64()))], names=["node", "deep"])

    return _texts(asked, docs, nodes, text_col).select("node", "text").mapInArrow(deep, "node long, deep array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float, width: int, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, written."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = table(_texts(asked, docs, nodes, text_col), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = round(threshold * 100)
        shingled = lru_cache(maxsize=64)(lambda text: shingles(text, width))
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = shingled(x.as_py()), shingled(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return table(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


class _Groups:
    """Components of the links confirmed so far; asks only about pairs across them."""

    def __init__(self, spark, confirm):
        self.confirm, self.links = confirm, spark.createDataFrame([], "a long, b long")
        self.label = spark.createDataFrame([], "node long, label long")

    def across(self, pairs: DataFrame) -> DataFrame:
        """a, b, la, lb of the pairs whose nodes are in different components."""
        of = lambda c: self.label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
        return named.select("a", "b", F.least(la, lb).alias("la"), F.greatest(la, lb).alias("lb")).where("la != lb")

    def ask(self, pairs: DataFrame) -> bool:
        """Confirm the pairs; whether that gave new links."""
        pairs = table(pairs.select("a", "b"), "pairs")
        more = None if pairs.isEmpty() else self.confirm(pairs)
        if more is None or more.isEmpty():
            return False
        self.links = self.links.unionByName(more)
        self.label = components(self.links)
        return True

    def ask_across(self, pairs: DataFrame) -> None:
        """First one pair of every two components, then all that are still apart."""
        apart = table(self.across(pairs), "across")
        first = apart.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        if self.ask(first):
            apart = self.across(apart.select("a", "b"))
        self.ask(apart.select("a", "b").subtract(first))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = table(described(docs, width, id_col, text_col), "rows")
    values = ["text_key", "n", *(f"s{i}" for i in range(BATCHES))]
    nodes = table(
        rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.first(F.struct("bands", *values)).alias("v")).select("node", "least_id", "v.bands", *(f"v.{c}" for c in values)),
        "nodes",
    )
    sketches = nodes.select("node", "n", *(f"s{i}" for i in range(BATCHES)))

    # buckets with more than one node; the leader is the node that shares most bands with
    # most nodes, so that copies meet the text they were made from
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = table(members.join(sizes, "bucket"), "buckets")
    central = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    draw = F.struct(F.col("reach"), F.xxhash64("node").alias("draw"), F.col("node").alias("leader"))
    shared = shared.select("bucket", "node").join(central, "node")
    lead = shared.groupBy("bucket").agg(F.max(draw).alias("lead"))
    shared = table(shared.select("bucket", "node").join(lead, "bucket").select("bucket", "node", "lead.leader", "lead.reach"), "led")

    groups = _Groups(docs.sparkSession, lambda pairs: _confirmed(pairs, docs, nodes, threshold, width, text_col))
    star = shared.where("node != leader").groupBy("node", "leader").agg(F.max("reach").alias("reach"))
    star = star.alias("p").join(sketches.alias("x"), F.col("p.node") == F.col("x.node")).join(sketches.alias("y"), F.col("p.leader") == F.col("y.node"))
    star = table(star.where(_stays(threshold, miss, "x", "y")).select(F.col("p.node").alias("a"), F.col("p.leader").alias("b"), "reach"), "star")
    groups.ask(star.groupBy("a").agg(F.max_by("b", F.struct("reach", "b")).alias("b")))
    groups.ask_across(star)

    # what stars left apart: all pairs of a bucket across components
    placed = shared.select("bucket", "node").join(groups.label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    apart = table(placed.join(mixed, "bucket"), "apart")
    deep = _deep(apart.select("node").distinct(), docs, nodes, width, text_col)
    apart = table(apart.join(sketches.join(deep, "node").join(nodes.select("node", "bands"), "node"), "node"), "apart")
    first_shared = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")  # a pair meets once
    cross = apart.alias("x").join(apart.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & _stays(threshold, miss, "x", "y") & _stays_deep(threshold, miss, "x", "y") & first_shared)
    groups.ask_across(table(cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "cross"))
    label = groups.label

    group = nodes.select("node", "least_id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = group.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = group.join(least, "label").select("node", "component_id")
    out = rows.select("id", "n", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
