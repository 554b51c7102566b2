"""Exact top-k inner products through a pivot-distance index.

Components become floor(64 x).  Inner products turn into distances by one more
component: with M the largest norm, a vector x gets sqrt(M^2 - |x|^2) and a query 0, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the highest scores are the nearest vectors.  Every
vector is keyed by its nearest pivot and its distance to it, and the keys of a pivot are
cut into sorted annuli.  A query at distance d of a pivot can find nothing nearer than
max(0, d - hi, lo - d) in the annulus [lo, hi] (triangle inequality), so annuli are
expanded in the order of that bound and left out once it passes the distance of the
query's k-th best so far.

Pivots and the annuli's edges are fitted on at most ``SAMPLE`` vectors, chosen by hash; all
vectors are indexed, and results don't depend on the sample.  Equal vectors are one entry
with its k+1 smallest ids and how often each occurs, gathered by salted steps, so a vector
that a third of all rows repeat costs no more than another.  Queries go in blocks of ``QUERY_BLOCK``, each
against slices of ``SLICE`` annuli of at most ``CELL`` vectors.

Vectors that are null or hold null or non-finite components take no part.  Shorter
vectors are filled up with zeros.  A row with a null id is a candidate after all others of
its score and no query; rows with the query's id are its own, however many there are and on whatever vectors.
Repeated rows of another id take a place each.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import table

SAMPLE, PIVOTS, CELL, SLICE, QUERY_BLOCK, SALTS = 4096, 64, 4096, 256, 256, 32
NO_ID = (1 << 63) - 1
#: In place of the second id of a vector that has one.
NO_NEXT = -(1 << 63)
#: Kept below the largest distance that rounding could move.
SLACK = 1e-6


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype, int]:
    """(id, v) of the vectors that take part, as packed integers; their type and length."""
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 64))
    fine = F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole.alias("x"))
    size, most = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    dtype, size = np.dtype("<i4" if (most or 0) < 1 << 31 else "<i8"), size or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            full = np.zeros((len(lists), size), dtype)
            full[np.arange(size)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in full], pa.binary())], names=["id", "v"])

    return rows.mapInArrow(pack, "id long, v binary"), dtype, size


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """key, v, ids (the k+1 smallest, each followed by its number of rows): one row a vector."""
    keyed = rows.withColumn("key", F.md5("v"))
    times = keyed.groupBy("key", "id").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = times.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    part = some.groupBy("key", "salt").agg(F.collect_list(F.struct("id", "n")).alias("few"))
    few = part.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, k + 1).alias("few"))
    ids = F.flatten(F.transform("few", lambda x: F.array(x["id"], x["n"]))).alias("ids")
    return keyed.groupBy("key").agg(F.first("v").alias("v")).join(few, "key").select("key", "v", ids)


class Pivots:
    """Pivots in the augmented space, edges of their annuli, and a sample of vectors."""

    def __init__(self, sample: np.ndarray, apart: np.ndarray, norm2: float, rows: int):
        self.norm2, self.apart = norm2, sample[apart]
        x = self.lift(sample)
        rng = np.random.Generator(np.random.PCG64(7))
        c = x[rng.choice(len(x), min(PIVOTS, len(x)), replace=False)]
        for _ in range(8):
            near = self._far(x, c).argmin(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        self.c = c
        d = self._far(x, c)
        near = d.argmin(axis=1)
        self.edges = []
        for i in range(len(c)):
            own = np.sort(d[near == i, i])
            parts = max(4, math.ceil(rows * max(len(own), 1) / len(x) / CELL))
            self.edges.append(np.unique(np.quantile(own, np.arange(1, parts) / parts)) if len(own) else np.zeros(0))

    @staticmethod
    def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None]])

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, annulus and distance of each vector."""
        d = self._far(self.lift(x), self.c)
        near = d.argmin(axis=1)
        far = d[np.arange(len(x)), near]
        return near, np.array([np.searchsorted(self.edges[p], v, "right") for p, v in zip(near, far, strict=True)], np.int64), far

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return self._far(np.hstack([q, np.zeros((len(q), 1))]), self.c)


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through floats where no sum can pass 2**53."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if high < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _matrix(blob: bytes, dtype: np.dtype, size: int) -> np.ndarray:
    return np.frombuffer(blob, dtype).reshape(-1, size)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query."""
    spark = vectors.sparkSession
    rows, dtype, size = packed(vectors, id_col, vec_col)
    rows = table(rows, "vectors")
    out = "query_id long, rank int, vec_id long, score long"
    if not size or rows.isEmpty():
        return spark.createDataFrame([], out)
    index = table(distinct_vectors(rows, k), "distinct")
    count = index.count()
    least = index.select("key", "v", F.col("ids")[0].alias("lead")).orderBy("key").limit(SAMPLE).collect()
    sample, lead = np.stack([np.frombuffer(r.v, dtype) for r in least]), np.array([r.lead for r in least], np.int64)
    apart = np.sort(np.unique(np.where(_asks(lead, query_every), lead, -1 - np.arange(len(lead)) * query_every), return_index=True)[1])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b"".join(b.column(0).to_pylist()), dtype, size).astype(np.float64)
            yield pa.record_batch([pa.array((x * x).sum(1))], names=["n"])

    norm2 = index.select("v").mapInArrow(norms, "n double").agg(F.max("n")).first()[0]
    shared = spark.sparkContext.broadcast(Pivots(sample, apart, norm2, count))

    # the index: one row an annulus, cut by hash where an annulus holds too many vectors
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, ring, far = shared.value.key(_matrix(b"".join(b.column(0).to_pylist()), dtype, size))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(ring, pa.int32()), pa.array(far)], names=["v", "ids", "pivot", "ring", "dist"])

    def cells(groups):
        t = groups
        lead = np.array([x[0].as_py() for x in t.column("ids")], np.int64)
        t = t.take(pa.array(np.argsort(lead, kind="stable")))
        d = t.column("dist").to_numpy()
        yield_ids = [x.as_py() for x in t.column("ids")]
        return pa.table({"pivot": pa.array([t.column("pivot")[0].as_py()], pa.int32()), "lo": [float(d.min())], "hi": [float(d.max())], "x": pa.array([b"".join(t.column("v").to_pylist())], pa.binary()), "ids": pa.array([yield_ids], pa.list_(pa.list_(pa.int64())))})

    placed = index.select("v", "ids").mapInArrow(keyed, "v binary, ids array<long>, pivot int, ring int, dist double")
    placed = table(placed, "placed")
    parts = placed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    split = placed.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    index_cells = split.select("pivot", "ring", "part", "v", "ids", "dist").groupBy("pivot", "ring", "part").applyInArrow(cells, "pivot int, lo double, hi double, x binary, ids array<array<long>>")
    index_cells = table(index_cells.withColumn("cell", F.monotonically_increasing_id()), "cells")

    # queries: distinct vectors asked for, near ones together, with a first bound from the sample
    asked = rows.where((F.col("id") % query_every == 0) & (F.col("id") != NO_ID)).select(F.col("id").alias("query_id"), F.md5("v").alias("key"))
    wanted = index.select("key", "v").join(asked.select("key").distinct(), "key", "left_semi")

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b"".join(b.column(1).to_pylist()), dtype, size)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shared.value.of_queries(q).argmin(1), pa.int32())], names=["key", "v", "pivot"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, n = shared.value, 0
        base = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                q = _matrix(b"".join(part.column(1).to_pylist()), dtype, size)
                best = -np.sort(-_dot(q, p.apart), axis=1)
                first = best[:, k] if best.shape[1] > k else np.full(len(q), np.iinfo(np.int64).min)
                d = p.of_queries(q)
                far = np.where(first > np.iinfo(np.int64).min, _radius(q, first, p.norm2), np.inf)
                m = d.shape[1]
                yield pa.record_batch([pa.array([base + n] * m), pa.array(np.arange(m), pa.int32()), pa.array(d.min(0)), pa.array(d.max(0)), pa.array([float(far.max())] * m), *(pa.array([v] + [None] * (m - 1), t) for v, t in ((b"".join(part.column(1).to_pylist()), pa.binary()), (part.column(0).to_pylist(), pa.list_(pa.string())), (first.tolist(), pa.list_(pa.int64()))))], names=["block", "pivot", "near", "far", "reach", "q", "keys", "first"])
                n += 1

    near = wanted.mapInArrow(near_pivot, "key string, v binary, pivot int").repartitionByRange("pivot", "key").sortWithinPartitions("pivot", "key")
    asked_blocks = table(near.mapInArrow(blocks, "block long, pivot int, near double, far double, reach double, q binary, keys array<string>, first array<long>"), "blocks")
    bound = F.greatest(F.lit(0.0), F.col("near") - F.col("hi"), F.col("lo") - F.col("far"))
    slices = -(-index_cells.count() // SLICE)
    visits = asked_blocks.select("block", "pivot", "near", "far", "reach").join(index_cells.select("cell", "pivot", "lo", "hi"), "pivot").where(bound <= F.col("reach") * (1 + SLACK) + SLACK)
    visits = visits.select("block", "cell", bound.alias("bound"), F.pmod(F.xxhash64("cell"), F.lit(slices)).alias("slice"))
    work = visits.join(index_cells, "cell").join(asked_blocks.where("q is not null").select("block", "q", "keys", "first"), "block")
    work = work.repartition("block", "slice").sortWithinPartitions("block", "slice", "bound", "cell")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, state = shared.value, None
        for b in batches:
            for row in b.to_pylist():
                if state is None or state.at != (row["block"], row["slice"]):
                    if state:
                        yield from state.rows()
                    state = _Search((row["block"], row["slice"]), _matrix(row["q"], dtype, size), row["keys"], row["first"], p, k, query_every)
                state.visit(row["pivot"], row["lo"], row["hi"], _matrix(row["x"], dtype, size), row["ids"])
        if state:
            yield from state.rows()

    found = work.select("block", "slice", "pivot", "lo", "hi", "x", "ids", "q", "keys", "first").mapInArrow(search, "key string, score long, ids array<long>")
    # no query needs an id more than k times, nor more than 2k entries, of which k may be its own
    one, best = (Window.partitionBy(*by).orderBy(F.desc("score"), "id") for by in (("key", "id"), ("key",)))
    pair = F.transform(F.sequence(F.lit(0), F.size("ids") - 2, F.lit(2)), lambda i: F.struct(F.get("ids", i).alias("id"), F.get("ids", i + 1).alias("n")))
    found = found.select("key", "score", F.explode(pair).alias("x")).select("key", "score", "x.id", "x.n")
    found = found.withColumn("r", F.row_number().over(one)).where(F.col("r") <= k).withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * k).drop("r")
    per = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    before = F.coalesce(F.sum("n").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = asked.distinct().join(found, "key").where("id != query_id").withColumn("r", F.row_number().over(per)).where(F.col("r") <= k)
    ranked = ranked.withColumn("before", before).where(F.col("before") < k)
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))))).withColumn("rank", F.col("rank").cast("int"))
    return ranked.select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")


def _asks(ids: np.ndarray, query_every: int) -> np.ndarray:
    """Which ids are those of queries."""
    return (ids % query_every == 0) & (ids != NO_ID)


def _radius(q: np.ndarray, score: np.ndarray, norm2: float) -> np.ndarray:
    """Distance at which a query has the score."""
    q = q.astype(np.float64)
    return np.sqrt(np.maximum((q * q).sum(1) + norm2 - 2.0 * score, 0))


class _Search:
    """The best of a block of queries over one slice of the index.

    Which ids ask for a vector isn't known here, so any id may be a query's own.  Vectors
    whose smallest id is a query's are one to the count when they share it: a query can lose
    no more than one of k+1 vectors so counted.  Of those that share it, k that hold other
    ids too and k that don't are enough.
    """

    def __init__(self, at: tuple, q: np.ndarray, keys: list[str], first: list[int], pivots: Pivots, k: int, query_every: int):
        self.at, self.q, self.keys, self.k, self.norm2, self.every = at, q, keys, k, pivots.norm2, query_every
        self.floor = np.array(first, np.int64)
        self.d = pivots.of_queries(q)
        self.who, self.score, self.lead, self.next = (np.zeros(0, np.int64) for _ in range(4))
        self.ids: list[list[int]] = []

    def visit(self, pivot: int, lo: float, hi: float, x: np.ndarray, ids: list[list[int]]) -> None:
        d = self.d[:, pivot]
        least = np.maximum(0, np.maximum(d - hi, lo - d))
        reach = np.where(self.floor > np.iinfo(np.int64).min, _radius(self.q, self.floor, self.norm2), np.inf)
        ask = np.flatnonzero(least <= reach * (1 + SLACK) + SLACK)
        if not len(ask):
            return
        s = _dot(self.q[ask], x)
        i, j = np.nonzero(s >= self.floor[ask][:, None])
        if not len(i):
            return
        old = len(self.who)
        self.who = np.concatenate([self.who, ask[i]])
        self.score = np.concatenate([self.score, s[i, j]])
        self.lead = np.concatenate([self.lead, np.array([ids[n][0] for n in j], np.int64)])
        self.next = np.concatenate([self.next, np.array([ids[n][2] if len(ids[n]) > 2 else NO_NEXT for n in j], np.int64)])
        self.ids += [ids[n] for n in j]
        assert len(self.ids) == old + len(i)
        order = np.lexsort((self.next, self.lead, -self.score, self.who))
        who, (new, enough) = self.who[order], self._shared(order)
        start = np.searchsorted(who, who)
        upto = np.concatenate([[0], np.cumsum(new)])
        place = upto[:-1] - upto[start]
        keep = order[(place <= self.k) & ~enough]
        last = order[(place == self.k) & new]
        self.floor[self.who[last]] = np.maximum(self.floor[self.who[last]], self.score[last])
        self.who, self.score, self.lead, self.next = self.who[keep], self.score[keep], self.lead[keep], self.next[keep]
        self.ids = [self.ids[n] for n in keep]

    def _shared(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In this order: the first vector of each smallest id, and those with k like them before."""
        new, enough = np.ones(len(order), bool), np.zeros(len(order), bool)
        at = np.flatnonzero(_asks(self.lead[order], self.every))
        if len(at) > 1:
            who, lead, more = self.who[order][at], self.lead[order][at], self.next[order][at] != NO_NEXT
            for by, limit in (((lead, who), 1), ((more, lead, who), self.k)):
                near = np.lexsort(by)
                same = np.ones(len(at), bool)
                same[0] = False
                for c in by:
                    same[1:] &= c[near][1:] == c[near][:-1]
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
                (new if limit == 1 else enough)[at[near]] = run < 1 if limit == 1 else run >= limit
        return new, enough

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([self.keys[w] for w in self.who], pa.string()), pa.array(self.score), pa.array(self.ids, pa.list_(pa.int64()))], names=["key", "score", "ids"])
