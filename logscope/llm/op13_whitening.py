"""Whitening of vectors on an integer grid, with exact moments merged pairwise.

Each partition computes the count, the local mean (held as an exact integer sum) and the scatter
about it; two such states merge by Chan's formula in a treeReduce.  The driver decomposes the
covariance, and a second pass over all rows merges the moments of the whitened values the same
way, to verify that their covariance is the identity.

A component c becomes x = floor(scale * c) + offset.  Rows whose vector is null, or holds a null
or a non-finite component, are left out.  Vectors of unlike lengths have no common covariance:
the length that most rows have is fitted (of equals the longer), and rows of other lengths are
left out.  Repeated rows and repeated or null ids count row by row.  Ties between eigenvalues:
any basis of their space.  Directions without variance (a single row, a constant component)
have no whitened value: null, and they take no part in the identity's error.  An empty table gives an
empty result; columns other than the id and the vector are ignored.

A state is 8 * d * d bytes (d the vectors' length); the driver holds some of them, whatever the
number of rows.  With d up to some thousands that is the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components kept.
COMPONENTS = 32
#: Shares of the largest eigenvalue below which a direction counts as without variance.
FLAT = 1e-12
#: Rows of which one block of moments is computed.
BLOCK = 4096
#: Depth of the tree in which states merge.
DEPTH = 3


@dataclass
class Moments:
    """Count, sum and centred scatter of some vectors; sums of integers are exact."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of the rows of ``x``."""
        n, total = len(x), x.sum(axis=0)
        # for integers n * x - total is exact, so centring loses nothing however far the origin is
        centred = (n * x - total) / n if x.dtype.kind == "i" else x - total / n
        return Moments(n, total.astype(object) if x.dtype.kind == "i" else total, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula; the difference of integer means is taken before rounding."""
        n = self.n + other.n
        apart = other.total * self.n - self.total * other.n
        delta = (apart / (self.n * other.n)).astype(float)
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n))


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    """id and vector (array of double) of the rows that take part, and their length."""
    v = rows.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    length = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (v, None) if length is None else (v.where(F.size("vector") == length["d"]), length["d"])


def _grid(column: pa.Array, d: int, scale: float, offset: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return np.floor(scale * flat).astype(np.int64) + offset


def _reduced(rows: DataFrame, block, d: int) -> Moments:
    """The moments of ``block(batch)`` over all batches of all partitions."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                new = Moments.of(block(b.slice(at, BLOCK)))
                state = new if state is None else state.merge(new)
        if state is not None:
            exact = state.total.dtype == object
            yield pa.record_batch([pa.array([state.n], pa.int64()), pa.array([[str(t) for t in state.total]]), pa.array([exact]), pa.array([state.scatter.tobytes()])], names=["n", "total", "exact", "scatter"])

    def state(row) -> Moments:
        total = np.array([int(t) for t in row.total], object) if row.exact else np.array([float(t) for t in row.total])
        return Moments(row.n, total, np.frombuffer(row.scatter).reshape(len(total), -1))

    states = rows.mapInArrow(partition, "n long, total array<string>, exact boolean, scatter binary").rdd.map(state)
    return states.treeReduce(Moments.merge, depth=DEPTH)


@dataclass(frozen=True)
class Whitening:
    """A fit: exact sums, and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: float
    offset: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, exactly."""
        return self.n * x - np.array(self.total, np.int64)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the rows of ``x``; NaN along directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            got = (self.centred(x) / self.n) @ self.vectors / np.sqrt(self.values)
        got[:, ~self.live] = np.nan
        return got

    @property
    def live(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0) if len(self.values) else np.zeros(0, bool)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values]


def fit(v: DataFrame, d: int, scale: float, offset: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows of ``v``, which isn't empty."""
    m = _reduced(v.select("vector"), lambda b: _grid(b.column(0), d, scale, offset), d)
    covariance = m.scatter / m.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    best = np.argsort(-values, kind="stable")[:components]
    return Whitening(m.n, [int(t) for t in m.total], vectors[:, best], values[best], float(np.trace(covariance)), scale, offset)


def identity_error(v: DataFrame, d: int, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity: a pass over all rows."""
    live = int(w.live.sum())
    if not live:
        return 0.0
    m = _reduced(v.select("vector"), lambda b: w.apply(_grid(b.column(0), d, w.scale, w.offset))[:, :live], live)
    return float(np.abs(m.scatter / m.n - np.eye(live)).max())


def whitened(v: DataFrame, d: int, w: Whitening) -> DataFrame:
    """id, deviation, whitened (array, null along directions without variance) of each row.

    deviation is the sum over the components of (n * x - total) squared, exact; null where that
    is beyond a long.
    """
    kind = v.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _grid(part.column(1), d, w.scale, w.offset)
                apart = w.centred(x)
                exact = (apart * apart).sum(axis=1)
                # the sum in floating point tells where the one in integers has run over
                near = (apart.astype(float) ** 2).sum(axis=1)
                deviations = [int(e) if f < 9e18 else _exact(a) for e, f, a in zip(exact, near, apart, strict=True)]
                y = w.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), from_pandas=True))
                yield pa.record_batch([part.column(0), pa.array(deviations, pa.int64()), lists], names=["id", "deviation", "whitened"])

    return v.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def _exact(apart: np.ndarray) -> int | None:
    got = sum(int(a) ** 2 for a in apart)
    return got if got < 1 << 63 else None


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64, offset: int = 1_000_000, components: int = COMPONENTS) -> DataFrame:
    """``id_col``, component (from 1), n, deviation, whitened, explained, identity_error."""
    v, d = vectors(rows, id_col, vector_col)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return v.select(F.col("id").alias(id_col), *(F.lit(None).cast(s.split()[1]).alias(s.split()[0]) for s in schema.split(", "))).where("false")
    w = fit(v, d, scale, offset, components)
    error = identity_error(v, d, w)
    each = whitened(v, d, w).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, w.explained)), F.col("at") + 1)
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"),
    )
