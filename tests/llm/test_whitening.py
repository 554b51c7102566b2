"""op13 against plain numpy over all rows, and its edge cases."""

import numpy as np

from logscope.llm import op13_whitening as op13
from logscope.llm.common import read
from logscope.llm.queries import op13_whitening


def brute(vectors, components=32):
    """n, deviation per row, whitened per row, explained: from the whole matrix at once."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_query_equals_numpy(spark, sf):
    rows = op13_whitening(spark, sf).collect()
    table = {r.vec_id: r.embedding for r in read(spark, sf, "embeddings").collect()}
    ids = sorted(table)
    n, deviation, whitened, explained = brute([table[i] for i in ids])
    assert len(rows) == 32 * len(ids)
    got = np.zeros((len(ids), 32))
    for r in rows:
        k = ids.index(r.vec_id)
        got[k, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[k])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<float>, whitened string, component double")


def test_rows_left_out_and_repeated(spark):
    rng = np.random.default_rng(3)
    good = [(i // 2 or None, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 5)))]
    good += good[:3]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    rows = op13.whiten(frame(spark, good + odd).repartition(7)).collect()
    assert len(rows) == len(good) * 5 and {r.n for r in rows} == {43}
    assert sorted((r.vec_id or 0) for r in rows) == sorted((i or 0) for i, _ in good for _ in range(5))
    n, deviation, _, explained = brute([np.float32(v) for _, v in good])
    assert sorted(r.deviation for r in rows) == sorted(d for d in deviation.tolist() for _ in range(5))
    assert np.allclose(sorted({r.explained for r in rows}, reverse=True), explained)


def test_no_variance(spark):
    one = op13.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = op13.whiten(frame(spark, [(1, [0.0, 3.0]), (2, [1.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, None if r.whitened is None else abs(r.whitened)) for r in flat if r.component == 1) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert [r.whitened for r in flat if r.component == 2] == [None, None]


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        got = op13.whiten(frame(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_merging_is_exact_far_from_the_origin():
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, size=(5000, 8)) + 10**9
    parts = [op13.Moments.of(p) for p in np.array_split(x, 13)]
    state = parts[0]
    for p in parts[1:]:
        state = state.merge(p)
    whole = op13.Moments.of(x)
    assert state.n == whole.n and list(state.total) == list(whole.total)
    assert np.abs(state.scatter - whole.scatter).max() < 1e-12 * whole.scatter.max()


def test_deviation_beyond_a_long_is_null():
    assert op13._exact(np.array([3, 4])) == 25 and op13._exact(np.array([1 << 32, 1])) is None
