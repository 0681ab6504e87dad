"""Whitening against numpy on the whole table."""

import numpy as np
import pytest

pytest.importorskip("quirespark.llm")
from quirespark.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, "n") for k, v in rows], SCHEMA)


def plain(vectors, k=4):
    x = np.floor(np.array(vectors) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((fit - fit[0]).T.astype(float), bias=True))
    values, axes = values[::-1][:k], axes.T[::-1][:k]
    return x, n, sums, values, (x - sums / n) @ axes.T / np.sqrt(values)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).tolist()
    good += [good[5]] * 150 + [[v + 1 / 1024 for v in good[6]]]  # copies, and one that has the same integers or nearly so
    bad = [None, [], [1.0] * 6 + [None], [float("nan")] * 7, [1.0] * 6 + [float("-inf")], [1e300] * 7, [1.0, 2.0]]
    rows = [(k, v) for k, v in enumerate(good)] + [(1000 + k, v) for k, v in enumerate(bad)] + [(None, good[0]), (3, good[3])]
    d = frame(spark, rows).repartition(5)
    w = whitening.fit(d)
    x, n, sums, values, want = plain(good)
    assert (w.n, w.sums) == (n, sums.tolist()) and np.allclose(w.values, values, rtol=1e-12) and w.identity_error < 1e-9
    got = whitening.whiten(d, w).collect()
    assert len(got) == len(good) + 2 and sum(r.vec_id is None for r in got) == 1
    ours = {r.vec_id: r for r in got}
    for k in range(len(good)):
        assert ours[k].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))
        assert np.allclose(np.abs(ours[k].whitened), np.abs(want[k]), atol=1e-9)


def test_offsets_lose_no_digits(spark):
    rng = np.random.default_rng(4)
    small = rng.integers(-500, 500, (200, 3)) / 256
    far = whitening.fit(frame(spark, [(k, (v + 2.0**42).tolist()) for k, v in enumerate(small)]))
    near = whitening.fit(frame(spark, list(enumerate(small.tolist()))))
    assert np.allclose(far.values, near.values, rtol=1e-12) and far.n == near.n
    huge = frame(spark, [(0, [2.0**54, 1.0]), (1, [-(2.0**54), 0.0]), (2, [0.0, 5.0])])
    w = whitening.fit(huge)
    assert w.sums == [0, 6 * 256] and all(r.deviation is None for r in whitening.whiten(huge, w).collect() if r.vec_id < 2)


def test_few_directions_and_none(spark):
    line = frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])
    w = whitening.fit(line)
    assert len(w.values) == 1 and w.identity_error < 1e-9 and {len(r.whitened) for r in whitening.whiten(line, w).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, None), (2, [])], [(1, [3.0]), (2, [3.0])]):
        d = frame(spark, rows)
        assert whitening.whiten(d, whitening.fit(d)).collect() == []
