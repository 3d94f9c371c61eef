"""Whitening against dense linear algebra on small tables."""

import math

import numpy as np
import pytest

from sievework.llm import whitening as wh
from tests.conftest import SMALL


def plain(vectors, k=16):
    """(kept places, n, deviations, whitened up to sign, shares) from the dense covariance."""
    good = [i for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in vectors[i]) for i in good]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    keep = [i for i in range(min(k, len(values))) if values[i] > 1e-12 * values[0]]
    own = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    return good, n, dev, own @ vecs[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def check(rows, ids, vectors, tolerance=1e-8):
    good, n, dev, white, shares = plain(vectors)
    k = white.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(good) * k and len(got) == len(rows)
    for c in range(k):
        mine = np.array([got[ids[i], c + 1]["whitened"] for i in good])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine * sign - white[:, c]).max() < tolerance * max(1, np.abs(white[:, c]).max())
        assert all(got[ids[i], c + 1]["explained"] == pytest.approx(shares[c], rel=1e-9) for i in good[:3])
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    assert [got[ids[i], 1]["deviation"] for i in good] == dev


def test_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check(wh.query(spark, SMALL).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_awkward(spark):
    rng = np.random.default_rng(1)
    vectors = [list(map(float, rng.normal(size=5))) for _ in range(60)]
    vectors += [vectors[0]] * 300 + [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, x int, whitened string").repartition(3)
    by_id = {r["vec_id"]: r["embedding"] for r in df.collect()}
    check(wh.by_component(wh.gridded(df)).collect(), ids, [by_id[i] for i in ids])
    more = df.unionByName(spark.createDataFrame([(None, [1e300] * 5, 0, ""), (7, [1.0, 2.0], 0, "")], "vec_id long, embedding array<double>, x int, whitened string"))
    assert wh.gridded(more).count() == 360
    assert wh.by_component(wh.gridded(df.where("false"))).count() == 0
    one = df.where("vec_id = 3 or embedding is null")
    assert wh.by_component(wh.gridded(one)).count() == 0  # one vector has no covariance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = wh.by_component(wh.gridded(line)).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("d", [3, 40, 120])
def test_lanczos(d):
    """Close, equal and zero eigenvalues; restarts of a full basis; a start that is an invariant space."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    for values in (np.sort(rng.random(d))[::-1], np.repeat(rng.random(d), 2)[:d], np.concatenate([[5.0, 4.0], np.zeros(d - 2)]), np.linspace(1, 0.9, d), np.ones(d), np.zeros(d)):
        a = (q * np.sort(values)[::-1]) @ q.T
        for block, most in ((4, 256), (2, 24), (16, 256)):
            got, vecs, _ = wh.lanczos(lambda b: a @ b, d, 6, block, most, 1e-12)
            assert np.abs(got - np.sort(values)[::-1][: len(got)]).max() < 1e-9
            assert np.abs(vecs.T @ vecs - np.eye(len(got))).max() < 1e-10
            assert np.abs(a @ vecs - vecs * got).max() < 1e-9


def test_large_counts_stay_exact():
    """Deviations beyond 64 bits are whole numbers of any size."""
    n, m = 3_000_000_000, np.array([[1_000_000, 1_000_064], [7, 2**50]])
    sums = [n * 1_000_000 + 5, n * 1_000_001 - 7]
    w = wh.Whitening(n, sums, np.array([s // n for s in sums]), np.zeros(2), np.ones(0), np.zeros((2, 0)))
    assert list(w.deviations(m)) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in m]


def test_sums_of_many_partitions(spark):
    rows = spark.range(0, 1000, numPartitions=30).select("id")

    def work(batches):
        return np.array([sum(b.num_rows for b in batches), 1.0])

    assert wh.added(rows, work).tolist() == [1000.0, 30.0]
