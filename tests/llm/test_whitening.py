import math
from fractions import Fraction

import numpy as np
import pytest

from ultraframe.llm import whitening
from ultraframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """Rows of (id, vector) by the covariance of the distinct vectors."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in kept}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(values)[::-1]
    out = {}
    for i, v in x.items():
        own = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for j, at in enumerate(order[:k], 1):
            out[i, j] = (n, deviation, abs(own @ vectors[:, at] / math.sqrt(values[at])), values[at] / values.sum())
    return out


def compare(found, expected):
    assert {(r.vec_id, r.component) for r in found} == set(expected)
    for r in found:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-6)
        assert 0 <= r.identity_error <= 1e-4


def test_equals_covariance(spark):
    found = QUERIES["op11_whitening"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(found, brute([(r[0], r[1]) for r in rows]))


def test_many_partitions_and_levels(spark, monkeypatch):
    """Forty partitions are merged along two levels; signs agree between rows."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 100]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies are fitted once
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    found = whitening.whiten(frame).collect()
    compare(found, brute(rows))
    z = {(r.vec_id, r.component): r.whitened for r in found}
    fit = np.array([[z[i, c] for c in range(1, 5)] for i in range(900)])
    assert np.abs(np.cov(fit.T, bias=True) - np.eye(4)).max() < 1e-9
    assert all(z[1000 + i, c] == z[0, c] for i in range(300) for c in range(1, 5))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 2.0]), (54, [1.0, -inf, 2.0]), (55, [1.0, 2.0]), (None, rows[3][1]), (7, rows[9][1])]
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in rows + odd], "vec_id long, embedding array<double>, x int, `a.b` int")
    found = whitening.whiten(frame).collect()
    expected = brute(rows)
    compare([r for r in found if r.vec_id is not None and r.vec_id != 7], {k: v for k, v in expected.items() if k[0] != 7})
    assert sum(r.vec_id == 7 for r in found) == 6 and sum(r.vec_id is None for r in found) == 3
    assert all(r.n == 40 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == []


def test_exact_beyond_longs(spark):
    rows = [(1, [2.0**52, 1.0]), (2, [-(2.0**52), 3.0]), (3, [5.0, 0.25])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    expected = brute(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in found} == {i: e[1] for (i, _), e in expected.items()}


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)
