"""Whitening against exact sums and a plain eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherum.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)


def exact(vectors):
    """Whole numbers, their sums, and the covariance from exact fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    second = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(dim)] for i in range(dim)]
    return x, sums, np.array([[float(Fraction(s, n**3)) for s in row] for row in second])


@pytest.mark.parametrize("kind", ["spread", "equal", "two", "steep", "close", "flat"])
def test_leading_components_of_a_matrix(kind):
    rng = np.random.default_rng(len(kind))
    for d in (1, 2, 5, 33):
        values = {
            "spread": rng.random(d), "equal": np.ones(d), "two": np.where(np.arange(d) < d // 2, 1.0, 0.5),
            "steep": 10.0 ** (-np.arange(d) / 3), "close": 1 + 1e-9 * rng.random(d), "flat": np.where(np.arange(d) < 3, 1.0, 0),
        }[kind]
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = turn @ np.diag(values) @ turn.T * 3e4
        v = (v + v.T) / 2
        found, vectors = whitening.leading(v, 8)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(found) == min(8, (want > 1e-9 * want[0]).sum())
        assert np.abs(found - want[: len(found)]).max() < 1e-8
        assert np.abs(v @ vectors - vectors * found).max() < 1e-8
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 40):
        for _ in range(20):
            m = rng.standard_normal((d, d))
            m = m + m.T - np.diag(np.diag(m)) * rng.integers(0, 3)  # zero diagonals need pivots of two
            assert whitening.inertia(m) == (np.linalg.eigvalsh(m) > 0).sum()
    assert whitening.inertia(np.zeros((4, 4))) == 0


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("key", "row", "v", "whitened", "n"):
        df = df.withColumn(name, F.lit(1))
    return df


def test_awkward_rows_and_large_numbers(spark):
    rng = random.Random(2)
    good = [(i, [1e9 * (j == 2) + rng.gauss(i % 3, 1) * 10.0 ** (1.5 * j) for j in range(4)]) for i in range(90)]
    good += [(3, good[3][1]), (None, good[4][1]), (5, good[6][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [math.nan] * 4), (104, [1.0, math.inf, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0]), (107, [1.0] * 5)]
    for parts in (1, 5):
        df = rows_of(spark, good + bad).repartition(parts)
        found = whitening.fit(df)
        x, sums, v = exact([r[1] for r in good])
        n = len(good)
        assert (found.n, found.sums) == (n, sums)
        assert abs(found.trace - np.trace(v)) < 1e-9 * found.trace
        got = whitening.whiten(df, found, with_row=True).collect()
        assert len(got) == n and {r["row"]["vec_id"] for r in got} == {r[0] for r in good}
        want = {tuple(r[1]): sum((n * a - s) ** 2 for a, s in zip(y, sums, strict=True)) for r, y in zip(good, x, strict=True)}
        for r in got:
            assert int(r["deviation"]) == want[tuple(r["row"]["embedding"])]
        assert np.abs(np.cov(np.array([r["whitened"] for r in got]).T, bias=True) - np.eye(4)).max() < 1e-4


def test_no_rows_and_equal_rows(spark):
    for rows in ([], [(1, None), (2, [math.nan])], [(1, [1.0, 2.0])] * 4):
        df = rows_of(spark, rows)
        found = whitening.fit(df)
        assert (found is None) == (len(rows) < 4)
        kept = whitening.whiten(df, found).collect()
        assert [r["whitened"] for r in kept] == [[]] * (len(rows) if len(rows) == 4 else 0)
        assert whitening.identity_error(whitening.whiten(df, found), 0) == 0


def test_registered_query_is_exact(spark):
    table = queries.op11_whitening(spark, SF)
    assert dict(table.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [r for r in rows if usable(r[1], 64)]
    x, sums, v = exact([r[1] for r in rows])
    n = len(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    flat = (np.array(x, float) - np.array(sums) / n) @ vectors / np.sqrt(values)
    got = table.collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9
    place = {r[0]: i for i, r in enumerate(rows)}
    own = np.zeros((n, 8))
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        own[i, k] = r["whitened"]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert abs(r["explained"] / (values[k] / np.trace(v)) - 1) < 1e-9
    sign = np.sign((own * flat).sum(axis=0))
    assert np.abs(own * sign - flat).max() < 1e-6
