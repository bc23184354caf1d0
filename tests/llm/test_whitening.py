from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemart.llm import whitening as w
from lakemart.llm.common import importable

FOLDER = "/root/testdata/sf0.001"


def brute_force(rows, components=16):
    """vec_id, then per component whitened (up to sign) and explained, with numpy's symmetric solver."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    mean = fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    return len(fit), (x - mean) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov), ((len(fit) * x - fit.sum(0)) ** 2).sum(1)


def by_row(df, k):
    rows = df.orderBy("vec_id", "component").collect()
    assert [r["component"] for r in rows] == list(range(1, k + 1)) * (len(rows) // k)
    return rows, np.array([r["whitened"] for r in rows]).reshape(-1, k)


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()]
    n, expected, explained, deviations = brute_force(given)
    rows, got = by_row(w.whitened_vectors(importable(spark) and df), 16)
    assert np.abs(got - expected * np.sign((got * expected).sum(0))).max() < 1e-9
    assert {r["n"] for r in rows} == {n}
    assert [r["deviation"] for r in rows[::16]] == deviations.tolist()
    assert np.allclose([r["explained"] for r in rows[:16]], explained, rtol=1e-12)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def faddeev(matrix):
    """Coefficients of det(x - matrix), lowest first, by traces of powers."""
    d = len(matrix)
    a = np.array(matrix, object)
    c, m = [Fraction(1)], np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = a.dot(m) + np.eye(d, dtype=int).astype(object) * c[-1]
        c.append(-Fraction(sum(a.dot(m)[i, i] for i in range(d))) / k)
    return [int(v) for v in reversed(c)]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_is_exact(spark, d):
    chance = random.Random(d)
    x = [[chance.randint(-(10**6), 10**6) for _ in range(d)] for _ in range(d + 1 if d != 7 else 3)]
    matrix = tuple(tuple(sum(r[i] * r[j] for r in x) for j in range(d)) for i in range(d))
    assert w.characteristic_polynomial(importable(spark), matrix) == faddeev(matrix)


def test_polynomial_of_sparse_matrices(spark):
    matrix = ((4, 0, 0, 0), (0, 9, 0, 2), (0, 0, 4, 0), (0, 2, 0, 9))
    assert w.characteristic_polynomial(importable(spark), matrix) == faddeev(matrix)
    p = w.primes_beyond(10**40)
    assert w.polynomial_modulo(matrix, p[0]) == [v % p[0] for v in faddeev(matrix)]
    assert len(set(p)) == len(p) == 5


def times(roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    return c


@pytest.mark.parametrize("roots", [[5, 3, 1], [7, 7, 7, 2], [8, 8, 4, 4, 0, 0], [10**30 + 1, 10**30, 10**30 - 1, 1], [1, 1], [3]])
def test_roots_are_isolated(roots):
    polynomial = times(roots)
    for rank, root in enumerate(roots, 1):
        if root:
            low, bits, first, count = w.root_interval(polynomial, rank, 1 << (sum(roots).bit_length()))
            assert Fraction(low, 1 << bits) < root <= Fraction(low + 1, 1 << bits)
            assert low.bit_length() > w.ROOT_BITS
            assert (first, count) == (roots.index(root) + 1, roots.count(root))
    assert w.roots_above(polynomial, 0, 0) == sum(r > 0 for r in roots)


def frame(spark, rows, kind="double"):
    importable(spark)
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, id string, x string, component string, n string")


def full(rows):
    return [(i, v, 0, "a", "b", "c", "d") for i, v in rows]


def test_equal_eigenvalues(spark):
    axes = [[float(s * (i == k)) for i in range(4)] for k in range(4) for s in (1, -1)]
    rows, got = by_row(w.whitened_vectors(frame(spark, full(enumerate(axes)))), 4)
    assert np.allclose(got.T @ got / 8, np.eye(4), atol=1e-12)
    assert [r["explained"] for r in rows[:4]] == [0.25] * 4 and rows[0]["identity_error"] < 1e-12


def test_nearly_equal_eigenvalues(spark):
    chance = np.random.default_rng(3)
    x = chance.normal(size=(400, 6)) * np.array([1, 1, 1, 1.0001, 2, 0.01])
    given = list(enumerate(x.tolist()))
    rows, got = by_row(w.whitened_vectors(frame(spark, full(given))), 6)
    _, expected, explained, _ = brute_force(given)
    assert np.abs(got - expected * np.sign((got * expected).sum(0))).max() < 1e-7
    assert np.allclose([r["explained"] for r in rows[:6]], explained, rtol=1e-9)


def test_odd_rows(spark):
    chance = np.random.default_rng(4)
    good = [(i, v) for i, v in enumerate(chance.normal(size=(60, 3)).tolist())]
    again = [(7, good[7][1]), (None, good[8][1]), *[(100 + k, good[9][1]) for k in range(500)]]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 2.0])]
    odd += [(205, [1.0, float("-inf"), 2.0]), (206, [1.0, 2.0]), (207, [1.0, 2.0**60, 0.0]), (None, None)]
    out = w.whitened_vectors(frame(spark, full(good + again + odd)))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids = sorted((r["vec_id"] for r in out.where("component = 1").collect()), key=str)
    assert ids == sorted([i for i, _ in good + again], key=str)
    alone = w.whitened_vectors(frame(spark, full(good)))
    assert out.select("n").distinct().collect() == alone.select("n").distinct().collect() == [(60,)]
    same = out.groupBy("vec_id", "component").agg(F.first("whitened").alias("w")).join(alone, ["vec_id", "component"])
    assert same.where("abs(w - whitened) > 1e-12").count() == 0 and same.count() == 180


def test_flat_and_empty_tables(spark):
    flat = [(k, [1.0, float(k % 5), 2.0 * (k % 5)]) for k in range(20)]  # varies along one line only
    rows, got = by_row(w.whitened_vectors(frame(spark, full(flat))), 1)
    assert rows[0]["explained"] == 1.0 and np.allclose(got.std(), 1.0)
    assert w.whitened_vectors(frame(spark, full([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).count() == 0
    assert w.whitened_vectors(frame(spark, [])).count() == 0
    assert w.whitened_vectors(frame(spark, full([(1, None)]))).count() == 0


def test_large_entries(spark):
    """Sums beyond doubles and longs stay exact."""
    big = [(k, [float((k * 7919 % 101) * 2**e) for e in (0, 30, 47)]) for k in range(40)]
    out = w.whitened_vectors(frame(spark, full(big)), components=1)
    fit = w.scatter(w.whole_vectors(frame(spark, full(big)), "vec_id", "embedding"))
    x = [[int(64 * c) for c in v] for _, v in big]
    expected = [[40 * sum(r[i] * r[j] for r in x) - sum(r[i] for r in x) * sum(r[j] for r in x) for j in range(3)] for i in range(3)]
    assert [list(r) for r in fit.matrix] == expected
    assert {r["deviation"] for r in out.collect()} == {None}


def test_floor_goes_down_and_floats_are_widened(spark):
    given = [(1, [-0.001, 0.1]), (2, [0.9999, -0.1]), (3, [1.5, 0.3])]
    rows = w.whole_vectors(frame(spark, full(given), "float"), "vec_id", "embedding").orderBy("id").collect()
    assert [r["x"] for r in rows] == [[int(np.floor(64 * float(np.float32(c)))) for c in v] for _, v in given]
