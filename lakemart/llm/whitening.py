"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors become whole numbers, so their scatter is an exact integer matrix, summed on the
executors. Its characteristic polynomial is found modulo primes (one task each, by
Hessenberg reduction) and put together by Chinese remaindering. Eigenvalues are its real
roots, isolated by counting sign changes; components are null vectors of ``scatter -
root``, by inverse iteration in long decimals. What the driver sees is bounded by the
dimension: the matrix, the coefficients and the components, never a row of the table.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import spread, stored

STEPS = 64  # of an entry's unit
OFFSET = 1_000_000
COMPONENTS = 16
ROOT_BITS = 192  # a root is known to this part of itself
DIGITS = 120
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 63
HALF = 1 << 64  # sums travel in two parts, so that none outgrows a decimal


# ---- whole-number vectors and their scatter


def whole_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id``, ``x`` (longs without the offset) of the rows that have a usable vector."""
    entries = F.transform(F.col(vector_column), lambda c: STEPS * c.cast("double"))
    # NaN is greater than any number here, so one bound leaves out NaN, infinities and what no long holds
    usable = F.forall("y", lambda y: y.isNotNull() & (F.abs(y) < float(1 << 61)))
    rows = df.select(F.col(id_column).alias("id"), entries.alias("y")).where(F.col("y").isNotNull() & (F.size("y") > 0) & usable)
    return rows.select("id", F.transform("y", lambda y: F.floor(y)).alias("x"))


def same_length(rows: DataFrame) -> DataFrame:
    """Rows whose vector has the most frequent length, of equally frequent ones the longest."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (found["d"] if found else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of whole numbers, exactly, as Python integers."""
    most = int(np.abs(x).max()) ** 2 * len(x)
    if most < EXACT_FLOAT:
        return (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
    if most < EXACT_LONG:
        return (x.T @ x).astype(object)
    return x.T.astype(object) @ x.astype(object)


def _task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of dimensions and task; dimension -1 stands for the number 1."""
    total, n = None, 0
    for batch in batches:
        x = _matrix(batch.column(0))
        if not len(x):
            continue
        n += len(x)
        for start in range(0, len(x), 4096):
            block = np.hstack([np.ones((len(x[start : start + 4096]), 1), np.int64), x[start : start + 4096]])
            total = _products(block) if total is None else total + _products(block)
    if total is not None:
        i, j = np.triu_indices(len(total))
        halves = [pa.array([decimal.Decimal(v) for v in half], pa.decimal128(38, 0)) for half in zip(*(divmod(int(v), HALF) for v in total[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), *halves], ["i", "j", "high", "low"])


@dataclass(frozen=True)
class Scatter:
    """``n`` vectors, their sums, and ``n * sum(x y) - sum(x) sum(y)``, all exact: n * n times the covariance."""

    n: int
    sums: tuple[int, ...]
    matrix: tuple[tuple[int, ...], ...]

    @property
    def trace(self) -> int:
        return sum(self.matrix[k][k] for k in range(len(self.matrix)))


def scatter(fit: DataFrame) -> Scatter | None:
    """Of the vectors ``x``; None without rows. The result's size depends on the dimension alone."""
    moments = fit.select("x").mapInArrow(_task_moments, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = moments.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    if not rows:
        return None
    at = {(r["i"], r["j"]): int(r["high"]) * HALF + int(r["low"]) for r in rows}
    d = max(j for _, j in at) + 1
    n, sums = at[-1, -1], [at[-1, j] for j in range(d)]
    matrix = [[n * at[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return Scatter(n, tuple(sums), tuple(map(tuple, matrix)))


# ---- characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide all numbers below 2**64."""
    if n < 41:
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31 whose product exceeds the bound."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_modulo(matrix: tuple[tuple[int, ...], ...], p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime below 2**31, lowest first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        pivot = k + 1 + int(nonzero[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k by k part
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        row -= h[k - 1, k - 1] * minors[k - 1] % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row -= int(h[i - 1, k - 1]) * below % p * minors[i - 1] % p
        minors[k] = row % p
    return minors[d].tolist()


def characteristic_polynomial(spark, matrix: tuple[tuple[int, ...], ...]) -> list[int]:
    """det(x - matrix) of a positive semidefinite integer matrix, exact, lowest coefficient first.

    Each prime is a task's row. By Maclaurin's inequality the k-th elementary sum of the
    roots is at most binomial(d, k) * (trace / d)**k, which says how many primes decide.
    """
    d = len(matrix)
    trace = sum(matrix[k][k] for k in range(d))
    bound = max(math.comb(d, k) * (-(-(trace**k) // d**k)) for k in range(d + 1))
    primes = primes_beyond(4 * bound)

    def reduced(batches):
        for batch in batches:
            found = [polynomial_modulo(matrix, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    frame = spread(spark.createDataFrame([(p,) for p in primes], "p long"), "p")
    found = {r["p"]: r["c"] for r in frame.mapInArrow(reduced, "p long, c array<long>").collect()}
    values, product = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(product, -1, p)
        values = [v + product * ((c - v) * inverse % p) for v, c in zip(values, found[p])]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


# ---- real roots


def roots_above(polynomial: list[int], number: int, bits: int) -> int:
    """How many roots, repeated ones counted, exceed ``number / 2**bits``; exact where all roots are real.

    By Descartes' rule: the sign changes of the polynomial moved to the number.
    """
    d = len(polynomial) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]
    if number:
        for i in range(d):
            carry = c[d]
            for k in range(d - 1, i - 1, -1):
                carry = c[k] + number * carry
                c[k] = carry
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], number: int, bits: int) -> int:
    value, d = 0, len(polynomial) - 1
    for k in range(d, -1, -1):
        value = value * number + (polynomial[k] << (bits * (d - k)))
    return (value > 0) - (value < 0)


def root_interval(polynomial: list[int], rank: int, top: int) -> tuple[int, int, int, int]:
    """The rank-th largest root, which is positive: ``low``, ``bits``, first rank and number of roots there.

    The root lies in (low, low + 1] / 2**bits, an interval of at most 2**-ROOT_BITS of
    itself. Roots that no interval of that width parts share one: repeated roots.
    ``top`` is at least the largest root.
    """
    low, high, bits = 0, top, 0
    above_low, above_high = roots_above(polynomial, low, bits), 0
    while high - low > 1 or (low.bit_length() <= ROOT_BITS):
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        if above_low - above_high == 1:
            if not (at_high := _sign(polynomial, high, bits)):
                low = high - 1
                if low.bit_length() <= ROOT_BITS:  # the root is the upper end itself
                    extra = ROOT_BITS + 1 - low.bit_length()
                    high, bits = high << extra, bits + extra
                    low = high - 1
                break
            if _sign(polynomial, middle, bits) in (0, at_high):
                high = middle
            else:
                low = middle
            continue
        above = roots_above(polynomial, middle, bits)
        if above >= rank:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, bits, above_high + 1, above_low - above_high


def _decimal(number: int, bits: int, context: decimal.Context) -> decimal.Decimal:
    return context.divide(context.create_decimal(number), context.create_decimal(1 << bits))


# ---- null vectors


def null_vectors(matrix: tuple[tuple[int, ...], ...], root: tuple[int, int], count: int) -> list[list[decimal.Decimal]]:
    """``count`` orthonormal null vectors of ``matrix - root``, by inverse iteration over one elimination."""
    d = len(matrix)
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=10**6, Emin=-(10**6))) as context:
        value = _decimal(2 * root[0] + 1, root[1] + 1, context)
        a = np.array([[decimal.Decimal(v) for v in row] for row in matrix], object)
        a[range(d), range(d)] -= value
        tiny = value.scaleb(-DIGITS + 10)
        swaps = []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            swaps.append(pivot)
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
            if not a[k, k]:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            if k + 1 < d:
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            b = b.copy()
            for k in range(d):
                if swaps[k] != k:
                    b[[k, swaps[k]]] = b[[swaps[k], k]]
                b[k + 1 :] = b[k + 1 :] - a[k + 1 :, k] * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = b[k] / a[k, k]
                b[:k] = b[:k] - a[:k, k] * b[k]
            return b

        chance = np.random.default_rng(1)
        vectors = [np.array([decimal.Decimal(int(v)) for v in chance.integers(1, 1 << 30, d)], object) for _ in range(count)]
        for _ in range(3):
            basis: list[np.ndarray] = []
            for v in vectors:
                v = solved(v)
                v = v / max(abs(e) for e in v)
                for _ in range(2):
                    for other in basis:
                        v = v - other * (v * other).sum()
                basis.append(v / (v * v).sum().sqrt())
            vectors = basis
        signed = []
        for v in vectors:
            largest = max(range(d), key=lambda i: abs(v[i]))
            signed.append([e if v[largest] > 0 else -e for e in v])
        return signed


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into its whitened values; its size depends on the dimension alone."""

    scatter: Scatter
    explained: tuple[float, ...]
    weights: np.ndarray  # dimension by component, for n * x - sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: longs, or Python integers where these don't hold them."""
        n, sums = self.scatter.n, self.scatter.sums
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
        if most < EXACT_LONG:
            return n * x - np.array(sums, np.int64)
        return n * x.astype(object) - np.array(sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(np.float64) @ self.weights


def whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on the vectors ``x``, each counted as often as it comes; None where nothing varies."""
    found = scatter(fit)
    if found is None or not found.trace:
        return None
    spark = fit.sparkSession
    common = math.gcd(*(v for row in found.matrix for v in row))
    matrix = tuple(tuple(v // common for v in row) for row in found.matrix)
    trace = found.trace // common
    polynomial = characteristic_polynomial(spark, matrix)
    rank = roots_above(polynomial, 0, 0)
    wanted = min(components, rank)
    top = 1 << trace.bit_length()

    def isolated(batches):
        for batch in batches:
            rows = [tuple(map(str, root_interval(polynomial, k, top))) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(list, rows), pa.list_(pa.string()))], ["k", "root"])

    ranks = spread(spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int"), "k")
    roots = {tuple(map(int, r["root"])) for r in ranks.mapInArrow(isolated, "k int, root array<string>").collect()}

    def basis(batches):
        for batch in batches:
            for low, bits, first, count in zip(*(batch.column(i).to_pylist() for i in range(4))):
                vectors = null_vectors(matrix, (int(low), bits), count)
                texts = [[str(e) for e in v] for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + count), pa.int32()), pa.array([low] * count), pa.array([bits] * count, pa.int32()),
                     pa.array(texts, pa.list_(pa.string()))],
                    ["k", "low", "bits", "v"],
                )

    distinct = spread(spark.createDataFrame([(str(a), b, f, m) for a, b, f, m in roots], "low string, bits int, first int, count int"), "first")
    rows = sorted(distinct.mapInArrow(basis, "k int, low string, bits int, v array<string>").collect(), key=lambda r: r["k"])[:wanted]
    context = decimal.Context(prec=DIGITS)
    weights, explained = [], []
    for row in rows:
        value = _decimal((2 * int(row["low"]) + 1) * common, row["bits"] + 1, context)  # n * n times the eigenvalue
        scale = value.sqrt(context)
        weights.append([float(context.divide(decimal.Decimal(e), scale)) for e in row["v"]])
        explained.append(float(Fraction(2 * int(row["low"]) + 1, (1 << (row["bits"] + 1)) * trace)))
    return Whitening(found, tuple(explained), np.array(weights).T)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""

    def sums(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                y = model.whitened(model.deviations(x))
                y = np.hstack([np.ones((len(y), 1)), y])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r["i"], r["j"]): r["v"] / model.scatter.n for r in rows}
    return max(abs(v - at[0, i] * at[0, j] - (i == j)) for (i, j), v in at.items() if i > 0)


def whitened_vectors(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Per usable row and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c is floor(64 * c) + 1000000. The model is fitted on each distinct vector of
    such numbers once, and applied to every usable row, repeated rows and null ids included.
    Left out are rows whose vector is null, empty, holds nulls, NaN, infinities or entries of
    2**55 or more, or has another length than most vectors. Components of equal eigenvalues
    are any orthonormal ones, the same for all rows; those of eigenvalue 0 don't exist, so
    there are fewer where vectors vary in fewer directions, and none where all are equal or
    the table is empty. ``deviation`` is null where no long holds it. Other columns are not read.
    """
    usable = whole_vectors(vectors, id_column, vector_column)
    rows = same_length(usable)
    fit = stored(rows.select("x").distinct(), "distinct-vectors")  # copies go in each task, before the shuffle
    model = whitening(fit, components)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    error = identity_error(fit, model)
    k = len(model.explained)

    def applied(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                deviations = model.deviations(_matrix(part.column(1)))
                most = int(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1]
                if most < EXACT_LONG:
                    squares = pa.array((deviations.astype(np.int64) ** 2).sum(axis=1))
                else:
                    exact = [int((row.astype(object) ** 2).sum()) for row in deviations]
                    squares = pa.array([v if v < EXACT_LONG else None for v in exact], pa.int64())
                n = part.num_rows
                again = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.scatter.n)),
                        squares.take(again),
                        pa.array(model.whitened(deviations).ravel()),
                        pa.array(np.tile(np.array(model.explained), n)),
                        pa.array(np.full(n * k, error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(applied, schema).withColumnRenamed("id", id_column)
