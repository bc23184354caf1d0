from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemart.llm import vectors
from lakemart.llm.vectors import near_vectors


def brute(rows, threshold=0.95):
    ok = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])]
    links, parent = [0] * len(ok), list(range(len(ok)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(ok):
        for j in range(i):
            b = ok[j]
            if len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(ok):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = [(r[0], links[i], least.get(find(i))) for i, r in enumerate(ok)]
    out += [(r[0], 0, r[0]) for r in rows if not any(r is o for o in ok)]
    return sorted((*r, r[0] == r[2]) for r in out if True) if all(r[0] is not None for r in out) else out


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label string, cls long")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, **options).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == sorted(brute(rows, **options))


def clustered(n, d, seed, groups=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    out = []
    for i in range(n):
        if rng.random() < 0.5:
            v = centre[rng.integers(groups)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.2, 0.35])
        elif rng.random() < 0.5:
            v = centre[0] * rng.choice([1, 3]) + rng.normal(size=d) * 0.02
        else:
            v = rng.normal(size=d)
        out.append((int(i * 7 % (n * 3)), v.astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("cell,side", [(2_000, 1 << 21), (20, 1 << 21), (20, 1)])
def test_equals_brute_force(spark, monkeypatch, cell, side):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "SIDE_BYTES", side)
    compare(spark, clustered(400, 8, 1))


def test_large_core_is_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE_BYTES", 1)
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(4)[0] + rng.normal(size=4) * 0.08).tolist()) for i in range(500)]
    compare(spark, rows + [(i + 500, rng.normal(size=4).tolist()) for i in range(200)])


def test_odd_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, []), (7, [1e-30, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [2.0, 0.0]), (10, [2.0, 0.0])]
    compare(spark, rows)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (3, 1, 3, True), (None, 0, None, True)], key=str)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell,side,turned", [(4_000, 1 << 24, None), (20, 1 << 24, 6), (20, 1, None), (20, 1, 6), (500, 1, 20)])
def test_long_vectors_equal_brute_force(spark, monkeypatch, cell, side, turned):
    """Cells in one block, cells cut in blocks, and vectors that are compared on a few directions first."""
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "SIDE_BYTES", side)
    if turned:
        directions = np.linalg.qr(np.random.default_rng(9).normal(size=(40, 40)))[0][:, :turned].astype(np.float32)
        monkeypatch.setattr(vectors, "choose_turn", lambda sample, threshold: directions)
    compare(spark, clustered(500, 40, 3))


def test_doubles_of_any_size_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "SIDE_BYTES", 1)
    rng = np.random.default_rng(4)
    rows = [(i, (np.array(v) * 10.0 ** rng.integers(-200, 200)).tolist()) for i, v in clustered(300, 24, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect())
    unit = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    assert got == sorted(brute(unit))


def test_links_at_the_threshold_are_told_in_double_precision(spark):
    """Pairs nearer to the threshold than single precision can tell."""
    rows = []
    for k in range(40):
        cosine = 0.95 + (k - 19.5) * 1e-9
        a, b = np.zeros(80), np.zeros(80)
        a[2 * k], b[2 * k], b[2 * k + 1] = 1, cosine, np.sqrt(1 - cosine**2)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(i // 2 >= 20) for i in range(80)}


def test_a_vector_goes_to_one_task_however_many_cells_are_near(spark, monkeypatch):
    """Vectors without structure lie near most cells; copies for each took executors beyond their memory."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    moved, spread = [], vectors.spread

    def watched(df, *keys):
        sent = F.octet_length("data") if "data" in df.columns else 4 * F.size("v")
        moved.append(df.agg(F.sum(sent)).first()[0])
        return spread(df, *keys)

    monkeypatch.setattr(vectors, "spread", watched)
    rng = np.random.default_rng(6)
    compare(spark, [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(600)])
    assert sum(moved) <= 2 * 600 * 64 * 4
