"""Whitening against numpy's own eigenvectors and exact whole-number arithmetic; contours and counts on hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evplace.llm import whitening


def brute(rows, components=16):
    """For each row by place: n, deviation, and whitened values, with explained shares."""
    x = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    out = {}
    for d in {len(v) for v in x if v}:
        fit = sorted({tuple(v) for v in x if v and len(v) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        c = np.array([[float(a * n - b) / n for a, b in zip(v, s)] for v in fit])
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = e[::-1], u[:, ::-1]
        k = min(components, int((e > d * 1e-14 * max(e[0], 1e-300)).sum()))
        for i, v in enumerate(x):
            if v and len(v) == d:
                own = np.array([float(a * n - b) / n for a, b in zip(v, s)])
                out[i] = (n, sum((n * a - b) ** 2 for a, b in zip(v, s)), (own @ u[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum())
    return out


def held_against_brute(got, rows, loose=1e-7):
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == {rows[i][0] for i in want if len(want[i][2])}
    signs = {}
    for i, (n, deviation, z, share) in sorted(want.items()):
        mine = sorted(by.get(rows[i][0], []), key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, len(z) + 1))
        for k, r in enumerate(mine):
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9 and math.isclose(r["explained"], share[k], rel_tol=1e-9)
            if abs(z[k]) > 1e-3:
                sign = signs.setdefault((len(rows[i][1]), k), np.sign(z[k] * r["whitened"]))
                assert abs(r["whitened"] * sign - z[k]) < loose


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held_against_brute(whitening.op13_embedding_whitening(spark, f"/root/testdata/{sf}").collect(), rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [1.0, None, 2.0, 3.0, 4.0]), (105, [1.0, float("nan"), 2.0, 3.0, 4.0]), (106, [float("inf")] * 5)]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (300, [1.0, 0.0, 3.0]), (301, [2.0, 0.0, 5.0]), (302, [3.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("no").alias(c) for c in ("id", "x", "dim", "n", "component")])
    got = whitening.whitened(df.repartition(3)).collect()
    held_against_brute(got, rows)  # 200 and 201 are one vector without variance: no rows; 300 to 302 have two components
    assert {r["vec_id"] for r in got} >= {100, 101} and not {r["vec_id"] for r in got} & {102, 103, 104, 105, 106, 200, 201}
    assert whitening.whitened(df.limit(0)).collect() == []
    ids = whitening.whitened(spark.createDataFrame([(None, [1.0]), (None, [2.0]), (7, [4.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(str(r["vec_id"]) for r in ids) == ["7", "None", "None"] and sum(r["whitened"] for r in ids) == pytest.approx(0, abs=1e-9)


def test_huge_values_are_exact_or_null(spark):
    rows = [(0, [1e12, 1.0]), (1, [-1e12, 2.0]), (2, [3.0, 5.0]), (3, [1e300, 0.0])]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(v is None for v in got.values()) and len(got) >= 4
    few = brute(rows[:3])
    close = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame([(i, [v[0] / 1e5, v[1]]) for i, v in rows[:3]], "vec_id long, embedding array<double>")).collect()}
    assert few and close == {i: w[1] for i, w in brute([(i, [v[0] / 1e5, v[1]]) for i, v in rows[:3]]).items()}


@pytest.mark.parametrize("values", [np.linspace(1, 2, 40), np.r_[np.full(20, 3.0), np.linspace(0, 1, 20)], np.r_[1e6, 1e5, np.full(5, 7.0), 7.0 + 1e-7, np.zeros(30)], np.r_[5.0], np.zeros(4), 2.0 ** -np.arange(40)])
def test_contours_miss_no_eigenvalue(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    slices = whitening.spectrum_slices(a)
    found = [whitening.contour_eigenpairs(a, *s) for s in slices]
    e = np.sort(np.concatenate([f[0] for f in found]))[::-1] if found else np.empty(0)
    true = np.linalg.eigvalsh(a)[::-1]
    k = min(16, int((true > len(a) * 1e-14 * max(true[0], 1e-300)).sum()))
    assert len(e) >= k and np.allclose(e[:k], true[:k], rtol=1e-9, atol=1e-11 * max(true[0], 1e-300))
    for v, u in found:
        assert np.allclose(u.T @ u, np.eye(len(v)), atol=1e-10) and np.abs(a @ u - u * v).max(initial=0) < 1e-9 * max(true[0], 1e-300)
    d, b = whitening.tridiagonal(a)
    for shift in (0.5, 1.5, 6.9, -1.0):
        assert whitening.count_above(d, b, shift) == (true > shift).sum()
