"""Whitening against a full eigendecomposition, exact sums and awkward vectors."""

import math

import numpy as np
import pytest

from cytoloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component int, label int"
OFFSET = 1_000_000


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", 2, 3) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, dims):
    """Rows that take part, their x, and the exact sums of the distinct ones."""
    rows = []
    for i, v in vectors:
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        c = [float(np.float32(e)) for e in v] + [0.0] * (dims - len(v))
        rows.append((i, tuple(min(max(math.floor(64 * e), -(2**52)), 2**52) + OFFSET for e in c)))
    fit = sorted({x for _, x in rows})
    return rows, fit, [sum(x[d] for x in fit) for d in range(dims)]


def run(spark, vectors, wanted=16):
    x = whitening.sound_vectors(table(spark, vectors))
    model = whitening.fit_whitening(x, wanted)
    return model, whitening.whiten(x, model).collect()


def clouds():
    rng = np.random.default_rng(3)
    data = rng.standard_normal((300, 12)) * np.geomspace(5, 0.2, 12) + 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    return rows + [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0, 2.0]), (2005, [])]


def test_against_full_decomposition(spark):
    vectors = clouds()
    model, got = run(spark, vectors, wanted=5)
    rows, fit, sums = plain(vectors, 12)
    n = len(fit)
    centred = np.array([[n * e - s for e, s in zip(x, sums)] for x in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:5], axes[:, ::-1][:, :5]
    assert model.frame.n == n and model.frame.sums == sums
    assert len(got) == 5 * len(rows)
    want = {}
    for i, x in rows:
        spread = [n * e - s for e, s in zip(x, sums)]
        y = np.array(spread, float) / n @ axes / np.sqrt(values)
        want.setdefault(i, []).append((sum(e * e for e in spread), np.abs(y)))
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / (centred**2).sum() * n, rel=1e-10)
        assert any(
            r["deviation"] == deviation and abs(r["whitened"]) == pytest.approx(y[r["component"] - 1], rel=1e-7, abs=1e-8)
            for deviation, y in want[r["vec_id"]]
        )
    # One sign per component: whitened coordinates of the fit have no correlation with the wrong sign.
    signs = model.components @ axes
    assert np.abs(np.abs(np.diag(signs)) - 1).max() < 1e-10


def test_equal_eigenvalues_and_low_rank(spark):
    corners = [(2 * d + s, [float((1 - 2 * s) * (d == e)) for e in range(8)]) for d in range(8) for s in (0, 1)]
    model, got = run(spark, corners)
    assert len(model.variances) == 8 and np.ptp(model.variances) < 1e-9 * model.variances[0]
    assert model.identity_error <= 1e-9 and len(got) == 16 * 8
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(30)]
    model, got = run(spark, flat)
    assert len(model.variances) == 1 and model.identity_error <= 1e-9 and len(got) == 30


def test_no_variance_and_empty(spark):
    for vectors in ([(1, [1.0, 2.0])] * 4, [(1, None)], []):
        model, got = run(spark, vectors)
        assert got == [] and len(model.variances) == 0


def test_huge_entries(spark):
    vectors = [(i, [1e30 * (i % 2), float(i), 3e38 * (i % 3 - 1)]) for i in range(12)]
    model, got = run(spark, vectors)
    rows, fit, sums = plain(vectors, 3)
    assert model.frame.sums == sums
    exact = {i: sum((len(fit) * e - s) ** 2 for e, s in zip(x, sums)) for i, x in rows}
    assert got and all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 2**63 else None) for r in got)


def test_offset_does_not_cost_digits(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 6)) * 0.05)]
    near, _ = run(spark, vectors)
    x = whitening.sound_vectors(table(spark, vectors), offset=10**12)
    far = whitening.fit_whitening(x, offset=10**12)
    assert np.allclose(near.variances, far.variances, rtol=1e-12)
