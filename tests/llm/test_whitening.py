from fractions import Fraction

import numpy as np
import pytest

from cartulary.llm import queries, whitening

LONG = np.longdouble


def made(values, seed):
    """A symmetric matrix with the given eigenvalues, in extended precision."""
    d = len(values)
    q = whitening.orthogonal(np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(LONG))
    a = (q * np.array(values, dtype=LONG)) @ q.T
    return (a + a.T) / 2


SPECTRA = [
    [5, 3, 2, 1], [1, 1, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [1 + 1e-12, 1, 0.3, 0.3, 0.3 - 1e-6, 0.1],
    list(np.linspace(1, 1.001, 64)), [1, 0, 0, 0], [2, 2, 1, 1, 1 + 1e-4, 1 + 1e-4 + 1e-8], [1e6, 1, 1 + 1e-10, 1e-6],
    [2400, *np.random.default_rng(0).uniform(800, 1200, 63)], [7],
]


@pytest.mark.parametrize("k", range(len(SPECTRA)))
def test_refined_eigenvectors_reach_extended_precision(k):
    a = made(SPECTRA[k], k)
    values, x = whitening.eigen(a)
    top = max(map(abs, SPECTRA[k]))
    assert float(np.abs(a @ x - x * values).max()) < 1e-17 * top
    assert float(np.abs(x.T @ x - np.eye(len(a))).max()) < 1e-17
    assert np.allclose(values.astype(float), sorted(SPECTRA[k], reverse=True), rtol=0, atol=1e-15 * top)
    # far beyond what float32, the first guess, and float64 give
    assert list(values) == sorted(values, reverse=True)


def plain(rows, count=4):
    """The whole contract in a few lines, in memory."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: [int(np.floor(256 * float(c))) for c in v] for k, (_, v) in enumerate(good)}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return {
        (good[k][0], j + 1): (
            n, sum((n * c - s) ** 2 for c, s in zip(x[k], sums)),
            float(np.array([float(Fraction(n * c - s, n)) for c, s in zip(x[k], sums)]) @ u[:, j] / np.sqrt(e[j])), e[j] / np.trace(cov),
        )
        for k in x for j in range(len(e))
    }


def agree(found, wanted):
    assert {(r[0], r["component"]) for r in found} == set(wanted)
    for j in {r["component"] for r in found}:
        mine = [(r["whitened"], wanted[r[0], j][2]) for r in found if r["component"] == j]
        sign = np.sign(sum(a * b for a, b in mine))
        assert np.allclose([a for a, _ in mine], [sign * b for _, b in mine], rtol=1e-8, atol=1e-8)
    for r in found:
        n, deviation, _, explained = wanted[r[0], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    agree(queries.op13_whitening(spark, small).collect(), plain(rows))


SCHEMA = "vec_id long, embedding array<float>, label int, x string, id int, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, "x", "x") for i, v in rows], SCHEMA)


def test_odd_vectors(spark):
    draw = np.random.default_rng(2).normal(size=(40, 6)).astype(np.float32).tolist()
    rows = list(enumerate(draw)) + [(k + 100, draw[0]) for k in range(30)] + [(k + 200, draw[1]) for k in range(3)]
    rows += [(None, draw[2])]
    bad = [(900, None), (901, []), (902, [float("nan")] + draw[0][1:]), (903, [float("inf")] + draw[0][1:]), (904, [None] + draw[0][1:]), (905, [1.0, 2.0])]
    agree(whitening.whiten(vectors(spark, rows + bad)).collect(), plain(rows))


def test_no_variance_and_no_rows(spark):
    found = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in found] == [
        (1, 1, 0, None, None), (2, 1, 0, None, None)] * 2
    line = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r["component"], abs(r["whitened"] or 0), r["explained"]) for r in line] == [(1, 1.0, 1.0), (2, 0, 0.0)] * 2
    assert whitening.whiten(vectors(spark, [])).count() == 0


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[1 << 30, -(1 << 29)], [3, 5]])
    n, sums = 1 << 30, [(1 << 60) + 1, -7]
    found = [int(v) for v in whitening.deviations(x, n, sums).to_pylist()]
    assert found == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(np.array([[1 << 62]]), n, [0]).to_pylist() == [None]


def test_huge_entries_do_not_crash(spark):
    rows = [(1, [1e30, -3.4e38]), (2, [0.0, 1.0]), (3, [1.0, 0.5])]
    assert whitening.whiten(vectors(spark, rows)).count() == 6
