import cases  # noqa: F401
import numpy as np
import pytest
from tripledger.llm import whitening


def table(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return made.selectExpr("*", "1 AS x", "'d' AS i", "2 AS component", "3 AS n", "4 AS v")


def whole(v):
    return tuple(int(np.floor(64 * float(np.float32(e)))) + 1_000_000 for e in v)


def check(spark, rows, most=16):
    """Every row against eigenvalues and exact sums worked out here."""
    got = whitening.whiten(table(spark, rows).repartition(3), most).collect()
    kept = [(i, whole(v)) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    listed = sorted({x for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    centred = np.array([[(x * n - s) / n for x, s in zip(v, sums, strict=True)] for v in listed])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    size = min(most, int((values > 1e-10 * values[0]).sum()))
    held = {}
    for r in got:
        held.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    expected = {}
    for i, x in kept:
        key = (i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        expected[key] = expected.get(key, 0) + size
    assert {k: len(v) for k, v in held.items()} == expected
    whitened = {}
    for r in got:
        assert r["n"] == n and 1 <= r["component"] <= size
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        whitened.setdefault((r["vec_id"], r["component"]), set()).add(r["whitened"])
        assert r["identity_error"] < 1e-6
    places = {x: i for i, x in kept}
    w = np.array([[min(whitened[places[x], c]) for c in range(1, size + 1)] for x in listed])
    assert np.abs(w.T @ w / n - np.eye(size)).max() < 1e-6
    # A projection on eigenvectors: the components' loadings diagonalise the covariance.
    loadings = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[:size])
    if len(listed) > covariance.shape[0]:
        assert np.abs(covariance @ loadings - loadings * values[:size]).max() < 1e-7 * values[0]


def test_against_eigenvalues_and_exact_sums(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(24, 24)) * np.geomspace(5, 0.2, 24)
    rows = [(k, (rng.normal(size=24) @ mixing.T).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [rows[0], rows[0], (None, rows[1][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 22), (2002, [float("nan")] * 24),
             (2003, [float("-inf")] + [0.0] * 23)]
    check(spark, rows)


def test_fewer_dimensions_and_rank_than_components(spark):
    rng = np.random.default_rng(2)
    check(spark, [(k, rng.normal(size=3).tolist()) for k in range(50)])
    # Five distinct vectors in twenty dimensions span four directions.
    check(spark, [(k, v) for k in range(5) for v in [rng.normal(size=20).tolist()]])
    # A dimension that never varies and two that are equal.
    rows = [(k, [float(a), 3.0, float(a), float(b)]) for k, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    check(spark, rows)


def test_dimensions_of_very_different_size(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(a * 3e8), float(b), float(c * 40)]) for k, (a, b, c) in enumerate(rng.normal(size=(200, 3)))]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-4
    listed = [whole(v) for _, v in rows]
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for (i, _), x in zip(rows, listed, strict=True)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == exact


def test_nothing_varies(spark):
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_each_width_is_a_space_of_its_own(spark):
    rows = [(k, [float(k), float(k * k)]) for k in range(9)] + [(k, [float(k % 4)]) for k in range(20, 30)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {(r["n"], r["component"]) for r in got} == {(9, 1), (9, 2), (4, 1)}


def test_entry_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(table(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    for size, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        b = rng.normal(size=(size, rank)) * np.geomspace(1, 1e-6, rank)
        a = b @ b.T
        factor, order = whitening.pivoted_cholesky(a)
        assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-14 * np.abs(a).max())
        assert np.allclose(factor, np.tril(factor))
        values, vectors = whitening.eigen(a)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, a, atol=1e-13 * np.abs(a).max())
        if rank == size:
            assert np.allclose(values, np.linalg.svd(b, compute_uv=False) ** 2, rtol=1e-3)
    # Graded: small eigenvalues keep their digits beside large ones.
    scale = np.geomspace(1e8, 1, 10)
    core = np.eye(10) + 0.3 * np.ones((10, 10))
    values, _ = whitening.eigen(core * np.outer(scale, scale))
    assert np.allclose(1 / values[::-1], whitening.eigen(np.linalg.inv(core) / np.outer(scale, scale))[0], rtol=1e-9)
