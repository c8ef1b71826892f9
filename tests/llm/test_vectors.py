import cases  # noqa: F401
import numpy as np
from pyspark.sql import functions as F
from tripledger.llm import vectors


def brute(rows, k, asks):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if asks(i)}:
        scores = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), j)
            for j, v in whole
            if j != i and len(v) == len(q)
        )
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return made.select("*", F.lit(1).alias("v"), F.lit("x").alias("query_id"), F.lit(2).alias("rank"))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=8) * (1 + 50 * (k % 7 == 0))).tolist()) for k in range(300)]
    rows += [(400 + k, rows[k][1]) for k in range(30)]  # ties
    rows += [(500, None), (510, [1.0, None] + [0.0] * 6), (520, [float("nan")] + [0.0] * 7),
             (530, [float("inf")] + [0.0] * 7), (None, [0.5] * 8), (540, []), (550, []),
             (560, [0.0] * 8), (570, [0.25] * 3), (580, [1.0] * 3)]
    got = vectors.top_k(vectors.whole_vectors(frame(spark, rows)), F.col("vec_id") % 10 == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, lambda i: i % 10 == 0)


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(120)]
    got = vectors.top_k(vectors.whole_vectors(frame(spark, rows)), F.col("vec_id") % 4 == 0, 3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, lambda i: i % 4 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    rows = rng.integers(-700, 700, (2000, 32))
    cells = vectors.Cells(rows.min(axis=0), rows.max(axis=0))
    middle, slack = cells.middles(cells.of(rows)), cells.slack(rows[:50])
    exact = rows[:50] @ rows.T
    assert (np.abs(rows[:50] @ middle.T - exact) <= slack[:, None]).all()
    reach = (rows[:50] @ middle.T + slack[:, None]) >= np.sort(exact, axis=1)[:, -10][:, None]
    assert reach.mean() < 0.05


def test_fewer_rows_than_asked_and_none(spark):
    few = vectors.whole_vectors(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]))
    assert [tuple(r) for r in vectors.top_k(few, F.col("vec_id") == 0, 10).collect()] == [
        (0, 1, 1, 1024 * 2048), (0, 2, 2, -1024 * 1024),
    ]
    assert vectors.top_k(few.limit(0), F.col("vec_id") == 0, 10).count() == 0


def test_large_components_and_many_dimensions(spark):
    few = [(0, [1.0, 2.0]), (1, [300_000.0, -1.0]), (2, [300_000.0, 5.0])]
    got = vectors.top_k(vectors.whole_vectors(frame(spark, few)), F.col("vec_id") == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(few, 10, lambda i: i == 0)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=160) * (1e5 if k % 3 else 1e-2)).tolist()) for k in range(60)]
    rows += [(100 + k, [(-1.0) ** (j + k) * 1.5e5 for j in range(160)]) for k in range(4)]
    got = vectors.top_k(vectors.whole_vectors(frame(spark, rows)), F.col("vec_id") % 10 == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, lambda i: i % 10 == 0)


def test_scores_beyond_a_long_are_an_error():
    one = np.array([[2**40, 1]])
    assert vectors.products(one, np.array([[2**22, -5]])).tolist() == [2**62 - 5]
    assert vectors.products(np.array([[2**40, 2**40]]), np.array([[2**30, 1 - 2**30]])).tolist() == [2**40]
    with np.testing.assert_raises(ValueError):
        vectors.products(one, one)
