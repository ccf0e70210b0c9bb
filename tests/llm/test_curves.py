import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import curves

SCHEMA = "vec_id long, embedding array<double>, rep string, score double"


def brute(rows, every, k):
    """Nearest by comparing all, ties to smaller ids."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for q, x in good:
        if q % every == 0:
            scores = sorted((-float(np.einsum("i,i->", x, y)), i) for i, y in good if i != q and len(y) == len(x))
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(c) if c is not None else None for c in v] if v is not None else None, "x", 0.5) for i, v in rows], SCHEMA).repartition(3)
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in curves.nearest_vectors(df, **options).collect()}


def recall(got, true):
    pairs = lambda s: {(q, v) for q, _, v, _ in s}
    return len(pairs(got) & pairs(true)) / len(pairs(true))


def test_keys_follow_the_curve():
    for axes, bits in ((2, 4), (3, 3), (1, 6)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = curves.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_exact(spark):
    """Copies, ties, nulls, zeros, unlike lengths and norms, and lists shorter than k."""
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (30, 5))
    rows = [(i, base[i % 30].tolist()) for i in range(90)] + [(200 + i, (100.0 * base[i]).tolist()) for i in range(5)]
    rows += [(100, None), (120, []), (140, [0.0] * 5), (160, [1.0, None, 2.0, 3.0, 4.0]), (180, [float("nan")] * 5), (300, [1e-300, 0, 0, 0, 0]), (None, [1.0] * 5), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [7.0])]
    assert found(spark, rows, k=8) == brute(rows, 20, 8)


def test_half_of_all_are_one_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 == 0 else rng.normal(size=3).tolist()) for i in range(400)]
    assert found(spark, rows, k=5) == brute(rows, 20, 5)


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths"])
def test_recall_by_windows_of_small_blocks(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.uniform(0.5, 1.5, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, true = found(spark, rows, k=10, block=64), brute(rows, 20, 10)
    assert len(got) == len(true) == 1500
    assert recall(got, true) >= 0.9


def test_clusters_need_few_comparisons(spark):
    """The fitted window follows the data: a small part of all where vectors lie in clusters."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 32))[np.repeat(np.arange(100), 30)] + 0.05 * rng.normal(size=(3000, 32))
    seen = []
    fit = curves.fitted_window
    curves.fitted_window = lambda *a: seen.append(fit(*a)) or seen[-1]
    try:
        found(spark, [(i, v.tolist()) for i, v in enumerate(x)], k=10, block=64)
    finally:
        curves.fitted_window = fit
    assert seen[0] <= 300


def test_no_rows_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert curves.nearest_vectors(empty).collect() == []
    assert curves.nearest_vectors(spark.createDataFrame([(1, [1.0], "x", 0.0)], SCHEMA)).collect() == []
    assert curves.nearest_vectors(spark.createDataFrame([(20, [1.0], "x", 0.0)], SCHEMA)).collect() == []


def test_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in curves.nearest_vectors(table.withColumn("key", F.lit(1))).collect()}
    assert recall(got, brute(rows, 20, 20)) >= 0.9
