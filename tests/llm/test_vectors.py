import numpy as np
import pytest

from leafmill.llm.vectors import Space, coded, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n long, key string"


def brute(rows, cosine=0.95):
    good = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for size in {len(v) for _, v in good}:
        same = [(i, v) for i, v in good if len(v) == size]
        u = np.array([v / np.linalg.norm(v) for _, v in same])
        near = (u @ u.T >= cosine) & ~np.eye(len(u), dtype=bool)
        low = np.array([i for i, _ in same])
        while True:
            new = np.minimum(low, np.where(near, low[None, :], low.max()).min(axis=1))
            if (new == low).all():
                break
            low = new
        out |= {i: (int(k), int(c), i == c) for (i, _), k, c in zip(same, near.sum(axis=1), low, strict=True)}
    return out


def some_vectors(size=16):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for copies in [1] * 60 + [2] * 20 + [9, 40]:
        base = rng.normal(size=size)
        for _ in range(copies):
            rows.append((n, [float(x) for x in base + rng.normal(size=size) * rng.choice([0, 0.1, 0.2, 0.25])]))
            n += 1
    rows += [(n, rows[3][1]), (n + 1, [x * 3.0 for x in rows[3][1]])]
    rows += [(n + 2, None), (n + 3, [0.0] * size), (n + 4, [float("nan")] * size), (n + 5, [1.0] * (size - 1)), (n + 9, [2.0] * (size - 1)), (n + 10, [1.0] * (3 * size)), (n + 6, []), (n + 7, [None] + [1.0] * (size - 1)), (n + 8, [float("inf")] * size)]
    return rows


@pytest.mark.parametrize("piece", [6000, 5])
def test_equals_brute_force(spark, piece):
    rows = some_vectors()
    df = spark.createDataFrame([(i, v, 0, 1, "k") for i, v in rows], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, piece=piece).collect()}
    expected = {i: (0, i, True) for i, _ in rows} | brute(rows)
    assert got == expected


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, near_vectors(df).collect()), key=str)
    assert got == sorted([(2, 2, 2, True), (2, 2, 2, True), (None, 0, None, True), (5, 2, 2, False), (6, 0, 6, True)], key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_cells_do_not_depend_on_the_batch():
    codes, _ = coded(np.random.default_rng(3).normal(size=(50, 64)))
    where = Space(64, 0.95, 36, 2.4)
    assert (where.turned(codes)[7:8] == where.turned(codes[7:8])).all()
    assert (where.cells(where.turned(codes))[7:8] == where.cells(where.turned(codes[7:8]))).all()


def pairs_at(cosine, size, n):
    """n pairs of unit vectors of that cosine, to the last digits."""
    rng = np.random.default_rng([4, size])
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=(n, size))
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1)[:, None]


@pytest.mark.parametrize(("cosine", "size", "least"), [(0.9501, size, 0.99) for size in (4, 8, 16, 23, 24, 32, 64, 100, 384, 768)] + [(0.96, 64, 0.998), (0.98, 64, 0.9999), (0.9501, 2, 0.99)])
def test_recall_of_pairs_by_their_cosine(cosine, size, least):
    n = 4000 if size < 300 else 600
    x, y = pairs_at(cosine, size, n)
    codes, slack = coded(np.concatenate((x, y)) / np.abs(np.concatenate((x, y))).max(axis=1)[:, None])
    where = Space(size, 0.95, 36, 2.4)
    assert (where.first_grid(where.turned(codes), slack, np.arange(n), np.arange(n) + n) >= 0).mean() >= least


@pytest.mark.parametrize("size", [4, 8, 16, 23, 24, 64, 768])
def test_no_links_are_lost_at_the_threshold(spark, size):
    """Whole runs, with pairs just over and just under the line."""
    n = 300 if size < 100 else 60
    over, under = pairs_at(0.9501, size, n), pairs_at(0.9499, size, n)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((*over, *(-u * 3 for u in under))))]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    true = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert all(got[i] <= true[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * true.sum() and true.sum() >= 2 * n


def test_few_pairs_of_unlike_vectors_share_a_cell():
    rng, where = np.random.default_rng(5), Space(64, 0.95, 36, 2.4)
    for n in (2_000, 20_000):
        codes, _ = coded(rng.normal(size=(n, 64)) / 5)
        cells = where.cells(where.turned(codes))
        met = sum(int((c * (c - 1) // 2).sum()) for g in range(cells.shape[1]) for c in [np.unique(cells[:, g], return_counts=True)[1]])
        assert met < 0.05 * n * (n - 1) / 2
