"""Clusters of vectors by rounds of assignment and means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "cluster int, n long, total array<double>, cost double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by differences, so that equal points are at 0."""
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (x - c for c in centres)], axis=1)


def nearest_centres(vectors: DataFrame, centres: np.ndarray, column: str) -> DataFrame:
    """``vectors`` with cluster, the first of the nearest centres, and cost, the squared distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                gaps = _gaps(_matrix(frame[column]), centres)
                yield frame.assign(cluster=gaps.argmin(axis=1).astype("int32"), cost=gaps.min(axis=1))

    kinds = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return vectors.mapInPandas(run, f"{kinds}, cluster int, cost double")


def _round(vectors: DataFrame, centres: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of the clusters, their sizes and the whole cost; tasks return sums, a row for each cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, cost = np.zeros(len(centres), np.int64), np.zeros(centres.shape), np.zeros(len(centres))
        for frame in frames:
            if len(frame):
                x = _matrix(frame[column])
                gaps = _gaps(x, centres)
                own = gaps.argmin(axis=1)
                np.add.at(n, own, 1)
                np.add.at(total, own, x)
                np.add.at(cost, own, gaps.min(axis=1))
        yield pd.DataFrame({"cluster": np.arange(len(centres), dtype=np.int32), "n": n, "total": list(total), "cost": cost})

    size = centres.shape[1]
    sums = vectors.select(column).mapInPandas(run, SUMS).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"), F.sum("cost").alias("cost"))
    means, sizes, cost = centres.copy(), np.zeros(len(centres), np.int64), 0.0
    for row in sums.collect():  # k rows
        sizes[row.cluster] = row.n
        cost += row.cost
        if row.n:
            means[row.cluster] = np.array(row.total) / row.n
    return means, sizes, cost


def _start(vectors: DataFrame, k: int, seed: int, id_col: str, column: str) -> np.ndarray:
    """Start centres: each is drawn with a chance in proportion to its squared distance from those before.

    A row has the key -log(u) / distance for a u that its id and the seed decide,
    and the least key is drawn; one pass a centre.
    """
    u = lambda j: (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(j)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = vectors.orderBy(u(0), id_col).limit(1).select(column).collect()
    centres = np.array([first[0][0]], float)
    while len(centres) < k:
        far = nearest_centres(vectors.select(id_col, column), centres, column).where("cost > 0")
        row = far.withColumn("draw", -F.log(u(len(centres))) / F.col("cost")).orderBy("draw", id_col).limit(1).select(column).collect()
        if not row:  # no more than these different points
            break
        centres = np.vstack((centres, np.array(row[0][0], float)))
    return centres


def k_means(vectors: DataFrame, k: int = 4, *, seed: int = 7, rounds: int = 20, attempts: int = 3, least_move: float = 1.0, id_col: str = "vec_id", column: str = "embedding") -> tuple[np.ndarray, np.ndarray, float]:
    """Centres by size, the largest first, with their sizes and the whole cost: the best of some attempts.

    An attempt ends after ``rounds``, or once no centre moves by more than
    ``least_move``. Only k centres and sums ever come to the driver. Vectors are of
    one length, without nulls. Fewer than k different vectors give fewer centres; an
    empty table gives none.
    """
    rows = vectors.select(F.col(id_col), F.col(column).cast("array<double>").alias(column))
    if not rows.limit(1).count():
        return np.empty((0, 0)), np.empty(0, np.int64), 0.0
    best = None
    for attempt in range(attempts):
        centres = _start(rows, k, seed + attempt, id_col, column)
        for _ in range(rounds):
            means, _, _ = _round(rows, centres, column)
            moved = np.sqrt(np.einsum("ij,ij->i", means - centres, means - centres)).max()
            centres = means
            if moved <= least_move:
                break
        _, sizes, cost = _round(rows, centres, column)
        if best is None or cost < best[2]:
            best = (centres, sizes, cost)
    order = np.lexsort((*best[0].T[::-1], -best[1]))
    return best[0][order], best[1][order], best[2]
