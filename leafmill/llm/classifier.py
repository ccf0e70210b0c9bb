"""A quality classifier: kernel ridge by random Fourier features, then isotonic calibration.

Document statistics are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Partitions sum
their part of the normal equations; the ridge solution is of fixed size whatever
the corpus. Rows of one fold that the ridge has not seen calibrate its output by
pooling adjacent violators over binned scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, fold_of
from leafmill.llm.stats import FEATURES, labelled, matrix, with_stats

BINS = 1000
#: Labelled rows that a classifier is fitted on, about so many at most.
FIT_ROWS = 200_000


@dataclass(frozen=True)
class Fourier:
    """The map from statistics to random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        # a column of ones stands for the intercept
        return np.hstack([np.cos(z @ self.weights + self.phases) * np.sqrt(2.0 / len(self.phases)), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Classifier:
    features: Fourier
    beta: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, from 0 to 1; the last thousandth orders rows of one step."""
        raw = self.raw(x)
        steps = np.interp(raw, self.edges, self.values)
        return np.clip(0.999 * steps + 0.001 * np.clip(raw, 0.0, 1.0), 0.0, 1.0)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nondecreasing fit: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def _normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y; each partition sends its sum, by row of the matrix."""
    size = len(features.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            f = features(matrix(batch.column(1)))
            total[:, :size] += f.T @ f
            total[:, size] += f.T @ np.asarray(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.select("label", "stat_features").mapInArrow(run, "i int, sums array<double>")
    summed = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = summed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).collect()
    table = np.zeros((size, size + 1))
    for r in found:
        table[r["i"]] = [x["v"] for x in r["row"]]
    return table[:, :size], table[:, size]


def fit(stats: DataFrame, labels: DataFrame, *, dimensions: int = 256, ridge: float = 1e-3, width: float = 3.0, fit_rows: int = FIT_ROWS, seed: int = 7) -> Classifier:
    """Fit ``labels.quality`` on document statistics, rows of fold 0 left out.

    Folds 1 to 3 give the ridge, fold 4 the calibration, of about ``fit_rows``
    rows together at most. With no usable rows all scores are 0.5.
    """
    rows = labelled(stats, labels, "quality", fit_rows)
    ridge_rows = rows.where("fold <> 4").coalesce(8)
    ends = range(len(FEATURES))
    moments = ridge_rows.agg(F.count("*").alias("n"), *[f(F.col("stat_features")[i]).alias(f"{f.__name__}_{i}") for i in ends for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(len(FEATURES), dimensions)) / width
    phases = rng.uniform(0, 2 * np.pi, dimensions)
    if not moments["n"]:
        return Classifier(Fourier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), weights, phases), np.zeros(dimensions + 1), np.array([0.0]), np.array([0.5]))
    scale = np.array([max(moments[f"stddev_pop_{i}"], 1e-3) for i in ends])
    features = Fourier(np.array([moments[f"avg_{i}"] for i in ends]), scale, weights, phases)
    a, b = _normal_equations(ridge_rows, features)
    penalty = np.full(dimensions + 1, ridge * moments["n"] / dimensions)
    penalty[-1] = 1e-9
    beta = np.linalg.solve(a + np.diag(penalty), b)
    model = Classifier(features, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.clip(np.round(model.raw(matrix(batch.column(1))) * BINS), -BINS, 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place, pa.int32())], ["label", "bin"])

    held = rows.where("fold = 4").select("label", "stat_features").mapInArrow(run, "label double, bin int")
    bins = sorted((r["bin"], r["n"], r["mean"]) for r in held.groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("mean")).collect())
    if not bins:
        return model
    place, n, mean = (np.array(x, float) for x in zip(*bins, strict=True))
    return Classifier(features, beta, place / BINS, isotonic(n, mean))


def score(stats: DataFrame, model: Classifier, threshold: float = 0.3) -> DataFrame:
    """``stats`` with score double and predicted int (1 if score >= threshold)."""
    kept = [f for f in stats.schema.fields if f.name not in ("score", "predicted")]
    place = [f.name for f in kept].index("stat_features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(matrix(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])
    return stats.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Classifier, threshold: float = 0.3) -> DataFrame:
    """The columns of ``score`` beside those of ``docs``, whose texts are counted and scored in one pass."""
    return with_stats(docs, {"score": model}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    Null and empty texts have statistics of 0 and are scored like others;
    held_out is null for a null doc_id; an empty table gives no rows.
    """
    stats = cut(with_stats(docs.select("doc_id", "text")).select("doc_id", "stat_features"))
    return score(stats, fit(stats, labels)).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
