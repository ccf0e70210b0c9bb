"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on binned statistics of a bounded sample of labelled rows, with
logistic loss and monotone constraints: more symbols, repeated lines or repeated
words can only lower a score. The forest is flattened into numpy arrays of
nodes, so a batch of documents walks all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut
from leafmill.llm.stats import COUNTS, FEATURES, labelled, matrix, with_stats

#: Labelled rows that a forest is grown from, about so many at most.
FIT_ROWS = 50_000
#: Features in which a score may only fall.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_word_share", "adjacent_repeat_share", "top_word_share")


@dataclass(frozen=True)
class Forest:
    """All trees' nodes, one after another; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, smooth: float = 1.0) -> Forest:
    """Boost trees on a matrix of statistics and labels 0 or 1.

    ``least``: hessian a leaf must have; ``smooth``: ridge term of leaf values.
    Without rows every score is 0.5.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    place = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]) if len(y) else np.empty((0, x.shape[1]), int)
    falls = np.array([name in FALLING for name in FEATURES])
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + smooth), low, high))

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = float(g[rows].sum()), float(h[rows].sum())
        nodes.append([0, np.inf, me, me, rate * leaf(total_g, total_h, low, high)])
        best = (1e-6, -1, -1)
        for f, c in enumerate(cuts) if level < depth and total_h >= 2 * least else ():
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(place[rows, f], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(place[rows, f], h[rows], len(c) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = (np.clip(-a / (b + smooth), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + gr * vr) - (hl + smooth) * vl**2 / 2 - (hr + smooth) * vr**2 / 2
            whole = leaf(total_g, total_h, low, high)
            gain -= -(total_g * whole) - (total_h + smooth) * whole**2 / 2
            gain[(hl < least) | (hr < least) | (falls[f] & (vl < vr))] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            return me
        goes_left = place[rows, f] <= k
        a, b = rows[goes_left], rows[~goes_left]
        left_span = right_span = (low, high)
        if falls[f]:
            middle = (leaf(float(g[a].sum()), float(h[a].sum()), low, high) + leaf(float(g[b].sum()), float(h[b].sum()), low, high)) / 2
            left_span, right_span = (middle, high), (low, middle)
        nodes[me][:2] = [f, cuts[f][k]]
        nodes[me][2] = split(a, g, h, level + 1, *left_span)
        nodes[me][3] = split(b, g, h, level + 1, *right_span)
        return me

    for _ in range(trees if len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(split(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        part = _forest(nodes, [roots[-1]], depth, 0.0)
        margin = margin + part.margin(x)
    return _forest(nodes, roots, depth, start)


def _forest(nodes: list[list[float]], roots: list[int], depth: int, start: float) -> Forest:
    table = np.array(nodes, float).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Forest(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots, np.int64), depth, start)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Grow a forest on ``labels.quality`` from about ``fit_rows`` labelled rows at most, none of fold 0."""
    rows = labelled(stats, labels, "quality", fit_rows).select("label", "stat_features").toArrow().combine_chunks()
    x = np.asarray(rows.column("stat_features").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if len(rows) else np.empty((0, len(FEATURES)))
    y = rows.column("label").to_numpy()
    order = np.lexsort((*x.T, y)) if len(y) else slice(0)
    return grow_forest(x[order], y[order])


def judge(stats: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``stats`` with the base counts, base_failed, rule_score and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated
    windows. kept: base passed and the forest's score is ``threshold`` or more.
    """
    kept = [f for f in stats.schema.fields if f.name != "rule_score"]
    place = [f.name for f in kept].index("stat_features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest(matrix(batch.column(place))), pa.float64())], [*batch.schema.names, "rule_score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["rule_score double"])
    return _verdicts(stats.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema), threshold)


def judge_texts(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The columns of ``judge`` beside those of ``docs``, whose texts are counted and scored in one pass."""
    return _verdicts(with_stats(docs, {"rule_score": forest}), threshold)


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    counted = scored.withColumns({c: F.col("stat_counts")[i] for i, c in enumerate(COUNTS)})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("rule_score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule_score of each document.

    Null, empty and blank texts have no words and fail; repeated rows are judged
    one by one; an empty table gives no rows.
    """
    stats = cut(with_stats(docs.select("doc_id", "text")).select("doc_id", "stat_counts", "stat_features"))
    return judge(stats, fit(stats, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "rule_score")
