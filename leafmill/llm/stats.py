"""Statistics of whole texts, on which quality rules and classifiers rest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "mean_word_chars",
    "symbols_per_word",
    "punctuation_share",
    "capital_share",
    "digit_share",
    "dup_line_share",
    "repeat_word_share",
    "adjacent_repeat_share",
    "distinct_share",
    "top_word_share",
    "words_per_line",
    "wide_share",
)
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_PUNCT = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text; all 0 for null, empty and blank ones.

    A word is in n_repeat_words if it lies in a window of three words that the
    text holds twice or more, first occurrences included. A line is a duplicate
    if it has a word and equals an earlier line.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    n, body = len(words), b"".join(words)
    wide = np.count_nonzero(np.frombuffer(body, np.int8) < -64)  # continuation bytes
    chars = len(body) - int(wide)
    count = lambda these: len(body) - len(body.translate(None, these))
    seen: set[bytes] = set()
    lines = repeated_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            lines, repeated_lines = lines + 1, repeated_lines + 1
        elif line.split(None, 1):
            seen.add(line)
            lines += 1
    names: dict[bytes, int] = {}
    code = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    repeated = 0
    if n >= 4:
        _, pair = np.unique(code[:-1] * len(names) + code[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(names) + code[2:], return_inverse=True, return_counts=True)
        again = (times > 1)[window]
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeated = int(inside.sum())
    symbols = count(SYMBOLS)
    counts = [n, chars, symbols, repeated_lines, repeated]
    return counts, [
        math.log1p(n),
        chars / n,
        symbols / n,
        count(_PUNCT) / chars,
        count(_UPPER) / chars,
        count(_DIGIT) / chars,
        repeated_lines / lines,
        repeated / n,
        float(np.count_nonzero(code[1:] == code[:-1])) / n,
        len(names) / n,
        float(np.bincount(code).max()) / n,
        min(n / lines, 1000.0),
        float(wide) / chars,
    ]


def with_stats(docs: DataFrame, scores: Mapping[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """``docs`` with stat_counts array<long>, stat_features array<double> and a double for each of ``scores``.

    A score is a function of the matrix of features. It is taken in the task that
    has counted the text, so texts go to Python once. Columns of these names are
    replaced; all others stay.
    """
    scores = scores or {}
    new_names = ["stat_counts", "stat_features", *scores]
    kept = [f for f in docs.schema.fields if f.name not in new_names]
    place = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(x.as_py()) for x in batch.column(place)]
            new = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            new += [pa.array(score(matrix(new[1])), pa.float64()) for score in scores.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *new_names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["stat_counts array<long>", "stat_features array<double>"] + [f"`{name}` double" for name in scores])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def drawn_ids(labels: DataFrame, column: str, fit_rows: int) -> DataFrame:
    """doc_id of about ``fit_rows`` labelled rows at most, none of fold 0; where there are more, those of the smallest hashes."""
    from leafmill.llm.common import fold_of

    ids = labels.where(F.col(column).isin(0, 1)).select("doc_id").distinct().where(fold_of(F.col("doc_id")) != 0)
    n = ids.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    return ids.where(draw < int(fit_rows / n * 2.0**53)) if n > fit_rows else ids


def labelled(stats: DataFrame, labels: DataFrame, column: str, fit_rows: int) -> DataFrame:
    """label (0 or 1), fold and stat_features of about ``fit_rows`` labelled documents at most.

    Rows of fold 0 (crc32 of the id as text, modulo 5) are left out. Where more
    rows are labelled, those of the smallest hashes are taken.
    """
    from leafmill.llm.common import cut, fold_of

    marks = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("double").alias("label"))
    rows = stats.select("doc_id", "stat_features").join(marks, "doc_id").withColumn("fold", fold_of(F.col("doc_id"))).where("fold <> 0")
    rows = cut(rows.select("label", "fold", "stat_features", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("draw")))
    n = rows.count()
    return rows.where(F.col("draw") < int(min(1.0, fit_rows / max(n, 1)) * 2.0**53)) if n > fit_rows else rows


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of stat_features as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES))
