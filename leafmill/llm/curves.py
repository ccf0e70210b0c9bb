"""Nearest vectors by shifted space-filling curves.

Vectors are projected to a few dimensions, on several projections with a shift of
their own each, and put in order along a Hilbert curve. Vectors that are near in
the projection are often near on the curve, and what one curve tears apart another
with other axes and another shift keeps together. Spark sorts each curve by ranges;
ranks follow from the counts of the ranges. A query is compared with whole windows
of neighbouring ranks on each curve, and what the windows find is merged and ranked
by the inner product of the vectors themselves.

How wide windows must be depends on the data: the ranks between a sample of queries
and their true neighbours, on the nearest curve, tell the width at which the wanted
part of them is found. Everything is indexed and every query is searched; only that
width is fitted on a sample (of ``sample`` queries, met by all vectors once).

Vectors in no order but chance, of many dimensions, have no curve that helps: then
windows are as wide as it takes, which comes close to comparing all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, whole_groups

#: Dimensions of a projection, and bits of each.
AXES, BITS = 6, 8
#: Queries that meet one block of candidates in one task, at most about so many.
PIECE = 4096
GROUP = ("curve", "size", "block", "piece")
#: Neighbouring blocks of a curve that one task compares, and found rows after which it merges their lists.
RUN, HELD = 8, 200_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below 2 ** bits, one a row.

    The usual way through Gray codes: from the highest bit down, a set bit of a
    coordinate turns the lower bits of the first one round, a clear one swaps them
    with its own; what is left is a Gray code of the place, its bits interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(len(x)):
            turned = (x[k] >> bit) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    place = np.zeros(len(cells), np.int64)
    parity = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(len(x)):
            parity ^= (x[k] >> bit) & 1
            place = place << 1 | parity
    return place


class Curves:
    """Projections and shifts for vectors of one length."""

    def __init__(self, size: int, curves: int) -> None:
        rng = np.random.default_rng([size, curves])
        axes = min(AXES, size)
        self.frames = [np.linalg.qr(rng.normal(size=(size, axes)))[0] for _ in range(curves)]
        self.shifts = [rng.random(axes) for _ in range(curves)]
        self.spread = np.sqrt(size)

    def keys(self, units: np.ndarray) -> np.ndarray:
        """A key for each unit vector (a row) on each curve."""
        cells = 1 << BITS
        out = []
        for frame, shift in zip(self.frames, self.shifts, strict=True):
            # coordinates of unit vectors times the root of their length are of order 1; twelve of these, shifted by up to two, fill the cells
            place = np.floor((units @ frame * self.spread + 5 + 2 * shift) / 12 * cells)
            out.append(hilbert_keys(np.clip(place, 0, cells - 1), BITS))
        return np.stack(out, axis=1)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of a column of lists, and their matrix; null components are nan."""
    lengths = np.array([len(v) if v.is_valid else 0 for v in column], np.int64) if column.null_count else np.diff(np.asarray(column.offsets))
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        values = column.take(pa.array(rows)).flatten()
        yield rows, values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _usable(table: DataFrame, id_col: str, column: str) -> DataFrame:
    """vec_id, size, key, raw, norm of each vector that takes part; raw is of floats where these say all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                rows, x = rows[good], x[good] + 0.0
                if len(rows):
                    with np.errstate(over="ignore"):
                        narrow = bool((x.astype(np.float32) == x).all())
                    raws = [v.tobytes() for v in (x.astype(np.float32) if narrow else x)]
                    keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
                    most = np.abs(x).max(axis=1)
                    norms = most * np.sqrt(np.einsum("ij,ij->i", x / most[:, None], x / most[:, None]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(norms)], ["vec_id", "size", "key", "raw", "norm"])

    return table.select(F.col(id_col).cast("long"), F.col(column).cast("array<double>")).where(f"`{id_col}` is not null").mapInArrow(run, "vec_id long, size int, key binary, raw binary, norm double")


def matrix(raws: list[bytes], size: int) -> np.ndarray:
    """Vectors of one length as doubles, from floats or doubles."""
    if all(len(r) == 4 * size for r in raws):
        return np.frombuffer(b"".join(raws), np.float32).reshape(-1, size).astype(float)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * size else float) for r in raws], float)


def _sized(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _placed(reps: DataFrame, largest: dict[int, float], curves: int) -> DataFrame:
    """size, curve, key, asks, rep: the key of each vector as a candidate, and as a query where it is one.

    Candidates have one more coordinate, which makes all as long as the longest; a
    query has none there. Then the nearest by distance is the nearest by product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rep, asks = (np.asarray(batch.column(c)) for c in ("size", "rep", "asks"))
            for size, rows in _sized(sizes):
                x = matrix(batch.column("raw").take(pa.array(rows)).to_pylist(), size)
                norms = np.asarray(batch.column("norm"))[rows]
                where = Curves(size + 1, curves)
                rest = np.sqrt(np.maximum(1 - (norms / largest[size]) ** 2, 0))
                for kind, some, units in ((False, rows, np.column_stack((x / largest[size], rest))), (True, rows[asks[rows]], np.column_stack((x / norms[:, None], np.zeros(len(x))))[asks[rows]])):
                    keys = where.keys(units)
                    flat = [np.repeat(sizes[some], curves), np.tile(np.arange(curves, dtype=np.int32), len(some)), keys.ravel(), np.full(keys.size, kind), np.repeat(rep[some], curves)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], ["size", "curve", "key", "asks", "rep"])

    return reps.select("rep", "size", "raw", "norm", "asks").mapInArrow(run, "size int, curve int, key long, asks boolean, rep long")


def _ranked(placed: DataFrame) -> DataFrame:
    """size, curve, asks, rep, rank: candidates numbered from 0 on each curve; a query has the number of those before it.

    Ranges are sorted and counted by their tasks; only their counts are added up.
    """
    order = ["size", "curve", "key", "asks", "rep"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            groups, asks = np.asarray(batch.column("size")).astype(np.int64) << 32 | np.asarray(batch.column("curve")), np.asarray(batch.column("asks"))
            local = np.empty(len(batch), np.int64)
            for group in np.unique(groups).tolist():
                rows = np.flatnonzero(groups == group)
                stands = np.cumsum(~asks[rows])
                local[rows] = counts.get(group, 0) + stands - ~asks[rows]
                counts[group] = counts.get(group, 0) + (int(stands[-1]) if len(rows) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("size", "curve", "asks", "rep")), pa.array(local), pa.array(np.full(len(batch), part, np.int32))], ["size", "curve", "asks", "rep", "local", "part"])

    ranges = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranges.mapInArrow(number, "size int, curve int, asks boolean, rep long, local long, part int"))
    before = Window.partitionBy("size", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("size", "curve", "part").agg(F.count_if(~F.col("asks")).alias("stands"))  # a row for each range and curve
    offsets = parts.select("size", "curve", "part", F.coalesce(F.sum("stands").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), ["size", "curve", "part"]).select("size", "curve", "asks", "rep", (F.col("local") + F.col("offset")).alias("rank"))


def _products(asked: np.ndarray, stands: np.ndarray, low: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and of candidates, and products, of the ``top`` largest of each query; equal ones by low."""
    order = np.argsort(low, kind="stable")
    stands = stands[order]
    queries, found, scores = [], [], []
    for at in range(0, len(asked), 512):
        rough = asked[at : at + 512] @ stands.T
        few = min(top, rough.shape[1])
        # a sum may end in another digit by the way it is added, so a little less than the last of the best is looked at again
        least = np.partition(rough, -few, axis=1)[:, -few] if few else np.zeros(len(rough))
        q, c = np.nonzero(rough >= (least - 1e-9 * (np.abs(least) + np.abs(rough).max(axis=1)))[:, None])
        exact = np.einsum("ij,ij->i", asked[at + q], stands[c])
        by = np.lexsort((c, -exact, q))
        q, c, exact = q[by], c[by], exact[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < top
        queries.append(at + q[keep])
        found.append(order[c[keep]])
        scores.append(exact[keep])
    return np.concatenate(queries), np.concatenate(found), np.concatenate(scores)


def _merged(found: list[np.ndarray], top: int) -> np.ndarray:
    """The ``top`` of each query among lists of asking, rep, low and score, each pair once."""
    rows = np.concatenate(found)
    rows = rows[np.unique(np.stack((rows["asking"], rows["rep"])), axis=1, return_index=True)[1]]
    rows = rows[np.lexsort((rows["low"], -rows["score"], rows["asking"]))]
    return rows[np.arange(len(rows)) - np.searchsorted(rows["asking"], rows["asking"]) < top]


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ("asking", "rep", "score")], ["asking", "rep", "score"])


def _true_neighbours(reps: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """asking, rep: the ``k`` nearest other vectors of each of some queries (rep, size, raw), by comparing with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rep, low = (np.asarray(batch.column(c)) for c in ("size", "rep", "low"))
            for size, rows in _sized(sizes):
                own = [q for q in queries if q[1] == size]
                if own:
                    x = matrix(batch.column("raw").take(pa.array(rows)).to_pylist(), size)
                    q, c, score = _products(matrix([bytes(r) for _, _, r in own], size), x, low[rows], k + 1)
                    names = np.array([n for n, _, _ in own])
                    yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(rep[rows][c]), pa.array(low[rows][c]), pa.array(score)], ["asking", "rep", "low", "score"])

    met = reps.select("rep", "size", "raw", "low").mapInArrow(run, "asking long, rep long, low long, score double").where("asking <> rep")
    best = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "low"))
    return met.withColumn("place", best).where(F.col("place") <= k).select("asking", "rep")


def fitted_window(reps: DataFrame, ranks: DataFrame, k: int, recall: float, sample: int) -> int:
    """Ranks on each side of a query within which, on some curve, ``recall`` of the true neighbours of sampled queries are."""
    drawn = [tuple(r) for r in reps.where("asks").orderBy(F.xxhash64("key"), "rep").limit(sample).select("rep", "size", "raw").collect()]
    if not drawn:
        return 1
    true = cut(_true_neighbours(reps, drawn, k))
    names = [r[0] for r in drawn]
    own = ranks.where(F.col("asks") & F.col("rep").isin(names)).select("size", "curve", F.col("rep").alias("asking"), F.col("rank").alias("asked_at"))
    gaps = ranks.where(~F.col("asks")).join(F.broadcast(true), "rep").join(F.broadcast(own), ["size", "curve", "asking"])  # sample * k and sample * curves rows
    nearest = gaps.groupBy("asking", "rep").agg(F.min(F.abs(F.col("rank") - F.col("asked_at"))).alias("gap"))
    found = sorted(r.gap for r in nearest.select("gap").collect())
    return max(found[min(int(np.ceil(recall * len(found))), len(found)) - 1], 1) if found else 1


def nearest_vectors(table: DataFrame, *, every: int = 20, k: int = 20, curves: int = 6, recall: float = 0.95, sample: int = 96, block: int = 2048, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by the largest inner product in double precision.

    Queries are the vectors whose id ``every`` divides; candidates are all others
    of the same length. Null and zero vectors, those with null or non-finite
    components and rows without id take no part. Ties go to smaller ids. Equal
    vectors are one point with its smallest k + 1 ids, as no list can hold more
    of them. A query whose own id is not unique leaves out all rows of that id.
    Other columns are left out; an empty table gives no rows.
    """
    usable = cut(_usable(table, id_col, column))
    first = F.row_number().over(Window.partitionBy("size", "key").orderBy("vec_id"))
    # of a point's ids only the smallest are kept, which tasks do before rows meet
    few = usable.select("size", "key", "vec_id").distinct().withColumn("place", first).where(F.col("place") <= k + 1)
    ids = few.groupBy("size", "key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = usable.groupBy("size", "key").agg(F.min("raw").alias("raw"), F.min("norm").alias("norm"), F.max(F.col("vec_id") % every == 0).alias("asks"))
    reps = cut(points.join(ids, ["size", "key"]).withColumn("low", F.col("ids")[0]).withColumn("rep", F.monotonically_increasing_id()))
    largest = {r["size"]: r["norm"] for r in reps.groupBy("size").agg(F.max("norm").alias("norm")).collect()}  # a row for each length
    ranks = cut(_ranked(_placed(reps, largest, curves)))
    window = fitted_window(reps, ranks, k, recall, sample)
    # a query meets the whole blocks that its window touches; many queries of a wide window are dealt out
    pieces = max(1, -(-(2 * window + block) // (every * PIECE)))
    stands = ranks.where(~F.col("asks")).select("curve", F.expr(f"rank div {block}").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "asks", "rep")
    touched = F.sequence(F.expr(f"greatest(rank - {window}, 0) div {block}"), F.expr(f"(rank + {window}) div {block}"))
    asking = ranks.where("asks").select("curve", F.explode(touched).alias("block"), F.pmod(F.xxhash64("rep"), F.lit(pieces)).cast("int").alias("piece"), "asks", "rep")
    dealt = stands.unionByName(asking).join(reps.select("rep", "size", "raw", "low"), "rep").select(*GROUP, "asks", "rep", "low", "raw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # asking, rep, low, score of what neighbouring blocks have found
        for part, bounds in whole_groups(batches, GROUP):
            asks, rep, low, sizes = (np.asarray(part.column(c)) for c in ("asks", "rep", "low", "size"))
            raws = part.column("raw")
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                q, c = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if len(q) and len(c):
                    x, y = (matrix(raws.take(pa.array(rows)).to_pylist(), int(sizes[a])) for rows in (q, c))
                    i, j, score = _products(x, y, low[c], k + 1)
                    held.append(np.rec.fromarrays([rep[q][i], rep[c][j], low[c][j], score], names="asking,rep,low,score"))
                if sum(map(len, held)) > HELD:
                    held = [_merged(held, k + 1)]
                    if len(held[0]) > HELD // 2:
                        yield _batch(held.pop())
        if held:
            yield _batch(_merged(held, k + 1))

    # neighbouring blocks meet in one task, so that a query's lists are merged there
    near = dealt.repartition("curve", "size", F.expr(f"block div {RUN}"), "piece").sortWithinPartitions(*GROUP)
    met = near.mapInArrow(compare, "asking long, rep long, score double")
    merged = cut(met.groupBy("asking", "rep").agg(F.max("score").alias("score")))
    named = merged.join(reps.select("rep", "low"), "rep")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "low")
    named = named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = named.join(reps.select("rep", "ids"), "rep").select("asking", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = listed.groupBy("asking").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))  # k + 1 at most
    queries = usable.where(F.col("vec_id") % every == 0).select("size", "key", F.col("vec_id").alias("query_id")).distinct()
    known = lists.join(reps.select(F.col("rep").alias("asking"), "size", "key"), "asking").select("size", "key", "found")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(known, ["size", "key"]).select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
