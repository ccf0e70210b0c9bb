"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c. Vectors are turned by a
random rotation, which spreads distances evenly, and split into blocks of 16
dimensions; each block gets its share of the squared distance allowed. A pair
within the whole distance is within the share of one block at least; the union of
the blocks' range joins are the candidates, each decided by its cosine in double
precision.

A block's range join uses randomly shifted grids over all its dimensions, with
cells ``wide`` times as wide as the range. A vector lies in one cell of each grid,
so nothing is sent to neighbouring cells, and unrelated vectors share a cell in
1 of some 2,000 cases; a pair in range shares one with a chance that grows as it
is nearer, and at least ``grids`` grids over the blocks together make that chance
(almost) certain: for 64 dimensions a pair of cosine 0.9501 is found with
probability 0.994, one of 0.955 with 0.9992 (simulated; see tests).

Cells are compared by tasks of bounded size, piece against piece. Tasks see codes
(a byte a component) and return the vectors that may have a partner; these come
again whole, and the tasks return sums of links and a spanning forest, no pairs,
however many near copies a group has. A pair belongs to the first grid where it
shares a cell and is in range, which every task tells from the codes; these are
whole numbers, as is the rotation, so all tasks agree to the last bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, dealt, spanning_forest, whole_groups
from leafmill.llm.components import connected_components

#: Dimensions of a block.
BLOCK = 16
#: Units of the rotation, and of a component of a code.
SCALE, CODE = float(2**20), 127
#: Crowded cells up to which they are sent to every task.
SENT_CELLS = 200_000
TASK = ("cell", "i", "j")
TASK_SCHEMA = "cell long, i int, j int, side int, rep long, n long, grid int, code binary, slack float"
LINK_SCHEMA = "rep long, links long, root long"


class Space:
    """Rotation, blocks, budgets and grids for vectors of one length."""

    def __init__(self, size: int, cosine: float, grids: int, wide: float) -> None:
        rng = np.random.default_rng(20)
        q, r = np.linalg.qr(rng.normal(size=(size, size)))
        self.size, self.angle = size, float(np.arccos(min(cosine, 1.0)))
        self.rotation = np.round(q * np.sign(np.diag(r)) * SCALE)
        edges = np.linspace(0, size, max(1, round(size / BLOCK)) + 1).astype(int)
        self.blocks = [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        whole = 2 - 2 * cosine
        self.budgets = [max(whole, 1e-4) * (b.stop - b.start) / size for b in self.blocks]
        each = -(-grids // len(self.blocks))
        self.grids = [(b, wide * np.sqrt(self.budgets[b]), rng.random(s.stop - s.start), rng.integers(1, 2**62, s.stop - s.start, dtype=np.int64) | 1) for b, s in enumerate(self.blocks) for _ in range(each)]

    def turned(self, codes: np.ndarray) -> np.ndarray:
        """Rotated unit vectors of codes; products of whole numbers, so the same in any batch."""
        return (codes @ self.rotation) / (SCALE * np.sqrt(np.einsum("ij,ij->i", codes, codes)))[:, None]

    def cells(self, turned: np.ndarray) -> np.ndarray:
        """The number of each vector's cell in each grid."""
        out = np.empty((len(turned), len(self.grids)), np.int64)
        for g, (block, width, shift, factors) in enumerate(self.grids):
            place = np.floor(turned[:, self.blocks[block]] / width + shift).astype(np.int64)
            with np.errstate(over="ignore"):
                mixed = (place * factors).sum(axis=1) + (g + 1) * 0x5851F42D4C957F2D % 2**62
            out[:, g] = mixed ^ (mixed >> 29)
        return out

    def first_grid(self, turned: np.ndarray, slack: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first grid where each pair of rows shares a cell and may be in its block's range; -1 for none.

        A code is off its vector by ``slack`` at most, as an angle and so as a
        distance; the range is wider by that of both, so no pair in range is left out.
        """
        rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        cells = self.cells(turned[rows])
        shared = cells[place[: len(a)]] == cells[place[len(a) :]]
        gaps = np.stack([np.einsum("ij,ij->i", d, d) for d in (turned[a, s] - turned[b, s] for s in self.blocks)], axis=1)
        reach = np.sqrt(np.array(self.budgets)) + (slack[a] + slack[b])[:, None] + 1e-6
        shared &= (gaps <= reach * reach)[:, [g[0] for g in self.grids]]
        return np.where(shared.any(axis=1), shared.argmax(axis=1), -1)


@cache
def _space(size: int, cosine: float, grids: int, wide: float) -> Space:
    return Space(size, cosine, grids, wide)


def usable_vectors(table: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, key, raw: digest and bytes (doubles) of each vector that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                x = np.array(v.as_py() if i.is_valid and v.is_valid else [], dtype=float)  # null components become nan
                good = len(x) and np.isfinite(x).all() and x.any()
                raw = (x + 0.0).tobytes() if good else None
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "raw"])

    return table.select(F.col(id_col).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, key binary, raw binary")


def _scaled(raws: list[bytes], size: int) -> np.ndarray:
    """Vectors whose largest component is 1 or -1, so that squares neither vanish nor overflow."""
    x = np.frombuffer(b"".join(raws), float).reshape(-1, size)
    return x / np.abs(x).max(axis=1, keepdims=True)


def coded(scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the angle between each vector and its code."""
    codes = np.round(scaled * CODE)
    cosines = np.einsum("ij,ij->i", codes, scaled) / np.sqrt(np.einsum("ij,ij->i", codes, codes) * np.einsum("ij,ij->i", scaled, scaled))
    return codes, np.arccos(np.minimum(cosines, 1.0)) + 1e-6


def _codes(reps: DataFrame, space: tuple[float, int, float]) -> DataFrame:
    """rep, n, size, code, slack and the cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            sizes = np.array([len(r) // 8 for r in raws])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                codes, slack = coded(_scaled([raws[i] for i in rows], size))
                where = _space(size, *space)
                cells = where.cells(where.turned(codes))
                part = batch.take(pa.array(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel() + size))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.astype(np.int8).tobytes() for c in codes], pa.binary()), pa.array(slack, pa.float32()), lists], ["rep", "n", "code", "slack", "cells"])

    return reps.select("rep", "n", "raw").mapInArrow(run, "rep long, n long, code binary, slack float, cells array<long>")


def _by_size(codes: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each length among the codes of a task, which all but always have one."""
    sizes = np.array([len(c) for c in codes])
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _maybe(where: Space, codes: np.ndarray, slack: np.ndarray, side: np.ndarray, across: bool, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be near and whose first grid is this one."""
    units = codes / np.sqrt(np.einsum("ij,ij->i", codes, codes))[:, None]
    loosest = np.cos(min(where.angle + 2 * slack.max(), np.pi))
    found: list[list[np.ndarray]] = [[], []]
    for low in range(0, len(codes), 512):
        rows = slice(low, low + 512)
        cosines = units[rows] @ units[low:].T
        a, b = np.nonzero(cosines >= loosest - 1e-9)
        angle = np.arccos(np.clip(cosines[a, b], -1.0, 1.0))
        a, b = a + low, b + low
        keep = (a < b) & ((side[a] != side[b]) | (not across)) & (angle <= where.angle + slack[a] + slack[b] + 1e-6)
        found[0].append(a[keep])
        found[1].append(b[keep])
    a, b = np.concatenate(found[0]), np.concatenate(found[1])
    out: list[list[np.ndarray]] = [[], []]
    turned = where.turned(codes) if len(a) else codes
    for low in range(0, len(a), 16384):
        x, y = a[low : low + 16384], b[low : low + 16384]
        mine = where.first_grid(turned, slack, x, y) == grid
        out[0].append(x[mine])
        out[1].append(y[mine])
    return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (a, b)


def _pairs(table: pa.Table, bounds: np.ndarray, space: tuple[float, int, float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends of the pairs that may be near, as rows of the table, cell by cell."""
    i, j, side, grid, slack = (np.asarray(table.column(c)) for c in ("i", "j", "side", "grid", "slack"))
    codes = table.column("code").to_pylist()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low < 2:
            continue
        for size, rows in _by_size(codes[low:high]):
            rows = rows + low
            matrix = np.frombuffer(b"".join(codes[r] for r in rows), np.int8).reshape(-1, size).astype(float)
            a, b = _maybe(_space(size, *space), matrix, slack[rows].astype(float), side[rows], bool(i[low] != j[low]), int(grid[low]))
            if len(a):
                yield rows[a], rows[b]


def near_vectors(table: DataFrame, *, cosine: float = 0.95, grids: int = 36, wide: float = 2.4, piece: int = 2000, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one length link if their cosine in double precision is ``cosine``
    or more. Null and zero vectors, those with null or non-finite components, or
    without id link with nothing. Equal vectors are one point of their number;
    repeated rows count as vectors of their own; other columns are left out. An
    empty table gives no rows.
    """
    space = (cosine, grids, wide)
    rows = cut(usable_vectors(table, id_col, column))
    # ids may repeat, so points have numbers of their own
    points = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    reps = cut(points.withColumn("rep", F.monotonically_increasing_id()))
    named = cut(_codes(reps, space))
    placed = named.select("rep", "n", "code", "slack", F.posexplode("cells").alias("grid", "cell"))
    crowded = cut(placed.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > piece).select("cell", F.ceil(F.col("size") / F.lit(float(piece))).cast("int").alias("pieces")))
    crowded = F.broadcast(crowded) if crowded.count() <= SENT_CELLS else crowded
    tasks = dealt(placed.join(crowded, "cell", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))), "cell", "rep", "pieces")
    names = [f.split(" ")[0] for f in TASK_SCHEMA.split(", ")]
    tasks = tasks.select(*names).repartition(*TASK).sortWithinPartitions(*TASK)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, TASK):
            keep = np.zeros(len(part), bool)
            for a, b in _pairs(part, bounds, space):
                keep[a] = keep[b] = True
            yield from part.filter(pa.array(keep)).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, TASK):
            reps_, weight, raws = np.asarray(part.column("rep")), np.asarray(part.column("n")), part.column("raw").to_pylist()
            for a, b in _pairs(part, bounds, space):
                near = []
                for low in range(0, len(a), 16384):
                    at = np.concatenate((a[low : low + 16384], b[low : low + 16384]))
                    some, back = np.unique(at, return_inverse=True)
                    x = _scaled([raws[r] for r in some], len(raws[at[0]]) // 8)
                    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
                    p, q = back[: len(at) // 2], back[len(at) // 2 :]
                    near.append(np.einsum("ij,ij->i", x[p], x[q]) / (norms[p] * norms[q]) >= cosine)
                good = np.concatenate(near)
                some, back = np.unique(np.concatenate((a[good], b[good])), return_inverse=True)
                if not len(some):
                    continue
                p, q = back[: len(back) // 2], back[len(back) // 2 :]
                links = np.bincount(p, weight[some[q]], len(some)) + np.bincount(q, weight[some[p]], len(some))
                root = spanning_forest(len(some), p, q)
                yield pa.RecordBatch.from_arrays([pa.array(reps_[some]), pa.array(links.astype(np.int64)), pa.array(reps_[some[root]])], ["rep", "links", "root"])

    marked = cut(tasks.mapInArrow(candidates, TASK_SCHEMA))
    wanted = marked.select("rep").distinct()
    raws = reps.select("rep", "raw").join(wanted, "rep", "left_semi")
    again = marked.join(raws, "rep").select(*names, "raw").repartition(*TASK).sortWithinPartitions(*TASK)
    found = cut(again.mapInArrow(linked, LINK_SCHEMA))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = reps.select("key", "rep", "low", "n").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    joined = cut(joined.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("component", "rep").alias("group")))
    lowest = joined.groupBy("group").agg(F.min("low").alias("component_id"))
    classes = joined.join(lowest, "group").select("key", "n_links", "component_id")
    known = rows.select("vec_id", "key").join(classes, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
