"""Near duplicates by a chosen-path set similarity join.

Documents are branched into the nodes of several independent trees. A node picks
positions of the minwise signature, and its documents go to one child for each,
by their value there; so all documents of a node that share the chosen minwise
token meet again. Small nodes are compared exhaustively, large ones branch on. A
tree opens with one position, of 16 in all; further down each node picks two of those
that belong to its level, so no path uses a position twice and a pair at the
threshold meets in 1.5 times as many nodes at each level, on average. A pair of
similarity 0.75 meets in none of 16 openings with probability 2.3e-10; where it
must survive five levels more, the deepest there are, with 5e-7 (computed).

Three things keep groups of copies from becoming quadratic. Equal sets are one
point. A few pivots of each first-level node are compared with all others of it
first; what they link is one component from then on, and only documents of
different components are compared later. A node that keeps most of its parent is
as alike as branching can make it and branches no more.

A node is compared by tasks of bounded size: its documents are dealt into pieces,
and each pair of pieces meets in a task of its own. A task sees sketches (a byte
of each minwise value) and returns the documents that may have a partner; these
come again with their texts, and the task counts the intersections of their full
sets and returns a spanning forest. No pairs leave a task. Sketches that agree in
under half of their bytes are no candidates; a pair of similarity 0.75 is lost so
with probability 3.4e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, dealt, parts_for, spanning_forest, whole_groups
from leafmill.llm.components import connected_components
from leafmill.llm.shingles import minwise, minwise_parameters, shingle_set, similar

SIGNATURE = 128
#: Equal values that two signatures must have; at similarity 0.75 fewer come with probability 6e-8.
AGREE = 68
#: Documents to a partition of what is kept of them between steps.
PART_ROWS = 8_000
#: Documents of a node that branches no more.
SMALL = 2_000
#: Documents, and shingles of all of them, that a piece of a node has on average at most.
PIECE, PIECE_SHINGLES = 500, 1_000_000
#: Values that open trees; a sketch has them whole, and a byte of each other value.
OPENINGS = 16
#: A node with this share of its parent's documents or more branches no further.
STUCK = 0.7
#: Ids up to which they are sent to every task, instead of all texts to theirs.
SENT_IDS = 500_000
#: Columns of shingles that are compared at a time.
COLUMNS = 8192


def set_signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), sig (minwise values) and sketch (their low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = minwise_parameters(SIGNATURE)
        for batch in batches:
            ids, counts, keys, rows = batch.column(0), [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), width)
                counts.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                rows.append(minwise(found, parameters))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SIGNATURE, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), sigs, sketches(rows)], ["doc_id", "n_shingles", "set_key", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<int>, sketch binary")


def sketches(signatures: list[np.ndarray]) -> pa.Array:
    """The values of the openings and a byte of each other value."""
    return pa.array([s[:OPENINGS].tobytes() + (s[OPENINGS:] & 255).astype(np.uint8).tobytes() for s in signatures], pa.binary())


def _agree(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _likely(pairs: DataFrame, reps: DataFrame, part: int, whole: int) -> DataFrame:
    """Distinct pairs a, b that can still be similar by size and by signature."""
    side = lambda end: reps.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}"))
    sized = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part)
    return sized.where(_agree(F.col("sig_a"), F.col("sig_b")) >= AGREE).select("a", "b")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents with the ids, which are distinct and cut."""
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, part: int, whole: int, parts: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = cut(pairs, parts)
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), parts)
    texts = cut(_texts_of(docs, ends).dropDuplicates(["id", "text"]), parts)
    side = lambda end: texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[str | None, np.ndarray]] = {}

        def known(place: int, text: str | None) -> np.ndarray:
            # rows come sorted by one end, whose set is then built once
            if place not in last or last[place][0] != text:
                last[place] = (text, shingle_set(text, width))
            return last[place][1]

        for batch in batches:
            good = [similar(known(2, x.as_py()), known(3, y.as_py()), part, whole) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(run, "a long, b long").coalesce(parts).distinct(), parts)


def _arrays(table: pa.Table) -> list[np.ndarray]:
    """What tells which rows of a table's tasks may be similar."""
    i, j, side, component, n, whole_at, opening = (np.asarray(table.column(c)) for c in ("i", "j", "side", "component", "n", "whole_at", "opening"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
    first = np.ascontiguousarray(sketch[:, : 4 * OPENINGS]).view(np.int32)
    return [i != j, side, component, n, whole_at, opening, first, sketch[:, 4 * OPENINGS :]]


def _maybe(arrays: list[np.ndarray], part: int, whole: int) -> np.ndarray:
    """Which rows of a task may be similar; the upper triangle.

    Pairs that meet in a whole node of an earlier opening are left to that one.
    """
    across, side, component, n, whole_at, opening, first, rest = arrays
    found = np.zeros((len(n), len(n)), bool)
    before = (whole_at[:, None] >> np.arange(OPENINGS) & 1).astype(bool) & (np.arange(OPENINGS) < opening[:, None])
    for i in range(len(n) - 1):
        near = (component[i + 1 :] != component[i]) & (np.minimum(n[i + 1 :], n[i]) * whole >= np.maximum(n[i + 1 :], n[i]) * part)
        if across[0]:
            near &= side[i + 1 :] != side[i]
        at = np.flatnonzero(near) + i + 1
        if not len(at):
            continue
        same = first[at] == first[i]
        good = np.count_nonzero(same, axis=1) + np.count_nonzero(rest[at] == rest[i], axis=1) >= AGREE
        found[i, at] = good & ~(same & before[at] & before[i]).any(axis=1)
    return found


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, by products of their incidence matrices."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # shingles of one set only are in no intersection
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[here], column[here] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


TASK = ("node", "i", "j")
TASK_SCHEMA = "node long, i int, j int, side int, rep long, component long, n long, sketch binary, whole_at int, opening int"


def compare_nodes(rows: DataFrame, docs: DataFrame, width: int, part: int, whole: int, parts: int) -> DataFrame:
    """a, b: a spanning forest of the links in each node between documents of different components.

    ``rows`` has node, pieces (of the node), rep, component, n and sketch;
    opening, or OPENINGS further down a tree; and the bits of the openings where
    the document's node is compared whole.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, TASK):
            keep, arrays = np.zeros(len(table), bool), _arrays(table)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high - low > 1:
                    found = _maybe([x[low:high] for x in arrays], part, whole)
                    keep[low:high] = found.any(axis=0) | found.any(axis=1)
            yield from table.filter(pa.array(keep)).to_batches()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, TASK):
            ends: list[list[np.ndarray]] = [[], []]
            arrays, names, texts = _arrays(table), np.asarray(table.column("rep")), table.column("text")
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                found = _maybe([x[low:high] for x in arrays], part, whole)
                if not found.any():
                    continue
                sets = [shingle_set(t.as_py(), width) for t in texts[low:high]]
                common, size = _intersections(sets), np.array([len(x) for x in sets])
                a, b = np.nonzero(found & (whole * common >= part * (size[:, None] + size[None, :] - common)))
                reps = names[low:high]
                root = spanning_forest(len(reps), a, b)
                away = root != np.arange(len(reps))
                ends[0].append(reps[away])
                ends[1].append(reps[root[away]])
            if ends[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e), pa.int64()) for e in ends], ["a", "b"])

    tasks = dealt(rows, "node", "rep", "pieces").select(*[f.split(" ")[0] for f in TASK_SCHEMA.split(", ")])
    tasks = tasks.repartition(*TASK).sortWithinPartitions(*TASK)
    marked = cut(tasks.mapInArrow(candidates, TASK_SCHEMA))
    ids = cut(marked.select(F.col("rep").alias("id")).distinct(), parts)
    texts = _texts_of(docs, ids).dropDuplicates(["id", "text"]).withColumnRenamed("id", "rep")
    again = marked.join(texts, "rep").select(*marked.columns, "text").repartition(*TASK).sortWithinPartitions(*TASK)
    return cut(again.mapInArrow(confirmed, "a long, b long").distinct(), parts)


def _children(rows: DataFrame, first: int, width: int) -> DataFrame:
    """Each row of a node in two child nodes, by two of the ``width`` bytes of its sketch from ``first`` that the node chooses."""
    one = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(width))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(1)), F.lit(width - 1)), F.lit(width))
    child = lambda j: F.xxhash64("node", j, F.substring("sketch", (j + first + 4 * OPENINGS + 1).cast("int"), F.lit(1)))
    return rows.select(F.explode(F.array(child(one), child(two))).alias("node"), F.col("size").alias("parent"), "rep", "component", "n", "sketch", "whole_at", F.lit(OPENINGS).alias("opening"))


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    part: int = 75,
    whole: int = 100,
    pivots: int = 8,
    small: int = SMALL,
    piece: int = PIECE,
    depth: int = 6,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``whole * |intersection| >= part * |union|`` of
    their shingle sets; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have no shingles and link with nothing, as have rows
    without doc_id (component_id null, kept). Rows of one doc_id are one
    document for links. Equal texts are linked; very long texts are compared
    whole; other columns are left out; an empty table gives no rows.
    """
    # positions of the signature that belong to each level below the openings
    own = (SIGNATURE - OPENINGS) // max(1, depth - 1)
    sigs = cut(set_signatures(docs, width))
    parts = parts_for(docs.sparkSession, sigs.count(), PART_ROWS)
    usable = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = cut(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), parts)

    openings = [F.struct(F.lit(place).alias("opening"), F.xxhash64(F.lit(place), F.col("sig")[place]).alias("node")) for place in range(OPENINGS)]
    rows = reps.select("rep", F.inline(F.array(*openings)))
    pivot = [F.min_by("rep", F.xxhash64("rep", F.lit(j))).alias(f"p{j}") for j in range(pivots)]
    met = rows.groupBy("node").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), *pivot).where("low < high")
    members = cut(rows.join(met.select("node", F.array_distinct(F.array(*[f"p{j}" for j in range(pivots)])).alias("pivots")), "node"), parts)
    first = members.select("rep", F.explode("pivots").alias("p")).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).where("a < b")
    linked = _confirmed(_likely(first, reps, part, whole), docs, width, part, whole, parts)
    found = cut(connected_components(linked, parts=parts), parts)

    known = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("node", "opening", "rep", F.coalesce("component", "rep").alias("component"))
    met = known.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    known = cut(known.join(met.select("node", "size"), "node"), parts)
    compared = F.when(F.col("size") <= small, F.expr("shiftleft(1, opening)")).otherwise(0)
    bits = known.groupBy("rep").agg(F.bit_or(compared).alias("whole_at"))
    known = known.drop("size").join(reps.select("rep", "n", "sketch").join(bits, "rep"), "rep").withColumn("parent", F.lit(None).cast("long"))
    leaves = None
    for level in range(depth):
        known = cut(known, parts)
        mixed = known.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        open_rows = known.join(mixed.select("node", "size", "shingles"), "node")
        stuck = F.coalesce(F.col("size") >= STUCK * F.col("parent"), F.lit(False))
        leaf = (F.col("size") <= small) | stuck | F.lit(level == depth - 1)
        pieces = F.ceil(F.greatest(F.col("size") / F.lit(float(piece)), F.col("shingles") / F.lit(float(PIECE_SHINGLES)))).cast("int").alias("pieces")
        here = cut(open_rows.where(leaf).select("node", pieces, "rep", "component", "n", "sketch", "whole_at", "opening"), parts)
        leaves = here if leaves is None else leaves.union(here)
        large = open_rows.where(~leaf)
        if level == depth - 1 or large.isEmpty():
            break
        known = _children(large, level * own, own)
    more = compare_nodes(leaves, docs, width, part, whole, parts)
    final = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), parts=parts)

    classes = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    named = sigs.join(classes, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
