"""Sequences cut by budgets: batches of texts, wrapped lines, sizes that fit, samples, runs, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.layout import id_block, ranked

DELIMITER = 9


def _next_starts(n: np.ndarray, budget: int, delimiter: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each row (and of all), and for each row where the batch that it starts is full.

    A batch from row i is full at the first j > i with sums[j] - sums[i] + n[j] over
    the budget; sums[j] + n[j] never falls, so a search finds it.
    """
    sums = np.concatenate(([0], np.cumsum(n + delimiter)))
    return sums, np.maximum(np.searchsorted(sums[:-1] + n, sums[:-1] + budget, "right"), np.arange(1, len(n) + 1))


def block_summary(n: np.ndarray, budget: int, delimiter: int) -> tuple[list[int], list[int], list[int], int]:
    """What a block of rows does to a batch that is open when it begins.

    The open batch is full at one of the first rows; for each of these: the sum at
    which it is met, the batches that start from there on, and what the last one
    holds at the block's end. And the sum of all rows.
    """
    sums, after = _next_starts(n, budget, delimiter)
    m = len(n)
    ends = sums[:-1] + n
    reach = min(int(np.searchsorted(ends, budget, "right")) + 1, m)
    # pointers doubled until all have come to the last start of their path
    to, steps = np.where(after < m, after, np.arange(m)), (after < m).astype(np.int64)
    for _ in range(max(m, 1).bit_length()):
        steps, to = steps + steps[to], to[to]
    return ends[:reach].tolist(), (steps[:reach] + 1).tolist(), (sums[m] - sums[to[:reach]]).tolist(), int(sums[m])


def _through(summary: tuple, used: int | None, batch: int, budget: int) -> tuple[int, int]:
    """What the open batch holds and its number after a block, given both before it; used is None where a group begins."""
    ends, starts, left, total = summary
    row = 0 if used is None else int(np.searchsorted(np.asarray(ends), budget - used, "right"))
    return (left[row], batch + starts[row]) if row < len(ends) else (used + total, batch)


def _numbered(n: np.ndarray, used: int | None, batch: int, budget: int, delimiter: int) -> np.ndarray:
    """Batch of each row of a block that is entered with an open batch."""
    sums, after = _next_starts(n, budget, delimiter)
    row = 0 if used is None else int(np.searchsorted(sums[:-1] + n, budget - used, "right"))
    new = np.zeros(len(n), np.int64)
    while row < len(n):
        new[row] = 1
        row = int(after[row])
    return batch + np.cumsum(new)


def greedy_batches(rows: DataFrame, group: str, order: str, length: str, budget: int = 2500, delimiter: int = DELIMITER, block: int = 1 << 16) -> DataFrame:
    """group, order, batch: rows in order; a batch is full when the next row would pass the budget.

    Each row costs its length and a delimiter. A row over the budget has a batch
    of its own. Rows are taken in blocks: each block says what it does to the batch
    that is open when it begins, a scan of the blocks' few numbers tells each one's
    open batch, and then each block numbers its own rows. Null lengths are 0; rows
    of equal order are taken shortest first.
    """
    narrow = rows.select(F.col(group).cast("string").alias("grp"), F.col(order).cast("long").alias("ord"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    placed = ranked(narrow.withColumn("near", id_block(narrow, "ord")), ["grp"], "near", ["ord", "n"], "rank").select("grp", F.expr(f"rank div {block}").alias("block"), "ord", "n", "rank")

    def summarise(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ends, starts, left, total = block_summary(part.sort_values("rank")["n"].to_numpy(), budget, delimiter)
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "ends": [ends], "starts": [starts], "left": [left], "total": [total]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, batch = object(), None, -1
        for frame in frames:
            out = []
            for grp, no, ends, starts, left, total in frame.itertuples(index=False, name=None):
                if grp != last:
                    last, used, batch = grp, None, -1
                out.append((grp, no, used, batch))
                used, batch = _through((ends, starts, left, total), used, batch, budget)
            yield pd.DataFrame(out, columns=["grp", "block", "used", "batch"]).astype({"used": "Int64"})

    def number(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        used = part["used"].iloc[0]
        return part.assign(batch=_numbered(part["n"].to_numpy(), None if pd.isna(used) else int(used), int(part["batch"].iloc[0]), budget, delimiter))[["grp", "ord", "batch"]]

    summed = placed.groupBy("grp", "block").applyInPandas(summarise, "grp string, block long, ends array<long>, starts array<long>, left array<long>, total long")
    entries = summed.repartition("grp").sortWithinPartitions("grp", "block").mapInPandas(scan, "grp string, block long, used long, batch long")
    entries = entries.withColumnsRenamed({"grp": "in_grp", "block": "in_block"})
    met = placed.join(entries, F.col("grp").eqNullSafe(F.col("in_grp")) & (F.col("block") == F.col("in_block")))
    done = met.select("grp", "block", "ord", "n", "rank", "used", "batch").groupBy("grp", "block").applyInPandas(number, "grp string, ord long, batch long")
    return done.select(F.col("grp").alias(group), F.col("ord").alias(order), "batch")


def wrapped(text: Column, width: int) -> Column:
    """Lines of a text: words are added while the line fits; a word over the width stands alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        longer = F.concat_ws(" ", F.nullif(state["line"], F.lit("")), word)
        fits = (state["line"] == "") | (F.length(longer) <= width)
        return F.when(fits, F.struct(state["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.concat(state["done"], F.array(state["line"])).alias("done"), word.alias("line")))

    return F.aggregate(words, start, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))


def wrapped_count(text: Column, width: Column) -> Column:
    """Lines that ``wrapped`` would make, for a width of its own in each row."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))
    fits = lambda s, n: (s["lines"] > 0) & (s["used"] + 1 + n <= width)
    add = lambda s, n: F.when(fits(s, n), F.struct(s["lines"].alias("lines"), (s["used"] + 1 + n).alias("used"))).otherwise(F.struct((s["lines"] + 1).alias("lines"), n.alias("used")))
    return F.aggregate(words, start, add, lambda s: s["lines"])


def fits_in(text: Column, halves: Column, width: Column, height: Column, glyph: float = 0.55, leading: float = 1.2) -> Column:
    """Whether a text, wrapped, fits in a box in type of so many half points; a word wider than the box stands out."""
    size = halves / 2
    chars = F.greatest(F.floor(width / (size * glyph)).cast("int"), F.lit(1))
    return wrapped_count(text, chars) * size * leading <= height


def fitting_size(text: Column, size: Column, width: Column, height: Column, least: float = 6.0, shrink: float = 0.7) -> Column:
    """The largest size, in half points down from ``size``, in which a text fits; the least allowed where none does.

    Sizes go down to ``shrink`` of the whole size, or ``least``. A larger size has
    fewer characters to a line, so no fewer lines, and each is higher: what fits in
    one size fits in all smaller ones, and halving finds the largest.
    """
    top = F.floor(size * 2).cast("int")
    bottom = F.least(top, F.ceil(F.greatest(F.lit(least), size * shrink) * 2).cast("int"))
    start = F.struct(bottom.alias("low"), top.alias("high"))
    middle = lambda s: F.ceil((s["low"] + s["high"]) / 2).cast("int")
    halve = lambda s, _: F.when(fits_in(text, middle(s), width, height), F.struct(middle(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), F.greatest(s["low"], middle(s) - 1).alias("high")))
    # eight halvings tell 256 sizes apart
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, halve, lambda s: s["low"] / 2)


def systematic_sample(rows: DataFrame, group: str, order: str, text: Column, sample: int = 120, least: int = 12, budget: int = 8000) -> DataFrame:
    """Every nth row, short texts left out, up to the row that fills the budget."""
    numbered = rows.withColumn("text_length", F.length(text))
    counts = rows.groupBy(group).agg(F.count("*").alias("group_rows")).withColumnRenamed(group, "sample_group")
    on = F.col(group).eqNullSafe(F.col("sample_group"))
    step = F.greatest(F.lit(1), F.expr(f"group_rows div {sample}"))
    drawn = numbered.join(counts, on).where((F.col(order) % step == 0) & (F.col("text_length") >= least))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # about ``sample`` rows of a group are left here, whatever its size
    kept = drawn.withColumn("filled", F.coalesce(F.sum("text_length").over(before), F.lit(0))).where(F.col("filled") < budget)
    return kept.drop("sample_group", "group_rows")


def runs(rows: DataFrame, group: str, order: str, flag: str, gap: int = 2, least: int = 3) -> DataFrame:
    """group, run_start, run_end: runs of true rows; those at most ``gap`` apart are one, short ones go."""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.where(flag).withColumn("new", F.coalesce(F.col(order) - F.lag(order).over(w) - 1 > gap, F.lit(True)))
    numbered = marked.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    found = numbered.groupBy(group, "run").agg(F.min(order).alias("run_start"), (F.max(order) + 1).alias("run_end"))
    return found.where(F.col("run_end") - F.col("run_start") >= least).select(group, "run_start", "run_end")


def page_chunks(lines: DataFrame, size: int = 40) -> DataFrame:
    """book, chunk, first_page, last_page, lines."""
    return lines.groupBy("book", F.expr(f"page div {size}").alias("chunk")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("lines"))
