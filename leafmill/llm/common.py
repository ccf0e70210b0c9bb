"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names; only where that is unset
    and Spark runs on one machine (tests, a laptop) a local one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, name: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It learns of them when the driver's JVM collects its garbage, which a driver
    with little to do may put off until the disks of the executors are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """No more rows to an Arrow batch of whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def light_batches(spark: SparkSession, size: int) -> None:
    """No more bytes, about, to an Arrow batch; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name).lower().removesuffix("b")
    held = int(said.rstrip("kmgtp")) << 10 * (" kmgtp".find(said[-1]) if said[-1].isalpha() else 0)
    if not 0 < held <= size:
        spark.conf.set(name, f"{size}b")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, in at most ``parts`` files."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about ``each`` rows, but no more than a shuffle has."""
    return max(1, min(-(-rows // each), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, SPACE_CLASS))).otherwise(0).cast("long")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Give every executor a file, kept in the checkpoint folder; returns its name for SparkFiles."""
    context, folder = spark.sparkContext, shared_folder(spark)
    jvm = context._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, name)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        # written apart and renamed, so that the name never stands for half a file
        draft = jvm.org.apache.hadoop.fs.Path(folder, f"{name}.{uuid.uuid4().hex}")
        out = files.create(draft, True)
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
        out.close()
        if not files.rename(draft, path):
            files.delete(draft, False)
    context.addFile(path.toString())
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts (and the last ends), of rows sorted by whole-number columns.

    A table has a batch or two, and as many more as its last group needs.
    """

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(table) - 1, 0), bool)
        for name in key:
            values = np.asarray(table.column(name))
            new |= values[1:] != values[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1))

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        ends = [tuple(batch.column(k)[i].as_py() for k in key) for i in (0, len(batch) - 1)]
        if held and (ends[0] != last or ends[0] != ends[1]):
            table = pa.Table.from_batches([*held, batch])
            first = starts(table)
            # the last group may go on
            yield table.slice(0, first[-1]), first
            held = table.slice(first[-1]).to_batches()
        else:
            held.append(batch)
        last = ends[1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate((starts(table), [len(table)]))


def dealt(rows: DataFrame, group: str, item: str, pieces: str) -> DataFrame:
    """``rows`` once for each task that compares its piece of the group: with i, j and side.

    A group of k ``pieces`` has tasks i <= j below k. In task i < j those of side
    0 meet those of side 1; in task i = j all are of side 0 and meet each other.
    """
    own = F.pmod(F.xxhash64(group, item), F.col(pieces)).cast("int")
    task = lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j"), (F.col("own") > k).cast("int").alias("side"))
    placed = rows.withColumn("own", own)
    return placed.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.col(pieces) - 1), task))).select("*", "task.*").drop("own", "task", pieces)


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row connected to each of n rows by the links a, b."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new
