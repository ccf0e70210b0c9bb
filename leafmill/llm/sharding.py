"""Sharding by a k-d tree over document metadata.

A point is a document's metadata: source, language and log of its size, as
integer codes. Names are coded by the four bytes that follow what all names
of the table begin with, so codes keep the order of the names. A node that must yield k shards is cut along its widest dimension
(range over the table's range) at the weighted quantile ``(k // 2) / k``, bytes
being the weights, until each leaf is one shard. Equal texts share one point, so
a cut keeps them together unless their group lies across the quantile itself.

The quantiles are found by histograms. Every pass adds up bytes by (node, bin)
with map-side combining, so the driver gets at most ``shards * bins`` rows
whatever the size of the table, and then looks again inside the one bin that
holds the cut. Keys are ``code << 32 | crc32(text)``; a key that is itself too
heavy to fall on one side is cut by a hash of the document's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut

BINS = 1024
#: Groups of equal texts that are sent to all tasks, at most.
SENT_GROUPS = 50_000
DIMS = ("dim_source", "dim_lang", "dim_size")


def name_code(name: Column, least: str | None, most: str | None) -> Column:
    """A number under 2**31 in the order of names between ``least`` and ``most``; 0 for null.

    Names that agree in the four bytes after their common beginning share a number.
    """
    low, high = ((x or "").encode("utf-8", "surrogatepass") for x in (least, most))
    shared = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    told = F.rpad(F.hex(F.substring(name.cast("binary"), shared + 1, 4)), 8, "0")
    return F.coalesce(F.shiftright(F.conv(told, 16, 10).cast("long"), 1) + 1, F.lit(0)).cast("long")


def _of_equal_texts(rows: DataFrame, many: int) -> DataFrame:
    """``rows`` with the least source and language of their equal texts.

    Groups of over ``many`` rows, SENT_GROUPS at most, are sent to all tasks; their
    rows are dealt out by id, so no task gets a large group.
    """
    same = ["size", "crc", "same"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("copies"), F.struct(F.min("source").alias("source"), F.min("lang").alias("lang")).alias("group"))
    large = groups.where(F.col("copies") > many).select(*same, F.col("group").alias("large"))
    small = groups.where(F.col("copies") <= many).select("size", "crc", F.col("same").alias("probe"), "group")
    met = rows.drop("source", "lang").join(F.broadcast(large), same, "left")
    met = met.withColumn("probe", F.when(F.col("large").isNull(), F.col("same")).otherwise(F.xxhash64(F.lit(29), F.col("doc_id"))))
    of = F.coalesce("large", "group")
    return met.join(small, ["size", "crc", "probe"], "left").withColumns({"source": of["source"], "lang": of["lang"]})


def metadata_points(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, spread and one key under 2**63 per dimension; a group of equal texts has its least source and language."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("same"),
        "source",
        "lang",
    )
    spans = docs.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("source", "lang") for f in (F.min, F.max)]).first()
    rows = _of_equal_texts(rows, max(1000, spans["n"] // SENT_GROUPS))
    code = lambda c: name_code(F.col(c), spans[f"min_{c}"], spans[f"max_{c}"])
    log_size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 5e7), F.lit(2**31 - 1)).cast("long")
    keyed = lambda c: F.shiftleft(c, 32).bitwiseOR(F.col("crc"))
    return rows.select(
        "doc_id",
        "size",
        "crc",
        F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id")), 2).alias("spread"),
        keyed(code("source")).alias("dim_source"),
        keyed(code("lang")).alias("dim_lang"),
        keyed(log_size).alias("dim_size"),
    )


def _pick(node: Column, names: dict[int, str]) -> Column:
    """The column named for each node."""
    out = F.lit(None).cast("long")
    for k, name in names.items():
        out = F.when(node == k, F.col(name)).otherwise(out)
    return out


def _by_node(values: dict[int, int]) -> Column:
    """A number for each node."""
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(F.col("node") == k, F.lit(v)).otherwise(out)
    return out


def _quantiles(points: DataFrame, value: str, goals: dict[int, float], ranges: dict[int, tuple[int, int]], slack: float) -> dict[int, tuple[int, float, float]]:
    """For each node the value at which the running weight passes its goal.

    Returns node -> (cut, weight below the cut, weight at the cut); rows with a
    smaller value go left. Passes look inside the bin that holds the goal until
    a boundary is within ``slack`` or the bin is one value.
    """
    done: dict[int, tuple[int, float, float]] = {}
    base = dict.fromkeys(goals, 0.0)
    while goals:
        low, high = ({k: ranges[k][i] for k in goals} for i in (0, 1))
        hist = (
            points.where(F.col("node").isin(list(goals)))
            .withColumn("low", _by_node(low))
            .withColumn("step", _by_node({k: (high[k] - low[k]) // BINS + 1 for k in goals}))
            .where((F.col(value) >= F.col("low")) & (F.col(value) <= _by_node(high)))
            .withColumn("bin", F.expr(f"({value} - low) div step"))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("w"), F.min(value).alias("lo"), F.max(value).alias("hi"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for r in sorted(hist, key=lambda r: (r["node"], r["bin"])):
            by_node.setdefault(r["node"], []).append(r)
        for k in list(goals):
            below = base[k]
            for r in by_node[k]:
                if below + r["w"] >= goals[k]:
                    break
                below += r["w"]
            if goals[k] - below <= slack:
                done[k] = (r["lo"], below, 0.0)
            elif below + r["w"] - goals[k] <= slack:
                done[k] = (r["hi"] + 1, below + r["w"], 0.0)
            elif r["lo"] == r["hi"] and value == "spread":
                # one row: it goes to the side that comes nearer to the goal
                done[k] = (r["lo"] + (2 * (goals[k] - below) >= r["w"]), below, 0.0)
            elif r["lo"] == r["hi"]:
                done[k] = (r["lo"], below, float(r["w"]))
            else:
                ranges[k], base[k] = (r["lo"], r["hi"]), below
                continue
            del goals[k]
    return done


def kd_shards(docs: DataFrame, *, shards: int = 24, slack: float = 0.01, slot_rows: int = 2000) -> DataFrame:
    """Documents with their shard, of nearly equal bytes, and their slot in it.

    Size is the text's UTF-8 bytes (null: none) plus 8. Returns doc_id, size,
    text_crc32, shard (0 .. shards - 1) and slot (0, 1, ... within the shard, by
    hash block and doc_id). ``slack`` is the part of a shard's bytes by which
    one cut may miss its quantile; a group of equal texts is only divided where
    it is heavier. Null metadata forms a code of its own, equal
    rows are separate rows, texts are weighed whole, other columns are left out,
    an empty table gives no rows.
    """
    points = cut(metadata_points(docs))
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
    whole = points.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *spans).first()
    total = whole["w"] or 0
    tolerance = slack * total / shards
    width_all = {c: max(1, (whole[f"max_{c}"] or 0) - (whole[f"min_{c}"] or 0)) for c in DIMS}
    cuts_at: dict[int, Column] = {}  # node -> rows for which it holds go left
    parts, leaf = {1: shards}, {}

    def place(k: int, name: Callable[[int], int]) -> Column:
        """The leaf or open node of a row, by one test per node on its path."""
        return F.when(cuts_at[k], place(2 * k, name)).otherwise(place(2 * k + 1, name)) if k in cuts_at else F.lit(name(k))

    while parts and total:
        at = points.withColumn("node", place(1, int))
        seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect()}
        leaf |= {k: p for k, p in parts.items() if p == 1 or k not in seen}  # without rows all its shards stay empty
        split = {k: p for k, p in parts.items() if k not in leaf}
        if not split:
            break
        widest = {k: max(DIMS, key=lambda c: ((seen[k][f"max_{c}"] - seen[k][f"min_{c}"]) / width_all[c], -DIMS.index(c))) for k in split}
        goals = {k: seen[k]["w"] * (p // 2) / p for k, p in split.items()}
        ranges = {k: (seen[k][f"min_{widest[k]}"], seen[k][f"max_{widest[k]}"]) for k in split}
        keyed = at.where(F.col("node").isin(list(split))).select("node", "size", "spread", _pick(F.col("node"), widest).alias("key"))
        cuts = _quantiles(keyed, "key", dict(goals), ranges, tolerance)
        heavy = {k: c for k, c in cuts.items() if c[2] > 0}
        inner = {}
        if heavy:
            same = _by_node({k: c[0] for k, c in heavy.items()})
            inner = _quantiles(keyed.where(F.col("key") == same), "spread", {k: goals[k] - c[1] for k, c in heavy.items()}, {k: (0, 2**62 - 1) for k in heavy}, tolerance)
        for k in split:
            key, value = F.col(widest[k]), F.lit(cuts[k][0])
            cuts_at[k] = (key < value) | ((key == value) & (F.col("spread") < F.lit(inner[k][0]))) if k in inner else key < value
        parts = {c: p for k, q in split.items() for c, p in ((2 * k, q // 2), (2 * k + 1, q - q // 2))}
    # shards in the order of the leaves, left to right
    order = sorted(leaf, key=lambda k: bin(k)[2:].ljust(64, "0"))
    first, shards_before = {}, 0
    for k in order:
        first[k], shards_before = shards_before, shards_before + leaf[k]
    shard = place(1, lambda k: first.get(k, 0))
    blocks = (whole["n"] or 0) // (slot_rows * shards) + 1
    placed = points.select("doc_id", "size", F.col("crc").alias("text_crc32"), shard.cast("int").alias("shard"), F.pmod("spread", F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    return placed.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.row_number().over(within) - 1).alias("slot"))
