"""Joins: lookups, caches, nearest words, boxes over boxes, placement of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

#: A second table is sent to every task up to so many rows; beyond, Spark chooses.
SENT_ROWS = 10_000


def maybe_sent(small: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A broadcast hint if the table has few rows, which a bounded count tells."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def first_per_key(rows: DataFrame, key: Column, order: str, last: bool = False) -> DataFrame:
    """One row per key: the one of the least order, or of the greatest; ties keep map-side combining cheap."""
    columns = [c for c in rows.columns if c != "match_key"]
    pick = F.max if last else F.min
    packed = F.struct(F.col(order).alias("by"), *columns)
    return rows.groupBy(key.alias("match_key")).agg(pick(packed).alias("best")).select("match_key", *[F.col(f"best.{c}").alias(c) for c in columns])


def lookup(rows: DataFrame, found: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``rows`` with the value of their key, or the default where it is missing or blank."""
    return rows.join(found.select(key, F.col(value).alias("looked_up")), key, "left").withColumn(value, T.either(F.col("looked_up"), default)).drop("looked_up")


def nearest_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, fixed: each token as the known word nearest to it, or itself.

    ``words`` has word and ord. Exact matches in lower case win; else the least
    edit distance, first in order, if it is 1, or 2 for tokens of four letters or
    more. A word differs at one side of a deletion at least, so candidates meet by
    their two-deletion neighbourhoods' common keys instead of all with all.
    """
    known = first_per_key(words.select("word", "ord", F.lower("word").alias("lw")), F.col("lw"), "ord").select("word", "ord", "lw")
    low = tokens.select("token").distinct().withColumn("low", F.lower("token"))
    pairs = _neighbours(low, "low").join(_neighbours(known, "lw"), "near").where(F.abs(F.length("low") - F.length("lw")) <= 2)
    scored = pairs.select("token", "low", "word", "ord", F.levenshtein("low", "lw").alias("d"))
    best = scored.groupBy("token", "low").agg(F.min(F.struct("d", "ord", "word")).alias("best"))
    accepted = (F.col("best.d") == 1) & (F.length("low") >= 2) | (F.col("best.d") == 2) & (F.length("low") >= 4)
    fixed = F.when(F.col("token") == F.upper("token"), F.upper("best.word")).otherwise(F.col("best.word"))
    found = best.where(accepted).select("token", fixed.alias("fixed"))
    return tokens.join(found, "token", "left").withColumn("fixed", F.coalesce("fixed", "token"))


def corrected_texts(rows: DataFrame, keys: list[str], column: str, words: DataFrame, least: int = 2) -> DataFrame:
    """keys, column, fixed, changed: texts whose words are put right by the known ones.

    A text is cut into words and what is between; each word of ``least`` letters or
    more is replaced as ``nearest_words`` tells, and the parts are put together
    again. Equal words are looked up once.
    """
    # columns of its own are set apart from those of the rows
    apart = {c: f"own_{i}" for i, c in enumerate([*keys, column])}
    named = rows.select(*[F.col(c).alias(n) for c, n in apart.items()])
    parts = F.regexp_extract_all(F.col(apart[column]), F.lit(T.WORD + "|" + T.NO_WORD), F.lit(0))
    tokens = named.select("*", F.posexplode(parts).alias("part_no", "token"))
    wanted = tokens.where((F.length("token") >= least) & F.col("token").rlike("^" + T.WORD)).select("token").distinct()
    fixed = nearest_words(wanted, words)
    joined = tokens.join(fixed, "token", "left").withColumn("fixed", F.coalesce("fixed", "token"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "fixed"))), lambda p: p["fixed"]), "")
    done = joined.groupBy(*apart.values()).agg(whole.alias("fixed"))
    return done.select(*[F.col(n).alias(c) for c, n in apart.items()], "fixed", (F.col("fixed") != F.col(apart[column])).alias("changed"))


def _neighbours(rows: DataFrame, column: str) -> DataFrame:
    """Rows once for each string left by up to two deletions; strings within distance 2 share one."""
    cut_one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    once = F.when(F.length(column) > 0, cut_one(F.col(column))).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(F.filter(once, lambda x: F.length(x) > 0), cut_one))
    return rows.withColumn("near", F.explode(F.array_distinct(F.concat(F.array(column), once, twice))))


def covered_boxes(boxes: DataFrame, share: float = 0.6, least: float = 0.0) -> DataFrame:
    """book, page, id, image_id: boxes of which an image of the same page covers more than ``share``."""
    block = boxes.where("not image").alias("b")
    image = boxes.where("image").select("book", "page", F.col("id").alias("image_id"), *[F.col(c).alias(f"i_{c}") for c in ("x0", "x1", "y0", "y1")]).alias("i")
    across = F.least("x1", "i_x1") - F.greatest("x0", "i_x0")
    down = F.least("y1", "i_y1") - F.greatest("y0", "i_y0")
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1.0))
    pairs = block.join(image, ["book", "page"]).where((across > least) & (down > 0) & (across * down > share * area))
    return pairs.select("book", "page", "id", "image_id")


def _ranges_of_a_tree(low: Column, high: Column, levels: int = 24) -> Column:
    """The fewest nodes of a binary tree over whole numbers that make up low (included) to high (excluded): level and place."""
    start = F.struct(low.cast("long").alias("l"), high.cast("long").alias("r"), F.array().cast("array<struct<level:int,place:bigint>>").alias("nodes"))

    def up(state: Column, level: Column) -> Column:
        left, right = state["l"], state["r"]
        own = lambda keep, place: F.when(keep, F.array(F.struct(level.cast("int").alias("level"), place.alias("place")))).otherwise(F.array().cast("array<struct<level:int,place:bigint>>"))
        odd_l, odd_r = (left < right) & (left % 2 == 1), (left < right) & (right % 2 == 1)
        shift = lambda c: F.floor(c / 2).cast("long")
        taken_l, taken_r = left + odd_l.cast("long"), right - odd_r.cast("long")
        # where one cell is left, it is taken once
        both = odd_r & (taken_l <= right - 1)
        return F.struct(shift(taken_l).alias("l"), shift(F.greatest(taken_r, taken_l)).alias("r"), F.concat(state["nodes"], own(odd_l, left), own(both, right - 1)).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, up, lambda s: s["nodes"])


def floors(boxes: DataFrame, gap: float = 2.0, levels: int = 24, crowded: int = 64) -> DataFrame:
    """book, page, id, floor: ``gap`` above the nearest box below that overlaps in x, else ``gap`` above the page's end.

    Boxes have a width. On a page of up to ``crowded`` boxes each looks at all
    others; more crowded pages are swept, whose work does not grow with the
    square of their boxes. Both give the same rows, and both read one shuffle of
    the boxes by page.
    """
    page = ["book", "page"]
    counted = boxes.select(*page, "id", "x0", "x1", "y0", "page_h").withColumn("n", F.count("*").over(Window.partitionBy(*page)))
    few, many = counted.where(F.col("n") <= crowded), counted.where(F.col("n") > crowded)
    lowest = F.least(F.col("page_h") - gap, F.coalesce(F.col("next") - gap, F.col("page_h")))
    return _next_by_looking(few, gap).unionByName(_next_by_sweep(many, gap, levels)).select(*page, "id", lowest.alias("floor"))


def _next_by_looking(boxes: DataFrame, gap: float) -> DataFrame:
    """book, page, id, page_h and next, the top of the nearest box below: each box against its page's list."""
    below = lambda a: F.filter("all", lambda b: (b["y0"] > a["y0"] + gap) & (b["x1"] > a["x0"]) & (b["x0"] < a["x1"]))
    told = lambda a: F.struct(a["id"].alias("id"), a["page_h"].alias("page_h"), F.array_min(F.transform(below(a), lambda b: b["y0"])).alias("next"))
    pages = boxes.groupBy("book", "page").agg(F.collect_list(F.struct("id", "x0", "x1", "y0", "page_h")).alias("all"))
    return pages.select("book", "page", F.inline(F.transform("all", told)))


def _next_by_sweep(boxes: DataFrame, gap: float, levels: int) -> DataFrame:
    """book, page, id, page_h and next, the top of the nearest box below: by a sweep down a tree of each page's edges.

    The edges are numbered on each page, and a box is a few nodes of a binary tree
    over these numbers. Two boxes overlap in x if a node of one is, or lies above,
    a node of the other; so each box stands at its own nodes and at all above
    them, and a sweep down each node's boxes tells the next lower one. There are a
    few rows to a box, and no pairs.
    """
    box = ["book", "page", "id", "y0", "page_h"]
    edges = boxes.select(*box, F.explode(F.array("x0", "x1")).alias("x"))
    numbered = edges.withColumn("number", F.dense_rank().over(Window.partitionBy("book", "page").orderBy("x")))
    placed = numbered.groupBy(*box).agg(F.min("number").alias("low"), F.max("number").alias("high"))
    # the tree of a page is no higher than its edges need
    top = F.ceil(F.log2(F.max("high").over(Window.partitionBy("book", "page")) + 1)).cast("int")
    nodes = placed.withColumn("top", top).select(*box, "top", _ranges_of_a_tree(F.col("low"), F.col("high"), levels).alias("own"))
    above = F.flatten(F.transform("own", lambda n: F.transform(F.sequence(n["level"], F.greatest("top", n["level"])), lambda up: F.struct(up.alias("level"), n["place"].alias("place"), n["level"].alias("from")))))
    standing = nodes.select(*box, F.explode(above).alias("n")).select(*box, F.col("n.level").alias("level"), F.expr("shiftright(n.place, n.level - n.from)").alias("place"), (F.col("n.level") == F.col("n.from")).alias("own"))
    standing = standing.groupBy(*box, "level", "place").agg(F.max("own").alias("own"))
    # a box asks from just under its top; boxes at that very height are not below
    stands = F.struct(F.col("y0").alias("at"), F.lit(1).alias("kind"), F.col("y0").alias("top"))
    asks = F.struct((F.col("y0") + gap).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("top"))
    events = standing.select(*box, "level", "place", "own", F.explode(F.array(stands, asks)).alias("e")).select(*box, "level", "place", "own", "e.*")
    up = Window.partitionBy("book", "page", "level", "place").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    every, owned = F.last("top", ignorenulls=True).over(up), F.last(F.when(F.col("own"), F.col("top")), ignorenulls=True).over(up)
    # at a node of its own a box meets all that stand there, at one above only those whose own it is
    swept = events.withColumn("met", F.when(F.col("own"), every).otherwise(owned)).where("kind = 0")
    return swept.groupBy(*box).agg(F.min("met").alias("next")).drop("y0")


def overlaps(boxes: DataFrame, share: float = 0.1, band: float = 50.0) -> DataFrame:
    """book, page, i, j, area: pairs i < j of one page whose intersection is over ``share`` of the smaller box.

    Boxes meet in bands of ``band`` points, in the first that both are in.
    """
    bands = F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("band")
    a = boxes.select("book", "page", bands, F.col("id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")])
    b = boxes.select("book", "page", bands, F.col("id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")])
    across = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    down = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    size = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    met = F.floor(F.greatest("a_y0", "b_y0") / band) == F.col("band")
    pairs = a.join(b, ["book", "page", "band"]).where("i < j").where(met & (across > 0) & (down > 0))
    return pairs.where(across * down > share * F.greatest(F.least(size("a"), size("b")), F.lit(1.0))).select("book", "page", "i", "j", (across * down).alias("area"))


def image_anchors(images: DataFrame, flow: DataFrame) -> DataFrame:
    """book, page, image_id, anchor: the last element of the flow on the image's page that begins above its centre.

    ``images`` has the centre as y; ``flow`` has par_no and y0. Without one the
    anchor is null: the image goes to the end.
    """
    nothing = F.lit(None).cast("long")
    elements = flow.select("book", "page", F.col("y0").alias("y"), F.lit(0).alias("kind"), F.col("par_no").cast("long").alias("par_no"), nothing.alias("image_id"))
    asking = images.select("book", "page", "y", F.lit(1).alias("kind"), nothing.alias("par_no"), F.col("image_id").cast("long").alias("image_id"))
    down = Window.partitionBy("book", "page").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = elements.unionByName(asking).withColumn("anchor", F.max("par_no").over(down))
    return merged.where("kind = 1").select("book", "page", "image_id", "anchor")


def first_matches(rows: DataFrame, known: DataFrame) -> DataFrame:
    """name, override: the value of the first known string that equals a name or is within distance 2.

    ``known`` has orig, value and ord. Names of fewer than 3 characters never
    match, those of fewer than 6 only exactly.
    """
    norm = F.lower(T.one_spaced(F.col("name")))
    names = rows.select("name").distinct().withColumn("norm", norm).where("length(norm) >= 3")
    table = known.select("value", "ord", F.lower(T.one_spaced(F.col("orig"))).alias("so")).where("length(so) > 0")
    # strings within distance 2 share one that up to two deletions leave
    pairs = _neighbours(names, "norm").join(_neighbours(table, "so"), "near").drop("near")
    near = (F.col("norm") == F.col("so")) | ((F.length("norm") >= 6) & (F.levenshtein("norm", "so") <= 2))
    hits = pairs.where(near).groupBy("name").agg(F.min(F.struct("ord", "value")).alias("best"))
    return rows.join(hits.select("name", F.col("best.value").alias("override")), "name", "left")


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in a checkpoint, whose keys are strings."""
    ids = done.select(F.col(key).cast("string").alias("done_key")).distinct()
    return rows.join(ids, F.col(key).cast("string") == F.col("done_key"), "left_anti")


def window_rank(rows: DataFrame, group: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))
