"""Reports and aggregations over books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T


def quality_report(lines: DataFrame, threshold: float = 5.0, least: int = 4, per_page: int = 3) -> DataFrame:
    """book, total, suspect, garbled_percent, has_issues, suspect_pages.

    Lines of fewer than ``least`` characters do not count. Pages (from 1) with
    ``per_page`` suspect lines or more are listed if the share of the whole book
    reaches the threshold.
    """
    counted = lines.where(F.length("text") >= least)
    pages = counted.groupBy("book", "page").agg(F.count("*").alias("n"), F.count_if(T.suspect_garble(F.col("text"))).alias("bad"))
    books = pages.groupBy("book").agg(
        F.sum("n").alias("total"),
        F.sum("bad").alias("suspect"),
        F.array_sort(F.collect_list(F.when(F.col("bad") >= per_page, F.col("page") + 1))).alias("marked"),
    )
    percent = F.bround(F.lit(100.0) * F.col("suspect") / F.greatest("total", F.lit(1)), 1)
    books = books.withColumn("garbled_percent", percent).withColumn("has_issues", F.col("garbled_percent") >= threshold)
    listed = F.when(F.col("has_issues"), F.concat_ws(",", F.col("marked").cast("array<string>"))).otherwise("")
    return books.select("book", "total", "suspect", "garbled_percent", "has_issues", listed.alias("suspect_pages"))


def scanned_books(pages: DataFrame, per_page: int = 25, least_pages: int = 3) -> DataFrame:
    """book, pages, chars, scanned: books of three pages or more with hardly any text."""
    books = pages.groupBy("book").agg(F.countDistinct("page").alias("pages"), F.sum("chars").alias("chars"))
    return books.withColumn("scanned", (F.col("pages") >= least_pages) & (F.col("chars") < per_page * F.col("pages")))


def most_frequent(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The value each group has most often; on ties the one of the least order."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", rank).where("place = 1").select(*group, value, "n")


def page_bodies(lines: DataFrame) -> DataFrame:
    """book, page, body: the mode of whole type sizes on a page, from 6 to 16."""
    rows = lines.select("book", "page", "line_no", F.greatest(F.lit(1), F.bround("size").cast("int")).alias("whole"))
    best = most_frequent(rows, ["book", "page"], "whole", "line_no")
    return best.select("book", "page", F.least(F.lit(16), F.greatest(F.lit(6), F.col("whole"))).alias("body"))


def words_to_lines(words: DataFrame, least: float = 35.0, zoom: float = 200 / 72) -> DataFrame:
    """Recognised words joined into lines, with the box around them in points.

    ``words`` has book, page, block_num, par_num, line_num, ord, text, conf (text),
    left, top, width, height. Blank words and those of low or no confidence go.
    """
    sure = F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0)) >= least
    good = words.where((F.length(T.strip(F.col("text"))) > 0) & sure)
    grouped = good.groupBy("book", "page", "block_num", "par_num", "line_num").agg(
        F.array_sort(F.collect_list(F.struct("ord", T.strip(F.col("text")).alias("text")))).alias("parts"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    ends = [(F.col(c) / zoom).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return grouped.select("book", "page", "block_num", "par_num", "line_num", F.concat_ws(" ", "parts.text").alias("text"), *ends)


def reading_order(lines: DataFrame, step: float = 5.0) -> DataFrame:
    """``lines`` with their place on the page by rows of ``step`` points, then from the left."""
    order = Window.partitionBy("book", "page").orderBy(F.bround(F.col("y0") / step), "x0", "line_no")
    return lines.withColumn("place", F.row_number().over(order) - 1)


def abbreviations(texts: DataFrame) -> DataFrame:
    """token, n: words of 2 to 5 capitals, Latin or without Cyrillic vowels."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])([А-ЯЁЇІЄҐA-Z]{2,5})(?![\p{L}\p{N}_])"), F.lit(1)))
    tokens = texts.select(found.alias("token"))
    return tokens.where(F.col("token").rlike("^[A-Z]{2,5}$") | ~F.col("token").rlike("[АЕЁИОУЫЭЮЯЇІЄ]")).groupBy("token").agg(F.count("*").alias("n"))


def first_casings(words: DataFrame) -> DataFrame:
    """The casing met first of each word, by ``ord``."""
    best = words.groupBy(F.lower("word").alias("low")).agg(F.min(F.struct("ord", "word")).alias("best"), F.count("*").alias("n"))
    return best.select("low", F.col("best.word").alias("word"), "n")


def title_lines(lines: DataFrame, body_page: DataFrame, share: float = 0.7, titles: int = 4, authors: int = 3) -> DataFrame:
    """book, title, authors: on each book's title page, the large lines and the first small ones."""
    rows = lines.join(body_page, ["book", "page"])
    rows = rows.withColumn("largest", F.max("size").over(Window.partitionBy("book")))
    large = F.col("size") >= F.col("largest") * share
    kind = F.when(large & (F.length("text") >= 2), "title").when(~large & F.length("text").between(3, 60), "author")
    ranked = rows.withColumn("kind", kind).where("kind is not null").withColumn("place", F.row_number().over(Window.partitionBy("book", "kind").orderBy("line_no")))
    part = lambda k, n: F.concat_ws(" " if k == "title" else "; ", F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("place") <= n), F.struct("place", "text")))), lambda s: s["text"]))
    return ranked.groupBy("book").agg(F.substring(part("title", titles), 1, 120).alias("title"), part("author", authors).alias("authors"))


def cover_gate(blocks: Column, keep_original: Column) -> Column:
    """Whether a cover is made anew: its page has no block of text, and the original is not to stay."""
    return (blocks == 0) & ~F.coalesce(keep_original, F.lit(False))


def dominant_colours(pixels: DataFrame, k: int = 6, step: int = 12) -> DataFrame:
    """id, place, r, g, b, share, plain, base, accent: each image's ``k`` most frequent colours in steps of ``step``.

    ``pixels`` has id, r, g, b and n. A colour stands for its step's middle.
    ``plain``: the first has over half of all pixels. ``base``: of the first three,
    the one whose luminance is farthest from 110; ``accent``: the one of the widest
    range of channels. Ties go to the more frequent.
    """
    down = lambda c: F.expr(f"{c} div {step} * {step}").cast("int").alias(c)
    counts = pixels.select("id", down("r"), down("g"), down("b"), "n").groupBy("id", "r", "g", "b").agg(F.sum("n").alias("n"))
    totals = pixels.groupBy("id").agg(F.sum("n").alias("every")).withColumnRenamed("id", "of_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "r", "g", "b"))
    top = counts.withColumn("place", rank).where(F.col("place") <= k).join(totals, F.col("id") == F.col("of_id"))
    up = lambda c: F.least(F.lit(255), F.col(c) + step // 2).cast("int").alias(c)
    top = top.select("id", "place", up("r"), up("g"), up("b"), F.round(F.col("n") / F.col("every"), 6).alias("share"))
    # k rows an image
    own = Window.partitionBy("id")
    far = F.when(F.col("place") <= 3, F.abs(T.luminance(F.col("r"), F.col("g"), F.col("b")) - 110))
    wide = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    best = lambda score: F.max(F.struct(score.alias("score"), (-F.col("place")).alias("place"))).over(own)["place"] == -F.col("place")
    return top.withColumn("plain", F.max("share").over(own) > 0.5).withColumn("base", best(F.round(far, 6))).withColumn("accent", best(wide))
