"""Rebuilding a book's flow from placed lines: sizes, headers, headings, paragraphs, segments."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.matching import maybe_sent
from leafmill.sources.checkpoints import cut

KINDS = ("h1", "h2", "h3", "para")


def body_size(lines: DataFrame, least: int = 25, default: float = 11.0) -> DataFrame:
    """book, body: the most frequent type size of long lines, in halves; on ties the one met first."""
    half = F.bround(F.col("size") * 2) / 2
    long_line = F.length("text") >= least
    first = F.min(F.when(long_line, F.struct("page", "line_no"))).alias("first")
    sizes = lines.select("book", "page", "line_no", "text", half.alias("half")).groupBy("book", "half").agg(F.count_if(long_line).alias("n"), first)
    rank = Window.partitionBy("book").orderBy(F.desc("n"), "first")
    best = sizes.withColumn("place", F.row_number().over(rank)).where("place = 1")
    return best.select("book", F.when(F.col("n") > 0, F.col("half")).otherwise(F.lit(default)).alias("body"))


def in_zone(y0: Column | None = None, y1: Column | None = None) -> Column:
    """Whether a line stands in the top or bottom part of its page."""
    y0, y1 = F.col("y0") if y0 is None else y0, F.col("y1") if y1 is None else y1
    return (y0 < F.col("page_h") * 0.12) | (y1 > F.col("page_h") * 0.88)


def repeated_headers(lines: DataFrame, fraction: float = 0.25) -> DataFrame:
    """book, header, pages: texts in the zone of at least 3 pages and of that part of the book's pages."""
    header = T.header_key(F.col("text"))
    zone = lines.where(in_zone()).select("book", "page", header.alias("header")).where("length(header) between 3 and 60")
    counted = zone.distinct().groupBy("book", "header").agg(F.count("*").alias("pages"))
    books = lines.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("book_pages"))
    on = counted["book"].eqNullSafe(books["book"])
    return counted.join(books, on).where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("book_pages") * fraction))).select(counted["book"], "header", "pages")


def without_artifacts(lines: DataFrame, body: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines without repeated headers, bare page numbers and rows of an old table of contents."""
    t = T.strip(F.col("text"))
    b = body.select(F.col("book").alias("body_book"), "body")
    h = headers.select(F.col("book").alias("header_book"), F.col("header"))
    rows = lines.join(b, F.col("book").eqNullSafe(F.col("body_book")))
    rows = rows.where(~(in_zone() & t.rlike(T.PAGE_NUMBER)) & ~t.rlike(T.LEADERS))
    repeated = (F.col("book").eqNullSafe(F.col("header_book"))) & (T.header_key(t) == F.col("header")) & in_zone() & (F.col("size") < F.col("body") * 1.25)
    return rows.join(h, repeated, "left_anti").drop("body_book")


def toc_pages(lines: DataFrame) -> DataFrame:
    """book, page, is_toc: a page headed by a contents title, or mostly of lines with dot leaders."""
    order = F.array_sort(F.collect_list(F.when(F.col("line_rank") <= 2, F.struct("line_rank", "text"))))
    ranked = lines.withColumn("line_rank", F.row_number().over(Window.partitionBy("book", "page").orderBy("line_no")))
    pages = ranked.groupBy("book", "page").agg(order.alias("top"), F.count("*").alias("n"), F.count_if(F.col("text").rlike(T.LEADERS)).alias("leaders"))
    head = F.lower(F.regexp_replace(F.concat_ws(" ", "top.text"), r"\s+", ""))
    titled = F.lit(False)
    for title in T.TOC_TITLES:
        titled = titled | F.startswith(head, F.lit(title))
    return pages.select("book", "page", (titled | ((F.col("n") >= 4) & (F.col("leaders") >= F.greatest(F.lit(3), F.expr("n div 2"))))).alias("is_toc"))


def skip_pages(lines: DataFrame) -> DataFrame:
    """book, page, reason: the cover, the first page of text after it, and old contents pages."""
    pages = lines.select("book", "page").distinct()
    title = pages.where("page > 0").groupBy("book").agg(F.min("page").alias("page")).withColumn("reason", F.lit("title"))
    cover = pages.select("book", F.lit(0).alias("page")).distinct().withColumn("reason", F.lit("cover"))
    toc = toc_pages(lines).where("is_toc").select("book", "page", F.lit("contents").alias("reason"))
    return cover.unionByName(title).unionByName(toc)


def without_pages(lines: DataFrame, skipped: DataFrame) -> DataFrame:
    """Lines of pages that are not among the skipped ones."""
    gone = skipped.select(F.col("book").alias("gone_book"), F.col("page").alias("gone_page")).distinct()
    return lines.join(gone, F.col("book").eqNullSafe(F.col("gone_book")) & (F.col("page") == F.col("gone_page")), "left_anti")


def median_gaps(lines: DataFrame, default: float = 4.0) -> DataFrame:
    """book, page, median_gap: the upper median of positive gaps between neighbouring lines."""
    before = Window.partitionBy("book", "page").orderBy("line_no")
    gaps = lines.select("book", "page", (F.col("y0") - F.lag("y1").over(before)).alias("gap"))
    sorted_gaps = F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    pages = gaps.groupBy("book", "page").agg(sorted_gaps.alias("gaps"))
    upper = F.try_element_at("gaps", F.expr("cast(size(gaps) div 2 + 1 as int)"))
    return pages.select("book", "page", F.coalesce(upper, F.lit(default)).alias("median_gap"))


def pages_of(lines: DataFrame) -> DataFrame:
    """book, page, page_h (where lines have it), lines: the lines of each page in its row, in order."""
    height = [F.first("page_h").alias("page_h")] if "page_h" in lines.columns else []
    return lines.groupBy("book", "page").agg(*height, F.array_sort(F.collect_list(F.struct(*[c for c in LINE if c in lines.columns]))).alias("lines"))


#: What the array of a page has of each line.
LINE = ("line_no", "text", "x0", "x1", "y0", "y1", "size")


def lines_of(pages: DataFrame) -> DataFrame:
    """The rows of all pages' lines."""
    return pages.select("book", "page", "page_h", F.inline("lines"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once, however often it is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_contents(lines: Column) -> Column:
    """Whether lines of a page are those of ``toc_pages``."""
    head = F.lower(F.regexp_replace(F.concat_ws(" ", F.transform(F.slice(lines, 1, 2), lambda x: x["text"])), r"\s+", ""))
    leaders = F.size(F.filter(lines, lambda x: x["text"].rlike(T.LEADERS)))
    n = F.size(lines)
    titled = _bound(head, lambda h: reduce(Column.__or__, [F.startswith(h, F.lit(title)) for title in T.TOC_TITLES]))
    return titled | ((n >= 4) & (leaders >= F.greatest(F.lit(3), F.floor(n / 2))))


def flow_pages(pages: DataFrame, first: DataFrame | None = None, fraction: float = 0.02) -> DataFrame:
    """book, page, par_no, kind, text, y0: what ``paragraphs`` makes of ``pages``, each done in its own row, so no text leaves its task.

    Repeated headers, page numbers and leader lines go first, so they are no part
    of what follows; then the cover, the first page of text after it, and old
    contents pages. ``first`` has each book's cover as book and cover; else it is
    page 0.
    """
    rows = lines_of(pages)
    body = body_size(rows).select(F.col("book").alias("of_book"), "body")
    headers = repeated_headers(rows, fraction).groupBy("book").agg(F.collect_set("header").alias("headers")).withColumnRenamed("book", "h_book")
    books = body.join(headers, F.col("of_book").eqNullSafe(F.col("h_book")), "left").drop("h_book")
    if first is not None:
        covers = first.select(F.col("book").alias("c_book"), "cover")
        books = books.join(covers, F.col("of_book").eqNullSafe(F.col("c_book"))).drop("c_book")
    else:
        books = books.withColumn("cover", F.lit(0))
    books = cut(books.withColumn("headers", F.coalesce("headers", F.array().cast("array<string>"))))

    def stays(x: Column) -> Column:
        t, zone = T.strip(x["text"]), in_zone(x["y0"], x["y1"])
        return ~(zone & t.rlike(T.PAGE_NUMBER)) & ~t.rlike(T.LEADERS) & ~(zone & (x["size"] < F.col("body") * 1.25) & F.array_contains("headers", T.header_key(t)))

    placed = pages.join(maybe_sent(books), F.col("book").eqNullSafe(F.col("of_book"))).drop("of_book")
    titles = cut(placed.where((F.col("page") > F.col("cover")) & F.exists("lines", stays)).groupBy("book").agg(F.min("page").alias("title"))).withColumnRenamed("book", "t_book")
    inner = placed.where(F.col("page") != F.col("cover")).join(maybe_sent(titles), F.col("book").eqNullSafe(F.col("t_book")), "left")
    inner = inner.where(F.col("title").isNull() | (F.col("page") != F.col("title")))
    # kept lines are bound, or they would be found anew for each use
    pars = _bound(F.filter("lines", stays), lambda x: F.when((F.size(x) > 0) & ~_is_contents(x), _page_paragraphs(x, F.col("body"))))
    return inner.select("book", "page", F.posexplode(pars).alias("par_no", "p")).select("book", "page", F.col("par_no").cast("long").alias("par_no"), "p.kind", "p.text", "p.y0")


def paragraphs(lines: DataFrame, body: DataFrame) -> DataFrame:
    """book, page, par_no, kind, text, y0: lines joined into headings and paragraphs, page by page.

    A line starts a new one where the kind changes; in headings after a large
    gap; in text at an indent, a gap, or after a short line before a capital. A
    hyphen at a line's end is dropped before a lower-case letter.
    """
    b = body.select(F.col("book").alias("body_book"), "body")
    rows = pages_of(lines).join(b, F.col("book").eqNullSafe(F.col("body_book")))
    pars = rows.select("book", "page", F.posexplode(_page_paragraphs(F.col("lines"), F.col("body"))).alias("par_no", "p"))
    return pars.select("book", "page", F.col("par_no").cast("long").alias("par_no"), "p.kind", "p.text", "p.y0")


def _page_paragraphs(lines: Column, body: Column, default_gap: float = 4.0) -> Column:
    """The paragraphs (kind, text, y0) of a page's lines, which are an array in order."""

    def of(k: Column) -> Column:
        gaps = F.array_sort(F.filter(F.transform(k, lambda x, i: F.when(i > 0, x["y0"] - F.get(k, i - 1)["y1"])), lambda g: g > 0))
        middle = _bound(gaps, lambda g: F.coalesce(F.get(g, F.floor(F.size(g) / 2).cast("int")), F.lit(default_gap)))
        left, right = F.array_min(F.transform(k, lambda x: x["x0"])), F.array_max(F.transform(k, lambda x: x["x1"]))
        page = F.struct(middle.alias("gap"), left.alias("left"), F.greatest(right - left, F.lit(1.0)).alias("width"))
        return _bound(page, lambda p: broken(k, p))

    def starts(x: Column, last: Column, p: Column) -> Column:
        gap = x["y0"] - last["y1"]
        indent = (x["x0"] - p["left"] > p["width"] * 0.03) & (x["x0"] - last["x0"] > 4)
        short = (last["x1"] - p["left"] < p["width"] * 0.6) & x["text"].rlike(T.CAPITAL_START)
        return (
            F.when(last.isNull() | (x["kind"] != last["kind"]), True)
            .when(x["kind"] != "para", gap > p["gap"] * 2.5 + 1)
            .otherwise(indent | (gap > p["gap"] * 1.8 + 0.5) | short)
        )

    def broken(k: Column, p: Column) -> Column:
        new = F.transform(k, lambda x, i: F.when(F.when(i == 0, True).otherwise(starts(x, F.get(k, i - 1), p)), i))
        first = F.filter(new, lambda i: i.isNotNull())
        return _bound(first, lambda s: F.transform(s, lambda at, j: F.slice(k, at + 1, F.coalesce(F.get(s, j + 1), F.size(k)) - at)))

    kinds = F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["y0"].alias("y0"), x["y1"].alias("y1"), T.heading_level(x["size"], x["text"], body).alias("kind")))
    return F.transform(_bound(kinds, of), lambda part: F.struct(F.get(part, F.lit(0))["kind"].alias("kind"), _folded(part).alias("text"), F.get(part, F.lit(0))["y0"].alias("y0")))


def _folded(parts: Column) -> Column:
    """The texts of parts as one; a hyphen at the end of one is dropped before a lower-case letter."""
    return F.aggregate(
        parts,
        F.lit(""),
        lambda done, p: F.when(done == "", p["text"])
        # only its end is looked at, not all that is joined so far
        .when(F.right(done, F.lit(3)).rlike(T.HYPHEN_END) & p["text"].rlike(T.LOWER_START), F.concat(F.substring(done, F.lit(1), F.length(done) - 1), p["text"]))
        .otherwise(F.concat(done, F.lit(" "), p["text"])),
    )


def _joined(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The texts of a group in order, with its first row's kind and place."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text", "kind", "y0")))
    grouped = rows.groupBy(*group).agg(parts.alias("parts"))
    return grouped.select(*group, F.col("parts")[0]["kind"].alias("kind"), _folded(F.col("parts")).alias("text"), F.col("parts")[0]["y0"].alias("y0"))


def _at_block_ends(rows: DataFrame, value: Column, before: str) -> DataFrame:
    """``rows`` (book, block, page, par_no) with the value of the row before in the book, also over block ends.

    Inside a block its rows tell; for its first row the blocks' last values are
    carried over, a row for each block.
    """
    inside = Window.partitionBy("book", "block").orderBy("page", "par_no")
    over = Window.partitionBy("book").orderBy("block")
    last = rows.groupBy("book", "block").agg(F.max_by(value, F.struct("page", "par_no")).alias("last"))
    carried = last.select(F.col("book").alias("in_book"), F.col("block").alias("in_block"), F.lag("last").over(over).alias("carried"))
    met = rows.join(carried, F.col("book").eqNullSafe(F.col("in_book")) & (F.col("block") == F.col("in_block")))
    first = F.row_number().over(inside) == 1
    return met.withColumn(before, F.when(first, F.col("carried")).otherwise(F.lag(value).over(inside))).drop("in_book", "in_block", "carried")


def _counted_on(rows: DataFrame, new: Column, name: str) -> DataFrame:
    """``rows`` with the number of rows up to theirs in the book for which ``new`` holds: counts of blocks, then of rows."""
    inside = Window.partitionBy("book", "block").orderBy("page", "par_no")
    over = Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("book", "block").agg(F.count_if(new).alias("new"))
    first = counts.select(F.col("book").alias("in_book"), F.col("block").alias("in_block"), F.coalesce(F.sum("new").over(over), F.lit(0)).alias("so_far"))
    met = rows.join(first, F.col("book").eqNullSafe(F.col("in_book")) & (F.col("block") == F.col("in_block")))
    return met.withColumn(name, F.col("so_far") + F.sum(new.cast("int")).over(inside)).drop("in_book", "in_block", "so_far")


def merged_across_pages(pars: DataFrame, pages: int = 64, numbered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """book, flow_no, kind, text: paragraphs that go on over a page end are one, on its first page.

    A paragraph goes on if the one before has no sentence end, it starts in lower
    case, and its page is not the page where the merged one began. Rows that do
    not join keep that page, so a run of candidates joins by comparing with the
    page of the row before the run. Books are taken in blocks of whole pages: a run
    that comes from an earlier block began on another page, so all of it joins, and
    of each block the next needs no more than how its last row ends.

    What joins is found without texts, which then meet their numbers; texts that
    stay alone go no further. Where ``pars`` has keys of pages, of any type,
    ``numbered`` gives rows their page's number as page.
    """
    is_text = F.col("kind") == "para"
    opens = F.coalesce(is_text & ~F.col("text").rlike(T.SENTENCE_END), F.lit(False))
    lower = F.coalesce(is_text & F.col("text").rlike(T.LOWER_START), F.lit(False))
    told = pars.select("book", "page", F.col("page").alias("own_page"), "par_no", opens.alias("opens"), lower.alias("lower"))
    rows = cut(numbered(told) if numbered else told).withColumn("block", F.expr(f"page div {pages}"))
    rows = _at_block_ends(rows, F.col("opens"), "open_before")
    rows = rows.withColumn("goes_on", F.coalesce(F.col("open_before") & F.col("lower"), F.lit(False)))
    inside = Window.partitionBy("book", "block").orderBy("page", "par_no")
    rows = rows.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(inside))
    head = F.min("page").over(Window.partitionBy("book", "block", "run"))
    rows = rows.withColumn("joins", F.col("goes_on") & ((F.col("run") == 0) | (F.col("page") != head)))
    # the last row of a block may go on in the next
    rows = rows.withColumn("alone", ~F.col("joins") & ~F.coalesce(F.lead("joins").over(inside), F.lit(True)))
    rows = _counted_on(rows, ~F.col("joins"), "flow_no")
    placed = rows.select(F.col("book").alias("p_book"), "own_page", F.col("page").alias("p_page"), F.col("par_no").alias("p_par"), (F.col("flow_no") - 1).alias("flow_no"), "alone")
    met = pars.select("book", "page", "par_no", "kind", "text", F.lit(0).alias("y0")).join(placed, F.col("book").eqNullSafe(F.col("p_book")) & (F.col("page") == F.col("own_page")) & (F.col("par_no") == F.col("p_par")))
    several = _joined(met.where(~F.col("alone")).drop("page").withColumnRenamed("p_page", "page"), ["book", "flow_no"], ["page", "par_no"])
    return met.where("alone").select("book", "flow_no", "kind", "text").unionByName(several.drop("y0"))


def segments(flow: DataFrame, pages: int = 64) -> DataFrame:
    """``flow`` with segment (a new one at each h1 after the first row) and unindented, for text after a heading.

    Segments are counted in blocks of whole pages, and blocks added up.
    """
    rows = cut(flow).withColumn("block", F.expr(f"page div {pages}"))
    rows = _at_block_ends(rows, F.col("kind"), "kind_before")
    rows = _counted_on(rows, (F.col("kind") == "h1") & F.col("kind_before").isNotNull(), "segment")
    after = (F.col("kind") == "para") & F.coalesce(F.col("kind_before") != "para", F.lit(False))
    return rows.withColumn("unindented", after).drop("block", "kind_before")


#: Bits that tell which hashes of headings there may be: so many a heading, up to so many in all.
BITS_EACH, HASH_BITS = 64, 1 << 26
#: Hashes of headings up to which all tasks have them; with more they have the bits alone.
SENT_HASHES = 4_000_000
#: A heading on more pages than this has each block its own part of them.
WHOLE_HITS = 64
#: Stands for a page beyond those that a block knows of.
BEYOND = 1 << 62


def _window_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many characters."""
    h = np.zeros(max(len(points) - size + 1, 0), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)]
    return h ^ (h >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _book_salt(book: str | None) -> np.int64:
    return np.frombuffer(hashlib.blake2b((book or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.int64)[0]


def page_texts(pages: DataFrame) -> DataFrame:
    """book, page, body: the text of each page as headings are searched in it."""
    return pages.select("book", "page", F.lower(T.one_spaced(F.concat_ws(" ", F.transform("lines", lambda x: x["text"])))).alias("body"))


def heading_pages(heads: DataFrame, lines: DataFrame, cut_at: int = 40, probe: int = 12, pages: int = 64, reach: int = 64) -> DataFrame:
    """book, page, par_no, found: each heading's page, searched from the page of the heading before.

    ``heads`` has book, page, par_no and text; ``lines`` are rows of lines, or
    ``page_texts``. A page holds a heading if its lines in one space hold the first
    ``cut_at`` characters of it anywhere, whatever their case. A heading not found,
    or without text, has the page where its search began.

    Pages meet headings by hashes of all their windows of the length of a heading's
    first ``probe`` characters, and what follows a window tells whether the heading
    stands there. What a block of headings does to the page where its search begins
    is a step function of the pages where its headings are; a scan through the
    blocks tells where each begins, and then each finds its own.

    A search has passed the first page of each heading before, found or not: so no
    block begins before the greatest of those pages, and needs none before it. At
    first it has the pages up to ``reach`` behind its end. Where a search would go
    on behind these, more are taken, and the scan is done again.
    """
    key = F.left(F.lower(T.one_spaced(F.col("text"))), F.lit(cut_at))
    named = cut(heads.select("book", F.col("page").cast("long").alias("page"), F.col("par_no").cast("long").alias("par_no"), key.alias("needle"), F.expr(f"page div {pages}").cast("long").alias("block")))
    needles = named.where("needle <> ''").select("book", "needle").distinct()
    kept = F.least(F.length("needle"), F.lit(probe))
    sizes = sorted(r[0] for r in needles.select(kept).distinct().collect())  # probe different ones at most

    def hash_needles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [int(_window_hashes(_points(t[:probe]), min(len(t), probe))[0].astype(np.int64) ^ _book_salt(b)) for b, t in zip(frame["book"], frame["needle"], strict=True)]
            yield frame.assign(size=[min(len(t), probe) for t in frame["needle"]], hash=np.array(found, np.int64))

    hashed = cut(needles.mapInPandas(hash_needles, "book string, needle string, size int, hash long"))
    n_hashes = hashed.count()
    bits = 1 << min(max(n_hashes * BITS_EACH, 1 << 12) - 1, HASH_BITS - 1).bit_length()
    slot = F.expr(f"hash & {bits - 1}L")
    words = hashed.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()  # HASH_BITS / 64 rows at most
    known = np.zeros(max(bits // 64, 1), np.int64)
    known[np.asarray(words["word"])] = np.asarray(words["bits"])
    every = np.sort(np.asarray(hashed.select("hash").distinct().toArrow()["hash"])) if n_hashes <= SENT_HASHES else None

    def hash_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for book, page, body in zip(frame["book"], frame["page"], frame["body"], strict=True):
                if book is None:
                    continue
                points, salt = _points(body), _book_salt(book)
                for size in sizes:
                    h = _window_hashes(points, size).astype(np.int64) ^ salt
                    place = h & (bits - 1)
                    at = np.flatnonzero((known[place >> 6] >> (place & 63)) & 1)
                    if every is not None and len(at):
                        at = at[every[np.minimum(np.searchsorted(every, h[at]), len(every) - 1)] == h[at]]
                    length = cut_at if size == probe else size
                    out += [(book, page, size, k, near) for k, near in {(int(h[i]), body[i : i + length]) for i in at.tolist()}]
            yield pd.DataFrame(out, columns=["book", "page", "size", "hash", "near"])

    texts = lines if "body" in lines.columns else page_texts(lines.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines")))
    met = texts.select("book", F.col("page").cast("long").alias("page"), "body").mapInPandas(hash_pages, "book string, page long, size int, hash long, near string")
    met = met.join(maybe_sent(hashed), ["book", "size", "hash"]).where(F.startswith("near", "needle"))
    places = cut(met.groupBy("book", "needle").agg(F.array_sort(F.collect_set("page")).alias("hits")))

    asked = named.select("book", "block", "needle").distinct()
    firsts = asked.join(places.select("book", "needle", F.col("hits")[0].alias("first")), ["book", "needle"], "left").groupBy("book", "block").agg(F.max("first").alias("first"))
    before = Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lows = firsts.select("book", "block", F.coalesce(F.max("first").over(before), F.lit(0)).alias("low"))
    few = asked.join(places.where(F.size("hits") <= WHOLE_HITS), ["book", "needle"]).select("book", "block", "needle", "hits")
    many = places.where(F.size("hits") > WHOLE_HITS)
    asking = cut(asked.join(many.select("book", "needle"), ["book", "needle"]).join(lows, ["book", "block"]).select("book", "block", "needle", "low"))

    def parts_of(reach: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            hits = np.asarray(found["hits"].iloc[0], np.int64)
            low = np.searchsorted(hits, blocks["low"].to_numpy(np.int64))
            high = np.searchsorted(hits, (blocks["block"].to_numpy(np.int64) + 1) * pages + reach)
            own = [[*hits[i:j].tolist(), *([BEYOND] if j < len(hits) else [])] for i, j in zip(low, high, strict=True)]
            return blocks.assign(hits=own)[["book", "block", "needle", "hits"]]

        return run

    def own_hits(part: pd.DataFrame) -> dict[str, np.ndarray]:
        return {n: np.asarray(h, np.int64) for n, h in zip(part["of_needle"], part["hits"], strict=True)}

    def summarise(key: tuple, heads: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """For each page where a heading of the block is: the page where a search ends that begins there, or after the one before."""
        hits = own_hits(found)
        ends = np.unique(np.concatenate([*hits.values(), np.empty(0, np.int64)]))
        values, moved = ends.copy(), np.zeros(len(ends), bool)
        for needle in heads.sort_values(["page", "par_no"])["needle"] if hits else ():
            if needle in hits:
                at = np.searchsorted(hits[needle], values)
                some = at < len(hits[needle])
                values[some], moved[some] = hits[needle][at[some]], True
        values = np.where(moved, values, -1)
        last = np.append(values[1:] != values[:-1], True)[: len(values)]
        return pd.DataFrame({"book": [key[0]], "block": [key[1]], "ends": [ends[last].tolist()], "values": [values[last].tolist()]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = object(), 0
        for frame in frames:
            out = []
            for book, block, ends, values in frame.itertuples(index=False, name=None):
                if book != last:
                    last, at = book, 0
                begins = at
                place = int(np.searchsorted(np.asarray(ends, np.int64), at))
                if place < len(ends) and values[place] >= 0:
                    at = int(values[place])
                out.append((book, block, begins, at))
            yield pd.DataFrame(out, columns=["book", "block", "begins", "after"])

    def find(key: tuple, heads: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        hits, out = own_hits(found), []
        heads = heads.sort_values(["page", "par_no"])
        at = int(heads["begins"].iloc[0]) if len(heads) else 0
        for needle in heads["needle"]:
            place = int(np.searchsorted(hits[needle], at)) if needle in hits else 0
            at = int(hits[needle][place]) if needle in hits and place < len(hits[needle]) else at
            out.append(at)
        return heads.assign(found=out)[["book", "page", "par_no", "found"]]

    while True:
        parts = asking.groupBy("book", "needle").cogroup(many.groupBy("book", "needle")).applyInPandas(parts_of(reach), "book string, block long, needle string, hits array<long>")
        of_block = cut(few.unionByName(parts)).toDF("of_book", "of_block", "of_needle", "hits")
        grouped = of_block.groupBy("of_book", "of_block")
        steps = named.groupBy("book", "block").cogroup(grouped).applyInPandas(summarise, "book string, block long, ends array<long>, values array<long>")
        begins = cut(steps.repartition("book").sortWithinPartitions("book", "block").mapInPandas(scan, "book string, block long, begins long, after long"))
        if begins.where(f"after >= {BEYOND}L").isEmpty():
            break
        reach *= 64
    entered = named.join(begins.drop("after"), ["book", "block"])
    return entered.groupBy("book", "block").cogroup(grouped).applyInPandas(find, "book string, page long, par_no long, found long")


def line_pitch(lines: DataFrame, default: float = 1.15) -> DataFrame:
    """book, page, pitch: distance of neighbouring lines over their height, within 1.05 and 2."""
    n = F.count("*")
    pitch = (F.max("y0") - F.min("y0")) / (n - 1) / F.avg(F.col("y1") - F.col("y0"))
    return lines.groupBy("book", "page").agg(F.when(n > 1, F.greatest(F.lit(1.05), F.least(F.lit(2.0), pitch))).otherwise(default).alias("pitch"))


def ink_boxes(pixels: DataFrame, boxes: DataFrame, near: int = 48, least: int = 25, grown: float = 4.0) -> DataFrame:
    """block, x0, y0, x1, y1: each box drawn close around the pixels of its text's colour.

    ``pixels`` has image, x, y, r, g, b; ``boxes`` has block, image, the box, the
    image's width and height, and the colour as t_r, t_g, t_b. Pixels are searched
    in a window around the box, half its width (6 at least) to each side and 0.35
    of its height (6 at least) up and down; ink is what differs from the colour by
    ``near`` at most in grey. The box stays where its window is under 4 across or
    down, where there are under ``least`` points of ink, where the ink is beside
    it, or where its area would be more than ``grown`` times as large.
    """
    across, down = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    aside, above = F.greatest(F.lit(6.0), across * 0.5), F.greatest(F.lit(6.0), down * 0.35)
    low = lambda c: F.greatest(F.lit(0), c.cast("int"))
    seen = boxes.withColumns({"s_x0": low(F.col("x0") - aside), "s_y0": low(F.col("y0") - above), "s_x1": F.least("width", (F.col("x1") + aside).cast("int")), "s_y1": F.least("height", (F.col("y1") + above).cast("int"))})
    searched = seen.where("s_x1 - s_x0 >= 4 and s_y1 - s_y0 >= 4")
    # the grey of a difference in whole numbers, by the same weights in thousandths and rounded down
    grey = F.floor((F.abs(F.col("r") - F.col("t_r")) * 299 + F.abs(F.col("g") - F.col("t_g")) * 587 + F.abs(F.col("b") - F.col("t_b")) * 114) / 1000)
    inside = (F.col("x") >= F.col("s_x0")) & (F.col("x") < F.col("s_x1")) & (F.col("y") >= F.col("s_y0")) & (F.col("y") < F.col("s_y1"))
    ink = pixels.join(searched, "image").where(inside & (grey <= near))
    tight = ink.groupBy("block").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("rt"), (F.max("y") + 1).alias("bt"), F.count("*").alias("n"))
    beside = (F.col("rt") <= F.col("x0")) | (F.col("l") >= F.col("x1")) | (F.col("bt") <= F.col("y0")) | (F.col("t") >= F.col("y1"))
    area = F.greatest(across * down, F.lit(1))
    good = (F.col("n") >= least) & ~beside & ((F.col("rt") - F.col("l")) * (F.col("bt") - F.col("t")) <= grown * area)
    ends = [F.when(good, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("l", "x0"), ("t", "y0"), ("rt", "x1"), ("bt", "y1"))]
    return boxes.join(tight, "block", "left").select("block", *ends)
