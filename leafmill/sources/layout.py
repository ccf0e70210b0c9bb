"""Books, pages, lines and boxes as views of the documents table.

A book is a source, a page a document, a line a part between newlines. The data
has no coordinates, so a line's place follows from its number and length. Ranks
are found in two steps, in blocks of bounded size, so a book of any length
never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.sources.checkpoints import cut

BLOCK = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranked(df: DataFrame, group: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in its group.

    ``block`` is a column that never falls in the row order. Counts per block give
    each block's first rank; only the rows of one block are sorted together.
    """
    counts = df.groupBy(*group, block).agg(F.count("*").alias("block_rows"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(g).alias(f"first_{g}") for g in group], F.col(block).alias("first_block"), F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("first_rank"))
    on = [F.col(g).eqNullSafe(F.col(f"first_{g}")) for g in group] + [F.col(block).eqNullSafe(F.col("first_block"))]
    within = Window.partitionBy(*group, block).orderBy(*order)
    joined = df.join(first, on).withColumn(name, F.col("first_rank") + F.row_number().over(within) - 1)
    return joined.drop("first_block", "first_rank", *[f"first_{g}" for g in group])


def id_block(rows: DataFrame, column: str, each: int = BLOCK) -> Column:
    """A number that never falls with a whole-number column: blocks of about ``each`` rows, however sparse the ids are.

    It takes one pass over the column, for its least, its greatest and its count.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return F.lit(0).cast("long")
    width = max((high - low) * each // n, 1)
    # beyond that the difference itself would not fit
    return F.expr(f"(`{column}` - ({low}L)) div {width}L") if high - low < 1 << 62 else F.expr(f"shiftright(`{column}`, {width.bit_length() - 1})")


def book_pages(documents: DataFrame) -> DataFrame:
    """book, page, doc_id, text."""
    rows = documents.select(F.col("source").alias("book"), "doc_id", "text", id_block(documents, "doc_id").alias("block"))
    return ranked(rows, ["book"], "block", ["doc_id"], "page").select("book", F.col("page").cast("int").alias("page"), "doc_id", "text")


def _type_size(length: Column, number: Column) -> Column:
    return (
        F.when((length <= 24) & (number == 0), 24.0)
        .when((length <= 30) & (number % 5 == 0), 18.0)
        .when((length <= 30) & (number % 5 == 1), 15.0)
        .otherwise(11.5)
    )


def _page_height(n: Column) -> Column:
    return F.greatest(F.lit(595), 60 + 14 * n).cast("double")


def _placed(number: Column, text: Column, x0: Column, size: Column) -> dict[str, Column]:
    """A line's number, text, place and size."""
    return {"line_no": number, "text": text, "x0": x0, "x1": F.least(F.lit(356.0), x0 + 5 * F.length(text)), "y0": (30 + 14 * number).cast("double"), "y1": (42 + 14 * number).cast("double"), "size": size}


def _indented(number: Column) -> Column:
    return (52 + F.when(number % 3 == 2, 18).otherwise(0)).cast("double")


def _fields(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def lines(documents: DataFrame) -> DataFrame:
    """book, page, line_no, text, x0, x1, y0, y1, size, page_h: one row per line that is not blank."""
    split = F.split("text", "\n")
    rows = book_pages(documents).select("book", "page", F.size(split).alias("n"), F.posexplode(split).alias("line_no", "raw"))
    rows = rows.withColumn("text", strip(F.col("raw"))).where("length(text) > 0")
    number = F.col("line_no")
    placed = _placed(number, F.col("text"), _indented(number), _type_size(F.length("text"), number))
    return rows.select("book", "page", *_fields(placed), _page_height(F.col("n")).alias("page_h"))


#: Pages of documents set anew are numbered so far apart.
PAGES_OF_A_DOCUMENT = 10_000_000


def document_pages(documents: DataFrame) -> DataFrame:
    """book, page, page_h, lines: the lines of a document in its row, in order; its page is its doc_id.

    No text leaves its task. ``page_numbers`` says which page of its book a document is.
    """
    rows = documents.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("raw"))
    kept = F.filter(F.transform("raw", lambda t, i: F.struct(i.alias("n"), strip(t).alias("t"))), lambda x: F.length(x["t"]) > 0)
    placed = F.transform(kept, lambda x: F.struct(*_fields(_placed(x["n"], x["t"], _indented(x["n"]), _type_size(F.length(x["t"]), x["n"])))))
    return rows.select("book", "page", _page_height(F.size("raw")).alias("page_h"), placed.alias("lines"))


def set_pages(documents: DataFrame, words: int = 10, per_page: int = 30) -> DataFrame:
    """The columns of ``document_pages`` for documents set anew: ``words`` words to a line, ``per_page`` lines to a page.

    Pages of a document follow each other in its book, so texts go on over page
    ends, as they do in a book. A page is a struct of doc (the doc_id) and part.
    """
    every = F.filter(F.split("text", r"[ \t\n\x0b\x0c\r]+"), lambda w: w != "")
    rows = documents.select(F.col("source").alias("book"), F.col("doc_id").alias("doc"), every.alias("w")).where("size(w) > 0")
    parts = F.sequence(F.lit(0), F.expr(f"(size(w) - 1) div {words * per_page}").cast("int"))
    cut_out = F.transform(parts, lambda k: F.slice("w", k * (words * per_page) + 1, words * per_page))
    rows = rows.select("book", "doc", F.posexplode(cut_out).alias("part", "w"))
    starts = F.sequence(F.lit(0), F.expr(f"cast((size(w) - 1) div {words} as int)"))
    text = lambda k: F.array_join(F.slice("w", k * words + 1, words), " ")
    named = F.transform(starts, lambda k: F.struct(k.alias("n"), text(k).alias("t")))
    placed = F.transform(named, lambda x: F.struct(*_fields(_placed(x["n"], x["t"], F.lit(52.0), F.lit(11.5)))))
    return rows.select("book", F.struct("doc", F.col("part").cast("long").alias("part")).alias("page"), F.lit(60.0 + 14 * per_page).alias("page_h"), placed.alias("lines"))


def page_numbers(documents: DataFrame) -> DataFrame:
    """book, doc_id, page: which page of its book each document is. Only ids are sorted, no texts."""
    rows = documents.select(F.col("source").alias("book"), "doc_id", id_block(documents, "doc_id").alias("block"))
    return ranked(rows, ["book"], "block", ["doc_id"], "page").select("book", "doc_id", F.col("page").cast("int").alias("page"))


def numbered_apart(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, and their page numbers apart; where ids repeat or are missing, pages take their place as doc_id."""
    numbers = cut(page_numbers(documents))
    if numbers.groupBy("book", "doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return documents, numbers
    texts = cut(book_pages(documents).select(F.col("book").alias("source"), F.col("page").cast("long").alias("doc_id"), "text"))
    return texts, cut(texts.select(F.col("source").alias("book"), "doc_id", F.col("doc_id").cast("int").alias("page")))


def with_numbers(rows: DataFrame, numbers: DataFrame, doc: Column | str = "page") -> DataFrame:
    """``rows`` whose ``doc`` is a doc_id, with its page number as page; a row's other columns should be few."""
    n = numbers.select(F.col("book").alias("n_book"), F.col("doc_id").alias("n_doc"), F.col("page").alias("n_page"))
    doc = F.col(doc) if isinstance(doc, str) else doc
    return rows.join(n, F.col("book").eqNullSafe(F.col("n_book")) & (doc == F.col("n_doc")), "left").withColumn("page", F.col("n_page")).drop("n_book", "n_doc", "n_page")


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` of lines with a dense global id in the order of book, page and line."""
    keyed = rows.withColumn("block", F.expr("page div 64"))
    books = rows.groupBy("book").agg(F.count("*").alias("n"))
    # one row per book: the ids before each
    before = Window.partitionBy().orderBy(F.col("book").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = books.select(F.col("book").alias("first_book"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))
    placed = ranked(keyed, ["book"], "block", ["page", "line_no"], "in_book")
    joined = placed.join(first, F.col("book").eqNullSafe(F.col("first_book")))
    return joined.withColumn("id", F.col("first_id") + F.col("in_book")).drop("first_book", "first_id", "in_book", "block")


def boxes(rows: DataFrame) -> DataFrame:
    """Lines with ids; image: every seventh line from the fourth, 40 points wider on each side."""
    image = F.col("line_no") % 7 == 3
    wide = F.when(image, 40.0).otherwise(0.0)
    return with_ids(rows).withColumn("image", image).withColumn("x0", F.col("x0") - wide).withColumn("x1", F.col("x1") + wide)


def within_size(files: DataFrame, limit: int, column: str = "length") -> DataFrame:
    """Files with the verdict of an upload guard: by the announced size with some room, then by the real one."""
    size = F.col(column)
    return files.withColumn("verdict", F.when(size > limit * 1.05, "rejected early").when(size > limit, "rejected").otherwise("accepted"))


def binary_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """path, length, content of files up to the limit; larger ones are never read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= limit).select("path", "length", "content")
