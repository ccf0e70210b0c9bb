"""Queries by name: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import batching, clusters, jobs, matching, quality, reflow
from leafmill.plans import inputs as I
from leafmill.plans import literals as L
from leafmill.sources import checkpoints, layout
from leafmill.sources.layout import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.lines(table(spark, folder, "documents"))


def clean_lines(spark: SparkSession, folder: str, fraction: float = 0.02) -> DataFrame:
    rows = lines(spark, folder)
    return reflow.without_artifacts(rows, reflow.body_size(rows), reflow.repeated_headers(rows, fraction))


def flow(spark: SparkSession, folder: str, *told: Column) -> DataFrame:
    """book, page, par_no, kind and what is ``told`` of text and y0: headings and paragraphs of each book, without its cover, title and contents pages."""
    docs, numbers = layout.numbered_apart(table(spark, folder, "documents"))
    return flow_of_documents(docs, numbers, *told)


def flow_of_documents(docs: DataFrame, numbers: DataFrame, *told: Column) -> DataFrame:
    """Only what is told of a paragraph is sent to meet its page's number."""
    covers = docs.groupBy(F.col("source").alias("book")).agg(F.min("doc_id").alias("cover"))
    pars = reflow.flow_pages(layout.document_pages(docs), covers)
    return layout.with_numbers(pars.select("book", "page", "par_no", "kind", *told), numbers)


def flow_of(rows: DataFrame, fraction: float = 0.02) -> DataFrame:
    """The flow of lines as rows."""
    return reflow.flow_pages(reflow.pages_of(rows), fraction=fraction)


@query
def p02_global_ids(spark: SparkSession, folder: str) -> DataFrame:
    return layout.with_ids(lines(spark, folder)).select("book", "page", "line_no", F.col("id").cast("long").alias("id"))


@query
def p05_translatable(spark: SparkSession, folder: str) -> DataFrame:
    texts = L.frame(spark, L.TEXTS).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = table(spark, folder, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return texts.unionByName(docs).select("id", T.has_letter(F.col("text")).alias("is_real"))


@query
def p11_garble_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).where(F.length("text") >= 4)
    return rows.where(T.looks_garbled(F.col("text"))).select("book", "page", "line_no")


@query
def p11_garble_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return L.frame(spark, L.TEXTS).select("id", T.looks_garbled(F.col("text")).alias("verdict"))


@query
def p12_suspect_lines(spark: SparkSession, folder: str) -> DataFrame:
    texts = L.frame(spark, L.TEXTS).select(F.lit("literal").alias("book"), F.lit(0).alias("page"), F.col("id").alias("line_no"), "text")
    rows = texts.unionByName(lines(spark, folder).select("book", "page", "line_no", "text"))
    return rows.select("book", "page", "line_no", T.suspect_garble(F.col("text")).alias("verdict")).where("verdict")


@query
def p13_scanned_books(spark: SparkSession, folder: str) -> DataFrame:
    pages = lines(spark, folder).groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars"))
    return quality.scanned_books(pages, per_page=2400)


@query
def p15_toc_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.frame(spark, L.TOC).unionByName(lines(spark, folder).select("book", "page", "line_no", "text"))
    return reflow.toc_pages(rows)


@query
def p16_artifacts_removed(spark: SparkSession, folder: str) -> DataFrame:
    return clean_lines(spark, folder).select("book", "page", "line_no")


@query
def p19_heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    body = reflow.body_size(rows).withColumnRenamed("book", "body_book")
    placed = rows.join(body, F.col("book").eqNullSafe(F.col("body_book")))
    kinds = placed.select("book", T.heading_level(F.col("size"), F.col("text"), F.col("body")).alias("kind")).groupBy("book", "kind").agg(F.count("*").alias("n"))
    known = L.frame(spark, L.HEADINGS).select(F.concat(F.lit("literal "), F.col("id").cast("string")).alias("book"), T.heading_level(F.col("size"), F.col("text"), F.lit(11.5)).alias("kind"), F.lit(1).cast("long").alias("n"))
    return kinds.unionByName(known)


@query
def p20_placement(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    bodies = quality.page_bodies(rows)
    placed = rows.join(bodies, ["book", "page"])
    head = (F.col("size") >= F.col("body") * 1.4) & (F.length("text") <= 55)
    size = F.when(head, F.least("size", F.col("body") * F.lit(2.2))).otherwise(F.col("body").cast("double"))
    return placed.select("book", "page", "line_no", head.alias("is_head"), size.alias("place_size"))


@query
def p21_skip_pages(spark: SparkSession, folder: str) -> DataFrame:
    return reflow.skip_pages(lines(spark, folder))


@query
def p23_status_projection(spark: SparkSession, folder: str) -> DataFrame:
    shown = jobs.public_status(I.frame(spark, folder, I.JOBS).select("job_id", "status", "progress", "name", "file_hash", "path", "error"))
    return shown.withColumn("error", T.mask_keys(F.col("error")))


@query
def p25_bit_unpack(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.frame(spark, folder, I.COLOURS)
    part = lambda n: F.shiftright("colour", n).bitwiseAND(255)
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    channels = T.hex_channels(F.col("hex"))
    return rows.select("id", part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"), (has(16) | (F.col("size") >= 15)).alias("bold"), has(2).alias("italic"), has(4).alias("serif"), F.round(T.luminance(part(16), part(8), part(0)), 6).alias("luminance"), channels["red"].alias("hex_red"), channels["blue"].alias("hex_blue"))


@query
def p08_need_set(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(~T.has_letter(F.col("text")), "unchanged").when(T.looks_garbled(F.col("text")), "dropped")
    # a digest stands for a text's key
    pars = checkpoints.cut(flow(spark, folder, state.alias("state"), F.unhex(F.sha2(T.cache_key(F.col("text")).cast("binary"), 256)).alias("key")))
    cached = pars.where("page % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return pars.join(cached, "key", "left").select("book", "page", "par_no", F.coalesce("state", F.when(F.col("hit"), "cached").otherwise("needed")).alias("state"))


@query
def p10_length_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.frame(spark, folder, I.GLOSSARY)
    return rows.select("ord", "term", (F.length("term").between(2, 60) & F.length("value").between(1, 80)).alias("kept"))


@query
def p24_job_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.frame(spark, folder, I.JOBS)
    active = rows.select(F.count_if(F.col("status").isin(*jobs.ACTIVE)).alias("active"))
    key = F.coalesce(T.blank_as_null(F.col("fixed_key")), T.blank_as_null(F.col("slot_key")), F.lit("none"))
    return rows.crossJoin(F.broadcast(active)).select("job_id", "status", "progress", "name", "active", key.alias("resolved"))


@query
def j01_translation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.with_ids(lines(spark, folder)).select(F.col("id").cast("long").alias("id"), F.col("text").alias("source"))
    found = rows.where("id % 3 <> 1").select("id", F.when(F.expr("id % 3 = 2"), "  ").otherwise(F.lower("source")).alias("target"))
    return matching.lookup(rows, found, "id", "target", F.col("source")).select("id", "target")


@query
def j03_zip_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("items"))
    values = F.transform("items", lambda x: F.length(x["text"]))
    return rows.select("book", "page", F.explode(F.arrays_zip(F.col("items.line_no").alias("line_no"), values.alias("value"))).alias("z")).select("book", "page", "z.line_no", "z.value")


@query
def j04_checkpoint_anti(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return matching.unfinished(table(spark, folder, "documents").select("doc_id"), done, "doc_id")


@query
def j05_cache_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """The last document of each key answers for the others; texts without a key have no answer."""
    key = F.nullif(T.cache_key(F.col("text")), F.lit(""))
    rows = table(spark, folder, "documents").select("doc_id", F.md5(key.cast("binary")).alias("key"))
    cached = rows.where("length(key) > 0").groupBy("key").agg(F.max("doc_id").alias("reused_from"))
    return rows.join(cached, "key").where("reused_from <> doc_id").select("doc_id", "reused_from")


@query
def j06_glossary_merge(spark: SparkSession, folder: str) -> DataFrame:
    first = I.frame(spark, folder, I.GLOSSARY).where("length(value) > 0").groupBy("term").agg(F.min_by("value", "ord").alias("value"))
    pins = L.frame(spark, L.PINS).select("term", F.col("term").alias("pin"))
    return first.join(pins, "term", "full").select("term", F.coalesce("value", "pin").alias("value"))


@query
def j07_active_job_semi(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.active_duplicates(I.frame(spark, folder, I.SUBMITS), I.frame(spark, folder, I.JOBS).select("job_id", "status", "file_hash", "layout"))


@query
def t07_duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "hash").where("doc_id <> first_doc").select("doc_id", "first_doc")


@query
def j08_box_over_box(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.boxes(lines(spark, folder)).withColumn("y1", F.when(F.col("image"), F.col("y1") + 20).otherwise(F.col("y1")))
    return matching.covered_boxes(rows).select("book", "page", F.col("id").cast("long").alias("id"), F.col("image_id").cast("long").alias("image_id"))


@query
def j09_next_block_floor(spark: SparkSession, folder: str) -> DataFrame:
    return matching.floors(layout.boxes(lines(spark, folder))).withColumn("id", F.col("id").cast("long"))


@query
def j10_box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.boxes(lines(spark, folder)).withColumn("y1", F.col("y1") + F.when(F.col("image"), 9.0).otherwise(0.0))
    found = matching.overlaps(rows)
    return found.select("book", "page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "area")


@query
def j11_fuzzy_words(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    split = part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("k", "word"))
    words = split.groupBy("word").agg(F.min(F.col("p_partkey") * 100 + F.col("k")).alias("ord"))
    typo = F.concat(F.substring("word", 1, 2), F.lit("q"), F.expr("substring(word, 4)"))
    tokens = words.select(F.when(F.expr("ord % 2 = 0"), typo).otherwise(F.upper("word")).alias("token")).distinct()
    return matching.nearest_words(tokens, words).select("token", "fixed", (F.lower("fixed") != F.lower("token")).alias("changed"))


@query
def j12_fuzzy_titles(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_name").alias("orig"), F.concat(F.lit("<"), F.col("n_name"), F.lit(">")).alias("value"), F.col("n_nationkey").alias("ord"))
    names = nation.select(F.concat(F.substring("orig", 1, 3), F.lit("x"), F.expr("substring(orig, 4)")).alias("name")).union(nation.select(F.lower("orig"))).union(nation.select(F.concat(F.lit("  "), F.col("orig"), F.lit(" z"))))
    return matching.first_matches(names.distinct(), nation)


@query
def j13_image_placement(spark: SparkSession, folder: str) -> DataFrame:
    rows = checkpoints.cut(lines(spark, folder))
    images = layout.boxes(rows).where("image").select("book", "page", F.col("id").cast("long").alias("image_id"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return matching.image_anchors(images, flow_of(rows)).withColumn("anchor", F.col("anchor").cast("long"))


@query
def j17_adjacent_gap(spark: SparkSession, folder: str) -> DataFrame:
    return reflow.median_gaps(lines(spark, folder))


@query
def a03_words_to_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    words = rows.select("book", "page", F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), F.col("line_no").alias("line_num"), F.posexplode(F.split("text", " ")).alias("ord", "text"), "x0", "y0")
    conf = F.when(F.expr("ord % 7 = 6"), "low").when(F.expr("ord % 5 = 4"), "12.5").otherwise("90")
    placed = words.withColumns({"conf": conf, "left": F.col("x0") + 10 * F.col("ord"), "top": F.col("y0") - F.expr("ord % 2"), "width": F.lit(9.0), "height": F.lit(12.0)})
    return quality.words_to_lines(placed, zoom=2.0)


@query
def a05_body_size(spark: SparkSession, folder: str) -> DataFrame:
    return reflow.body_size(lines(spark, folder))


@query
def a06_repeated_headers(spark: SparkSession, folder: str) -> DataFrame:
    return reflow.repeated_headers(lines(spark, folder), 0.02)


@query
def a07_argmax_span(spark: SparkSession, folder: str) -> DataFrame:
    spans = I.frame(spark, folder, I.SPANS).where("kind = 0 and length(trim(text)) > 0")
    best = spans.groupBy("block").agg(F.max(F.struct("size", (-F.col("ord")).alias("back"), "text")).alias("best"))
    return best.select("block", F.col("best.text").alias("winner"), F.col("best.size").alias("size"))


@query
def a09_colour_mode(spark: SparkSession, folder: str) -> DataFrame:
    step = lambda c: F.expr(f"{c} div 12 * 12").cast("int").alias(c)
    rows = I.frame(spark, folder, I.PIXELS).select("id", step("r"), step("g"), step("b"), "n").groupBy("id", "r", "g", "b").agg(F.sum("n").alias("n"))
    shares = rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("id")), 6))
    top = shares.withColumn("place", matching.window_rank(rows, ["id"], F.desc("n"), "r", "g", "b")).where("place = 1")
    plus = lambda c: F.least(F.lit(255), F.col(c) + 6).alias(c)
    return top.select("id", plus("r"), plus("g"), plus("b"), "share")


@query
def a11_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = layout.boxes(lines(spark, folder))
    return rows.groupBy("book", "page").agg(F.round(F.sum(F.col("size") * area) / F.sum(area), 6).alias("mean_size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query
def a13_distinct_ci(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", r"[^\p{L}]+")).alias("k", "word")).where("length(word) between 2 and 70")
    return quality.first_casings(docs.select(F.struct("doc_id", "k").alias("ord"), "word"))


@query
def a15_abbreviations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text").union(L.frame(spark, L.TEXTS).select("text"))
    return quality.abbreviations(docs)


@query
def a16_quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(lines(spark, folder), threshold=0.2, per_page=1)


@query
def a22_title_guess(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    toc = reflow.toc_pages(rows).where("not is_toc").select("book", "page")
    pages = rows.where("page > 0").groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars")).where("chars >= 15").join(toc, ["book", "page"])
    return quality.title_lines(rows, pages.groupBy("book").agg(F.min("page").alias("page")))


@query
def a24_cover_title_author(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    return quality.title_lines(rows, rows.where("page = 0").select("book", "page").distinct(), titles=1, authors=1)


@query
def w02_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder, F.md5("text").alias("text_md5"), F.col("y0")).select("book", "page", "par_no", "kind", "text_md5", "y0")


@query
def w03_cross_page(spark: SparkSession, folder: str) -> DataFrame:
    """Over documents set in lines of ten words and pages of thirty lines, so that paragraphs go on over page ends."""
    docs, numbers = layout.numbered_apart(table(spark, folder, "documents"))
    covers = docs.groupBy(F.col("source").alias("book")).agg(F.struct(F.min("doc_id").alias("doc"), F.lit(0).cast("long").alias("part")).alias("cover"))
    known = L.frame(spark, L.FLOW).withColumn("page", F.struct(F.col("page").cast("long").alias("doc"), F.lit(-1).cast("long").alias("part"))).withColumn("par_no", F.col("par_no").cast("long"))

    def numbered(rows: DataFrame) -> DataFrame:
        """Literal rows, of no part, have their page's number as doc."""
        doc, part = F.col("own_page")["doc"], F.col("own_page")["part"]
        placed = layout.with_numbers(rows, numbers, doc)
        return placed.withColumn("page", F.when(part < 0, doc).otherwise(F.col("page") * F.lit(layout.PAGES_OF_A_DOCUMENT).cast("long") + part))

    merged = reflow.merged_across_pages(reflow.flow_pages(layout.set_pages(docs), covers).unionByName(known), numbered=numbered)
    return merged.select("book", F.col("flow_no").cast("long").alias("flow_no"), "kind", F.md5("text").alias("text_md5"))


@query
def w04_runs(spark: SparkSession, folder: str) -> DataFrame:
    return batching.runs(I.frame(spark, folder, I.MASK), "block", "y", "v")


@query
def w05_batches(spark: SparkSession, folder: str) -> DataFrame:
    return batching.greedy_batches(table(spark, folder, "documents"), "source", "doc_id", "n_chars")


@query
def w06_systematic_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.with_ids(lines(spark, folder))
    first = rows.groupBy("book").agg(F.min("id").alias("first_id")).withColumnRenamed("book", "first_book")
    numbered = rows.join(first, F.col("book").eqNullSafe(F.col("first_book"))).withColumn("number", F.col("id") - F.col("first_id"))
    return batching.systematic_sample(numbered, "book", "number", F.col("text"), budget=3000).select("book", F.col("number").cast("long").alias("number"))


@query
def w07_greedy_wrap(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return names.select("p_partkey", F.posexplode(batching.wrapped(F.col("text"), 16)).alias("line_no", "text"))


@query
def w08_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = reflow.segments(flow(spark, folder))
    return rows.select("book", "page", F.col("par_no").cast("long").alias("par_no"), F.col("segment").cast("long").alias("segment"), "unindented")


@query
def w12_page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return batching.page_chunks(lines(spark, folder)).withColumn("chunk", F.col("chunk").cast("long"))


@query
def f06_token_split(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    rows = lines(spark, folder).select("book", "page", "line_no", F.posexplode(tokens).alias("k", "token"))
    return rows.select("book", "page", "line_no", "k", F.btrim("token", F.lit(T.TOKEN_EDGE)).alias("core"), F.col("token").rlike(r"^[\p{L}\p{N}_]").alias("is_word"))


@query
def f11_html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"), F.length(T.escape_html(F.col("html"))).cast("long").alias("n"))


@query
def f12_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\nbye"))
    found = F.regexp_extract(noisy, r"(?s)\{.*\}", 0)
    return table(spark, folder, "events").select("event_id", F.coalesce(F.nullif(found, F.lit("")), F.lit("{}")).alias("object"))


@query
def f13_cover_json(spark: SparkSession, folder: str) -> DataFrame:
    item = "array<struct<text:string,bbox_pct:array<double>,color:string,role:string>>"
    items = F.from_json(F.regexp_extract("raw", r"(?s)\[.*\]", 0), item)
    rows = I.frame(spark, folder, I.COVERS).select("id", F.posexplode(items).alias("k", "x")).where("length(trim(x.text)) >= 2")
    value = lambda i: F.col("x.bbox_pct")[i]
    pixels = F.greatest(value(0), value(1), value(2), value(3)) > 100
    part = lambda i, whole: F.when(pixels, value(i) / whole * 100.0).otherwise(value(i))
    rows = rows.select("id", "k", F.trim("x.text").alias("text"), part(0, 800.0).alias("x"), part(1, 600.0).alias("y"), part(2, 800.0).alias("w"), part(3, 600.0).alias("h"), F.lower(F.coalesce("x.role", F.lit("other"))).alias("role"), T.hex_channels(F.coalesce("x.color", F.lit("#000000"))).alias("colour"))
    good = rows.where("x >= 0 and x < 100 and y >= 0 and y < 100 and w > 0 and h > 0 and colour is not null")
    role = F.when(F.col("role").isin("title", "subtitle", "author"), F.col("role")).otherwise("other")
    return good.select("id", F.col("k").cast("int").alias("k"), "text", "x", "y", F.least("w", 100 - F.col("x")).alias("w"), F.least("h", 100 - F.col("y")).alias("h"), role.alias("role"), F.col("colour.red").alias("red"))


@query
def f16_contrast_colour(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.frame(spark, folder, I.PIXELS).select("id", "r", "g", "b").distinct()
    back = F.when(T.luminance(F.col("r"), F.col("g"), F.col("b")) < 128, 255).otherwise(0)
    step = lambda c, t: F.floor(F.col(c) + (back - F.col(c)) * t).cast("int")
    steps = F.sequence(F.lit(0), F.lit(5))
    shade = F.transform(steps, lambda k: T.luminance(step("r", k * 0.2), step("g", k * 0.2), step("b", k * 0.2)))
    own = T.luminance(F.col("r"), F.col("g"), F.col("b"))
    first = F.coalesce(F.array_min(F.filter(steps, lambda k: F.abs(F.element_at(shade, k + 1) - own) >= 70)), F.lit(5))
    return rows.select("id", "r", "g", "b", first.cast("int").alias("steps"))


@query
def f20_names_and_cuts(spark: SparkSession, folder: str) -> DataFrame:
    base = F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return table(spark, folder, "pages").select("page_id", base.alias("base"), F.left("url", F.lit(40)).alias("cut"), F.format_string("Translate %s (page %d).", F.col("url"), F.col("page_id")).alias("prompt"), F.replace(F.base64(F.col("url").cast("binary")), F.lit("\r\n"), F.lit("")).alias("b64"))


@query
def f25_time_budget(spark: SparkSession, folder: str) -> DataFrame:
    pages = lines(spark, folder).groupBy("book").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"))
    return pages.select("book", T.time_budget(F.col("pages") * 17, F.lit(False)).alias("once"), T.time_budget(F.col("pages") * 17, F.lit(True)).alias("proofread"), T.progress_percent(F.col("pages"), F.col("n")).alias("percent"))


@query
def t02_stall_detection(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.stalls(table(spark, folder, "events"), "user_id", "ts", idle=3 * 86400, total=27 * 86400)


@query
def l01_mock_translate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"))
    done = jobs.translated(rows, lambda texts: [f"[{t}]" for t in texts])
    return done.select("id", F.md5("target").alias("target_md5"))


@query
def l03_glossary_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.frame(spark, folder, I.GLOSSARY)
    good = F.length("term").between(2, 60) & F.length("value").between(1, 80) & ~T.looks_garbled(F.col("term")) & ~T.looks_garbled(F.col("value"))
    return rows.where(good).groupBy("term").agg(F.max_by("value", "ord").alias("value"))


@query
def s01_block_transform(spark: SparkSession, folder: str) -> DataFrame:
    spans = I.frame(spark, folder, I.SPANS).where("kind = 0").select(F.col("block").cast("long").alias("block"), T.joined_lines(F.col("text")).alias("text")).where("length(text) > 0")
    docs = table(spark, folder, "documents").select((F.col("doc_id") + 1000).alias("block"), F.md5(T.joined_lines(F.col("text"))).alias("text"))
    return spans.unionByName(docs)


@query
def s03_first_pages(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).where("page < 6").groupBy("book", "page").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("lines"))


@query
def s04_ocr_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.frame(spark, L.TOC).unionByName(lines(spark, folder).select("book", "page", "line_no", "text"))
    return rows.select("book", "page", "line_no", F.md5(T.without_leaders(F.col("text"))).alias("text_md5"))


@query
def s05_ocr_line_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.reading_order(lines(spark, folder), 5.0).withColumnRenamed("place", "by_five")
    return quality.reading_order(rows, 4.0).select("book", "page", "line_no", "by_five", F.col("place").alias("by_four"))


@query
def s08_image_classes(spark: SparkSession, folder: str) -> DataFrame:
    share = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (420 * F.col("page_h")), 8)
    kind = F.when(F.col("share") >= 0.5, "page").when(F.col("share") >= 0.02, "inflow").otherwise("small")
    return layout.boxes(lines(spark, folder)).where("image").select(F.col("id").cast("long").alias("id"), share.alias("share")).withColumn("class", kind)


@query
def s09_scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    rows = lines(spark, folder).where(F.length("text") >= 4)
    counts = [F.sum(T.count_of(t, p)).cast("long").alias(n) for n, p in (("letters", r"\p{L}"), ("digits", r"\p{Nd}"), ("signs", r"[^\p{L}\p{N}\s]"))]
    return rows.groupBy("book").agg(F.count("*").alias("lines"), *counts)


@query
def s10_size_guard(spark: SparkSession, folder: str) -> DataFrame:
    return layout.within_size(table(spark, folder, "documents").select("doc_id", "n_chars"), 5000, "n_chars")


@query
def s16_font_lookup(spark: SparkSession, folder: str) -> DataFrame:
    fonts = spark.createDataFrame([(f, b, i, f"{f}{'-bold' * b}{'-italic' * i}") for f in ("sans", "serif") for b in (False, True) for i in (False, True)], "family string, bold boolean, italic boolean, font string")
    rows = lines(spark, folder).select("book", "page", "line_no", F.when(F.expr("line_no % 2 = 0"), "serif").otherwise("sans").alias("family"), (F.col("size") >= 15).alias("bold"), F.expr("line_no % 5 = 0").alias("italic"))
    return rows.join(F.broadcast(fonts), ["family", "bold", "italic"]).select("book", "page", "line_no", "font")


@query
def k02_page_plan(spark: SparkSession, folder: str) -> DataFrame:
    target = F.when(F.expr("line_no % 4 = 1"), " ").when(F.expr("line_no % 9 = 2"), "broken,-text").otherwise(F.upper("text"))
    rows = lines(spark, folder).withColumn("target", target)
    live = (F.length(T.strip(F.col("target"))) > 0) & ~T.looks_garbled(F.col("text")) & ~T.looks_garbled(F.col("target"))
    return rows.where(live).groupBy("book", F.expr("cast(page div 40 as int)").alias("chunk"), "page").agg(F.count("*").alias("live"), F.max("line_no").alias("last_line"))


@query
def k03_overlay_plan(spark: SparkSession, folder: str) -> DataFrame:
    target = F.when(F.expr("line_no % 3 = 0"), F.col("text")).when(F.expr("line_no % 5 = 0"), "").otherwise(F.concat(F.col("text"), F.lit("!")))
    shade = F.expr("line_no * 40 % 256")
    rows = lines(spark, folder).select("book", "page", "line_no", "text", target.alias("target"), shade.alias("shade"))
    drawn = rows.where((T.strip(F.col("target")) != T.strip(F.col("text"))) & (F.length("target") > 0))
    return drawn.select("book", "page", "line_no", F.when(T.luminance(F.col("shade"), F.col("shade"), F.col("shade")) > 130, "black").otherwise("white").alias("ink"))


@query
def k04_book_plan(spark: SparkSession, folder: str) -> DataFrame:
    docs, numbers = layout.numbered_apart(table(spark, folder, "documents"))
    pars = checkpoints.cut(flow_of_documents(docs, numbers, F.md5("text").alias("text_md5"), F.when(F.col("kind") != "para", F.col("text")).alias("text")))
    headings = pars.where("kind <> 'para'")
    found = reflow.heading_pages(headings, layout.with_numbers(reflow.page_texts(layout.document_pages(docs)), numbers))
    heads = headings.join(found, ["book", "page", "par_no"]).select("book", F.lit("contents").alias("section"), F.lit(2).alias("section_no"), F.col("found").cast("int").alias("page"), "par_no", F.left("text", F.lit(90)).alias("text"))
    body = pars.select("book", F.lit("body").alias("section"), F.lit(3).alias("section_no"), "page", "par_no", F.col("text_md5").alias("text"))
    cover = pars.select("book").distinct().select("book", F.lit("cover").alias("section"), F.lit(1).alias("section_no"), F.lit(0).alias("page"), F.lit(0).cast("long").alias("par_no"), F.col("book").alias("text"))
    return cover.unionByName(heads).unionByName(body).withColumn("par_no", F.col("par_no").cast("long"))


@query
def k08_template_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).where("page = 0").groupBy("book").agg(F.count("*").alias("n"), F.max_by("line_no", F.struct(F.length("text"), -F.col("line_no"))).alias("accent"))
    return rows.select("book", F.when(F.col("n") <= 2, "centred").when(F.col("n") == 3, "top").otherwise("band").alias("template"), "accent")


@query
def k14_preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.with_ids(lines(spark, folder)).withColumn("id", F.col("id").cast("long"))
    target = F.when(F.expr("id % 3 = 0"), F.lower("text")).when(F.expr("id % 3 = 1"), "").otherwise(F.lit(None))
    row = F.to_json(F.struct("id", "page", F.col("size").cast("int").alias("size"), F.col("text").alias("original"), T.either(target, F.col("text")).alias("translated")))
    return rows.select("book", "page", "line_no", "id", F.md5(row).alias("row_md5"))


@query
def m03_pixel_bbox(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen vectors of 64 components are an image of 32 x 32; each has boxes of several sizes, and a text colour."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    grey = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 1) * 128))).cast("int")
    pixels = vectors.select(F.expr("vec_id div 16").alias("image"), F.expr("cast(vec_id % 4 * 8 + i % 8 as int)").alias("x"), F.expr("cast(vec_id div 4 % 4 * 8 + i div 8 as int)").alias("y"), grey.alias("r"), (255 - grey).alias("g"), grey.alias("b"))
    images = table(spark, folder, "embeddings").select(F.expr("vec_id div 16").alias("image")).distinct()
    boxes = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).selectExpr("image", "image * 6 + k AS block", "cast(k * 3 as double) AS x0", "cast(k * 2 as double) AS y0", "cast(k * 3 + 4 + k * k as double) AS x1", "cast(k * 2 + 3 + k as double) AS y1", "32 AS width", "32 AS height", "80 + k * 20 AS t_r", "128 AS t_g", "200 - k * 20 AS t_b")
    return reflow.ink_boxes(pixels, boxes)


@query
def j14_heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    docs, numbers = layout.numbered_apart(table(spark, folder, "documents"))
    heads = flow_of_documents(docs, numbers, F.when(F.col("kind") != "para", F.col("text")).alias("text")).where("kind <> 'para'")
    return reflow.heading_pages(heads, layout.with_numbers(reflow.page_texts(layout.document_pages(docs)), numbers))


@query
def l02_proofread(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.concat(F.lit("~"), "text").alias("draft"))
    done = jobs.proofread(rows, lambda pairs: [d + "." if len(s) % 2 == 0 else " " for s, d in pairs])
    return done.select("id", F.md5("target").alias("target_md5"))


@query
def l05_cover_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Cover texts as read: words corrected by known ones, then replaced by known titles' translations, else translated.

    Read are the lines of first pages, and every part's name with a wrong letter.
    """
    nation = table(spark, folder, "nation").select(F.col("n_name").alias("orig"), F.concat(F.lit("<"), "n_name", F.lit(">")).alias("value"), F.col("n_nationkey").alias("ord"))
    part = table(spark, folder, "part")
    titles = nation.unionByName(part.groupBy(F.col("p_name").alias("orig")).agg((F.min("p_partkey") + 100).alias("ord")).select("orig", F.concat(F.lit("{"), "orig", F.lit("}")).alias("value"), "ord"))
    read = lines(spark, folder).where("page = 0 and length(text) between 2 and 59").select("book", F.col("line_no").cast("long").alias("line_no"), F.col("text").alias("name"))
    typo = lambda c: F.concat(F.substring(c, 1, 2), F.lit("q"), F.expr(f"substring({c}, 4)"))
    names = part.select(F.lit("parts").alias("book"), F.col("p_partkey").alias("line_no"), F.when(F.expr("p_partkey % 3 = 0"), F.upper(typo("p_name"))).when(F.expr("p_partkey % 3 = 1"), F.concat(typo("p_name"), F.lit(" - "), typo("p_brand"))).otherwise(F.col("p_name")).alias("name"))
    extra = nation.select(F.lit("nations").alias("book"), F.col("ord").cast("long").alias("line_no"), typo("orig").alias("name"))
    words = titles.select("ord", F.explode(F.regexp_extract_all("orig", F.lit(T.WORD), F.lit(0))).alias("word")).where("length(word) >= 2")
    fixed = matching.corrected_texts(read.unionByName(names).unionByName(extra), ["book", "line_no"], "name", words)
    known = matching.first_matches(fixed.select(F.col("fixed").alias("name")).distinct(), titles).withColumnRenamed("name", "fixed")
    shown = fixed.join(known, "fixed", "left")
    return shown.select("book", "line_no", F.coalesce("override", F.concat(F.lit("["), "fixed", F.lit("]"))).alias("shown"), "changed")


@query
def t04_resumed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"))
    saved = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("saved "), F.col("doc_id").cast("string")).alias("target"))
    done = jobs.resumed(rows, saved, lambda texts: [f"[{t}]" for t in texts])
    return done.select("id", F.md5("target").alias("target_md5"))


@query
def t10_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    pars = checkpoints.cut(flow(spark, folder, *jobs.digests(F.col("text")), F.md5("text").alias("text_md5")).drop("kind"))
    target = F.when(F.expr("par_no % 5 = 3"), " ").otherwise(F.concat(F.lit("T:"), F.col("page").cast("string"), F.lit(":"), F.col("par_no").cast("string")))
    known = jobs.answers(pars.where("page % 3 = 0").select("text_id", "key_id", "says", target.alias("target"), F.struct("page", "par_no").alias("ord")))
    rows = pars.join(known, F.col("key_id") == F.col("known_key"), "left")
    return rows.select("book", "page", "par_no", F.col("known_key").isNotNull().alias("cached"), F.coalesce(F.md5("found"), "text_md5").alias("target_md5"))


@query
def t13_quality_flag(spark: SparkSession, folder: str) -> DataFrame:
    """The report as a flag of a finished job: the job is done either way."""
    report = quality.quality_report(lines(spark, folder), threshold=0.2, per_page=1)
    return report.select("book", F.lit("done").alias("status"), F.when(F.col("has_issues"), "check").otherwise("clean").alias("flag"))


@query
def p14_scanned_override(spark: SparkSession, folder: str) -> DataFrame:
    """Books scanned by their text, or by sight where their text is thin too."""
    pages = lines(spark, folder).groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars"))
    seen = F.col("book").isin("src1", "src3", "src5")
    books = quality.scanned_books(pages, per_page=2400)
    return books.select("book", (F.col("scanned") | (seen & (F.col("chars") < 4000 * F.greatest("pages", F.lit(1))))).alias("scanned"))


@query
def p27_cover_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of every page of every book, and whether its picture is made anew: a first page of no block, unless the original is to stay."""
    known = L.frame(spark, L.COVER_PAGES).select("book", F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = known.unionByName(table(spark, folder, "documents").select(F.col("source").alias("book"), "doc_id", "text"))
    blocks = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.length(T.strip(t)) > 0))
    # counted before pages are numbered, so no text is sent
    counted = docs.select("book", "doc_id", blocks.cast("long").alias("blocks"))
    pages = layout.ranked(counted.withColumn("block", layout.id_block(docs, "doc_id")), ["book"], "block", ["doc_id"], "page")
    remake = (F.col("page") == 0) & quality.cover_gate(F.col("blocks"), F.expr("doc_id % 5 = 0"))
    return pages.select("book", F.col("page").cast("int").alias("page"), "doc_id", "blocks", remake.alias("remake"))


@query
def k15_downloads(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.downloads(I.frame(spark, folder, I.JOBS)).select("job_id", "path")


@query
def w09_line_pitch(spark: SparkSession, folder: str) -> DataFrame:
    return reflow.line_pitch(lines(spark, folder)).withColumn("pitch", F.round("pitch", 6))


@query
def o04_image_order(spark: SparkSession, folder: str) -> DataFrame:
    images = layout.boxes(lines(spark, folder)).where("image").select("book", "page", "y0", F.col("id").cast("long").alias("id"))
    return images.withColumn("place", matching.window_rank(images, ["book", "page"], "y0", "id").cast("long")).select("book", "page", "id", "place")


@query
def f19_join_split(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a page sent as one text and taken apart again, with the count check."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"])
    pages = lines(spark, folder).groupBy("book", "page").agg(F.concat_ws(L.DELIMITER, parts).alias("sent"), F.count("*").alias("n"))
    back = F.size(F.split("sent", L.DELIMITER.strip()))
    return pages.select("book", "page", F.md5("sent").alias("sent_md5"), "n", (back == F.col("n")).alias("whole"))


@query
def f23_glossary_text(spark: SparkSession, folder: str) -> DataFrame:
    """The first sixty terms, as a prompt has them."""
    rows = I.frame(spark, folder, I.GLOSSARY).where("length(value) > 0").orderBy("ord").limit(60)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "value"))), lambda p: F.concat(p["term"], F.lit(" → "), p["value"]))
    return rows.agg(F.concat_ws("; ", parts).alias("glossary"))


@query
def o06_top_by_count(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token")).where("length(token) > 2")
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(60)


@query
def u04_seen_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.with_ids(lines(spark, folder)).select("book", "id", F.md5("text").alias("key"))
    return rows.groupBy("book", "key").agg(F.min("id").cast("long").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query
def u02_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    every = table(spark, folder, "events").select("user_id", "event_type", "value")
    done = every.where("value >= 20").select("user_id", "event_type")
    return every.select("user_id", "event_type").exceptAll(done)


@query
def t03_watchdog(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as a job's beats: the first limit that ends."""
    beats = jobs.beats_of(table(spark, folder, "events"), "user_id", "ts", F.col("value"), F.lit(100))
    return jobs.timeouts(beats, idle=2 * 86400, total=20 * 86400)


@query
def t07_accepted_submits(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", F.sha2("props", 256).alias("file_hash"), F.col("event_type").alias("layout"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.first_submits(events).select("file_hash", "layout", "event_id", "submits")


@query
def k09_checkpoint_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents are saved in two parts, the second with some of the first anew; the work goes on from what is saved."""
    place = f"{checkpoints.work_folder(spark)}/work-{uuid.uuid4().hex}"
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    checkpoints.save(labels.where("quality = 0").select("id", F.concat(F.lit("first "), "id").alias("target")), place)
    checkpoints.save(labels.where("quality = 1 or length(id) < 3").select("id", F.concat(F.lit("second "), "id").alias("target")), place)
    saved = checkpoints.load(spark, place, "id string, target string", "id")
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"))
    return jobs.resumed(rows, saved, lambda texts: [f"[{t}]" for t in texts]).select("id", F.md5("target").alias("target_md5"))


@query
def w14_fitting_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The largest type in which each part's words fit in a box of its own."""
    part = table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), (8 + F.col("p_size") % 17).cast("double").alias("size"), (30 + F.col("p_partkey") % 90).cast("double").alias("width"), (10 + F.col("p_partkey") % 37).cast("double").alias("height"))
    return part.select("p_partkey", batching.fitting_size(F.col("text"), F.col("size"), F.col("width"), F.col("height")).alias("fits"))


@query
def a10_dominant_colours(spark: SparkSession, folder: str) -> DataFrame:
    """The six most frequent colours of each image, its own by contrast, and whether one has more than half."""
    return quality.dominant_colours(I.frame(spark, folder, I.PIXELS), 6)


@query
def p18_image_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes over images of more than a twentieth of the page are painted over, others are filled."""
    rows = layout.boxes(lines(spark, folder)).withColumn("y1", F.when(F.col("image"), F.col("y1") + 20).otherwise(F.col("y1")))
    large = rows.where(~F.col("image") | ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0.05 * 420 * F.col("page_h") * 0.2))
    over = matching.covered_boxes(large).select("id").distinct().withColumn("over", F.lit(True))
    return rows.where("not image").join(over, "id", "left").select(F.col("id").cast("long").alias("id"), F.coalesce("over", F.lit(False)).alias("painted"))


@query
def a18_palette(spark: SparkSession, folder: str) -> DataFrame:
    """Four clusters of all vectors, the largest first: no SQL, tested against plain rounds."""
    centres, sizes, cost = clusters.k_means(table(spark, folder, "embeddings"), least_move=0.001)
    rows = [(i, int(n), round(float(c[0]), 6), round(float(np.sqrt((c * c).sum())), 6)) for i, (n, c) in enumerate(zip(sizes, centres, strict=True))]
    return spark.createDataFrame(rows, "place int, size long, first double, length double")
