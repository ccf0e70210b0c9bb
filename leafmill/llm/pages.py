"""Main text of web pages by wrappers that are inferred for each host."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut
from leafmill.llm.wrappers import ALWAYS_PAGES, ASIDE_TAGS, MAIN_TAGS, blocks, digest, main_text, merge, parse, rules_of, wrapper_of

#: Rules of all hosts are sent to every task up to so many characters, else joined.
SENT_CHARS = 8_000_000
#: Wrappers that one task aligns.
ALIGNED = 200
#: A text is the template's on this share of a host's different pages, and on so many at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
#: Within articles it must be on nearly all of them.
ALWAYS_SHARE = 0.9
#: Paths that hold less than this part of a host's varying text say nothing of their own, so a host has a bounded number.
LEAST_PART = 20_000


def host_of(url: Column) -> Column:
    """The host in lower case; '' for null and for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def read_pages(pages: DataFrame) -> DataFrame:
    """host, page (digest), wrapper (JSON) and slots (path, digest, chars, links) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
        for batch in batches:
            names, wrappers, slots = [], [], []
            for source in batch.column(1).to_pylist():
                root = parse(source or "")
                found: dict[tuple[str, int], list[int]] = {}
                for path, text, links in blocks(root):
                    sums = found.setdefault((path, digest(f"{path}\n{text}")), [0, 0])
                    sums[0] += len(text)
                    sums[1] += links
                names.append(digest(source or ""))
                wrappers.append(json.dumps(wrapper_of(root)))
                slots.append([{"path": p, "text": t, "chars": c, "links": k} for (p, t), (c, k) in found.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(wrappers, pa.string()), pa.array(slots, kind)], ["host", "page", "wrapper", "slots"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(run, "host string, page long, wrapper string, slots array<struct<path:string,text:long,chars:long,links:long>>")


def host_wrappers(read: DataFrame) -> DataFrame:
    """host, wrapper: the different wrappers of a host's pages aligned, however the pages are dealt.

    Wrappers are aligned in groups of bounded size by their digests, in order,
    and the results likewise until each host has one.
    """

    def align(table: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(table.column("wrapper").to_pylist()):
            whole = json.loads(text) if whole is None else merge(whole, json.loads(text))
        return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(whole)]})

    rows = cut(read.select("host", "wrapper").distinct())
    while True:
        counts = cut(rows.groupBy("host").agg(F.count("*").alias("n")))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rows
        parts = F.ceil(F.col("n") / F.lit(float(ALIGNED)))
        grouped = rows.join(counts, "host").select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), parts).alias("part"))
        rows = cut(grouped.groupBy("host", "part").applyInArrow(align, "host string, wrapper string"))


def host_rules(pages: DataFrame) -> DataFrame:
    """host, starts, drop and template: where each host's article is, by its wrapper and what its slots hold.

    Equal pages of a host count once, so copies of a page make no template.
    """
    read = cut(read_pages(pages))
    wrappers = host_wrappers(read)
    once = read.select("host", "page", "slots").dropDuplicates(["host", "page"])
    n_pages = once.groupBy("host").agg(F.count("*").alias("n_pages"))
    texts = once.select("host", F.inline("slots")).groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    within = F.col("path").rlike(rf"(^|/)({'|'.join(sorted(MAIN_TAGS))})([./]|$)")
    most = lambda pages, share: F.greatest(F.lit(pages), F.ceil(F.col("n_pages") * F.lit(share)))
    fixed = F.col("n") >= F.when(within, most(ALWAYS_PAGES, ALWAYS_SHARE)).otherwise(most(TEMPLATE_PAGES, TEMPLATE_SHARE))
    judged = texts.join(n_pages, "host").withColumn("fixed", fixed)
    template = F.collect_list(F.when(F.col("fixed"), F.col("text")))
    paths = judged.groupBy("host", "path").agg(F.sum(F.when(F.col("fixed"), 0).otherwise(F.col("chars"))).alias("chars"), F.sum(F.when(F.col("fixed"), 0).otherwise(F.col("links"))).alias("links"), template.alias("fixed_texts"))
    # of fixed texts a page has no more than it has blocks, and most pages have each
    templates = paths.where("size(fixed_texts) > 0").groupBy("host").agg(F.flatten(F.collect_list("fixed_texts")).alias("template"))
    keys = F.split("path", "/", -1)
    never = F.exists(keys, lambda k: k.rlike(rf"^({'|'.join(sorted(ASIDE_TAGS))})([.]|$)"))
    ups = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(keys)), lambda n: F.array_join(F.slice(keys, F.lit(1), n), "/")))
    sums = paths.where(~never).select("host", F.explode(ups).alias("up"), "chars", "links").groupBy("host", "up").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    whole = sums.where("up = ''").select("host", F.col("chars").alias("whole"))
    told = sums.join(whole, "host").where((F.col("chars") * LEAST_PART >= F.col("whole")) & ((F.col("chars") > 0) | (F.col("up") == "")))
    slots = told.groupBy("host").agg(F.collect_list(F.struct("up", "chars", "links")).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, drops = [], []
            for wrapper, found, pages_ in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                start, drop = rules_of(json.loads(wrapper), {x["up"]: (x["chars"], x["links"]) for x in found or ()}, pages_)
                starts.append(start)
                drops.append(drop)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.string())), pa.array(drops, pa.list_(pa.string())), batch.column(3)], ["host", "starts", "drop", "template"])

    joined = wrappers.join(slots, "host", "left").join(templates, "host", "left").join(n_pages, "host").select("host", "wrapper", "slots", "template", "n_pages")
    return cut(joined.mapInArrow(run, "host string, starts array<string>, drop array<string>, template array<long>"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of each page.

    References are decoded, white space in a block is one blank, blocks are
    joined by two newlines. Null and empty html have an empty text; pages of a
    null or malformed url are one host; repeated rows stay; very long and deep
    pages are read whole; other columns are left out; an empty table gives no
    rows.
    """
    rules = host_rules(pages)
    size = F.length(F.concat_ws("", "starts", "drop")) + 8 * F.size(F.coalesce("template", F.array().cast("array<bigint>")))
    small = (rules.agg(F.sum(size).alias("n")).first()["n"] or 0) <= SENT_CHARS
    named = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = named.join(F.broadcast(rules) if small else rules, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(2000)
        def sets(starts: tuple, drop: tuple, template: tuple) -> tuple[frozenset, frozenset, frozenset]:
            return frozenset(starts), frozenset(drop), frozenset(template)

        for batch in batches:
            texts = []
            for source, *rule in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                texts.append(main_text(parse(source or ""), *sets(*(tuple(x or ()) for x in rule))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "starts", "drop", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
