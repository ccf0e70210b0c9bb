"""Jobs as tables: status, duplicates, stalls, checkpointed work through a translator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

ACTIVE = ("queued", "processing")
#: Columns of a job that no answer shows.
HIDDEN = ("path", "src_texts", "params", "file_hash", "started", "last_progress", "cancel", "abort_reason", "_api_key")


class Translator(Protocol):
    """Translates some texts at a time; one text out for each in."""

    def __call__(self, texts: list[str]) -> list[str]: ...


class ClientError(Exception):
    """The request itself is wrong: the run stops and no text is replaced by its source."""


def public_status(jobs: DataFrame) -> DataFrame:
    return jobs.drop(*HIDDEN)


def active_duplicates(submits: DataFrame, jobs: DataFrame) -> DataFrame:
    """Submits with the first active job of the same content and layout, if any."""
    active = jobs.where(F.col("status").isin(*ACTIVE))
    first = active.groupBy("file_hash", "layout").agg(F.min("job_id").alias("reused"))
    return submits.join(first, ["file_hash", "layout"], "left")


def stalls(beats: DataFrame, job: str, at: str, idle: int, total: int) -> DataFrame:
    """job, beats, longest_gap, elapsed, verdict, from a job's heartbeats in whole seconds.

    The total limit's verdict comes before that of standing still.
    """
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    gap = seconds - F.lag(seconds).over(Window.partitionBy(job).orderBy(seconds))
    rows = beats.select(job, seconds.alias("s"), gap.alias("gap"))
    jobs = rows.groupBy(job).agg(F.count("*").alias("beats"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), (F.max("s") - F.min("s")).alias("elapsed"))
    verdict = F.when(F.col("elapsed") > total, "over time").when(F.col("longest_gap") > idle, "stalled").otherwise("alive")
    return jobs.withColumn("verdict", verdict)


def beats_of(events: DataFrame, job: str, at: str, done: Column, total: Column) -> DataFrame:
    """job, at (microseconds), percent: what a job's events say of its progress."""
    return events.select(F.col(job).alias("job"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), T.progress_percent(done, total).alias("percent"))


def timeouts(beats: DataFrame, idle: int, total: int) -> DataFrame:
    """job, last_beat, beats, percent, verdict: each job's first limit that ended before a beat of it.

    ``beats`` has job, at (microseconds) and percent; only a change of the
    percentage is progress. The limit that ends first is the verdict, the total
    limit where both end together. The row tells the last beat before, and the
    beats until then. Jobs within their limits have no row.
    """
    order = Window.partitionBy("job").orderBy("at", "percent")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    goes = F.coalesce(F.col("percent") != F.lag("percent").over(order), F.lit(True))
    rows = beats.withColumn("went", F.when(goes, F.col("at")))
    rows = rows.withColumns({"started": F.min("at").over(before), "moved": F.max("went").over(before), "last_beat": F.max("at").over(before), "n": F.count("*").over(before), "last_percent": F.lag("percent").over(order)})
    by_total, by_idle = F.col("started") + total * 1_000_000, F.col("moved") + idle * 1_000_000
    late = rows.where(F.col("at") > F.least(by_total, by_idle)).withColumn("verdict", F.when(by_total <= by_idle, "over time").otherwise("stalled"))
    first = late.groupBy("job").agg(F.min(F.struct("at", "last_beat", "n", "last_percent", "verdict")).alias("first"))
    return first.select("job", F.col("first.last_beat").alias("last_beat"), F.col("first.n").alias("beats"), F.col("first.last_percent").alias("percent"), F.col("first.verdict").alias("verdict"))


def first_submits(submits: DataFrame) -> DataFrame:
    """Of the submits of one content and layout the first: its columns, and how many there were."""
    columns = [c for c in submits.columns if c not in ("file_hash", "layout")]
    first = submits.groupBy("file_hash", "layout").agg(F.min(F.struct("ts", *[c for c in columns if c != "ts"])).alias("first"), F.count("*").alias("submits"))
    return first.select("file_hash", "layout", *[F.col(f"first.{c}").alias(c) for c in columns], "submits")


def translated(rows: DataFrame, translator: Translator, key: str = "id", budget: int = 2500) -> DataFrame:
    """key, source, target: one row out for each in.

    Texts without a letter pass unchanged and never reach the translator. Batches
    hold up to ``budget`` characters. If a batch comes back with another number of
    texts, each is sent alone; a blank answer or a failure leaves the source; a
    ClientError stops the run.
    """

    def ask(texts: list[str]) -> list[str]:
        try:
            found = translator(texts)
        except ClientError:
            raise
        except Exception:
            found = []
        if len(found) == len(texts):
            return [(f or "").strip() or t for f, t in zip(found, texts, strict=True)]
        return list(texts) if len(texts) == 1 else [ask([t])[0] for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, batch, used = [], [], 0
            for text in frame["source"].tolist():
                if batch and used + len(text) > budget:
                    out += ask(batch)
                    batch, used = [], 0
                batch.append(text)
                used += len(text) + 9
            out += ask(batch) if batch else []
            yield frame.assign(target=out)

    named = rows.select(F.col(key).cast("long").alias(key), F.coalesce("source", F.lit("")).alias("source"))
    real = T.has_letter(F.col("source"))
    done = named.where(real).mapInPandas(run, f"{key} long, source string, target string")
    return done.unionByName(named.where(~real).withColumn("target", F.col("source")))


def resumed(rows: DataFrame, checkpoint: DataFrame, translator: Translator, key: str = "id") -> DataFrame:
    """Rows of a checkpoint (key as string, target) as they are, and the others translated."""
    saved = checkpoint.groupBy(F.col(key).alias("saved_key")).agg(F.max("target").alias("target"))
    joined = rows.join(saved, F.col(key).cast("string") == F.col("saved_key"), "left")
    cached = joined.where("saved_key is not null").select(F.col(key).cast("long").alias(key), "source", "target")
    return cached.unionByName(translated(joined.where("saved_key is null").select(key, "source"), translator, key))


class Editor(Protocol):
    """Corrects some drafts at a time, given pairs of a source and its draft; one text out for each in."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[str]: ...


def proofread(rows: DataFrame, editor: Editor, key: str = "id", budget: int = 2500) -> DataFrame:
    """key, source, draft, target: drafts as an editor leaves them.

    Batches hold up to ``budget`` characters of sources and drafts. A draft stays
    where the answer is blank, of another number of texts, or fails; blank
    drafts are not sent. A ClientError stops the run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs, out, batch, used = list(zip(frame["source"], frame["draft"], strict=True)), [], [], 0

            def ask(batch: list[tuple[str, str]]) -> list[str]:
                try:
                    found = editor(batch) if batch else []
                except ClientError:
                    raise
                except Exception:
                    found = []
                return [(f or "").strip() or d for f, (_, d) in zip(found, batch, strict=True)] if len(found) == len(batch) else [d for _, d in batch]

            for pair in pairs:
                size = len(pair[0]) + len(pair[1])
                if batch and used + size > budget:
                    out += ask(batch)
                    batch, used = [], 0
                batch.append(pair)
                used += size
            yield frame.assign(target=out + ask(batch))

    named = rows.select(F.col(key).cast("long").alias(key), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("draft", F.lit("")).alias("draft"))
    real = F.length(T.strip(F.col("draft"))) > 0
    done = named.where(real).mapInPandas(run, f"{key} long, source string, draft string, target string")
    return done.unionByName(named.where(~real).withColumn("target", F.col("draft")))


def digests(text: Column) -> list[Column]:
    """text_id and key_id, which stand for a text and its cache key, and whether the text says something."""
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    return [digest(text).alias("text_id"), digest(T.cache_key(text)).alias("key_id"), (F.length(T.strip(text)) > 0).alias("says")]


def answers(cached: DataFrame) -> DataFrame:
    """known_key, found: the target that answers for each cache key of ``cached``, which has ``digests``, target and ord."""
    texts = cached.groupBy("text_id").agg(F.min("ord").alias("came"), F.max_by("target", "ord").alias("target"), F.first("key_id").alias("key_id"), F.first("says").alias("says"))
    good = texts.where(F.col("says") & (F.length(T.strip(F.col("target"))) > 0))
    return good.groupBy(F.col("key_id").alias("known_key")).agg(F.max_by("target", "came").alias("found"))


def rebuilt(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows with target: the translation known for their cache key, else their own text; and whether it was known.

    ``cached`` has text, target and ord. A text has the target of its last row; of
    the texts of one key, the one that came last answers. Blank texts and blank
    targets answer nothing.
    """
    known = answers(cached.select(*digests(F.col("text")), "target", "ord"))
    joined = rows.join(known, digests(F.col("text"))[1] == F.col("known_key"), "left")
    return joined.withColumn("cached", F.col("known_key").isNotNull()).withColumn("target", F.coalesce("found", "text")).drop("known_key", "found")


def built(lines: DataFrame, path: str, threshold: float = 5.0, least: int = 4) -> dict:
    """Write a finished book and flag it in the same pass: status, and what the flag says.

    Suspect lines are counted as they are written. The job is done whatever the
    counts say, and also where they cannot be had; then there is no flag.
    """
    seen = Observation("quality")
    counted = F.length("text") >= least
    lines.observe(seen, F.count_if(counted).alias("total"), F.count_if(counted & T.suspect_garble(F.col("text"))).alias("suspect")).write.mode("overwrite").parquet(path)
    return {"status": "done", "quality": flag_of(seen, threshold)}


def flag_of(seen: Observation, threshold: float) -> dict | None:
    try:
        counts = seen.get
        percent = round(100.0 * counts["suspect"] / max(counts["total"], 1), 1)
        return {"total": counts["total"], "suspect": counts["suspect"], "garbled_percent": percent, "has_issues": percent >= threshold}
    except Exception:  # a book without a flag is still a book
        return None


def downloads(jobs: DataFrame) -> DataFrame:
    """Jobs whose result can be fetched: done and with a path."""
    return jobs.where((F.col("status") == "done") & (F.length("path") > 0))
