"""Heartbeats of jobs as streams: sessions, stalls, and checkpointed work batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from leafmill.operators.jobs import Translator, translated

STALL_SCHEMA = "job long, last_beat long, beats long, percent int, verdict string"
STATE_SCHEMA = "started long, moved long, last long, beats long, percent int, began long, went long"
#: The setting that keeps states with timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files; its times as timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, idle: str = "480 seconds", late: str = "1 hour") -> DataFrame:
    """job, began, ended, beats: spells of a job's beats with no gap of ``idle`` or more.

    On a stream a spell is out once the watermark has passed it; each but a job's
    last ends in a stall.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    spells = marked.groupBy(F.session_window("ts", idle).alias("spell"), F.col("user_id").alias("job")).agg(F.count("*").alias("beats"))
    return spells.select("job", F.col("spell.start").alias("began"), F.col("spell.end").alias("ended"), "beats")


class Watchdog(StatefulProcessor):
    """Two limits for each job: the time it may take, and the time its percentage may stand still.

    A beat has a time in microseconds and a percentage; only a change of the
    percentage is progress. Of the limits, the one that ends first is the verdict,
    the total limit where both end together. Beats are judged by their own clock;
    for a job that beats no more a timer is set, by the processing clock, to the end
    of the nearer limit. A job that was reported is over: its later beats count
    for nothing, and its state goes after ``forget_ms``.
    """

    def __init__(self, idle: float, total: float, forget_ms: int = 86_400_000) -> None:
        self.idle, self.total, self.forget_ms = idle, total, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE_SCHEMA)
        self.over = handle.getValueState("over", "told boolean", self.forget_ms)

    def verdict(self, now: float, started: float, moved: float, unit: float) -> str | None:
        """What ends a job by ``now``, on a clock of that many units a second."""
        by_total, by_idle = started + self.total * unit, moved + self.idle * unit
        if now > min(by_total, by_idle):
            return "over time" if by_total <= by_idle else "stalled"
        return None

    def _told(self, key: tuple, state: tuple, verdict: str) -> pd.DataFrame:
        self.job.clear()
        self.over.update((True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame([(key[0], state[2], state[3], state[4], verdict)], columns=["job", "last_beat", "beats", "percent", "verdict"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            return
        clock = timerValues.getCurrentProcessingTimeInMs()
        # started, moved and last by the beats' clock; then beats, percent; started and moved by the processing clock
        state = self.job.get() if self.job.exists() else None
        for at, percent in sorted((int(a), int(p)) for frame in rows for a, p in zip(frame["at"], frame["percent"], strict=True)):
            if state is None:
                state = (at, at, at, 1, percent, clock, clock)
                continue
            started, moved, last, beats, before, began, went = state
            verdict = self.verdict(at, started, moved, 1e6)
            if verdict:
                yield self._told(key, state, verdict)
                return
            goes = percent != before
            state = (started, at if goes else moved, max(last, at), beats + 1, percent, began, clock if goes else went)
        if state is not None:
            self.job.update(state)
            self._set_timer(state)

    def _set_timer(self, state: tuple) -> None:
        ends = int(min(state[5] + self.total * 1000, state[6] + self.idle * 1000)) + 1
        timers = set(self.handle.listTimers())
        for timer in timers - {ends}:
            self.handle.deleteTimer(timer)
        if ends not in timers:
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        state = self.job.get()
        verdict = self.verdict(timerValues.getCurrentProcessingTimeInMs(), state[5], state[6], 1000)
        if verdict:
            yield self._told(key, state, verdict)
        else:
            self._set_timer(state)

    def close(self) -> None:
        pass


def watchdog(beats: DataFrame, idle: float = 480.0, total: float = 3600.0, forget_ms: int = 86_400_000) -> DataFrame:
    """A row for each job of a stream that takes too long or stands still.

    ``beats`` has job, at (microseconds) and percent, as ``jobs.beats_of`` gives;
    on a finite table ``jobs.timeouts`` gives the same rows. Timers and states
    with a time to live need the state store ``STATE_STORE`` names.
    """
    rows = beats.select(F.col("job").cast("long").alias("job"), F.col("at").cast("long").alias("at"), F.col("percent").cast("int").alias("percent"))
    return rows.groupBy("job").transformWithStateInPandas(Watchdog(idle, total, forget_ms), STALL_SCHEMA, "Append", "processingTime")


def accepted_submits(submits: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first submit of each content and layout on a stream; repeats and late ones go.

    ``submits`` has file_hash, layout and a timestamp ts. A key is kept for
    ``within`` after its first submit, by the watermark, so state is bounded by what
    comes in that time; on a finite table ``jobs.first_submits`` gives the same rows
    for repeats within that time.
    """
    return submits.withWatermark("ts", within).dropDuplicatesWithinWatermark(["file_hash", "layout"])


def translate_stream(rows: DataFrame, translator: Translator, out: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Translate a stream of ``key, source`` into ``out``; a batch that is tried again replaces its own files."""

    def save(batch: DataFrame, number: int) -> None:
        translated(batch, translator, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
