import time
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import jobs
from leafmill.streaming import heartbeats

EVENTS = "/root/testdata/sf0.001/events.parquet"


def events(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.read.parquet(EVENTS)
    ends = rows.select(F.expr("percentile(unix_micros(cast(ts as timestamp)), array(0.33, 0.67))")).first()[0]
    part = F.when(F.unix_micros(F.col("ts").cast("timestamp")) <= ends[0], 0).when(F.unix_micros(F.col("ts").cast("timestamp")) <= ends[1], 1).otherwise(2)
    for k in range(3):  # one after the other, as streams read files by their age
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


def run(df, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table("out").collect()


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    path = events(spark, tmp_path)
    batch = heartbeats.sessions(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")), "2 days").collect()
    stream = run(heartbeats.sessions(heartbeats.read_events(spark, path, 10), "2 days"), tmp_path)
    assert stream and set(map(tuple, stream)) <= set(map(tuple, batch))
    assert len(stream) >= len(batch) // 2


class Clock:
    """A handle and a clock that are turned by hand: timers fire when the clock has passed them."""

    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    def __init__(self, processor):
        self.processor, self.now, self.timers, self.out = processor, 0, set(), []
        processor.init(self)

    def getValueState(self, name, schema, ttl=None):
        return self.Value()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def beat(self, at, percent):
        frame = pd.DataFrame({"at": [int(at * 1e6)], "percent": [percent]})
        self.keep(self.processor.handleInputRows((7,), iter([frame]), self))

    def keep(self, frames):
        self.out += [(self.now, *row) for frame in frames for row in frame.itertuples(index=False, name=None)]

    def turn(self, now):
        for timer in sorted(t for t in self.timers if t <= now):
            if timer in self.timers:
                self.timers.discard(timer)
                self.now = timer
                self.keep(self.processor.handleExpiredTimer((7,), self, None))
        self.now = now


def test_total_limit_ends_at_its_own_time_though_the_job_moves():
    job = Clock(heartbeats.Watchdog(idle=100, total=250))
    for k in range(5):
        job.turn(k * 50_000)
        job.beat(k * 50, 10 + k)
    job.turn(400_000)
    assert job.out == [(250_001, 7, 200_000_000, 5, 14, "over time")] and not job.timers


def test_only_a_change_of_the_percentage_is_progress():
    job = Clock(heartbeats.Watchdog(idle=100, total=10_000))
    for k in range(4):
        job.turn(k * 30_000)
        job.beat(k * 30, 5 if k else 4)
    job.turn(500_000)
    assert job.out == [(130_001, 7, 90_000_000, 4, 5, "stalled")]
    job.beat(600, 50)  # it is over
    job.turn(900_000)
    assert len(job.out) == 1


def test_beats_are_judged_by_their_own_clock():
    for times, verdict in (([0, 50, 301], "over time"), ([0, 250, 320], "over time"), ([0, 160], "stalled"), ([0, 100, 200, 300, 310], "over time")):
        job = Clock(heartbeats.Watchdog(idle=150 if verdict == "stalled" or len(times) == 5 else 400, total=300))
        for k, at in enumerate(times):
            job.beat(at, k)
        assert [row[-1] for row in job.out] == [verdict] and job.out[0][3] == len(times) - 1
    both = Clock(heartbeats.Watchdog(idle=300, total=300))
    both.beat(0, 1)
    both.beat(301, 2)
    assert both.out[0][-1] == "over time"


def beats(events):
    return jobs.beats_of(events, "user_id", "ts", F.col("value"), F.lit(100))


@pytest.fixture
def timed(spark):
    spark.conf.set(*heartbeats.STATE_STORE)
    yield spark
    spark.conf.unset(heartbeats.STATE_STORE[0])


def drained(query, rows, expected, seconds=90):
    """Rows of a stream that its timers keep going: until all are there, or its time is over."""
    found, ends = None, time.time() + seconds
    while found != expected and time.time() < ends and query.exception() is None:
        time.sleep(1)
        found = rows()
    query.stop()
    return found


@pytest.mark.parametrize(("idle", "total"), [(2 * 86400, 20 * 86400), (10 * 86400, 3 * 86400), (86400, 10**9)])
def test_watchdog_equals_the_batch(timed, tmp_path, idle, total):
    path = events(timed, tmp_path)
    expected = {tuple(r) for r in jobs.timeouts(beats(timed.read.parquet(path)), idle, total).collect()}
    stream = heartbeats.watchdog(beats(heartbeats.read_events(timed, path, 1)), idle, total, forget_ms=10**9)
    name = f"dog{idle}{total}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    got = drained(query, lambda: {tuple(r) for r in timed.table(name).collect()}, expected)
    assert got == expected and expected


def test_a_silent_job_is_told_by_its_timer(timed, tmp_path):
    path, schema = tmp_path / "beats", "job long, at long, percent int"
    timed.createDataFrame([(1, 0, 1), (2, 0, 1)], schema).coalesce(1).write.parquet(str(path / "a"))
    rows = timed.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(path))
    query = heartbeats.watchdog(rows, idle=5.0, total=1e6).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    expected = {(1, 0, 1, 1, "stalled"), (2, 0, 1, 1, "stalled")}
    assert drained(query, lambda: {tuple(r) for r in timed.table("silent").collect()}, expected) == expected


def submits(events):
    return events.select("event_id", F.sha2("props", 256).alias("file_hash"), F.col("event_type").alias("layout"), F.col("ts").cast("timestamp").alias("ts"))


def test_repeated_submits_equal_the_batch(spark, tmp_path):
    path = events(spark, tmp_path)
    batch = {(r.file_hash, r.layout, r.event_id) for r in jobs.first_submits(submits(spark.read.parquet(path))).collect()}
    stream = heartbeats.accepted_submits(submits(heartbeats.read_events(spark, path, 1)), "60 days")
    got = [(r.file_hash, r.layout) for r in run(stream, tmp_path)]
    assert sorted(got) == sorted({b[:2] for b in batch}) and len(batch) < 1000


def test_late_submits_go_and_forgotten_keys_come_again(spark, tmp_path):
    path, schema = tmp_path / "rows", "event_id long, file_hash string, layout string, ts timestamp"
    at = lambda minutes: datetime.fromtimestamp(1_700_000_000 + 60 * minutes, UTC)
    parts = [[(1, "a", "x", at(0)), (2, "a", "y", at(1))], [(3, "a", "x", at(30)), (4, "b", "x", at(200))], [(7, "d", "x", at(210))], [(5, "c", "x", at(10)), (6, "a", "x", at(300))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"p{k}"))
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))
    # 3 repeats 1 in time; once the watermark has 4 behind it, 5 is too old and 1 is forgotten when 6 comes
    assert sorted(r.event_id for r in run(heartbeats.accepted_submits(rows, "1 hour"), tmp_path)) == [1, 2, 4, 6, 7]


def test_translated_batches_replace_themselves(spark, tmp_path):
    path, out = str(tmp_path / "rows"), str(tmp_path / "out")
    schema = "id long, source string"
    spark.createDataFrame([(i, f"t{i}") for i in range(10)], schema).repartition(3).write.parquet(path)
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        heartbeats.translate_stream(rows, lambda texts: [t.upper() for t in texts], out, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.target for r in spark.read.parquet(out).collect()) == [f"T{i}" for i in range(10)]
