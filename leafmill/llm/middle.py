"""Fill-in-the-middle by a parallel automaton scan.

A text is cut at its lines. An automaton of six states reads its bytes: it knows
whether a line is open and whether a sentinel has been seen, and a unit starts with
each byte read at the start of a line. Texts are dealt out as chunks, and all chunks
are read in step, from every state at once: a chunk gives its transition function
(the state it ends in from each state) and the number of units that start in it from
each state. Functions compose associatively, so a scan by doubling resolves the
state that each chunk is entered in and the units before it; a cut is then searched
in the one chunk that holds it.

Texts up to ``piece`` bytes are read in place. Longer ones are dealt out in pieces
to tasks, which return one summary each; the pieces that hold a cut are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, light_batches, small_batches

#: Classes of bytes; the last stands for what lies beyond a chunk's end.
OTHER, NEWLINE, OPEN, LETTER, CLOSE, PAD = range(6)
#: States: at a line's start, within a line, after "<", after "<" and a letter, and the first two once a sentinel was seen.
START, INSIDE, OPENED, LETTERED, START_SEEN, INSIDE_SEEN = range(6)
STATES, CLASSES = 6, 6
#: Bytes of a chunk, and of a piece of a long text.
CHUNK, PIECE = 1024, 1 << 16
#: Bytes of texts, about, that a task holds and reads at once.
GROUP = 1 << 22
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state and whether a unit starts, at state * CLASSES + class."""
    classes = np.full(256, OTHER, np.uint8)
    for group, marks in ((NEWLINE, b"\n"), (OPEN, b"<"), (LETTER, b"PSM"), (CLOSE, b">")):
        classes[list(marks)] = group
    moves = np.empty((STATES, CLASSES), np.uint8)
    moves[:START_SEEN] = INSIDE
    moves[:START_SEEN, OPEN] = OPENED
    moves[OPENED, LETTER] = LETTERED
    moves[LETTERED, CLOSE] = INSIDE_SEEN
    moves[START_SEEN:] = INSIDE_SEEN
    moves[:START_SEEN, NEWLINE] = START
    moves[START_SEEN:, NEWLINE] = START_SEEN
    moves[:, PAD] = np.arange(STATES)
    starts = np.zeros((STATES, CLASSES), np.uint8)
    starts[[START, START_SEEN], :PAD] = 1
    return classes, moves.ravel(), starts.ravel()


CLASS_OF, NEXT, STARTS = _tables()


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts' bytes, a column for each chunk; and each text's first chunk, with the end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(np.maximum(-(-sizes // CHUNK), 1))))
    laid = np.full(first[-1] * CHUNK, PAD, np.uint8)
    for text, at in zip(texts, (first[:-1] * CHUNK).tolist(), strict=True):
        laid[at : at + len(text)] = CLASS_OF[np.frombuffer(text, np.uint8)]
    return np.ascontiguousarray(laid.reshape(-1, CHUNK).T), first


def summaries(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each state, the state that each chunk ends in and the units that start in it."""
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], columns.shape[1], axis=1)
    units = np.zeros(state.shape, np.int64)
    some = np.zeros(state.shape, np.uint16)  # a chunk has no more bytes than this holds
    for row in columns:
        at = state * CLASSES + row
        some += STARTS[at]
        state = NEXT[at]
    units += some
    return state.astype(np.int64), units


def composed(ends: np.ndarray, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of each text from its start to the end of each of its chunks, by doubling."""
    ends, units = ends.copy(), units.copy()
    longest = int(np.diff(first).max(initial=1))
    own = np.repeat(first[:-1], np.diff(first))
    index, step = np.arange(ends.shape[1]), 1
    while step < longest:
        b = index[index - step >= own]
        a = b - step
        middle = ends[:, a]
        ends[:, b], units[:, b] = np.take_along_axis(ends[:, b], middle, 0), units[:, a] + np.take_along_axis(units[:, b], middle, 0)
        step *= 2
    return ends, units


def entered(ends: np.ndarray, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state in which each chunk is entered, and the units of its text that start before it."""
    state, before = np.roll(ends[START], 1), np.roll(units[START], 1)
    state[first[:-1]], before[first[:-1]] = START, 0
    return state, before


def found_starts(columns: np.ndarray, state: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where, in each chunk entered in a state, the unit of that rank within the chunk starts."""
    state, place, seen = state.astype(np.uint8), np.full(len(state), -1), np.zeros(len(state), np.int64)
    for k, row in enumerate(columns):
        at = state * CLASSES + row
        new = STARTS[at].astype(bool)
        place[new & (seen == ranks) & (place < 0)] = k
        seen += new
        state = NEXT[at]
    return place


def cut_places(texts: list[bytes], picks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Units of each text, whether it has a sentinel, and the bytes before each of its cuts.

    ``picks`` are whole numbers; a text of n units is cut after pick % (n + 1) of them.
    """
    columns, first = chunks_of(texts)
    ends, units = composed(*summaries(columns), first)
    state, before = entered(ends, units, first)
    n = units[START, first[1:] - 1]
    seen = ends[START, first[1:] - 1] >= START_SEEN
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    numbered = np.repeat(base, np.diff(first)) + before  # units of all texts before each chunk, never falling
    sizes = np.array([len(t) for t in texts], np.int64)
    places = []
    for pick in picks:
        after = pick % (n + 1)
        place = sizes.copy()
        inner = np.flatnonzero(after < n)
        chunk = np.searchsorted(numbered, base[inner] + after[inner], "right") - 1
        at = found_starts(columns[:, chunk], state[chunk], base[inner] + after[inner] - numbered[chunk])
        place[inner] = (chunk - first[inner]) * CHUNK + at
        places.append(place)
    return n, seen, places


def _picks(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned numbers from the first digits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, no more than ``GROUP`` bytes of a column at once, or one row."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.binary_length(batch.column(column))), dtype=np.int64)
        start = 0
        while start < len(batch):
            held = upto[start - 1] if start else 0
            stop = max(int(np.searchsorted(upto, held + GROUP, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


CUTS = "n long, seen boolean, cut1 long, cut2 long"


def _short(rows: DataFrame) -> DataFrame:
    """``rows`` with units, sentinel and cuts, read in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "text"):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            n, seen, places = cut_places(texts, [np.asarray(batch.column(c)) for c in ("h1", "h2")])
            new = [pa.array(n), pa.array(seen), pa.array(np.minimum(*places)), pa.array(np.maximum(*places))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n", "seen", "cut1", "cut2"])

    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", " + CUTS)


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """The same for texts that are dealt out in pieces; the pieces of one text, of at most 2^31 bytes, have a summary each."""
    rows = rows.withColumn("key", F.sha2(F.col("text"), 256))
    keyed = rows.select("key", "h1", "h2", F.col("text").cast("binary").alias("bytes")).dropDuplicates(["key", "h1", "h2"])
    slices = F.transform(F.sequence(F.lit(0), F.expr(f"cast((octet_length(bytes) - 1) div {piece} as int)")), lambda k: F.substring(F.col("bytes"), k * piece + 1, F.lit(piece)))
    # one copy of a text, whatever rows have it
    texts = rows.select("key", F.col("text").cast("binary").alias("bytes")).dropDuplicates(["key"])
    pieces = texts.select("key", F.posexplode(slices).alias("no", "part")).repartition("key", "no")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "part"):
            columns, first = chunks_of(batch.column("part").to_pylist())
            ends, units = (x[:, first[1:] - 1].T for x in composed(*summaries(columns), first))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(ends.tolist(), pa.list_(pa.int64())), pa.array(units.tolist(), pa.list_(pa.int64()))], ["key", "no", "ends", "units"])

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        first = np.array([0, len(table)])
        ends, units = composed(np.array(table["ends"].to_pylist()).T, np.array(table["units"].to_pylist()).T, first)
        state, before = entered(ends, units, first)
        size = len(table)
        return pa.table({"key": table["key"], "no": table["no"], "state": state, "before": before, "upto": units[START], "n": np.full(size, units[START, -1]), "seen": np.full(size, ends[START, -1] >= START_SEEN)})

    summed = cut(pieces.mapInArrow(summarise, "key string, no int, ends array<long>, units array<long>"))
    resolved = summed.groupBy("key").applyInArrow(resolve, "key string, no int, state long, before long, upto long, n long, seen boolean")
    wanted = keyed.select("key", "h1", "h2").join(resolved, "key").select("*", F.explode(F.array("h1", "h2")).alias("pick"))
    wanted = wanted.withColumn("after", F.col("pick") % (F.col("n") + 1)).withColumn("inner", F.col("after") < F.col("n"))
    holds = (F.col("inner") & (F.col("after") >= F.col("before")) & (F.col("after") < F.col("upto"))) | (~F.col("inner") & (F.col("no") == 0))
    wanted = cut(wanted.where(holds).select("key", "no", "state", (F.col("after") - F.col("before")).alias("rank"), "pick", "inner", "n", "seen").distinct())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "part"):
            columns, first = chunks_of(batch.column("part").to_pylist())
            own, outer, rank = (np.asarray(batch.column(c)) for c in ("no", "state", "rank"))
            # each piece is entered in its own state, so its chunks' functions are applied to that
            ends, units = composed(*summaries(columns), first)
            index = np.repeat(np.arange(len(batch)), np.diff(first))
            state, before = np.roll(ends, 1, axis=1)[outer[index], np.arange(ends.shape[1])], np.roll(units, 1, axis=1)[outer[index], np.arange(ends.shape[1])]
            state[first[:-1]], before[first[:-1]] = outer, 0
            holds = (before <= rank[index]) & (units[outer[index], np.arange(ends.shape[1])] > rank[index])
            chunk = np.flatnonzero(holds)
            place = found_starts(columns[:, chunk], state[chunk], rank[index[chunk]] - before[chunk])
            where = own[index[chunk]].astype(np.int64) * piece + (chunk - first[index[chunk]]) * CHUNK + place
            at = batch.take(pa.array(index[chunk]))
            yield pa.RecordBatch.from_arrays([at.column("key"), at.column("pick"), at.column("n"), at.column("seen"), pa.array(where)], ["key", "pick", "n", "seen", "place"])

    inner = wanted.where("inner").join(pieces, ["key", "no"]).mapInArrow(search, "key string, pick long, n long, seen boolean, place long")
    places = cut(inner.unionByName(wanted.where("not inner").select("key", "pick", "n", "seen", F.lit(None).cast("long").alias("place"))))
    one, two = (places.select("key", F.col("pick").alias(h), *[F.col(c).alias(f"{h}_{c}") for c in ("n", "seen", "place")]) for h in ("h1", "h2"))
    joined = rows.join(one, ["key", "h1"]).join(two, ["key", "h2"])
    whole = F.octet_length("text").cast("long")
    ends = [F.coalesce(F.col(f"{h}_place"), whole) for h in ("h1", "h2")]
    kept = [c for c in rows.columns if c != "key"]
    return joined.select(*kept, F.col("h1_n").alias("n"), F.col("h1_seen").alias("seen"), F.least(*ends).alias("cut1"), F.greatest(*ends).alias("cut2"))


def fill_in_middle(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output: a row for each document.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these with the
    suffix first. Null texts are empty; empty texts and those that hold a
    sentinel are plain. A null id is hashed as the word null. Repeated rows give
    the same row each; other columns are left out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    light_batches(docs.sparkSession, GROUP)
    h = _picks(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(f"h{k + 1}") for k, c in enumerate(h)])
    long = F.octet_length("text") > piece
    done = _short(rows.where(~long)).unionByName(_long(rows.where(long), piece))
    data = F.col("text").cast("binary")
    part = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    form = F.when((F.col("n") == 0) | F.col("seen") | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    parts = {"prefix": part(F.lit(0), F.col("cut1")), "middle": part(F.col("cut1"), F.col("cut2")), "suffix": part(F.col("cut2"), F.octet_length("text"))}
    shown = done.select("doc_id", "text", "n", form.alias("form"), *[p.alias(name) for name, p in parts.items()])
    said = lambda name: F.concat(F.lit(SENTINELS[name]), F.col(name))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(said("prefix"), said("suffix"), said("middle"))).otherwise(F.concat(said("suffix"), said("prefix"), said("middle")))
    chars = lambda name: F.when(F.col("form") != "plain", F.length(name).cast("long")).alias(f"{name}_chars")
    return shown.select("doc_id", "text", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text before it was rearranged: no part holds a sentinel, so they tell the parts."""
    joined = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    # an array of one, so that each text is split once
    return F.when(form == "plain", output).otherwise(F.transform(F.array(F.split(output, "<[PSM]>", -1)), joined)[0])


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows by lists of lines.
MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
  array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""
