"""Collocations: phrases of two to five words that hang together, by language.

Two passes. The first adds every phrase of one to five words to a count-min sketch:
each task has one of its own, the sketches are added up slab by slab, and what is
kept of them is a bit for each counter that reaches the threshold. A sketch never
counts too little, so a phrase without all its bits is rare; the second pass counts
exactly those that have them, and drops the few that were only thought frequent.
Nothing frequent is lost. Parts of a frequent phrase are frequent, so the exact
counts hold all that scores and subsumption need.

Sketches have ``grams / (least / 2)`` counters a row and ``MOST_COUNTERS`` at most.
Beyond that more rare phrases reach the second pass, which costs time but changes
no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, small_batches

#: Longest phrase, rows of the sketch, counters of a slab, and counters of a row at most.
WORDS, ROWS, SLAB, MOST_COUNTERS = 5, 2, 1 << 16, 1 << 25
#: Bytes of texts that are looked at together, and words of a part of a longer text.
CHUNK, PART = 2 << 20, 250_000
BLANK, END = 1, 2
#: Phrases that are added at once to counters of 16 bits, none of which was above this number before.
STEP = 1 << 15
#: Bytes of texts to a task for each byte of its sketch, and at least; counted phrases that a task adds up before it returns them.
SHARE, LEAST_TEXT, HELD = 3, 32 << 20, 400_000
GRAM_SCHEMA = "lang string, words int, phrase string, n long"


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = BLANK
    kinds[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = END
    return lower, kinds


LOWER, KIND = _kinds()


def _starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    inside = np.concatenate(([False], KIND[data] == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def parts_of(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text, or parts of a long one with the four words after each, and where phrases to be counted may start."""
    if len(text) <= CHUNK:
        yield text, len(text)
        return
    starts, _ = _starts(np.frombuffer(text, np.uint8))
    for low in range(0, max(len(starts), 1), PART):
        at = int(starts[low]) if low else 0
        limit = int(starts[low + PART]) if low + PART < len(starts) else len(text)
        end = int(starts[low + PART + WORDS - 1]) if low + PART + WORDS - 1 < len(starts) else len(text)
        yield text[at:end], limit - at


class Chunk:
    """Words of some texts: their ids, languages, hashes and the phrases that start at each."""

    def __init__(self, texts: list[tuple[bytes, int]], langs: list[str]) -> None:
        joined = b"\n".join(t for t, _ in texts)
        data = LOWER[np.frombuffer(joined, np.uint8)]
        sizes = np.array([len(t) for t, _ in texts], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        starts, ends = _starts(data)
        own = np.searchsorted(offsets, starts, "right") - 1
        self.counted = starts < (offsets + np.array([limit for _, limit in texts]))[own]
        self.piece = np.cumsum(KIND[data] == END)[starts] if len(starts) else starts
        lengths = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(data[KIND[data] == 0].tobytes())])
        encoded = words.dictionary_encode()
        self.words, self.ids = encoded.dictionary, np.asarray(encoded.indices).astype(np.int64)
        self.langs, place = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = place[own]

    def valid(self, k: int) -> np.ndarray:
        """Whether a phrase of k words starts at each word, all in one piece."""
        ok = self.counted[: max(len(self.ids) - k + 1, 0)].copy()
        return ok & (self.piece[: len(ok)] == self.piece[k - 1 : k - 1 + len(ok)])

    def hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        """k, and a hash for each phrase of k words, whether it is valid or not."""
        of_words = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        of_langs = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in self.langs], np.uint64)
        if not len(self.ids):
            return
        one = mixed(of_words[self.ids] ^ of_langs[self.lang])
        h = one
        for k in range(1, WORDS + 1):
            if k > 1:
                size = max(len(one) - k + 1, 0)
                h = mixed(h[:size] * np.uint64(0x9E3779B97F4A7C15) + one[k - 1 : k - 1 + size])
            yield k, h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def counters(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch; rows use different halves of it."""
    half = h >> np.uint64(32) if row == 0 else h & np.uint64(0xFFFFFFFF)
    return (half * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    texts: list[tuple[bytes, int]] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in parts_of(text.as_buffer().to_pybytes()):
                if texts and held + len(part[0]) > CHUNK:
                    yield Chunk(texts, langs)
                    texts, langs, held = [], [], 0
                texts.append(part)
                langs.append(lang)
                held += len(part[0])
    if texts:
        yield Chunk(texts, langs)


def sketched(docs: DataFrame, width: int, least: int) -> DataFrame:
    """slab, bits: which counters of the merged sketch reach ``least``."""
    wide = np.uint16 if least < STEP else np.uint32
    kind = np.uint8 if least <= 255 else wide

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        for chunk in _chunks(batches):
            sketch = np.zeros((ROWS, width), wide) if sketch is None else sketch
            for k, h in chunk.hashes():
                h = h[chunk.valid(k)]
                for row in range(ROWS):
                    for at in range(0, len(h), STEP):
                        c = counters(h[at : at + STEP], row, width)
                        np.add.at(sketch[row], c, 1)
                        # once ``least`` is reached it does not matter by how much, and so nothing overflows
                        sketch[row][c] = np.minimum(sketch[row][c], least)
        if sketch is not None:
            for row in range(ROWS):
                for no, at in enumerate(range(0, width, SLAB)):
                    yield pa.RecordBatch.from_arrays([pa.array([row * (-(-MOST_COUNTERS // SLAB)) + no], pa.int32()), pa.array([sketch[row, at : at + SLAB].astype(kind).tobytes()], pa.binary())], ["slab", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["slab", "bits"])

        for batch in batches:
            for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if slab != last:
                    if last is not None:
                        yield bits()
                    last, total = slab, np.zeros(len(counts) // kind().itemsize, np.int64)
                total += np.frombuffer(counts, kind)
        if last is not None:
            yield bits()

    slabs = docs.mapInArrow(count, "slab int, counts binary").repartition("slab").sortWithinPartitions("slab")
    return slabs.mapInArrow(merge, "slab int, bits binary")


def frequent_bits(docs: DataFrame, width: int, least: int) -> list[bytes]:
    """A bit for each counter, row by row: MOST_COUNTERS / 8 bytes a row at most."""
    rows = cut(sketched(docs, width, least)).collect()
    each, found = -(-MOST_COUNTERS // SLAB), {r.slab: bytes(r.bits) for r in rows}
    empty = bytes(SLAB // 8)
    return [b"".join(found.get(row * each + no, empty) for no in range(-(-width // SLAB))) for row in range(ROWS)]


def _added(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal phrases of some tables as one."""
    summed = pa.concat_tables(tables).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
    return summed.rename_columns(["lang", "words", "phrase", "n"])


def exact_counts(docs: DataFrame, width: int, least: int) -> DataFrame:
    """lang, words, phrase, n: the phrases of one to five words that occur ``least`` times or more, and all words as phrase ''."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_bits(docs, width, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for table in counted(batches):
            held.append(table)
            if sum(map(len, held)) > 2 * HELD:
                held = [_added(held)]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches(max_chunksize=10_000)
        if held:
            yield from _added(held).to_batches(max_chunksize=10_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        bits = [np.frombuffer(b, np.uint8) for b in sent.value]
        for chunk in _chunks(batches):
            every = np.bincount(chunk.lang[chunk.counted], minlength=len(chunk.langs))
            rows = [(np.arange(len(chunk.langs)), np.full(len(chunk.langs), 0), pa.array([""] * len(chunk.langs), pa.large_binary()), every)]
            before = one = None
            for k, h in chunk.hashes():
                good = chunk.valid(k)
                if k > 1:
                    # a phrase is no more frequent than its parts; its first part has a number already
                    good &= (before[: len(good)] >= 0) & (one[k - 1 : k - 1 + len(good)] >= 0)
                at = np.flatnonzero(good)
                for row in range(ROWS):
                    c = counters(h[at], row, width)
                    at = at[(bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
                # numbers of phrases are told by those of the phrase before and of the last word: no hash decides here
                keys = (chunk.lang[at].astype(np.int64) * len(chunk.words) + chunk.ids[at]) if k == 1 else before[at] * len(chunk.words) + chunk.ids[at + k - 1]
                _, first, place, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                before = np.full(len(h), -1, np.int64)
                before[at] = place
                if k == 1:
                    # words past the counted part of a long text may end a phrase that is counted
                    one = np.where(chunk.counted, before, 0)
                here = at[first]
                names = pc.binary_join_element_wise(*[chunk.words.take(pa.array(chunk.ids[here + i])) for i in range(k)], pa.scalar(b" ", pa.large_binary())) if k > 1 else chunk.words.take(pa.array(chunk.ids[here]))
                rows.append((chunk.lang[here], np.full(len(here), k), names, n))
            for lang, words, phrase, n in rows:
                if len(n):
                    yield pa.table([pa.array(chunk.langs[lang].tolist(), pa.string()), pa.array(words.astype(np.int32)), phrase.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])

    partial = docs.mapInArrow(count, GRAM_SCHEMA)
    return partial.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _subphrase(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at, size), " ")


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, width: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations.

    Null texts are empty, null languages are ``und``; repeated rows count as
    often as they are there; other columns are left out; an empty table gives no
    rows. Ties go by count, then by the phrase's bytes.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if width is None:
        # about a word to six bytes, and five phrases to a word
        width = int(min(max(size / 6 * WORDS / (least / 2), SLAB), MOST_COUNTERS))
    # tasks have texts in proportion to their sketches, so that all sketches together stay a part of the texts
    rows = rows.coalesce(max(1, -(-size // max(SHARE * ROWS * width, LEAST_TEXT))))
    counts = cut(exact_counts(rows, width, least))
    every = counts.where("words = 0").select("lang", F.col("n").alias("all_words"))
    known = counts.where("words > 0").select("lang", "phrase", "n")
    cands = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cands.select("lang", "phrase", "a", "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _subphrase(F.col("w"), F.lit(1), F.col("k")).alias("left"), _subphrase(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(every, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    exact = cuts.withColumn("above", wide("a") * 1000 * wide("all_words")).withColumn("below", wide("l") * wide("r"))
    lowest = exact.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "all_words")).alias("lowest"))
    inner = F.flatten(F.transform(F.expr("sequence(2, words - 1)"), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _subphrase(F.col("w"), at, size))))
    longer = cands.where("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("lowest.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("lowest.l").alias("l"), F.col("lowest.r").alias("r"), F.col("lowest.all_words").alias("n"), F.col("lowest.score").alias("score"))


#: The same by counting all phrases.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM p),
e AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, range(1, 6) t(k) WHERE len(w) >= k),
c AS (SELECT lang, k, g, count(*) AS a, string_split(g, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= {least}),
t AS (SELECT c.lang, c.g, c.a, e.n, j, array_to_string(c.w[1:j], ' ') AS x, array_to_string(c.w[j + 1:], ' ') AS y FROM c JOIN e USING (lang), range(1, 5) t(j) WHERE j < k),
s AS (SELECT t.*, x.a AS l, y.a AS r, (1000::HUGEINT * t.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score FROM t JOIN c x ON x.lang = t.lang AND x.g = t.x JOIN c y ON y.lang = t.lang AND y.g = t.y),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
u AS (SELECT lang, sub, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[i:i + z - 1], ' ') FOR i IN range(1, k - z + 2)]) AS sub FROM c, range(2, 5) t(z) WHERE z < k) GROUP BY ALL),
f AS (SELECT m.* FROM m LEFT JOIN u ON u.lang = m.lang AND u.sub = m.g WHERE u.a IS NULL OR u.a < m.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score FROM f) WHERE rank <= 2000"""
