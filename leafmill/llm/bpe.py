"""Byte-level BPE encoding through a lexicon of frequent words, and decoding.

The words of a whole corpus are counted; the most frequent are merged once and
compiled into a minimal acyclic transducer (see ``lexicon``) that every task
maps into memory. A text is cut into words by vectorised rules, all its words
are looked up together, and those not in the lexicon are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, share_file
from leafmill.llm.lexicon import Lexicon, compile_lexicon
from leafmill.llm.shingles import span_hashes

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
#: Code points that Unicode calls white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First value past Unicode: ends a text; those after it stand for special tokens.
END = 0x110000
#: Characters, and rows of a batch, that are worked on together; a longer text is one piece.
CHUNK, ROWS = 1 << 18, 512
#: Counts below it have a step of the histogram each.
EXACT = 1 << 14


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(END)), np.uint8, END)
    table[WHITE] = SPACE
    return table


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where words begin in code points in which values from END on end texts.

    The words are those of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    kind = np.full(len(points) + 3, BREAK, np.uint8)
    inside = points < END
    kind[: len(points)][inside] = _classes()[points[inside]]
    start = np.ones(len(points) + 3, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    # of white space before a word the last character stands apart, and a blank joins the word
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quotes = np.flatnonzero(points == 0x27)
    quotes = quotes[start[quotes] & (kind[quotes + 1] == LETTER)]
    for j in quotes.tolist():
        tail = "".join(map(chr, points[j + 1 : j + 3][points[j + 1 : j + 3] < END]))
        n = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if n:
            start[j + 1 : j + 1 + n], start[j + 1 + n] = False, True
    return np.flatnonzero(start[: len(points)])


class Model:
    """Vocabulary and merges of a byte-level BPE file in the tokenizers format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {i: s.encode() for s, i in self.special.items()} | {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.single = [vocab[c] for _, c in sorted((b, c) for c, b in byte_of.items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        lengths = np.zeros(max(names) + 2, np.int64)
        for i, name in names.items():
            lengths[i + 1] = len(name)
        self.ends = np.cumsum(lengths)
        self.names = np.frombuffer(b"".join(names.get(i, b"") for i in range(max(names) + 1)), np.uint8)
        self.specials = sorted(self.special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: the pair of lowest rank first, leftmost on ties."""
        ids = [self.single[b] for b in word]
        merges = self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                got = merges.get((ids[i], ids[i + 1]))
                if got is not None and (best is None or got < best):
                    best, at = got, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, ids[i], ids[i + 1], got[1]) for i in range(n - 1) if (got := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (got[0], x, ids[x], ids[y], got[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        first, sizes = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        shift = first - (np.cumsum(sizes) - sizes)
        return self.names[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the ids from one end to the next."""
        raw = self.decode(ids).tobytes()
        edges = np.concatenate(([0], np.cumsum(self.ends[ids + 1] - self.ends[ids])))[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(edges)]


@cache
def _model(path: str) -> Model:
    return Model(path)


@cache
def _lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def _chunks(texts: list[str | None], model: Model) -> Iterator[tuple[list[np.ndarray], int]]:
    """Code points of whole texts, END after each, about CHUNK at a time; and the number of texts."""
    points, size = [], 0
    for text in texts:
        for piece in model.split.split(text or "") if model.split else [text or ""]:
            points.append(np.array([END + 1 + model.specials.index(piece)], np.uint32) if piece in model.special else np.frombuffer(piece.encode("utf-32-le"), np.uint32))
        points.append(np.array([END], np.uint32))
        size += len(text or "")
        if size >= CHUNK:
            yield points, sum(len(p) == 1 and p[0] == END for p in points)
            points, size = [], 0
    if points:
        yield points, sum(len(p) == 1 and p[0] == END for p in points)


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the text; start and length in it of each word; the word's first code point."""
    begin = word_starts(points)
    wide = np.where(points >= END, 0, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
    edge = np.concatenate(([0], np.cumsum(wide)))
    text = np.frombuffer(points[points < END].tobytes().decode("utf-32-le").encode(), np.uint8)
    at = edge[begin]
    return text, at, np.diff(at, append=edge[-1]), points[begin]


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n: how often each word of the BPE's word pattern is in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in _slices(batches):
            for points, _ in _chunks(batch.column(0).to_pylist(), model):
                text, at, size, first = _words(np.concatenate(points))
                at, size = at[first < END], size[first < END]
                if not len(at):
                    continue
                keys = span_hashes(text, at, at + size)
                _, one, n = np.unique(keys, return_index=True, return_counts=True)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + k] for i, k in zip(at[one].tolist(), size[one].tolist(), strict=True)], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, max_words: int = 100_000, max_bytes: int = 40) -> bytes:
    """The lexicon of the corpus's most frequent words of up to ``max_bytes``, ``max_words`` at most.

    All words are counted over all texts. A histogram of the counts gives the
    least count that no more than ``max_words`` words reach; only those come to
    the driver, with their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            ids = [model.merge(w.as_py()) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    # counts as they are up to EXACT, then in steps of a 64th of an octave
    step = F.when(F.col("n") < EXACT, F.col("n")).otherwise(EXACT + F.floor((F.log2(F.col("n").cast("double")) - F.log2(F.lit(float(EXACT)))) * 64)).cast("long")
    counts = cut(count_words(docs, path).where(F.length("word") <= max_bytes).select("word", step.alias("step")))
    least, reached = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        reached += r["words"]
        if reached > max_words:
            break
        least = r["step"]
    top = counts.where(F.col("step") >= least) if least is not None else counts.limit(0)
    found = top.select("word").repartition(8).mapInArrow(run, "word binary, ids array<int>").toArrow()
    words, ids = found.column("word").to_pylist(), found.column("ids").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    return compile_lexicon([words[i] for i in order], [ids[i] for i in order])


class Encoder:
    """Encodes texts with a lexicon; remembers up to ``keep`` unseen words."""

    def __init__(self, model: Model, lexicon: Lexicon, keep: int = 100_000) -> None:
        self.model, self.lexicon, self.keep = model, lexicon, keep
        self.memo: dict[bytes, list[int]] = {}

    def unseen(self, word: bytes) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.model.merge(word)
            if len(word) <= 64:
                if len(self.memo) >= self.keep:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some of the texts at a time, one after another, and the number of ids of each text."""
        for parts, n_texts in _chunks(texts, self.model):
            points = np.concatenate(parts)
            text, at, size, first = _words(points)
            row = self.lexicon.rows(text, at, size)
            row[first >= END] = -1
            seen = row >= 0
            count = np.zeros(len(row), np.int64)
            count[seen] = self.lexicon.lengths[row[seen]]
            raw, special = text.tobytes(), {END + 1 + i: [self.model.special[s]] for i, s in enumerate(self.model.specials)} | {END: []}
            rest = np.flatnonzero(~seen)
            extra = [special[p] if p >= END else self.unseen(raw[i : i + k]) for p, i, k in zip(first[rest].tolist(), at[rest].tolist(), size[rest].tolist(), strict=True)]
            count[rest] = [len(x) for x in extra]
            place = np.cumsum(count) - count
            out = np.empty(int(count.sum()), np.int32)
            lengths = count[seen]
            inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(place[seen], lengths) + inner] = self.lexicon.ids[np.repeat(self.lexicon.offsets[row[seen]], lengths) + inner]
            lengths = count[rest]
            inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(place[rest], lengths) + inner] = np.fromiter((i for x in extra for i in x), np.int32, int(lengths.sum()))
            ends = place[np.flatnonzero(first == END)]
            assert len(ends) == n_texts
            yield out, np.diff(ends, prepend=0)


def encode(docs: DataFrame, path: str, *, max_words: int = 100_000, decoded: bool = False) -> DataFrame:
    """``docs`` with a column ``ids``: the token ids of the whole text.

    Equal to the tokenizers library's without added special tokens, truncation
    or padding; special tokens written out in a text are found, as there. Null
    and empty texts have no ids. Other columns stay; an own column ``ids`` is
    replaced. With ``decoded``, a column of that name has the text that the ids
    give back, as :func:`decode` makes it. An empty table gives no rows.
    """
    data = build_lexicon(docs, path, max_words)
    name = share_file(docs.sparkSession, f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin", data)
    new = ["ids", "decoded"][: 1 + decoded]
    kept = [f for f in docs.schema.fields if f.name not in new]
    place = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        coder = Encoder(model, _lexicon(SparkFiles.get(name)))
        for batch in _slices(batches):
            done = 0
            for ids, sizes in coder(batch.column(place).to_pylist()):
                part = batch.slice(done, len(sizes))
                done += len(sizes)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array(model.texts(ids, ends), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "`ids` array<int>", "`decoded` string"][: len(kept) + len(new)])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with a column ``decoded``: the text of its column ``ids``.

    Special tokens are written out; bytes that are no UTF-8 become U+FFFD; null
    ids give an empty text.
    """
    kept = [f for f in tokens.schema.fields if f.name != "decoded"]
    place = [f.name for f in kept].index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in _slices(batches):
            lists = batch.column(place)
            sizes = np.array([len(x.values) if x.is_valid else 0 for x in lists], np.int64)
            texts = model.texts(np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "`decoded` string"])
    return tokens.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, and its ids if wanted."""
    done = encode(docs.select("doc_id", "text"), path, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )


def default_vocabulary(spark: SparkSession) -> str:
    """The BPE file that ``spark.leafmill.bpe`` names, else the installed public one."""
    named = spark.conf.get("spark.leafmill.bpe", "")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
