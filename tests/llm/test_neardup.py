import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import neardup
from leafmill.llm.components import connected_components
from leafmill.llm.neardup import near_duplicates
from leafmill.llm.shingles import PLAIN, shingle_set

SCHEMA = "doc_id long, text string, source string, rep long, node string"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, part=75, whole=100):
    """By whole sets; pairs at the threshold share one of the rarest shingles of each, so only such are compared."""
    sets = {i: shingles(text) for i, text in rows}
    times = Counter(s for found in sets.values() for s in found)
    low, holders = {i: i for i in sets}, {}

    def top(i):
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    for i in sorted(sets):
        rare = sorted(sets[i], key=lambda s: (times[s], s))[: len(sets[i]) - -(-part * len(sets[i]) // whole) + 1]
        for j in {j for s in rare for j in holders.get(s, ())}:
            common = len(sets[i] & sets[j])
            if whole * common >= part * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((top(i), top(j)))
                low[y] = x
        for s in rare:
            if times[s] > 1:
                holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = " ".join(rng.choices(words, k=40))
    for group in range(12):
        base = rng.choices(words, k=rng.randint(30, 160))
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            rows.append((n, text.upper() if group % 3 == 0 and n % 2 else text.replace(" ", "\t\n", 2)))
            n += 1
    for _ in range(30):
        rows.append((n, passage + " " + " ".join(rng.choices(words, k=60))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "É"), (n + 6, "é")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, small=4, piece=3).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}


def test_pairs_at_the_threshold_survive_branching(spark):
    rng, n, depth = np.random.default_rng(9), 2000, 6
    values = rng.integers(0, 1 << 30, (n, neardup.SIGNATURE), dtype=np.int32)
    other = np.where(rng.random(values.shape) < 0.75, values, rng.integers(0, 1 << 30, values.shape, dtype=np.int32))
    both = [x for pair in zip(values, other, strict=True) for x in pair]
    rows = [(i, i, 1, 0, x.tolist(), bytes(s)) for i, (x, s) in enumerate(zip(both, neardup.sketches(both).to_pylist(), strict=True))]
    sigs = spark.createDataFrame(rows, "rep long, component long, n long, whole_at int, sig array<int>, sketch binary").cache()
    start = F.explode(F.array(*[F.xxhash64(F.lit(j), F.col("sig")[j]) for j in range(neardup.OPENINGS)]))
    known = sigs.select(start.alias("node"), "rep", "component", "n", "sketch", "whole_at")
    own = (neardup.SIGNATURE - neardup.OPENINGS) // (depth - 1)
    for level in range(depth - 1):
        met = known.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        known = neardup._children(known.join(met, "node"), level * own, own).cache()
    pairs = known.groupBy("node").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1").select(F.explode("reps").alias("rep")).select(F.expr("rep div 2").alias("pair")).distinct().count()
    assert pairs == n


def test_a_large_group_below_the_threshold(spark):
    """2,000 sets of similarity 0.4 to 0.75 with each other, some of them linked."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4, 5])):
            text[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, small=300, piece=150).collect()}
    assert got == brute(rows)


def test_recall_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == expected


def test_hashes_of_self_similar_strings_differ():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    assert shingle_set(a)[0] != shingle_set(b)[0]
    long = " ".join(f"w{i % 997}" for i in range(2_200_000))  # over PLAIN bytes
    assert len(long) > PLAIN and len(shingle_set(long)) == 997


def test_very_long_and_clashing(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, 1, "x"), (2, long + " end", 2, "y"), (3, "short", 3, None)], "doc_id long, text string, rep long, node string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3)}
