import random
import zlib
from collections import defaultdict

from leafmill.llm.sharding import DIMS, kd_shards, metadata_points


def rows(n=1500):
    rng = random.Random(6)
    texts = ["copy " * 30] * 200 + ["x" * 40_000] + [" ".join(rng.choices(["é", "word", "中", "z"], k=rng.randint(1, 80))) for _ in range(n)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a"] * 5 + ["b", None])) for i, t in enumerate(texts)]
    return out + [(9000, None, None, None), (9001, "", "en", "a"), (7, texts[7], "en", "a"), (None, "no id", "en", "a")]


def test_shards_are_even_and_slots_gapless(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, lang string, source string, shard string").repartition(3)
    got = kd_shards(df, shards=6, slot_rows=40).collect()
    assert len(got) == len(data)
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _, _ in data)
    slots, sizes, places = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        places[r.text_crc32, r["size"]].add(r.shard)
    assert sorted(slots) == list(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.35 * min(sizes.values())  # one document is half a shard
    assert sum(len(p) > 1 for p in places.values()) <= 5  # no more groups divided than cuts made
    again = kd_shards(df.repartition(2), shards=6, slot_rows=40).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", "s"), (2, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.slot for r in kd_shards(df).collect()} <= {0, 1}
    assert kd_shards(df.limit(0)).count() == 0


def brute_tree(points, shards):
    """Shards of (doc_id, size) by a k-d tree built row by row."""
    span = lambda rows, c: max(r[c] for r in rows) - min(r[c] for r in rows)
    whole = {c: max(1, span(points, c)) for c in DIMS}

    def build(rows, k, first):
        if k == 1 or not rows:
            return {(r.doc_id, r["size"]): first for r in rows}
        widest = max(DIMS, key=lambda c: (span(rows, c) / whole[c], -DIMS.index(c)))
        goal = sum(r["size"] for r in rows) * (k // 2) / k
        left, total = [], 0
        ordered = sorted(rows, key=lambda r: (r[widest], r.spread))
        for r in ordered:
            if total + r["size"] >= goal:
                # a key that goes over the goal as a whole is cut by rows, the last to its nearer side
                if goal - total > 1e-6 and (total + r["size"] - goal <= 1e-6 or 2 * (goal - total) >= r["size"]):
                    left.append(r)
                break
            left.append(r)
            total += r["size"]
        return build(left, k // 2, first) | build(ordered[len(left) :], k - k // 2, first + k // 2)

    return build(points, shards, 0)


def test_equals_a_tree_built_row_by_row(spark):
    data = [r for r in rows(700) if r[0] is not None]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").dropDuplicates(["doc_id"]).cache()
    expected = brute_tree(metadata_points(df).collect(), 7)
    assert {(r.doc_id, r["size"]): r.shard for r in kd_shards(df, shards=7, slack=1e-12).collect()} == expected
