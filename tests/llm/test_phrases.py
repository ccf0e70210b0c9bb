import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from leafmill.llm import phrases

SCHEMA = "lang string, text string, n long, phrase string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    counts, every = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            every[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in every:
        found = []
        frequent = {p: a for (x, p), a in counts.items() if x == lang and a >= least}
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * every[lang] // (frequent[p[:k]] * frequent[p[k:]]), k, frequent[p[:k]], frequent[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, every[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def corpus(seed, docs=60):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", "  ", "\t", ". ", ",", "\n", "; "]
    words = ["Alpha", "beta", "ÉCOLE", "д", "new", "york", "a-b", "x"]
    text = lambda: "".join(words[w] + marks[m] for w, m in zip(rng.integers(0, 8, 50) // rng.integers(1, 3, 50), rng.integers(0, 8, 50), strict=True))
    rows = [(["en", "de", None, "und"][rng.integers(0, 4)], text()) for _ in range(docs)]
    return [*rows, rows[0], rows[0], ("en", None), ("en", ""), ("fr", " \n. ,"), ("en", "rare words here")]


@pytest.mark.parametrize("width", [None, 7])
def test_phrases_equal_a_plain_count(spark, width):
    """Also with a sketch far too narrow to tell anything: then all is counted exactly."""
    rows = corpus(1)
    got = found(spark, rows, least=4, top=30, width=width)
    assert got == [r for r in brute(rows, 4, 30)] and len(got) > 60


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    rows = [(lang, ((text or "") + " ") * 4) for lang, text in corpus(2, 30)] + [("en", "no end " * 300), ("en", "w" * 5000)]
    whole = found(spark, rows, least=5, top=50)
    chunk = phrases.Chunk([(b"a b c d e f g", 4)], ["en"])
    assert [int(chunk.valid(k).sum()) for k in range(1, 6)] == [2] * 5
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "PART", 7)
    text = rows[0][1].encode()
    parts = list(phrases.parts_of(text))
    assert len(parts) > 5
    assert sum(int(phrases.Chunk([p], ["en"]).counted.sum()) for p in parts) == int(phrases.Chunk([(text, len(text))], ["en"]).counted.sum())
    for k in range(1, 6):
        assert sum(int(phrases.Chunk([p], ["en"]).valid(k).sum()) for p in parts) == int(phrases.Chunk([(text, len(text))], ["en"]).valid(k).sum())
    assert whole == brute(rows, 5, 50)


def test_bits_never_miss_what_is_frequent(spark):
    rows = spark.createDataFrame([(lang or "und", text or "") for lang, text in corpus(3)], "lang string, text string")
    bits = phrases.frequent_bits(rows, 100, 6)
    counted = {(r.lang, r.phrase): r.n for r in phrases.exact_counts(rows, 100, 6).where("words > 0").collect()}
    true = Counter()
    for lang, text in corpus(3):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = piece.split()
            true.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert counted == {p: a for p, a in true.items() if a >= 6}
    assert [len(b) for b in bits] == [13, 13]


def test_products_past_64_bits(spark):
    rows = spark.createDataFrame([("en", 2, "a b", 9 * 10**15), ("en", 1, "a", 9 * 10**15), ("en", 1, "b", 9 * 10**15), ("en", 0, "", 4 * 10**17)], phrases.GRAM_SCHEMA)
    exact = phrases.exact_counts
    phrases.exact_counts = lambda *a: rows
    try:
        got = found(spark, [("en", "a b")])
    finally:
        phrases.exact_counts = exact
    assert got == [("en", 1, "a b", 9 * 10**15, 9 * 10**15, 9 * 10**15, 4 * 10**17, 1000 * 4 * 10**17 // (9 * 10**15))]


def test_no_rows_of_an_empty_table(spark):
    assert found(spark, []) == [] == found(spark, [("en", None)])


def test_the_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = phrases.collocations(spark.read.parquet(f"{folder}/documents.parquet"), least=12)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(phrases.PHRASES_SQL.replace("{least}", "12")).fetchall())
