import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import middle

SCHEMA = "doc_id long, text string, n string, output string"


def brute(doc_id, text, seed=7):
    """One document by lists of lines."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def shown(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=repr)


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "<P>", "x\n<", "P>", "a<S>\nb\n", "<<M>", "<P\n>", "<PS>", "é\n日本\n𝒳", "\r\n\r", " \n \n", "line\n" * 700 + "<M>", "long " * 3000, "one line and more\n" * 900, "<P" + "\n" * 3000]


@pytest.mark.parametrize("piece", [1 << 16, 1500])
def test_cuts_equal_lists_of_lines(spark, piece):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 3)]
    rows += [rows[-1], (None, "a\nb\nc", "x", "y"), (None, None, "x", "y"), (900, "one line and more\n" * 900, "x", "y")]
    done = middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), piece=piece)
    assert shown(done) == sorted((brute(i, t or "") for i, t, *_ in rows), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in middle.digests(done).collect()) == sorted(sha(t or "") for _, t, *_ in rows)


def test_no_rows_of_an_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_functions_of_chunks_compose(spark):
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"a<PSM>\n"), 5 * middle.CHUNK + 77).tolist())
    whole, first = middle.chunks_of([text])
    ends, units = middle.composed(*middle.summaries(whole), first)
    for s in range(middle.STATES):
        state, n = s, 0
        for byte in text:
            at = state * middle.CLASSES + int(middle.CLASS_OF[byte])
            n, state = n + int(middle.STARTS[at]), int(middle.NEXT[at])
        assert (ends[s, -1], units[s, -1]) == (state, n)


def test_the_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    done = middle.digests(middle.fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, done.collect())) == sorted(con.execute(middle.MIDDLE_SQL).fetchall())


class Taken:
    """Stands for rows: gives the function that their batches go through."""

    dtypes = [("text", "string"), ("h1", "bigint"), ("h2", "bigint")]

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_of_large_texts_is_read_in_small_groups():
    texts = ["a line of it\n" * (3000 + k % 1000) for k in range(600)] + [""] * 3
    picks = [7 * k for k in range(603)]
    batch = pa.record_batch({"text": pa.array(texts), "h1": pa.array(picks), "h2": pa.array(picks[::-1])})
    got, most = [], 0
    tracemalloc.start()
    for out in middle._short(Taken())(iter([batch, batch.slice(0, 0)])):
        got += zip(*[out.column(c).to_pylist() for c in ("n", "seen", "cut1", "cut2")], strict=True)
        most = max(most, len(out) and sum(len(t) for t in out.column("text").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lines = [t.count("\n") for t in texts]
    assert got == [(n, False, *sorted(13 * (h % (n + 1)) for h in pair)) for n, pair in zip(lines, zip(picks, picks[::-1], strict=True), strict=True)]
    assert most <= 1 << 22 and peak < 8 * (1 << 22)


def test_batches_are_bounded_in_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for said, held in (("64m", "4194304b"), ("67108864b", "4194304b"), ("512k", "512k"), ("4096", "4096"), ("1mb", "1mb")):
            spark.conf.set(name, said)
            middle.fill_in_middle(spark.createDataFrame([], SCHEMA))
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)
