import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.functions import text as T
from leafmill.operators import batching, jobs, matching, reflow
from leafmill.plans.oracles import ORACLES
from leafmill.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def one(spark, expression, **values):
    names = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(expression).first()[0]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"a18_palette"} and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    place = {c[0]: i for i, c in enumerate(cursor.description)}
    assert sorted(place) == columns
    assert got == sorted((tuple(plain(r[place[c]]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got or name in ("p11_garble_lines", "t07_duplicate_texts")


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["book", "total", "suspect", "garbled_percent", "has_issues", "suspect_pages"]


@pytest.mark.parametrize(("text", "verdict"), [("", False), ("Глава 1. Введение", False), ("Гла)а 1. ,)еде-ие", True), ("34567 I", True), ("12", False), ("(Spoerl, 1975)", False), ("1ГЛОР(23", True), ("в 1990-х как-то", False), ("a,-b", True)])
def test_garble_rules(spark, text, verdict):
    assert one(spark, T.looks_garbled(F.col("t")), t=text) is verdict


def test_suspect_needs_two_junk_tokens(spark):
    assert one(spark, T.suspect_garble(F.col("t")), t="M8/ab 15;г п79;с8") is True
    assert one(spark, T.suspect_garble(F.col("t")), t="see http://x.example/a1 only") is False


def test_heading_levels(spark):
    for text, size, kind in [("Глава первая", 11.5, "h1"), ("Chapter one.", 11.5, "para"), ("Title", 22.0, "h1"), ("Title", 18.0, "h2"), ("Title", 15.0, "h3"), ("УДК 1", 30.0, "para"), ("x" * 81, 30.0, "para"), ("Chapters", 11.5, "para")]:
        assert one(spark, T.heading_level(F.col("s"), F.col("t"), F.lit(11.5)), s=size, t=text) == kind, text


def line(page, n, text, x0=50.0, x1=350.0, y0=None, size=11.5):
    y = 30.0 + 14 * n if y0 is None else y0
    return ("b", page, n, text, x0, x1, y, y + 12, size, 600.0)


LINE = "book string, page int, line_no int, text string, x0 double, x1 double, y0 double, y1 double, size double, page_h double"


def test_paragraphs_join_and_break(spark):
    rows = [line(0, 0, "Long first line of the text with маги-"), line(0, 1, "ей and more words to make it long"), line(0, 2, "short", x1=120.0), line(0, 3, "New after short"), line(0, 4, "indented", x0=90.0), line(0, 5, "after gap", y0=400.0), line(0, 6, "Big", size=30.0)]
    lines = spark.createDataFrame(rows, LINE)
    body = spark.createDataFrame([("b", 11.5)], "book string, body double")
    got = [(r.kind, r.text) for r in reflow.paragraphs(lines, body).orderBy("par_no").collect()]
    assert got == [("para", "Long first line of the text with магией and more words to make it long short"), ("para", "New after short"), ("para", "indented"), ("para", "after gap"), ("h1", "Big")]


def brute_merge(rows):
    merged = []
    for page, kind, text in rows:
        if merged and kind == merged[-1][1] == "para" and page != merged[-1][0] and merged[-1][2].rstrip()[-1:] not in tuple('.!?…:»")') and text[:1].islower():
            last = merged[-1]
            last[2] = last[2][:-1] + text if last[2].endswith("-") and last[2][-2:-1].isalpha() else last[2] + " " + text
        else:
            merged.append([page, kind, text])
    return [(k, t) for _, k, t in merged]


def test_merging_across_pages_equals_a_loop(spark):
    rows = [(1, "para", "one goes"), (2, "para", "on and"), (2, "para", "still the same"), (3, "para", "chain ends."), (3, "para", "lower here"), (3, "para", "same page stays"), (4, "para", "joins half-"), (5, "para", "word"), (5, "h1", "Head"), (6, "para", "after head"), (7, "para", "Capital")]
    df = spark.createDataFrame([("b", p, i, k, t, float(i)) for i, (p, k, t) in enumerate(rows)], "book string, page int, par_no int, kind string, text string, y0 double")
    got = [(r.kind, r.text) for r in reflow.merged_across_pages(df).orderBy("flow_no").collect()]
    assert got == brute_merge(rows)


def test_batches_at_the_edges(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([1000, 1000, 1000, 4000, 10, 0])] + [(None, 0, None)], "g string, i long, n long")
    got = {(r.g, r.i): r.batch for r in batching.greedy_batches(df, "g", "i", "n").collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 3, ("g", 5): 3, (None, 0): 0}


def test_nearest_words_keep_case_and_ties(spark):
    words = spark.createDataFrame([("магия", 0), ("Тело", 1), ("mail", 2), ("main", 3)], "word string, ord int")
    tokens = spark.createDataFrame([("МАГЯЯ",), ("тело",), ("maix",), ("qqqqqq",), ("ма",)], "token string")
    got = {r.token: r.fixed for r in matching.nearest_words(tokens, words).collect()}
    assert got == {"МАГЯЯ": "МАГИЯ", "тело": "тело", "maix": "mail", "qqqqqq": "qqqqqq", "ма": "ма"}


def test_translator_contract(spark):
    def odd(texts):
        if len(texts) > 1:
            return texts[:-1]
        if "bad" in texts[0]:
            raise RuntimeError
        return [" "] if "blank" in texts[0] else [texts[0].upper()]

    df = spark.createDataFrame([(1, "one"), (2, "bad two"), (3, "blank"), (4, "12 34"), (5, None)], "id long, source string").coalesce(1)
    assert {r.id: r.target for r in jobs.translated(df, odd).collect()} == {1: "ONE", 2: "bad two", 3: "blank", 4: "12 34", 5: ""}


def test_client_errors_stop_the_run(spark):
    def wrong(texts):
        raise jobs.ClientError("key")

    with pytest.raises(Exception, match="ClientError"):
        jobs.translated(spark.createDataFrame([(1, "one")], "id long, source string"), wrong).collect()


def test_resume_asks_for_the_rest_only(spark, tmp_path):
    log = tmp_path / "asked"

    def note(texts):
        with log.open("a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [t + "!" for t in texts]

    df = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id long, source string")
    saved = spark.createDataFrame([(str(i), f"saved {i}") for i in range(3)], "id string, target string")
    assert {r.id: r.target for r in jobs.resumed(df, saved, note).collect()} == {0: "saved 0", 1: "saved 1", 2: "saved 2", 3: "text 3!", 4: "text 4!", 5: "text 5!"}
    assert sorted(log.read_text().split("\n")[:-1]) == ["text 3", "text 4", "text 5"]


def test_a_missing_answer_leaves_the_source(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two")], "id long, source string").coalesce(1)
    assert {r.id: r.target for r in jobs.translated(df, lambda texts: [None, "II"]).collect()} == {1: "one", 2: "II"}


def test_drafts_stay_where_the_editor_fails(spark):
    def editor(pairs):
        if any("bad" in s for s, _ in pairs):
            raise RuntimeError
        return [None if "none" in s else d.upper() for s, d in pairs]

    rows = [(1, "s", "draft"), (2, "none", "kept"), (3, "s", " "), (4, None, None), (5, "bad " * 700, "d " * 700)]
    got = {r.id: r.target for r in jobs.proofread(spark.createDataFrame(rows, "id long, source string, draft string").coalesce(1), editor).collect()}
    assert got == {1: "DRAFT", 2: "kept", 3: " ", 4: "", 5: "d " * 700}


def test_secret_columns_are_hidden(spark):
    assert jobs.public_status(spark.createDataFrame([(1, "x", "k")], "job_id int, path string, _api_key string")).columns == ["job_id"]


def test_chunks_do_not_depend_on_their_size(spark):
    lines = spark.createDataFrame([line(p, 0, "x") for p in range(5)], LINE)
    assert [sum(r.lines for r in batching.page_chunks(lines, n).collect()) for n in (2, 99)] == [5, 5]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_whole_texts_are_translated_and_looked_up(spark, tmp_path):
    long = "Word " * 700 + "END"
    folder = documents(spark, tmp_path, [(0, f"{long}\n{long}\n{long}", "a"), (1, "12 34", "a"), (2, "Short", "a")])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r.id: r.target_md5 for r in QUERIES["l01_mock_translate"](spark, folder).collect()}
    assert got == {0: md5(f"[{long}\n{long}\n{long}]"), 1: md5("12 34"), 2: md5("[Short]")}
    got = {r.id: r.target for r in QUERIES["j01_translation_lookup"](spark, folder).collect()}
    assert got == {0: long.lower(), 1: long, 2: long, 3: "12 34", 4: "Short"}


def test_words_tokens_and_reuse_take_every_row(spark, tmp_path):
    folder = documents(spark, tmp_path, [(0, "a b\nc\nd-e", "one"), (2, "x y", "two"), (4, "X  y", "two"), (5, "x-y", "one"), (7, "other", "two")])
    got = {(r.book, r.page, r.line_num): r.text for r in QUERIES["a03_words_to_lines"](spark, folder).collect()}
    assert got == {("one", 0, 0): "a b", ("one", 0, 1): "c", ("one", 0, 2): "d-e", ("one", 1, 0): "x-y", ("two", 0, 0): "x y", ("two", 1, 0): "X y", ("two", 2, 0): "other"}
    tokens = [(r.k, r.core) for r in QUERIES["f06_token_split"](spark, folder).where("book = 'one' and page = 0 and line_no = 2").collect()]
    assert [core for k, core in sorted(tokens) if k != 1] == ["d", "e"]
    assert {r.doc_id: r.reused_from for r in QUERIES["j05_cache_reuse"](spark, folder).collect()} == {2: 5, 4: 5}


def test_cover_gate_counts_every_page_of_every_book(spark, tmp_path):
    rows = [(0, "b", "a\nb\n \n"), (3, "b", "c"), (4, "b", None), (6, "c", " \n"), (9, "c", "d\n\ne"), (10, "d", ""), (13, "d", "f"), (15, "e", "g\nh\ni")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["p27_cover_gate"](spark, str(tmp_path)).collect()
    given = sorted((r.doc_id, r.book, r.page, r.blocks, r.remake) for r in got if not r.book.startswith("literal"))
    assert given == [(0, "b", 0, 2, False), (3, "b", 1, 1, False), (4, "b", 2, 0, False), (6, "c", 0, 0, True), (9, "c", 1, 2, False), (10, "d", 0, 0, False), (13, "d", 1, 1, False), (15, "e", 0, 3, False)]
    assert {r.book for r in got if r.remake} == {"c", "literal picture", "literal null", "literal empty"}
