import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import batching, clusters, jobs, matching, reflow
from leafmill.sources import layout


def fold(lengths, budget=2500, delimiter=9):
    batch, used, out = 0, 0, []
    for n in lengths:
        if used and used + n > budget:
            batch, used = batch + 1, 0
        used += n + delimiter
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 16])
def test_batches_equal_the_fold_at_any_block(spark, block):
    rng = np.random.default_rng(block)
    groups = {"mixed": rng.integers(0, 900, 150).tolist(), "none": [0] * 700, "ties": [1241, 1241, 1241] * 20, "large": [4000, 10, 4000, 2491, 0, 2500, 2500, 2501] * 6, None: [7, 2490, 1]}
    rows = [(g, 1_000_003 * i * i, n) for g, lengths in groups.items() for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(4)
    got = {(r.g, r.i): r.batch for r in batching.greedy_batches(df, "g", "i", "n", block=block).collect()}
    assert got == {(g, 1_000_003 * i * i): b for g, lengths in groups.items() for i, b in enumerate(fold(lengths))}


def test_ranks_of_sparse_ids(spark):
    rng = np.random.default_rng(1)
    ids = sorted({*rng.integers(-(2**63), 2**63, 300).tolist(), *range(50), -(2**63), 2**63 - 1})
    for some in (ids, ids[:1], list(range(10**12, 10**12 + 9000, 3))):
        df = spark.createDataFrame([(i, "b") for i in some], "i long, g string").repartition(3)
        ranks = layout.ranked(df.withColumn("near", layout.id_block(df, "i", 16)), ["g"], "near", ["i"], "rank")
        assert [r.i for r in ranks.orderBy("rank").collect()] == some and ranks.select("near").distinct().count() >= min(len(some) // 200, 2)


def brute_floors(boxes):
    out = {}
    for b, p, i, x0, x1, y0, h in boxes:
        below = [c[5] for c in boxes if c[:2] == (b, p) and c[2] != i and c[5] > y0 + 2 and c[4] > x0 and c[3] < x1]
        out[i] = min(h - 2, min(below) - 2 if below else h)
    return out


def test_floors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    boxes = []
    for page in range(4):
        for _ in range(60):
            x0 = float(rng.integers(0, 30 if page < 2 else 3000))
            boxes.append(("b", page, len(boxes), x0, x0 + float(rng.integers(1, 20 if page % 2 else 2000)), float(rng.integers(0, 40)), 300.0))
    boxes.append(("c", 0, len(boxes), 1.0, 2.0, 5.0, 300.0))
    df = spark.createDataFrame(boxes, "book string, page int, id int, x0 double, x1 double, y0 double, page_h double")
    assert {r.id: r.floor for r in matching.floors(df).collect()} == brute_floors(boxes)
    for crowded in (0, 59, 60, 1000):
        assert {r.id: r.floor for r in matching.floors(df, crowded=crowded).collect()} == brute_floors(boxes)
    assert matching.floors(df.limit(0)).count() == 0


def test_a_crowded_page_has_rows_in_proportion_to_its_boxes(spark):
    made = []
    for n in (1000, 4000):
        df = spark.range(n).select(F.lit("b").alias("book"), F.lit(0).alias("page"), "id", (F.pmod(F.xxhash64("id"), F.lit(5000)) * 1.0).alias("x0"), (F.col("id") * 1.0).alias("y0"), F.lit(1e6).alias("page_h"))
        df = df.withColumn("x1", F.col("x0") + 1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)))
        nodes = df.select(F.explode(matching._ranges_of_a_tree(F.col("x0"), F.col("x1"))))
        made.append(nodes.count() / n)
        assert matching.floors(df).count() == n
    assert made[1] <= 1.1 * made[0] <= 25


def test_images_go_after_what_begins_above_them(spark):
    flow = spark.createDataFrame([("b", 0, 0, 10.0), ("b", 0, 1, 20.0), ("b", 0, 2, 20.0), ("b", 1, 0, 50.0)], "book string, page int, par_no int, y0 double")
    images = spark.createDataFrame([("b", 0, 7, 20.0), ("b", 0, 8, 19.9), ("b", 0, 9, 5.0), ("b", 1, 10, 60.0), ("b", 2, 11, 1.0), ("b", 0, 12, 20.0)], "book string, page int, image_id long, y double")
    assert {r.image_id: r.anchor for r in matching.image_anchors(images, flow).collect()} == {7: 2, 8: 0, 9: None, 10: 0, 11: None, 12: 2}


def lloyd(x, centres, rounds, least_move):
    for _ in range(rounds):
        own = np.array([[((a - c) ** 2).sum() for c in centres] for a in x]).argmin(axis=1)
        means = np.array([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        moved, centres = np.sqrt(((means - centres) ** 2).sum(axis=1)).max(), means
        if moved <= least_move:
            break
    gaps = np.array([[((a - c) ** 2).sum() for c in centres] for a in x])
    return centres, np.bincount(gaps.argmin(axis=1), minlength=len(centres)), gaps.min(axis=1).sum()


def test_clusters_equal_plain_rounds_from_the_same_start(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3)
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], float)
    plain = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    starts = [clusters._start(plain, 4, 7 + a, "vec_id", "embedding") for a in range(3)]
    assert all(any((row == c).all() for row in x) for start in starts for c in start)
    tries = [lloyd(x, s, 20, 0.001) for s in starts]
    centres, sizes, cost = min(tries, key=lambda t: t[2])
    got, got_sizes, got_cost = clusters.k_means(table, least_move=0.001)
    order = np.argsort(-sizes, kind="stable")
    assert np.allclose(got, centres[order]) and got_sizes.tolist() == sizes[order].tolist() and np.isclose(got_cost, cost)


def test_few_points_give_few_clusters(spark):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [4.0, 6.0])], schema)
    centres, sizes, cost = clusters.k_means(same, 4)
    assert centres.tolist() == [[1.0, 2.0], [4.0, 6.0]] and sizes.tolist() == [5, 1] and cost == 0
    assert clusters.k_means(spark.createDataFrame([], schema))[1].tolist() == []


def test_the_largest_size_that_fits(spark):
    words = ["", "one", "some words to wrap", "a" * 40, "many words " * 12]
    rows = [(t, s, w, h) for t in words for s in (6.0, 9.5, 24.0) for w in (20.0, 60.0, 200.0) for h in (8.0, 30.0, 90.0)]
    df = spark.createDataFrame(rows, "t string, s double, w double, h double")
    got = [r[0] for r in df.select(batching.fitting_size(F.col("t"), F.col("s"), F.col("w"), F.col("h"))).collect()]

    def lines(text, width):
        done, used = 0, 0
        for w in text.split():
            if done and used + 1 + len(w) <= width:
                used += 1 + len(w)
            else:
                done, used = done + 1, len(w)
        return done

    def fits(t, halves, w, h):
        return lines(t, max(int(w // (halves / 2 * 0.55)), 1)) * (halves / 2) * 1.2 <= h

    for (t, s, w, h), found in zip(rows, got, strict=True):
        top = int(s * 2)
        bottom = min(top, -int(-max(6.0, s * 0.7) * 2 // 1))
        sizes = [k for k in range(top, bottom - 1, -1)]
        good = [fits(t, k, w, h) for k in sizes]
        assert good == sorted(good)  # what fits in one size fits in all smaller ones
        assert found == next((k for k, g in zip(sizes, good, strict=True) if g), bottom) / 2


SEARCHED = "book string, page long, line_no int, text string"


def search(heads, lines):
    """Page after page, as a reader would."""
    out, at = {}, {}
    for book, page, par, text in sorted(heads, key=lambda h: (h[0], h[1], h[2])):
        needle = " ".join(text.split())[:40].lower()
        bodies = {}
        for b, p, _, t in sorted(lines):
            if b == book:
                bodies[p] = (bodies[p] + " " + t) if p in bodies else t
        start = at.get(book, 0)
        found = next((p for p in sorted(bodies) if p >= start and needle and needle in " ".join(bodies[p].split()).lower()), start)
        out[book, page, par] = at[book] = found
    return out


@pytest.mark.parametrize("pages", [1, 4, 64])
def test_headings_are_found_anywhere_on_a_page(spark, pages):
    rng = np.random.default_rng(9)
    words = ["Contents", "the end", "Part one", "Ÿ", "x", "of  many"]
    lines, heads = [("b", 0, 0, "see CONTENTS."), ("b", 2, 0, "precontentsx"), ("b", 3, 0, "A very long heading that goes on and"), ("b", 3, 1, "on over its line end"), ("c", 9, 0, "contents")], []
    for page in range(4, 30):
        lines += [("b", page, k, " ".join(rng.choice(words, 4)) if k else f"page {page}") for k in range(2)]
        heads += [("b", page, k, str(rng.choice(words)) if k else f"Page {rng.integers(page - 3, page + 4)}") for k in range(3)]
    heads += [("b", 1, 0, "Contents"), ("b", 1, 1, "CONTENTS"), ("b", 3, 0, "a Very long heading that goes on and on over its line end"), ("b", 3, 1, " "), ("c", 9, 0, "not there"), ("c", 9, 1, "Contents"), ("d", 1, 0, "lost")]
    h = spark.createDataFrame(heads, "book string, page long, par_no int, text string").repartition(3)
    got = {(r.book, r.page, r.par_no): r.found for r in reflow.heading_pages(h, spark.createDataFrame(lines, SEARCHED), pages=pages).collect()}
    assert got == search(heads, lines)


def merge(rows):
    merged = []
    for page, kind, text in rows:
        if merged and kind == merged[-1][1] == "para" and page != merged[-1][0] and merged[-1][2].rstrip()[-1:] not in tuple('.!?…:»")') and text[:1].islower():
            last = merged[-1]
            last[2] = last[2][:-1] + text if last[2].endswith("-") and last[2][-2:-1].isalpha() else last[2] + " " + text
        else:
            merged.append([page, kind, text])
    return [(k, t) for _, k, t in merged]


@pytest.mark.parametrize("pages", [1, 2, 3, 64])
def test_merging_and_segments_equal_loops_at_any_block(spark, pages):
    rng = np.random.default_rng(pages)
    books, rows = {}, []
    for book in ("a", "b", None):
        own, page = [], 0
        for k in range(120):
            page += int(rng.integers(0, 3) == 0) + 4 * int(rng.integers(0, 20) == 0)
            kind = str(rng.choice(["para", "para", "para", "para", "h1", "h2"]))
            text = str(rng.choice(["lower", "lower", "lower", "Upper"])) + " " + str(rng.choice(["open", "open", "half-", "ends."]))
            own.append((page, kind, text))
            rows.append((book, page, k, kind, text, float(k)))
        books[book] = own
    df = spark.createDataFrame(rows, "book string, page int, par_no int, kind string, text string, y0 double").repartition(4)
    got = {}
    for r in reflow.merged_across_pages(df, pages).orderBy("flow_no").collect():
        got.setdefault(r.book, []).append((r.flow_no, r.kind, r.text))
    assert got == {b: [(i, *x) for i, x in enumerate(merge(own))] for b, own in books.items()}
    marked = {}
    for r in reflow.segments(df, pages).orderBy("par_no").collect():
        marked.setdefault(r.book, []).append((r.segment, r.unindented))
    for book, own in books.items():
        n, expected = 0, []
        for i, (_, kind, _) in enumerate(own):
            n += kind == "h1" and i > 0
            expected.append((n, kind == "para" and i > 0 and own[i - 1][1] != "para"))
        assert marked[book] == expected


def test_running_headers_are_gone_before_pages_are_joined(spark):
    from leafmill.plans.queries import flow_of

    line = lambda page, n, text, y: ("b", page, n, text, 50.0, 350.0, y, y + 12, 11.5, 600.0)
    rows = [line(0, 0, "Cover", 100.0), line(1, 0, "Title", 100.0)]
    for page in range(2, 7):
        rows += [line(page, 0, f"Chapter head {page}", 20.0), line(page, 1, "Long text of the page that goes on over its end", 100.0), line(page, 2, str(page), 580.0)]
    rows.append(line(7, 0, "Chapter head 7", 20.0))
    df = spark.createDataFrame(rows, "book string, page int, line_no int, text string, x0 double, x1 double, y0 double, y1 double, size double, page_h double")
    got = sorted((r.page, r.text) for r in flow_of(df, 0.25).collect())
    assert got == [(p, "Long text of the page that goes on over its end") for p in range(2, 7)]


def test_words_of_covers_are_put_right(spark):
    words = spark.createDataFrame([("НЛП", 0), ("Психология", 1), ("магия", 2)], "word string, ord int")
    rows = spark.createDataFrame([(1, "НАП: психалогия!"), (2, "МАГЫЯ"), (3, "другое  слово"), (4, ""), (5, "я НЛП")], "k int, t string")
    got = {r.k: (r.fixed, r.changed) for r in matching.corrected_texts(rows, ["k"], "t", words).collect()}
    assert got == {1: ("НЛП: Психология!", True), 2: ("МАГИЯ", True), 3: ("другое  слово", False), 5: ("я НЛП", False)}


def test_a_book_is_flagged_as_it_is_written(spark, tmp_path):
    lines = spark.createDataFrame([("1ГЛОР(23 тест",), ("good line of text",), ("abc",), ("a healthy line",)], "text string")
    done = jobs.built(lines, str(tmp_path / "book"), threshold=30.0)
    assert done == {"status": "done", "quality": {"total": 3, "suspect": 1, "garbled_percent": 33.3, "has_issues": True}}
    assert spark.read.parquet(str(tmp_path / "book")).count() == 4
    clean = jobs.built(lines.where("length(text) > 13"), str(tmp_path / "clean"), threshold=50.0)
    assert clean["quality"]["has_issues"] is False

    class Broken:
        @property
        def get(self):
            raise RuntimeError

    assert jobs.flag_of(Broken(), 5.0) is None


def test_rebuilds_take_the_last_translation_that_says_something(spark):
    cached = spark.createDataFrame([("A b", "one", 1), ("a-b", "two", 2), ("A b", "three", 3), ("c", "x", 4), ("c", " ", 5), ("d", "y", 6), (" ", "z", 7)], "text string, target string, ord int")
    rows = spark.createDataFrame([(1, "a B"), (2, "c"), (3, "D"), (4, " "), (5, "new")], "k int, text string")
    got = {r.k: (r.target, r.cached) for r in jobs.rebuilt(rows, cached).collect()}
    # "a-b" came after "A b" first came, so it answers for both; "c" has a blank target at last
    assert got == {1: ("two", True), 2: ("c", False), 3: ("y", True), 4: (" ", False), 5: ("new", False)}


def folder_of(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["w08_segments", "w03_cross_page", "p08_need_set", "t10_rebuild", "j14_heading_pages", "k04_book_plan"])
def test_no_texts_are_kept_between_steps(spark, tmp_path, name):
    from pathlib import Path

    from leafmill.plans.queries import QUERIES
    from leafmill.sources.checkpoints import work_folder

    rng = np.random.default_rng(1)
    text = lambda: "\n".join(["A short head", *(rng.bytes(150).hex() for _ in range(10))])
    folder = folder_of(spark, tmp_path / "sf", [(i, text(), "en", f"src{i % 2}", 3000) for i in range(400)])
    kept = Path(work_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in kept.rglob("*") if p.is_file())
    before = size()
    assert QUERIES[name](spark, folder).count() >= 396
    assert size() - before < 0.3 * 400 * 3000


def test_documents_of_one_id_are_pages_each(spark, tmp_path):
    from leafmill.plans.queries import QUERIES

    docs = [(i // 2, f"{chr(97 + i) * 70} is a text\nand goes on with {chr(97 + i) * 70}", "en", None, 80) for i in range(10)] + [(None, "No id has this one, which is a text as well", "en", None, 40)]
    rows = QUERIES["w02_paragraphs"](spark, folder_of(spark, tmp_path / "sf", docs)).collect()
    # the cover and the title page go; each other document is a page
    assert sorted(r.page for r in rows) == list(range(2, 11)) and len({r.text_md5 for r in rows}) == 9


def test_headings_that_jump_far_behind_are_followed(spark):
    """A common heading is on more pages than a block is given; a search that leaves these is done again with more."""
    common = lambda page: page % 3 == 0 and not 20 <= page < 700
    lines = [("b", page, 0, f"un. and page {page} of all" if common(page) else f"page {page} of all") for page in range(1000)]
    heads = [("b", page, 0, "un." if page % 5 else f"page {page} of") for page in range(1, 900, 7)]
    h = spark.createDataFrame(heads, "book string, page long, par_no int, text string")
    got = {(r.book, r.page, r.par_no): r.found for r in reflow.heading_pages(h, spark.createDataFrame(lines, SEARCHED), pages=4, reach=4).collect()}
    assert got == search(heads, lines)
