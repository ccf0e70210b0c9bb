import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import classifier, rules
from leafmill.llm.stats import COUNTS, FEATURES, drawn_ids, text_stats, with_stats


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(w.count(c) for w in words for c in "#*$%&|<>"), dup, len(covered)]


def some_texts():
    rng = random.Random(4)
    pieces = ["a", "b", "the", "é#", "中*", "|", "<b>", "&", "\n", "\n", "\t", " ", "x\x0b", " ", "end."]
    return ["".join(p + rng.choice(["", " "]) for p in rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(600)] + [None, "", " \n\n ", "a", "a a a a", "x y z x y z"]


def test_counts_equal_brute_force():
    for text in some_texts():
        counts, features = text_stats(text)
        assert counts == brute_counts(text), repr(text)
        assert len(features) == len(FEATURES) and np.isfinite(features).all()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice("alpha beta gamma delta rho tau sigma".split()) + str(rng.randrange(90)) for _ in range(rng.randint(55, 120))]
        rows.append((i, " ".join(words if good else [w.upper() + "$#*" for w in words]), "s", 1.0))
        if i % 3:
            labels.append((i, int(good), 0, "clash"))
    rows += [(1000, None, None, None), (1001, "", "s", 1.0), (1002, "one two", "s", 1.0), (None, "x " * 60, "s", 1.0), (1003, "a b c " * 40, "s", 1.0), (1003, "a b c " * 40, "s", 1.0)]
    labels += [(5000, 1, 0, "no such row"), (None, 1, 0, ""), (3, None, None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifier_holds_out_and_separates(tables):
    docs, labels = tables
    rows = classifier.classify(docs, labels).collect()
    truth = {r.doc_id: "$" not in (r.text or "") for r in docs.collect()}
    assert len(rows) == 406
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert bool(r.predicted) == truth[r.doc_id]


def test_classifier_without_rows(tables):
    docs, labels = tables
    assert classifier.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} <= {0.4995 + 0.0, 0.5, 0.4995}


def test_isotonic_pools_violators():
    fit = classifier.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1.0, 0.25, 0.9]))
    assert np.allclose(fit, [0.0, 0.5, 0.5, 0.9])


def test_rules_equal_brute_base_and_separate(tables):
    docs, labels = tables
    truth = {r.doc_id: r.text for r in docs.collect()}
    rows = rules.quality_rules(docs, labels).collect()
    assert len(rows) == 406
    for r in rows:
        counts = brute_counts(truth[r.doc_id])
        assert [r[c] for c in COUNTS] == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.base_failed == failed and r.kept <= (not failed)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.kept == ("$" not in truth[r.doc_id])
    assert rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_forest_is_monotone_and_flat_arrays_agree():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(FEATURES)))
    y = (x[:, FEATURES.index("symbols_per_word")] + 0.3 * rng.random(800) + 0.4 * x[:, 0] < 0.8).astype(float)
    forest = rules.grow_forest(x, y)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    assert ((forest(x) > 0.5) == (y > 0)).mean() > 0.9
    for name in rules.FALLING:
        f = FEATURES.index(name)
        grid = np.repeat(x[:20], 30, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 30), 20)
        steps = np.diff(forest.margin(grid).reshape(20, 30), axis=1)
        assert (steps <= 1e-9).all()


def test_ridge_equals_a_direct_solution(tables):
    docs, labels = tables
    stats = [(r.doc_id, text_stats(r.text)[1]) for r in docs.collect()]
    truth = {}
    for r in labels.collect():
        if r.quality in (0, 1):
            truth[r.doc_id] = max(r.quality, truth.get(r.doc_id, 0))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(x, truth[i]) for i, x in stats if i is not None and i in truth and fold(i) not in (0, 4)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    model = classifier.fit(with_stats(docs).select("doc_id", "stat_features"), labels)
    f = model.features(x)
    penalty = np.full(f.shape[1], 1e-3 * len(y) / (f.shape[1] - 1))
    penalty[-1] = 1e-9
    assert np.allclose(model.raw(x), f @ np.linalg.solve(f.T @ f + np.diag(penalty), f.T @ y), atol=1e-6)


def test_drawn_ids_are_bounded_and_of_no_held_out_row(spark):
    rows = [(i, i % 2) for i in range(5000)] + [(7, 1), (None, 1), (9001, None), (9002, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    usable = {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5}
    whole = [r.doc_id for r in drawn_ids(labels, "quality", 10_000).collect()]
    assert set(whole) == usable and len(whole) == len(usable)
    drawn = [sorted(r.doc_id for r in drawn_ids(labels.repartition(n), "quality", 1000).collect()) for n in (1, 3)]
    assert drawn[0] == drawn[1] and set(drawn[0]) < usable and 850 < len(drawn[0]) < 1150
    assert drawn_ids(labels.limit(0), "quality", 10).count() == 0


def test_scores_of_one_pass_are_those_of_two(spark, tables):
    docs, labels = tables
    docs = docs.unionByName(spark.createDataFrame([(9000, "first" + " more" * 300_000, "s", 1.0), (9001, "y" * 2_000_000, None, None)], docs.schema))
    stats = with_stats(docs)
    of = lambda df, *columns: sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)
    forest = rules.fit(stats, labels)
    one = of(rules.judge_texts(docs, forest), *COUNTS, "base_failed", "kept", "rule_score")
    assert one == of(rules.judge(stats, forest), *COUNTS, "base_failed", "kept", "rule_score") and len(one) == 408
    long = {r[0]: r for r in one if r[0] in (9000, 9001)}
    assert long[9000][1:6] == (300_001, 1_200_005, 0, 0, 300_000) and long[9001][1:6] == (1, 2_000_000, 0, 0, 0)
    model = classifier.fit(stats, labels)
    scored = classifier.score_texts(docs, model)
    assert of(scored, "score", "predicted") == of(classifier.score(stats, model), "score", "predicted")
    assert set(docs.columns) <= set(scored.columns)  # an own column score gives way to the score
