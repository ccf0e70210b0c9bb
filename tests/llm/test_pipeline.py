import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [a + b for a in "ka lo mi ter un ves".split() for b in "ra so tin um el".split()]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(rng.randint(60, 130))]
        bad = i % 6 == 0
        text = " ".join(w.upper() + "%%##" if bad else w for w in words)
        rows.append((i, text, "en", f"src{i % 3 if i % 2 else 0}", len(text)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(1000 + k, rows[k][1] + " extra end", "en", "src1", 1) for k in range(1, 20)]
    rows += [(2000, None, None, None, None), (2001, "", "", "", 0), (None, rows[1][1] + " without id here", "en", None, 5), (3, *rows[3][1:]), (3, *rows[3][1:])]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "mix", "encode"]
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs.withColumn("score", F.lit("own")).withColumn("n_words", F.lit("own")), folder)
        assert out.columns == [*docs.columns, "score", "n_words"]
        assert out.where("score <> 'own' or n_words <> 'own'").count() == 0
        docs = out.select(*docs.columns).cache()
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema, k
    assert {i for i in ids[1] if i is not None and i < 300} == {i for i in range(300) if i % 6}
    assert not {2000, 2001} & set(ids[0])
    assert sorted(i for i in ids[2] if i is not None) == [i for i in range(300) if i % 6]
    assert ids[2].count(None) == 1
    kept = set(ids[3])
    assert kept < set(ids[2]) and len(ids[3]) > len(kept)  # some not taken, some taken twice or more


def test_run_encodes_what_the_mix_took(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)


def brute_mix(rows, weights=(5, 2, 1), limit=3):
    sizes = {}
    for _, source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        rest, all_weight = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / all_weight > limit * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / all_weight for s in free}
            break
        for s in over:
            target[s] = float(limit * sizes[s])
            free.remove(s)
    return sizes, target


def test_mix_meets_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["b", "a", "c", None, "d"] + ["a"] * 6)) for i in range(900)] + [(2000, None, "a"), (2001, "", "z"), (5, "w w", "a"), (5, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mix_sources(df, bucket_rows=50).collect()
    assert len(got) == len(rows)
    sizes, target = brute_mix([(r.doc_id, r.source, r["size"], 0) for r in got])
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert all(abs(r.target - target[source]) < 1e-6 * max(1, target[source]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[source]) <= 60
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] for r in mine)
        assert len({r.epochs for r in mine}) <= 2  # whole epochs, and one more for some
    again = mix_sources(df.repartition(2), bucket_rows=50).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mix_sources(df.limit(0)).count() == 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_one_row_of_a_repeated_id_stays(spark, folder):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "a"), (1, "other " + words[::-1], "b"), (1, words, "a"), (2, None, "a"), (None, words, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(tuple, corpus_pipeline.near_dedup(spark, df.repartition(n), folder).collect()), key=str) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_mix_of_very_long_texts_ties_and_columns_of_its_own_names(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "x" * 3_000_000, "b"), (3, None, "b"), (4, "", None)] + [(5, "same words here", "b")] * 40 + [(100 + i, "one two " * 5_000, "c") for i in range(80)]
    df = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], "doc_id long, text string, source string, size string, target string, skey string, bucket string")
    got = mix_sources(df, bucket_rows=20).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    for source in ("a", "b", "c"):
        mine = [r for r in got if r.source == source]
        largest = max(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= largest and all(r.taken in {k * r["size"] for k in range(4)} for r in mine)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df.repartition(5), bucket_rows=20).collect()), key=repr)
