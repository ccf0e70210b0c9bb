import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe
from leafmill.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = list("ab'stmdrevl  \n\t\r,.!12é　\xa0中😀½²ß​_-<|") + ["<|endoftext|>", "'s", "'re", "'ll", " 's", "  ", "\n\n", "\x1c", "\x00"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(1500)] + ["", None, "xy" * 3000, "<|endoftext|>", "the the\n the "]


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 7))) for _ in range(500)} | {b"ending", b"sending", b"\xff\x00"})
    path = tmp_path / "x.bin"
    path.write_bytes(compile_lexicon(words, [[i, i + 1][: 1 + i % 2] for i in range(len(words))]))
    lexicon = Lexicon(str(path))
    probes = [*words, b"abcabcabcabc", b"z", b"endin", b"endings", b"\xff"]
    text = np.frombuffer(b"".join(probes), np.uint8)
    sizes = np.array([len(p) for p in probes])
    rows = lexicon.rows(text, np.cumsum(sizes) - sizes, sizes)
    known = {w: i for i, w in enumerate(words)}
    assert rows.tolist() == [known.get(p, -1) for p in probes]
    assert len(lexicon.base) < sum(map(len, words))


def library_ids(library, word):
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    names = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [t.id for t in library.model.tokenize("".join(names[b] for b in word))]


def test_long_words_merge_alike():
    model, library = bpe.Model(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choices(["the", "in", "a", "é", "x", "tion"], k=rng.randint(1, 60))).encode()
        expected = library_ids(library, word)
        assert model._merge_long([model.single[b] for b in word]) == expected
        assert model.merge(word) == expected


def test_equals_the_library(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", df_null()).repartition(3)
    library = Tokenizer.from_file(PATH)
    rows = bpe.decode(bpe.encode(df, PATH, max_words=400), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == expected, repr(texts[r.doc_id])
        assert r.decoded == library.decode(expected, skip_special_tokens=False)


def df_null():
    from pyspark.sql import functions as F

    return F.lit("own")


def test_digests_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (None, None), (3, "")], "doc_id long, text string")
    rows = bpe.token_digests(df, PATH).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert {(r.ids_sha256, r.decoded_sha256) for r in rows if not r.n_tokens} == {(none, none)}
    assert {r.ids_sha256 for r in rows if r.n_tokens} == {hashlib.sha256(b"15496,995").hexdigest()}
    assert bpe.token_digests(df.limit(0), PATH).count() == 0
