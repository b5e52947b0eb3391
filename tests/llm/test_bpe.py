import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import bpe


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(2)
    pools = ["abcdefghijklmnop qrstuvwxyz", "eaithnsr dlu", "äöüß éèñ", "0123456789 ,.;!?'", "ΑΣσς Ωабв", "日本語 한국", "😀🏽‍👍 ́̈", "\t\n\x0b\x0c\r\x1c\x1d\x85\xa0 　​﻿", "<|startoftext|> <|endoftext|>", "it's we'LL I'd İIıſK"]
    yield from ["", " ", "the quick brown fox", "<|endoftext|>x<|startoftext|><|endoftext", "ΟΔΟΣ ΣΑΣ", "a" * 5000, "hahaha" * 700, "<" * 300, "</w> </w>x", "unbelievable internationalisation", "Ǻ ﬁ Å"]
    for _ in range(1500):
        yield "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 60)))
    for _ in range(1500):
        yield " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "tion", "ing", "a", "z", "q"]) for _ in range(rng.randint(1, 8))) for _ in range(8))


def test_matches_library(model, library):
    some = list(texts())
    got = model.encode(some)
    for t, ids, want in zip(some, got, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert ids == want.ids, t
        assert model.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_path_is_used(model):
    model.forget()
    words = {w for t in texts() for w in model.words(t)}
    failed = model.learn(words)
    assert 0 < failed < len(words) / 2


def test_compatibility_is_exact(model):
    import numpy as np

    rng = random.Random(8)
    inner, final = sorted(model.inner.values()), sorted(model.final.values())
    a = [rng.choice(inner) for _ in range(4000)]
    b = [rng.choice(inner if rng.random() < 0.5 else final) for _ in range(4000)]
    got = model.compatible(np.array(a), np.array(b))
    for x, y, ok in zip(a, b, got, strict=True):
        s, t = model.token[x], model.token[y]
        body = t.removesuffix(model.end)
        assert ok == (model._merged(model._symbols(s + body, body != t)) == [x, y])


def test_dataframe(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "The same", None), (3, "The same", None), (None, "Ünïcode <|endoftext|> x", "c"), (5, "long word " * 50_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.bpe_decode(bpe.bpe_encode(df)).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert [list(r.ids) for r in got] == want
    assert [r.decoded for r in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.bpe_encode(df.limit(0)).count() == 0
