import random
import time
import zlib

import numpy as np
import pytest

from larkspur.llm import langid
from larkspur.llm.common import read_table

DATA = "/root/testdata/sf0.01"


def norm(text):
    """By definition: lower case, every run of other than letters one blank, UTF-8."""
    out = ""
    for c in text.lower():
        if c.isalpha():
            out += c
        elif not out or out[-1] != " ":
            out += " "
    return out.encode()


def slow_phrases(text, training):
    """Greedy parse into longest substrings of the training text, by definition."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in training:
            n += 1
        count, i = count + 1, i + n
    return count


def test_normalised_bytes():
    for t in ["", " ", "a", "  A b1c..Ü", "x\ud800y", "日本 語", "1", "a²b", "İ"]:
        got, has = langid.normalised(t)
        assert got.tobytes() == norm(t.replace("\ud800", " ")) and has == any(c.isalpha() for c in t.lower()), t


@pytest.mark.parametrize("length", [900, 9_000])
def test_phrases_equal_brute_force(length):
    """Also of texts of many blocks, of repeated patterns, and of bytes that no language has."""
    rng = random.Random(4)
    train = {"aa": "".join(rng.choices("abcd ", k=400)), "bb": "".join(rng.choices("cdef é", k=300)), "cc": "abab abba", "dd": "日本語 本 日日"}
    parser = langid.CrossParser(train)
    texts = ["".join(rng.choices("abcdefgé ,1日本", k=rng.randint(0, length))) for _ in range(40)] + ["ab" * (length // 2), "abababb" * (length // 7), "z" * length, "abba " * (length // 5), train["aa"] * (length // 400), "1" * length]
    got, size, letter = parser.phrases(texts)
    for t, row, n, has in zip(texts, got, size, letter, strict=True):
        codes = norm(t)
        assert n == len(codes) and has == any(c.isalpha() for c in t)
        for lang, c in zip(parser.langs, row, strict=True):
            assert c == slow_phrases(codes, norm(train[lang]))


def test_packed_automaton_accepts_its_substrings():
    rng = random.Random(8)
    text = bytes(rng.choices(b"abcdefg", k=3_000))
    owner, target, first = langid.packed(langid.automaton(list(text)))
    for _ in range(500):
        i = rng.randrange(2_990)
        part = text[i : i + rng.randint(1, 10)] if rng.random() < 0.5 else bytes(rng.choices(b"abcdefgh", k=4))
        state, ok = int(first[part[0]]), first[part[0]] > 0
        for c in part[1:]:
            ok = ok and owner[state + c] == state
            state = int(target[state + c]) if ok else 0
        assert ok == (part in text)


def test_large_alphabets():
    """Languages of 400 letters each, none of them shared, and many languages at once."""
    rng = random.Random(1)
    alphabets = [[chr(0x4E00 + 400 * k + i) for i in range(400)] for k in range(6)]
    words = [["".join(rng.choices(a, k=2)) for _ in range(500)] for a in alphabets]
    parser = langid.CrossParser({f"l{k}": " ".join(rng.choices(w, k=5_000)) for k, w in enumerate(words)})
    texts, want = zip(*[(" ".join(rng.choices(words[k % 6], k=30)), f"l{k % 6}") for k in range(200)], strict=True)
    assert parser.predict(list(texts))[0] == list(want)


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows = []
    for k in range(130):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)]
        rows += [(200 * k + i, " ".join(rng.choices(words, k=40)), f"l{k:03d}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, folds=1, fold=5).collect()
    assert len({r.lang_pred for r in got}) == 130 and all(r.lang == r.lang_pred for r in got)


def test_ties_go_to_the_first_language():
    parser = langid.CrossParser({"b": "same text", "a": "same text"})
    assert parser.predict(["same text", "zz"])[0] == ["a", "a"]


def test_long_text_in_reasonable_time():
    parser = langid.CrossParser({"a": "some words of a language " * 100, "b": "andere worte einer sprache " * 100})
    t = time.time()
    assert parser.predict(["words of some language " * 100_000, "abab" * 200_000])[0][0] == "a"
    assert time.time() - t < 30


def test_held_out_accuracy(spark):
    docs = read_table(spark, DATA, "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == docs.count()
    held = [r for d, r in got.items() if zlib.crc32(str(d).encode()) % 4 == 2 and r.lang and any(c.isalpha() for c in r.text)]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 ,. 45", "en", None), (None, "words here", None, "x"), (4, "the of and the", "en", "x"), (4, "the of and the", "en", "x"), (5, "der und die das " * 100_000, "de", "x")]
    df = spark.createDataFrame(rows, schema)
    got = langid.identify(df, folds=1, fold=5).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and len(got) == 7
    assert got[4].lang_pred == "en" and got[6].lang_pred == "de"
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
