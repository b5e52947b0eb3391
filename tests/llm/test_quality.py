import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from larkspur.llm import quality
from larkspur.llm.common import read_table
from larkspur.llm.sampling import kept_out

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, DATA, "documents"), read_table(spark, DATA, "labels")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[d].predicted, q) for d, q in truth.items() if d in got and got[d].held_out]
    right = [np.mean([p == q for p, q in held if q == k]) for k in (0, 1)]
    assert min(right) > 0.7 and np.mean(right) > 0.85


def test_scores_equal_sizes_by_the_library(spark):
    """Every whole text compressed anew, block by block, with the learned dictionaries."""
    docs, labels = read_table(spark, DATA, "documents"), read_table(spark, DATA, "labels")
    learned = labels.where(~kept_out(F.col("doc_id"), 5, 0))
    good, bad, weights, prior = quality.fit(docs, learned)
    made = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (good, bad)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_scores(docs, labels).collect():
        raw = (texts[r.doc_id] or "").encode()
        size = [sum(len(c.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK)) for c in made]
        x = 20 * (size[1] - size[0]) / (len(raw) + quality.DAMP)
        n = min(math.log(len(raw) + 50), quality.LONG) - quality.LONG
        want = 1 / (1 + math.exp(-min(35, max(-35, weights @ [1, x, x * n, n])))) if raw else prior
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3), r.doc_id


def test_ties_and_clashing_columns(spark):
    """Equal texts score alike; a score of exactly the threshold is predicted 1."""
    schema = "doc_id long, text string, score string, predicted string, held_out string"
    docs = spark.createDataFrame([(k, "the same text of some words", "x", "y", "z") for k in range(4)] + [(9, "", "x", "y", "z")], schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels, folds=1, fold=5, threshold=0.5).collect()}
    assert len({got[k].score for k in range(4)}) == 1 and got[9].score == 0.5 and got[9].predicted == 1


def test_odd_rows(spark):
    schema = "doc_id long, text string, quality string, held_out string"
    rows = [(1, None, "x", None), (2, "", "x", "y"), (None, "some words", None, None), (3, "a" * 2_000_000, "x", "x"), (3, "a" * 2_000_000, "x", "x")]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (3, 1, 1), (3, 0, 1)], none.schema)):
        got = quality.quality_scores(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_calibration_follows_the_labels():
    rng = np.random.default_rng(0)
    x = np.stack([np.ones(400), rng.normal(size=400)], axis=1)
    w = quality._logistic(x, (x[:, 1] + rng.normal(0, 0.1, 400) > 0).astype(float))
    assert w[1] > 1


def test_longer_texts_are_read_whole():
    sizer = quality.Sizer(b"", b"")
    assert sizer.evidence("ab" * 500_000) == (0, 1_000_000)


@pytest.mark.parametrize("samples", [[], [b"x"], [b"abc" * 50] * 3])
def test_dictionary_of_few_samples(samples):
    quality.Sizer(quality._dictionary(samples, 1000), b"").evidence("abc")
