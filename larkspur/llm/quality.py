"""Compression classifier: text compressed against a dictionary of good and one of bad labelled text.

Every whole text is cut into blocks, each compressed twice with zstandard, once
per dictionary.  The difference of the two sizes over the text's size is the
evidence; a logistic fit on labelled texts that built no dictionary turns it
into a score.  Blocks keep a long text from compressing against itself, so the
evidence means the same at every length; the slope may vary with log length up
to a bound.

The fit sees a bounded hash sample of labelled rows (``per_class`` of each
label, a passage of ``passage`` characters of each); scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .sampling import class_sample, kept_out, piece

BLOCK = 2_000
DICTIONARY = 262_144
LEVEL = 3
DAMP = 100.0  # bytes added to a text's size, so that short texts give weak evidence
LONG = 7.5  # log size beyond which length no longer matters


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw samples where they are too few to train one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Sizer:
    """Compressed sizes of a text against two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(raw: bytes):
        kind = {"dict_data": zstandard.ZstdCompressionDict(raw)} if len(raw) >= 8 else {}
        if kind:
            kind["dict_data"].precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, **kind)

    def evidence(self, text: str | None) -> tuple[int, int]:
        """(bytes saved by the good dictionary over the bad one, bytes of the text)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.by)
        return bad - good, len(raw)


def _design(saved: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = 20.0 * saved / (size + DAMP)
    length = np.minimum(np.log(size + 50.0), LONG) - LONG
    return np.stack([np.ones_like(x), x, x * length, length], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the log loss; both labels weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2_400, passage: int = 2_000) -> tuple[bytes, bytes, np.ndarray | None, float]:
    """``(good dictionary, bad dictionary, weights, share of label 1)`` from a bounded sample.

    ``labels(doc_id, <label>)`` must be the rows that may be learned from.  Two
    thirds of the sampled texts build the dictionaries, the others the calibration.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    picked, counts = class_sample(rows, "y", "doc_id", per_class)
    picked = picked.groupBy("doc_id").agg(F.min("y").alias("y")).limit(4 * per_class)  # bounded: safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", piece(F.col("text"), F.col("doc_id"), passage).alias("t"))
    sample = texts.where("t <> ''").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t").alias("t")).orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id").limit(4 * per_class).collect()
    prior = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    of = [[r["t"] for r in sample if r["y"] == y] for y in (0, 1)]
    built = [[t.encode("utf-8", "surrogatepass") for t in ts[: 2 * len(ts) // 3]] for ts in of]
    bad, good = (_dictionary(b, DICTIONARY) for b in built)
    sizer, rest = Sizer(good, bad), [(t, y) for y in (0, 1) for t in of[y][2 * len(of[y]) // 3 :]]
    if len({y for _, y in rest}) < 2:
        return good, bad, None, prior
    seen = np.array([sizer.evidence(t) for t, _ in rest], dtype=float)
    return good, bad, _logistic(_design(seen[:, 0], seen[:, 1]), np.array([y for _, y in rest], dtype=float)), prior


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3, per_class: int = 2_400, passage: int = 2_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text, ..)``.

    Learns from about ``per_class`` rows of each label, ``passage`` characters of each.
    Null and empty texts score the share of label 1 among the labels (0.5
    without labels), as do all texts if only one label can be learned.  A row
    with a null doc_id is scored and never held out.  Repeated rows stay; other
    columns are ignored; an empty table gives an empty result.
    """
    good, bad, weights, prior = fit(docs, labels.where(F.col("doc_id").isNotNull() & ~kept_out(F.col("doc_id"), folds, fold)), label, per_class, passage)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(good, bad)
        for texts in batches:
            seen = np.array([sizer.evidence(t) for t in texts], dtype=float).reshape(-1, 2)
            value = np.full(len(seen), prior)
            if weights is not None:
                z = np.clip(_design(seen[:, 0], seen[:, 1]) @ weights, -35, 35)
                value = np.where(seen[:, 1] > 0, 1 / (1 + np.exp(-z)), prior)
            yield pd.Series(value)

    scored = docs.select("doc_id", kept_out(F.col("doc_id"), folds, fold).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
