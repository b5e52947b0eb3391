"""Mixing to target weights by soft domain membership.

A classifier of the labelled table gives every document posteriors over the
domains; document rates w >= 0 are then fitted so that the expected tokens of
every domain, sum_d w_d tokens_d p_dk, meet the targets in least squares, by
projected gradient from w = 1.

The gradient of a document's rate is its posterior row times the residual of
the K domain totals (in the metric weighted by tokens), so one step needs K
sums over the documents and nothing else: w_d is the fold of the residuals so
far over p_d.  Each pass recomputes the rates from the short list of residuals
and returns K + K*K sums; no rate is ever stored, shuffled or collected, and a
lost executor costs one pass over a written table of K + 1 numbers a document.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .sampling import class_sample, piece

VOCABULARY = 3_000
DOMAINS = ["good", "toxic", "poor"]
#: Default target shares of tokens: mostly good, some poor, little toxic.
TARGETS = {"good": 0.94, "poor": 0.05, "toxic": 0.01}
#: Rows of the weight table for words outside the vocabulary, by shape: plain, capitals, symbols.
SHAPES = 3


DENSE = 7  # features besides the words


class DomainModel:
    """Multinomial logistic regression on which informative words a text has, and on the shapes of its words."""

    def __init__(self, domains: list[str], vocabulary: dict[str, int], weights: np.ndarray):
        self.domains, self.vocabulary, self.weights = domains, vocabulary, weights

    def features(self, words: list[str]) -> tuple[list[int], list[float]]:
        """(numbers of the informative words present, shape features)."""
        n, different = max(len(words), 1), set(words)
        get = self.vocabulary.get
        upper = sum(map(str.isupper, words)) / n
        bars = words.count("|") / n
        odd = sum([not w[-1].isalnum() and w[-1] not in ".,;:|" for w in words]) / n
        return [i for w in different if (i := get(w)) is not None], [1.0, 5 * upper, 5 * bars, 5 * odd, 3 * len(different) / n, 3 * (len(different) / n) ** 2, min(np.log(n + 1.0), 8.0) / 4]

    def score(self, words: list[str]) -> np.ndarray:
        present, dense = self.features(words)
        return self.weights[DENSE:][present].sum(axis=0) + np.array(dense) @ self.weights[:DENSE]

    def posterior(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of posteriors, and the number of words of each text."""
        cut = [(t or "").split() for t in texts]
        z = np.array([self.score(ws) for ws in cut]).reshape(-1, len(self.domains))
        z -= z.max(axis=1, keepdims=True, initial=-np.inf) if len(z) else 0.0
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), np.array([len(ws) for ws in cut], dtype=np.int64)


def _informative(texts: list[list[str]], y: np.ndarray, k: int, least: int = 4) -> dict[str, int]:
    """Words whose presence tells most about the domain (by mutual information), most telling first."""
    by: dict[str, np.ndarray] = {}
    for ws, d in zip(texts, y, strict=True):
        for w in set(ws):
            if w not in by:
                by[w] = np.zeros(k)
            by[w][d] += 1
    names = sorted(w for w, c in by.items() if c.sum() >= least)
    if not names:
        return {}
    on, size = np.stack([by[w] for w in names]), np.bincount(y, minlength=k).astype(float)
    gain = np.zeros(len(names))
    for part in (on, size - on):
        joint, alone = part / size.sum(), part.sum(axis=1, keepdims=True) / size.sum()
        expected = alone * size / size.sum()
        gain += np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0.0).sum(axis=1)
    best = np.argsort(-gain, kind="stable")[:VOCABULARY]
    return {names[i]: r for r, i in enumerate(best)}


def _regression(rows: list[tuple[list[int], list[float]]], y: np.ndarray, width: int, k: int, l2: float = 2e-4, steps: int = 250, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam on the mean log loss, every domain weighted alike."""
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    word = np.concatenate([np.array(r[0], dtype=np.int64) for r in rows]) if len(owner) else np.zeros(0, dtype=np.int64)
    dense = np.array([r[1] for r in rows])
    weight = 1.0 / (np.bincount(y, minlength=k)[y] * len(np.unique(y)))
    w, m, v = np.zeros((DENSE + width, k)), 0.0, 0.0
    target = np.eye(k)[y]
    for t in range(1, steps + 1):
        z = dense @ w[:DENSE]
        for c in range(k):
            z[:, c] += np.bincount(owner, w[DENSE + word, c], minlength=len(rows))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * weight[:, None]
        grad = l2 * w
        grad[:DENSE] += dense.T @ error
        for c in range(k):
            grad[DENSE:, c] += np.bincount(word, error[owner, c], minlength=width)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, per_class: int = 1_500, passage: int = 3_000) -> DomainModel:
    """Classifier of the labels' domains from a bounded sample: ``per_class`` texts, ``passage`` characters of each.

    Domains weigh alike in the fit; their shares among all labels are then put
    back as priors.  Without labels every posterior is equal.
    """
    y = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("poor")).when(F.col("quality") == 1, F.lit("good"))
    rows = labels.select("doc_id", y.alias("y"))
    picked, counts = class_sample(rows, "y", "doc_id", per_class)
    picked = picked.groupBy("doc_id").agg(F.min("y").alias("y")).limit(6 * per_class)  # bounded: safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", piece(F.col("text"), F.col("doc_id"), passage).alias("t"))
    sample = texts.where("t <> ''").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t").alias("t")).orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id").limit(6 * per_class).collect()
    k = len(DOMAINS)
    cut = [ws for r in sample if (ws := r["t"].split())]
    of = np.array([DOMAINS.index(r["y"]) for r in sample if r["t"].split()], dtype=np.int64)
    if not len(cut):
        return DomainModel(DOMAINS, {}, np.zeros((DENSE, k)))
    model = DomainModel(DOMAINS, _informative(cut, of, k), np.zeros((DENSE, k)))
    model.weights = _regression([model.features(ws) for ws in cut], of, len(model.vocabulary), k)
    model.weights[0] += np.log(np.array([counts.get(d, 0) for d in DOMAINS]) + 0.5)
    return model


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``docs`` with ``n_tokens`` (words of the whole text) and ``p`` (posteriors, one per domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, p array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        p, sizes = shared.value.posterior(list(texts))
        return pd.DataFrame({"n_tokens": sizes, "p": list(p)})

    rest = docs.drop("n_tokens", "p", "_m")
    return rest.withColumn("_m", run(F.col("text"))).select(*rest.columns, "_m.n_tokens", "_m.p")


def rates_of(p: np.ndarray, steps: np.ndarray, sure: float | None = None) -> np.ndarray:
    """Rates after the projected steps: w <- max(0, w - p . step), from w = 1.

    With ``sure`` they are chances: w is held to 1 at most, and one of at least
    ``sure`` counts as 1.
    """
    w = np.ones(len(p))
    for s in steps:
        w = np.clip(w - p @ s, 0.0, None if sure is None else 1.0)
    return w if sure is None else np.where(w >= sure, 1.0, w)


def step_of(residual: np.ndarray, gram: np.ndarray, scaled: bool) -> np.ndarray:
    """The gradient scaled by the inverse Gram matrix (with a small ridge), or by its largest eigenvalue."""
    if scaled:
        return np.linalg.solve(gram + 1e-3 * np.trace(gram) / len(gram) * np.eye(len(gram)), residual)
    return residual / np.linalg.eigvalsh(gram)[-1]


def fit_rates(members: DataFrame, targets: np.ndarray, rounds: int = 60, tolerance: float = 1e-4, sure: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the projected gradient that meet the target tokens per domain, and the totals they reach.

    ``members`` has ``n_tokens`` and ``p``.  A pass sums the domain totals of the
    present rates and the Gram matrix of the documents whose rate is not at its
    bound; the step is the gradient over that matrix's largest eigenvalue.

    With ``sure`` the rates are chances (see ``rates_of``), and the totals are
    those of the chances.  As no document can count more than once, the targets
    then give proportions, scaled to the total the domain with the greatest
    target has at present.  Totals that miss the targets after ``rounds`` are
    warned of.
    """
    k = len(targets)
    steps = np.zeros((0, k))

    def sums(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, gram = np.zeros(k), np.zeros((k, k))
            for b in batches:
                p = np.stack(list(b["p"])) if len(b) else np.zeros((0, k))
                n = b["n_tokens"].to_numpy(dtype=float)
                w = rates_of(p, steps, sure)
                total += (w * n) @ p
                gram += (p * (n * (w > 0))[:, None]).T @ p
            yield pd.DataFrame({"k": np.arange(k + k * k), "v": np.concatenate([total, gram.ravel()])})

        rows = members.select("n_tokens", "p").mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(k + k * k)
        for r in rows:
            v[r["k"]] = r["v"]
        return v[:k], v[k:].reshape(k, k)

    def missed(total: np.ndarray) -> np.ndarray:
        if sure is None:
            return total - targets
        anchor = int(np.argmax(targets))
        return total - targets * (total[anchor] / max(targets[anchor], 1e-9))

    total, gram = sums(steps)
    scaled = True

    def scale(total: np.ndarray) -> float:
        return max(float((targets if sure is None else total).sum()), 1.0)

    for _ in range(rounds):
        residual = missed(total)
        if np.abs(residual).max() <= tolerance * scale(total) or not gram.any():
            break
        new = np.vstack([steps, step_of(residual, gram, scaled)])
        found = sums(new)
        if scaled and np.linalg.norm(missed(found[0])) >= np.linalg.norm(residual):
            scaled = False  # the bounds change too much for the scaled step
            continue
        steps, (total, gram) = new, found
    short = float(np.abs(missed(total)).max()) / scale(total)
    if short > tolerance and total.any():
        warnings.warn(f"after {len(steps)} steps the domain totals {total.tolist()} miss their targets by up to {short:.2%} of all", stacklevel=2)
    return steps, total


def budgets(supply: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Target tokens per domain: the shares of what the scarcest wanted domain allows without repeating documents.

    A domain without any supply gets none and sets no bound.
    """
    wanted = (shares > 0) & (supply > 0)
    if not wanted.any():
        return np.zeros(len(shares))
    return np.where(wanted, shares, 0.0) * (supply[wanted] / shares[wanted]).min()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, scratch: Scratch | None = None, per_class: int = 1_500, rounds: int = 60, without: tuple[str, ...] = (), sure: float | None = None, passage: int = 3_000) -> DataFrame:
    """``docs`` with ``n_tokens``, ``p`` (posteriors of ``DOMAINS``) and ``rate`` (>= 0).

    ``without`` names columns the result need not carry; with ``sure`` the rates
    are chances of one draw, 1 from ``sure`` on.  ``targets`` are shares per
    domain, of the token budget that the scarcest domain allows (``budgets``).
    Null and empty texts have no tokens and a rate by their prior; without
    labels all posteriors are equal.  A document with several labels counts by
    its first domain name.  Rows, nulls and ties pass through; clashing columns
    are replaced; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    shares = np.array([(targets or TARGETS)[d] for d in DOMAINS], dtype=float)
    model = fit_domains(docs, labels, per_class, passage)
    members = scratch.keep(posteriors(docs.drop("rate"), model).drop(*without))
    have = members.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(len(DOMAINS))]).first()
    supply = np.array([have[i] or 0.0 for i in range(len(DOMAINS))])
    goal = budgets(supply, shares / shares.sum())
    steps, _ = fit_rates(members, goal, rounds, sure=sure)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(rates_of(np.stack(list(p)), steps, sure) if len(p) else [], dtype="float64")

    return members.withColumn("rate", rate(F.col("p")))


def sampled(rated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents drawn once each with their rate as chance; a rate of one (or more) is sure to stay.

    The draw is a hash of the key, so a retried task draws the same; a null key
    has one draw for all.
    """
    draw = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1_000_000_000)) / F.lit(1e9)
    return rated.where(F.col("rate") > draw)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rated = mixing_rates(docs, read_table(spark, sf_dir, "labels"), without=("text",))
    return rated.select("doc_id", "source", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")
