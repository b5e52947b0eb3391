"""Language identification by cross-parsing entropy.

A suffix automaton over each language's labelled text yields, from any place of
a new text, the longest match in that language; parsing the text greedily into
such matches gives its phrases.  The fewer phrases per byte, the lower the
cross entropy: the language with the fewest normalised phrases wins.

Texts are parsed as UTF-8, lower-cased, a run of anything but letters as one
blank: the alphabet is that of bytes whatever letters a language has.  The
automata are packed into one table by displaced rows: the transition of state
``s`` on byte ``c`` lies at ``s + c`` and names its owner, so the table grows
with the transitions and not with states times bytes.  A step that finds a
foreign owner ends the phrase.  All texts of a batch are parsed in step, one
lookup per byte and language.

Long texts are parsed in blocks of ``BLOCK`` bytes side by side.  Each starts
in the state that parsing the ``LEAD`` bytes before it gives; blocks whose start
is not the state their predecessor ends in are parsed again until all agree, so
the phrases are those of one parse of the whole text.

Training reads a bounded hash sample: of every language about ``per_lang``
passages of ``passage`` characters, at most ``chars`` characters together.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .sampling import class_sample, kept_out, piece

BLOCK = 1_024
LEAD = 64
SLICE = 2_000_000
UNKNOWN = "und"
_LONE = re.compile("[\ud800-\udfff]")
_LETTER: list[np.ndarray] = []


def normalised(text: str) -> tuple[np.ndarray, bool]:
    """The bytes that are parsed, and whether there is a letter among them."""
    if not _LETTER:  # by code point; made once a process
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    points = np.frombuffer(_LONE.sub(" ", text.lower()).encode("utf-32-le"), dtype=np.uint32)
    letter = _LETTER[0][points]
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    kept = np.where(letter, points, 32)[keep].astype(np.uint32)
    return np.frombuffer(kept.tobytes().decode("utf-32-le").encode(), dtype=np.uint8), bool(letter.any())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, state by state; 0 is the root."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(step)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def packed(step: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, target, first)`` of an automaton whose states are renamed to the places of their rows.

    ``target[s + c]`` holds for ``s`` if ``owner[s + c] == s``.  The root has no
    row: ``first[c]`` is where a phrase that starts with ``c`` leads to, 0 (the
    root) if none does.  Rows go to the first place that is free for all of
    their bytes, the longest first; no two have the same place.
    """
    width = max(256, 2 * sum(map(len, step)) + len(step) + 512)
    free, unused = (1 << width) - 1, (1 << width) - 2  # bit sets of slots, and of places (0 is the root's)
    place = [0] * len(step)
    order = sorted(range(1, len(step)), key=lambda s: -len(step[s]))
    low = 0  # no place below is unused, no slot below free
    for s in order:
        able = unused >> low
        for c in step[s]:
            able &= free >> (low + c)
        at = low + (able & -able).bit_length() - 1
        place[s] = at
        unused ^= 1 << at
        for c in step[s]:
            free ^= 1 << (at + c)
        if not s & 255:
            low = max(0, min((unused & -unused).bit_length() - 1, (free & -free).bit_length() - 256))
    size = max(place, default=0) + 256
    owner, target = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    for s in order:
        for c, t in step[s].items():
            owner[place[s] + c], target[place[s] + c] = place[s], place[t]
    first = np.zeros(256, dtype=np.int32)
    for c, t in step[0].items():
        first[c] = place[t]
    return owner, target, first


class CrossParser:
    """Phrase counts of texts against each language's automaton."""

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        found = [packed(automaton(normalised(training[lang])[0].tolist())) for lang in self.langs]
        sizes = [len(owner) for owner, _, _ in found]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        # States are counted through all languages; a language's root is its start, which owns nothing.
        self.owner = np.concatenate([np.where(o >= 0, o + b, -1) for (o, _, _), b in zip(found, self.starts, strict=True)] or [np.zeros(0)]).astype(np.int32)
        self.target = np.concatenate([t + b for (_, t, _), b in zip(found, self.starts, strict=True)] or [np.zeros(0)]).astype(np.int32)
        self.first = np.stack([f + b for (_, _, f), b in zip(found, self.starts, strict=True)] or [np.zeros(256)]).astype(np.int32)

    def _run(self, lanes: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, last state) of every lane and language, from ``state[lane, language]``."""
        length = np.array([len(x) for x in lanes], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        grid = np.zeros((int(length.max(initial=0)), len(lanes)), dtype=np.int32)
        for lane, k in enumerate(order):
            grid[: length[k], lane] = lanes[k]
        live = np.searchsorted(-length[order], -np.arange(1, len(grid) + 1), side="right")
        now = np.ascontiguousarray(state[order].T)
        count = np.zeros_like(now)
        for k, n in enumerate(live):
            codes, here = grid[k, :n], now[:, :n]
            at = here + codes
            goes = self.owner[at] == here
            count[:, :n] += ~goes
            now[:, :n] = np.where(goes, self.target[at], self.first[:, codes])
        phrases, last = np.empty_like(state), np.empty_like(state)
        phrases[order], last[order] = count.T, now.T
        return phrases, last

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, bytes by text, whether the text has a letter)."""
        coded = [normalised(t) for t in texts]
        size = np.array([len(c) for c, _ in coded], dtype=np.int64)
        letter = np.array([has for _, has in coded], dtype=bool)
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not self.langs or not size.sum():
            return total, size, letter
        owner = np.repeat(np.arange(len(texts)), -(-size // BLOCK))
        blocks = [c[i : i + BLOCK] for c, _ in coded for i in range(0, len(c), BLOCK)]
        follows = np.concatenate([[False], owner[1:] == owner[:-1]])
        start = np.repeat(self.starts[None, :].astype(np.int32), len(blocks), axis=0)
        later = np.flatnonzero(follows)
        if len(later):
            start[later] = self._run([blocks[k - 1][-LEAD:] for k in later], start[later])[1]
        count, last = self._run(blocks, start)
        while len(wrong := later[(start[later] != last[later - 1]).any(axis=1)]):
            start[wrong] = last[wrong - 1]
            count[wrong], last[wrong] = self._run([blocks[k] for k in wrong], start[wrong])
        np.add.at(total, owner, count)
        return total, size, letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in slices of bounded size."""
        langs, scores, part, held = [], [np.empty(0)], [], 0
        for k, t in enumerate(texts):
            part.append(t or "")
            held += len(part[-1])
            if held >= SLICE or k == len(texts) - 1:
                lang, score = self._predict(part)
                langs += lang
                scores.append(score)
                part, held = [], 0
        return langs, np.concatenate(scores)

    def _predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        count, size, letter = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate = count / np.maximum(size, 1)[:, None]
        best = rate.argmin(axis=1)
        z = -(rate - rate.min(axis=1, keepdims=True)) * (0.7 * np.minimum(size, 300))[:, None]
        score = np.exp(z).max(axis=1) / np.exp(z).sum(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0)


def fit(docs: DataFrame, per_lang: int = 80, passage: int = 600, chars: int = 40_000) -> CrossParser:
    """Automata of all languages of ``docs(doc_id, text, lang)``, each from a bounded sample of its texts."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null")
    picked, counts = class_sample(rows, "lang", "doc_id", per_lang)
    some = picked.select("lang", piece(F.col("text"), F.col("doc_id"), passage).alias("t"), F.xxhash64("doc_id", F.lit("order")).alias("h")).distinct()
    sample = some.orderBy("h", "lang", "t").limit(2 * per_lang * max(len(counts), 1)).collect()
    training: dict[str, str] = {}
    for r in sample:
        if len(training.get(r["lang"], "")) < chars:
            training[r["lang"]] = (training.get(r["lang"], "") + " " + r["t"])[:chars]
    return CrossParser({k: t for k, t in training.items() if any(c.isalpha() for c in t)})


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, per_lang: int = 80, passage: int = 600, chars: int = 40_000) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of every whole text (clashing columns are replaced).

    Learns every language that a row outside the held-out fold names, from
    about ``per_lang`` passages of ``passage`` characters each and at most
    ``chars`` characters (about 2 MB of tables a language).  A text that is null or has no letter
    gets ``und`` and score 0, as does every text if nothing can be learned.
    Ties go to the first language by name.  Repeated rows and nulls in other
    columns pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    learn = docs.where(F.col("doc_id").isNotNull() & ~kept_out(F.col("doc_id"), folds, fold))
    model = spark.sparkContext.broadcast(fit(learn, per_lang, passage, chars))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.value.predict([t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    rest = docs.drop("lang_pred", "score", "_id")
    return rest.withColumn("_id", run(F.col("text"))).select(*rest.columns, "_id.lang_pred", "_id.score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", kept_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
