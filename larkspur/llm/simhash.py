"""SimHash near-duplicates: generalised pigeonhole search in Hamming space.

A fingerprint takes the majority of each bit over the hashes of a text's
three-word shingles.  Distinct fingerprints are searched like this:

1. Bit and bit-pair counts over *all* fingerprints (64 x 64 numbers, whatever
   the input size) give correlations and collision estimates.
2. Correlated bits are grouped into the same partition, and for every number
   of partitions a dynamic program allots unequal radii ``t_i >= -1`` with
   ``sum(t_i) = tau - m + 1``; any pair within ``tau`` then agrees within
   ``t_i`` on at least one partition.  The cheapest plan by estimated probes
   and candidates wins.
3. Index rows hold a partition's value, probe rows all values within its
   radius; an equi-join proposes candidates, a popcount verifies them.
4. A value that more than ``bucket`` probe rows share is not enumerated.  Its
   members emit their balls of radius ``tau / 2``: two fingerprints meet in a
   ball value exactly if they are within ``tau``, and at most ``1 + 64``
   fingerprints (``tau = 2``) can share one.  So every link is found and no
   group's pairs are ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .components import connected_components

BITS = 64
SEED = 42
SHINGLE = 3
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash; 0 for a text without words (or null)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts: list[bytes] = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(parts), CHUNK):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts[at : at + CHUNK]]), dtype=np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _names() -> tuple[Column, Column]:
    """Two hashes of a row's id and text."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, k1, k2)`` of every row, by whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select("doc_id", of(F.col("text")).alias("fp"), *[h.alias(n) for n, h in zip(("k1", "k2"), _names(), strict=True)])


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j set."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch["fp"].to_numpy(dtype=np.int64))
            for at in range(0, len(raw), CHUNK):
                rows = raw[at : at + CHUNK]
                x = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.int64)
                n += len(rows)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*both[i, j], n]})

    rows = classes.select("fp").mapInPandas(partial, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return total, both


def _grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal size, each grown by the bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        weight = corr.sum(axis=1)
        part = [max(free, key=lambda i: (weight[i], -i))]
        free.discard(part[0])
        while len(part) < size:
            best = max(free, key=lambda i: (corr[i, part].mean(), -i))
            part.append(best)
            free.discard(best)
        parts.append(part)
    return parts


def _within(part: list[int], p: np.ndarray, pair: np.ndarray, corr: np.ndarray, radius: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..radius bits of a partition.

    A bit's chance to agree is taken given that its most correlated predecessor
    agrees, so a group of correlated bits counts as the few bits it is worth.
    """
    dist = np.zeros(radius + 1)
    dist[0] = 1.0
    for k, j in enumerate(part):
        same = p[j] ** 2 + (1 - p[j]) ** 2
        if k:
            i = max(part[:k], key=lambda x: corr[x, j])
            cells = np.array([pair[i, j], p[i] - pair[i, j], p[j] - pair[i, j], 1 - p[i] - p[j] + pair[i, j]])
            same = min(1.0, float((cells**2).sum()) / max(p[i] ** 2 + (1 - p[i]) ** 2, 1e-9))
        dist = dist * same + np.concatenate([[0.0], dist[:-1]]) * (1 - same)
    return list(np.cumsum(dist))


def plan(total: int, both: np.ndarray, tau: int, most: int = 5, probe_cost: float = 1.0, verify_cost: float = 0.5) -> list[tuple[list[int], int]]:
    """``[(bits, radius)]`` of the cheapest generalised pigeonhole plan."""
    n = max(total, 1)
    p = np.diag(both) / n
    pair = both / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(pair - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, most + 1):
        parts = _grouped(corr, m)
        costs = []
        for part in parts:
            chance = _within(part, p, pair, corr, tau)
            ball = np.cumsum([comb(len(part), t) for t in range(tau + 1)])
            costs.append([0.0] + [probe_cost * n * float(ball[t]) + verify_cost * n * (n - 1) / 2 * chance[t] for t in range(tau + 1)])
        # table[s]: least cost of the first partitions with radii that sum to s - (number of partitions)
        goal, table = tau - m + 1, {0: (0.0, [])}
        for row in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, radii) in table.items():
                for t in range(-1, tau + 1):
                    new = (cost + row[t + 1], [*radii, t])
                    if s + t not in grown or new[0] < grown[s + t][0]:
                        grown[s + t] = new
            table = grown
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], [(part, t) for part, t in zip(parts, table[goal][1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) & 1 else x


def _keys(classes: DataFrame, probes: list[tuple[int, int, int]]) -> DataFrame:
    """One row per class and (partition, and-mask, xor-mask)."""
    masks = F.array(*[F.struct(F.lit(p).cast("tinyint").alias("p"), F.lit(a).cast("long").alias("a"), F.lit(x).cast("long").alias("x")) for p, a, x in probes])
    rows = classes.select("fp", F.explode(masks).alias("m"))
    return rows.select("fp", F.col("m.p").alias("p"), F.col("fp").bitwiseAND(F.col("m.a")).bitwiseXOR(F.col("m.x")).alias("val"))


def links(classes: DataFrame, scratch: Scratch, tau: int = 2, bucket: int = 16) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that connect all of them within ``tau`` bits.

    ``classes`` has a distinct ``fp`` per row.  Rare values give every verified
    pair; shared ones give stars that connect the same fingerprints.
    """
    if tau < 0 or tau % 2:
        raise ValueError("tau must be even and not negative")
    total, both = bit_counts(classes)
    chosen = plan(total, both, tau)
    index, probe = [], []
    for p, (part, radius) in enumerate(chosen):
        mask = _signed(sum(1 << i for i in part))
        index.append((p, mask, 0))
        probe += [(p, mask, _signed(sum(1 << i for i in flip))) for t in range(radius + 1) for flip in combinations(part, t)]
    indexed, probed = _keys(classes, index), _keys(classes, probe)
    hot = scratch.keep(probed.groupBy("p", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("p", "val"))
    some_hot = not hot.isEmpty()
    cold_i, cold_p = (x.join(hot, ["p", "val"], "left_anti") for x in (indexed, probed)) if some_hot else (indexed, probed)
    pairs = cold_i.select("p", "val", F.col("fp").alias("a")).join(cold_p.select("p", "val", F.col("fp").alias("b")), ["p", "val"])
    edges = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)).select("a", "b")
    if not some_hot:
        return edges
    members = indexed.unionByName(probed).join(hot, ["p", "val"], "left_semi").select("fp").distinct()
    ball = [(0, -1, _signed(sum(1 << i for i in flip))) for t in range(tau // 2 + 1) for flip in combinations(range(BITS), t)]
    met = _keys(members, ball).groupBy("val").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return edges.unionByName(met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b")))


def _labelled(docs: DataFrame, scratch: Scratch, tau: int, bucket: int) -> DataFrame:
    """``doc_id, k1, k2, fp, component_id, component``: the last is the smallest fingerprint of the group, 128 bits of hash name id and text.

    The search links fingerprints and not ids, so rows that share an id are in
    one group only if their texts link them.
    """
    rows = scratch.keep(fingerprints(docs))
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = scratch.keep(connected_components(links(classes.select("fp"), scratch, tau, bucket), scratch))
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component"), "fp")


def simhash_dedup(docs: DataFrame, tau: int = 2, bucket: int = 16) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text, ..)``.

    Null texts count as empty; texts without words share fingerprint zero.  A
    row with a null doc_id links like any other; a group of such rows alone has
    a null component_id.  Rows that share a doc_id are rows of their own.
    Repeated rows stay.  An empty table gives an empty result; other columns
    are ignored.
    """
    rows = _labelled(docs, Scratch(docs.sparkSession, "simhash"), tau, bucket)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def unique_documents(docs: DataFrame, tau: int = 2, bucket: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group: the one with the smallest doc_id (the smallest hash where that id repeats).

    A row without an id stays only where its whole group has none.  Nothing
    else is compared by id, so texts that share one and do not link all stay.
    """
    rows = _labelled(docs, Scratch(docs.sparkSession, "simhash"), tau, bucket)
    chosen = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("k1").alias("_k1")).select("_k1")
    named = docs.select("*", *[h.alias(f"_{n}") for n, h in zip(("k1", "k2"), _names(), strict=True)])
    return named.join(chosen, "_k1", "left_semi").dropDuplicates(["_k1", "_k2"]).select(*docs.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents"))
