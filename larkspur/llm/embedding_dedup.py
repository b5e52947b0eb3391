"""Near-duplicate embeddings: random-hyperplane hashing, exact cosine, components.

Exact copies are collapsed first.  Every distinct vector gets one key per hash
table, the signs of its products with ``bits`` random hyperplanes; vectors of
equal label, dimension and key are compared exactly in double precision.

* ``bits`` follows the largest label group (log2 of its size plus a margin), so
  a table puts few unrelated vectors together at any size; ``tables`` then
  follows from the wanted recall of a pair right at the threshold.
* Keys without a partner are dropped by a semi-join *before* any vector is
  shuffled, so only rows that can link carry their vectors.
* A bucket of more than ``block`` vectors is cut into blocks, and pairs of
  blocks are dealt to different tasks, so a vector is sent once a table and
  block of its bucket; tasks return one row per vector (its link count and a
  hub of its local component), never the pairs.  Small buckets of one size are
  multiplied together, large ones in strips.
* A pair that meets in several tables is counted in the first only: a task
  recomputes the keys of the few pairs that reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .components import connected_components

SEED = 20_011


def table_shape(largest: int, threshold: float, miss: float = 1e-7, margin: int = 5) -> tuple[int, int]:
    """(bits, tables) for a largest label group of ``largest`` vectors.

    A pair at cosine ``threshold`` is missed by all tables with chance ``miss``.
    """
    bits = min(62, max(8, ceil(log2(max(largest, 2))) + margin))
    hit = (1 - acos(min(threshold, 1.0)) / pi) ** bits
    return bits, max(1, ceil(log(miss) / log(1 - hit))) if hit < 1 else 1


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (unit @ _planes(unit.shape[1], bits, tables) >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _hubs(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of ``n`` indices reaches over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _hubs_of_rows(rows: np.ndarray, n: int) -> np.ndarray:
    """The same for a symmetric matrix of packed bits: every row is read once."""
    label, fresh = np.full(n, -1), np.packbits(np.ones(n, dtype=bool))
    for start in range(n):
        if label[start] >= 0:
            continue
        reached = np.zeros_like(fresh)
        reached[start >> 3] = 128 >> (start & 7)
        while reached.any():
            found = np.flatnonzero(np.unpackbits(reached, count=n))
            label[found] = start
            fresh &= ~reached
            reached = np.bitwise_or.reduce(rows[found], axis=0) & fresh
    return label


class Verifier:
    """Links inside buckets: exact cosines, each pair counted in the first table where its vectors meet."""

    SMALL, STRIP, PAIRS, CELLS = 48, 512, 1 << 17, 1 << 22

    def __init__(self, threshold: float, bits: int, tables: int):
        self.threshold, self.bits, self.tables = threshold, bits, tables

    def of_batch(self, batch: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows ``cid, links, hub`` of the vectors with links; ``starts`` are the first rows of the buckets, and their end."""
        cid, w, t = (batch[c].to_numpy(dtype=np.int64) for c in ("cid", "w", "t"))
        cut, apart, dim = batch["cut"].to_numpy(), batch["i"].to_numpy() != batch["j"].to_numpy(), batch["dim"].to_numpy()
        size = np.diff(starts)
        for d in np.unique(dim[starts[:-1]]):
            here = dim[starts[:-1]] == d
            rows = np.flatnonzero(dim == d)
            unit = np.empty((len(batch), 0)) if not len(rows) else np.zeros((len(batch), d))
            unit[rows] = _unit(list(batch["embedding"].iloc[rows]))
            yield self._small(unit, cid, w, t, cut, apart, [(n, starts[:-1][here & (size == n)]) for n in np.unique(size[here & (size <= self.SMALL)]) if n > 1])
            for k in np.flatnonzero(here & (size > self.SMALL)):
                at = np.arange(starts[k], starts[k + 1])
                at = at[np.argsort(cid[at], kind="stable")]
                yield self._large(unit[at], cid[at], w[at], int(t[at[0]]), cut[at] if apart[at[0]] else None)

    def _small(self, unit, cid, w, t, cut, apart, groups: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        """Buckets of few vectors, all of one size at once."""
        firsts, seconds = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for n, starts in groups:
            i, j = np.triu_indices(n, 1)
            step = max(1, min(self.PAIRS // (n * n), self.CELLS // (n * unit.shape[1])))
            for k in range(0, len(starts), step):
                at = starts[k : k + step, None] + np.arange(n)
                vectors = unit[at]
                bucket, pair = np.nonzero((vectors @ vectors.transpose(0, 2, 1))[:, i, j] >= self.threshold)
                firsts.append(at[bucket, i[pair]])
                seconds.append(at[bucket, j[pair]])
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        counts = ~apart[a] | (cut[a] != cut[b])
        a, b = a[counts], b[counts]
        on, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        if not len(on):
            return pd.DataFrame({"cid": on, "links": on, "hub": on})
        pa, pb = place[: len(a)], place[len(a) :]
        keys, links = self._keys(unit[on], int(t[on].max())), np.zeros(len(on), dtype=np.int64)
        tables = np.arange(keys.shape[1])
        for k in range(0, len(a), self.PAIRS):
            x, y = pa[k : k + self.PAIRS], pb[k : k + self.PAIRS]
            new = ~((keys[x] == keys[y]) & (tables < t[on[x], None])).any(axis=1)
            np.add.at(links, x[new], w[on[y[new]]])
            np.add.at(links, y[new], w[on[x[new]]])
        order = np.argsort(cid[on], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(on))
        return pd.DataFrame({"cid": cid[on], "links": links, "hub": cid[on][order][_hubs(rank[pa], rank[pb], len(on))[rank]]})

    def _large(self, unit, cid, w, t: int, cut) -> pd.DataFrame:
        """A bucket of many vectors in strips; ``cut`` is given if only pairs of different cuts count."""
        n = len(cid)
        links, rows, keys = np.zeros(n, dtype=np.int64), np.zeros((n, -(-n // 8)), dtype=np.uint8), None
        for k in range(0, n, self.STRIP):
            part = slice(k, min(n, k + self.STRIP))
            link = unit[part] @ unit.T >= self.threshold
            link[np.arange(link.shape[0]), np.arange(part.start, part.stop)] = False
            if cut is not None:
                link &= cut[part, None] != cut[None, :]
            rows[part] = np.packbits(link, axis=1)
            if t and keys is None and link.any():
                keys = np.ascontiguousarray(self._keys(unit, t).T)
            for table in keys if keys is not None else ():
                if not link.any():
                    break
                link &= table[part, None] != table[None, :]
            links[part] = link @ w
        on = rows.any(axis=1)
        return pd.DataFrame({"cid": cid[on], "links": links[on], "hub": cid[_hubs_of_rows(rows, n)][on]})

    def _keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        made = [_signatures(unit[k : k + 4096], self.bits, self.tables)[:, :t] for k in range(0, len(unit), 4096)]
        return np.concatenate(made)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, block: int = 4096, miss: float = 1e-7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label, ..)``.

    Vectors with a null label, or that are null, empty, zero or hold null or
    non-finite components, link with nothing; so do vectors of different
    dimension.  Repeated vectors link with each other.  A vector with a null
    vec_id links with nothing and has a null component; vectors that share a
    vec_id are vectors of their own.  Cosines of exactly the threshold link.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    source = vectors.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    # 128 bits of content hash name an exact copy; the vector itself is shuffled once.
    named = source.withColumn("h1", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("h2", F.when(usable, F.xxhash64(F.lit(1), "embedding", "label")))
    # Numbered as they are written, so every class has a number of its own whatever the ids.
    classes = named.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = scratch.keep(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()))
    groups = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    bits, tables = table_shape(groups["n"] or 0, threshold, miss)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("dim", sort=False):
                keys = _signatures(_unit(list(part["embedding"])), bits, tables)
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "label": part["label"].to_numpy(), "dim": part["dim"].to_numpy(), "keys": list(keys)})

    kind = classes.schema["label"].dataType.simpleString()
    keyed = classes.select("cid", "label", "dim", "embedding").mapInPandas(hashed, f"cid long, label {kind}, dim int, keys array<long>")
    rows = scratch.keep(keyed.select("cid", "label", "dim", F.posexplode("keys").alias("t", "key")))
    name = ["label", "dim", "t", "key"]
    shared = rows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / block).cast("int"))
    live = rows.join(shared, name).withColumn("cut", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    # Member of cut c takes part in every pair of cuts that holds c.
    dealt = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("cid", *name, "cut", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"))
    ready = dealt.join(classes.select("cid", "w", "embedding"), "cid").repartition(*name, "i", "j").sortWithinPartitions(*name, "i", "j")
    group = [*name, "i", "j"]
    verifier = Verifier(threshold, bits, tables)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last bucket may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            now = batch[group].to_numpy()
            change = np.flatnonzero((now[1:] != now[:-1]).any(axis=1)) + 1
            if held and (held[-1][group].iloc[-1].to_numpy() != now[0]).any():
                change = np.concatenate([[0], change])
            if not len(change):
                held.append(batch)
                continue
            done = pd.concat([*held, batch.iloc[: change[-1]]], ignore_index=True)
            before = sum(map(len, held))
            starts = np.concatenate([[0], change + before])
            yield from verifier.of_batch(done, starts[np.concatenate([[True], starts[1:] > starts[:-1]])])
            held = [batch.iloc[change[-1] :]]
        if held:
            last = pd.concat(held, ignore_index=True)
            yield from verifier.of_batch(last, np.array([0, len(last)]))

    found = scratch.keep(ready.select("cid", "w", "embedding", *group, "cut").mapInPandas(verified, "cid long, links long, hub long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("cid", "hub").where("cid <> hub").distinct(), scratch)
    of = classes.select("h1", "h2", "cid", "w", "least").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    of = scratch.keep(of.select("h1", "h2", "least", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    per_class = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("h1", "h2", "n_links", "component_id")
    ids = named.select("vec_id", "h1", "h2")
    joined = ids.join(per_class, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(v.vec_id, coalesce(c.m, v.vec_id)) AS BIGINT) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
