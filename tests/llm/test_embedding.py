import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, threshold=0.98):
    ok = {}
    for v, e, label, _ in rows:
        if label is None or e is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        x = np.asarray(e, dtype=np.float32).astype(np.float64)
        if x.any():
            ok[v] = (label, x / np.linalg.norm(x))
    links, label_of = {v: 0 for v, *_ in rows}, {v: v for v, *_ in rows}
    ids = sorted(ok)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold]
    for a, b in near:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(label_of[a], label_of[b])
            if label_of[a] != m or label_of[b] != m:
                label_of[a] = label_of[b] = m
                changed = True
    return {v: (links[v], label_of[v], label_of[v] == v) for v, *_ in rows}


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows, vid = [], 0
    for _ in range(12):
        centre = rng.standard_normal(24)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 40))):
            rows.append((vid, [float(x) for x in np.float32(centre + rng.normal(0, 0.12, 24))], label, "x"))
            vid += 1
        rows += [(vid, rows[-1][1], label, "x"), (vid + 1, rows[-1][1], 9, "x"), (vid + 2, [2 * x for x in rows[-1][1]], label, None)]
        vid += 3
    for odd in (None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0]):
        rows += [(vid, odd, 1, "x"), (vid + 1, odd, 1, "x"), (vid + 2, odd, None, "x")]
        vid += 3
    rows += [(vid, [1e-30] * 24, 2, "x"), (vid + 1, [1e30] * 24, 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(df, block=block).collect()}
    assert got == brute(rows)


def test_ids_that_are_null_or_repeat_and_clashing_columns(spark):
    one, two, three = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.999, 0.01]
    rows = [(1, one, 1, "a"), (1, two, 1, "b"), (2, three, 1, "c"), (None, two, 1, "d"), (None, one, 1, "d"), (5, one, 1, "e"), (6, one, None, "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string").withColumn("n_links", F.lit("x")).withColumn("component_id", F.lit(None).cast("string"))
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in E.embedding_dedup(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 1, 1, False), (6, 0, 6, True)]


def test_ties_at_the_threshold_link(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [3.0, 4.0], 1), (4, [4.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(df, threshold=0.8, miss=1e-9).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1)}


def test_large_bucket_equals_brute_force():
    """A bucket beyond the size of the small ones, whole and as a pair of cuts."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((5, 16))
    x = np.concatenate([c + rng.normal(0, 0.15, (60, 16)) for c in centres])
    unit, cid, w, cut = x / np.linalg.norm(x, axis=1, keepdims=True), rng.permutation(300), rng.integers(1, 9, 300), rng.integers(0, 2, 300)
    order = np.argsort(cid)
    unit, cid, w, cut = unit[order], cid[order], w[order], cut[order]
    verifier = E.Verifier(0.98, 12, 20)
    keys = E._signatures(unit, 12, 20)
    for t, cuts in ((0, None), (7, None), (7, cut)):
        link = (unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool)
        if cuts is not None:
            link &= cuts[:, None] != cuts[None, :]
        met = (keys[:, None, :t] == keys[None, :, :t]).any(axis=2)
        got = verifier._large(unit, cid, w, t, cuts).set_index("cid")
        assert set(got.index) == set(cid[link.any(axis=1)])
        for k in np.flatnonzero(link.any(axis=1)):
            assert got.links[cid[k]] == w[link[k] & ~met[k]].sum()
        label = np.arange(300)
        while True:
            new = np.minimum(label, np.where(link, label[None, :], 300).min(axis=1))
            if (new == label).all():
                break
            label = new
        assert all(got.hub[cid[k]] == cid[label[k]] for k in np.flatnonzero(link.any(axis=1)))


def test_empty(spark):
    assert E.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shape_keeps_the_miss_rate():
    for n in (1, 10**3, 10**6, 10**9):
        bits, tables = E.table_shape(n, 0.98)
        hit = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - hit) ** tables <= 1.01e-7
