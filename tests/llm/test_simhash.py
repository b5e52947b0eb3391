import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash
from larkspur.llm.common import Scratch
from larkspur.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, near):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    for text in [None, "", " \n", "One", "One two", "a b c", "Ünïcode ÄÖ x y\x1cz w"] + [" ".join(rng.choices(["alpha", "Beta", "gAMMA", "ß"], k=rng.randint(1, 40))) for _ in range(50)]:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_plan_covers_every_pair():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    for n in (500, 10**6, 10**10):
        scale = bits.T @ bits * (n / 500)
        chosen = simhash.plan(n, scale, 2)
        assert sum(t + 1 for _, t in chosen) == 3  # sum of radii is tau - m + 1
        used = [i for part, _ in chosen for i in part]
        assert len(used) == len(set(used))
        # radii with -1 partitions may leave bits out, but any two flips must be caught
        for a, b in combinations(range(64), 2):
            assert any(len({a, b} & set(part)) <= t for part, t in chosen)


@pytest.mark.parametrize("bucket", [1, 16])
def test_links_equal_brute_force(spark, bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.randint(0, 60)):
            v = centre
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b
            values.add(v)
            centre = v if rng.random() < 0.1 else centre
    values |= {0, 1, 3, (1 << 64) - 1}
    rows = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(simhash._signed(v),) for _, v in rows], "fp long")
    scratch = Scratch(spark, "t")
    edges = simhash.links(df, scratch, 2, bucket)
    found = {r.node: r.component for r in connected_components(edges, scratch).collect()}
    place = {}
    for i, v in rows:  # a group is named by its smallest signed value
        place.setdefault(found.get(simhash._signed(v), simhash._signed(v)), i)
    got = {i: place[found.get(simhash._signed(v), simhash._signed(v))] for i, v in rows}
    want = components_of([i for i, _ in rows], [(i, j) for (i, a), (j, b) in combinations(rows, 2) if (a ^ b).bit_count() <= 2])
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(6)
    names = rng.sample(range(-(10**6), 10**6), 400)  # a long path in no order
    edges = [(i, i + 1) for i in range(2_000_000, 2_000_300)] + [(3_000_000, i) for i in range(3_000_001, 3_000_200)] + [(5, 5), (None, 3)]
    edges += list(zip(names, names[1:], strict=False)) + [(names[0], names[7])]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = connected_components(df, Scratch(spark, "t")).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)  # every node once
    least = min(names)
    assert got == {i: 2_000_000 for i in range(2_000_001, 2_000_301)} | {i: 3_000_000 for i in range(3_000_001, 3_000_200)} | {n: least for n in names if n != least}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_dedup_rows(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=120)) for _ in range(15)]
    rows = []
    for i, t in enumerate(base):
        rows += [(100 * i + 1, t), (100 * i + 2, t), (100 * i + 3, t + " tail"), (100 * i + 4, "x " + t)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9004, "one"), (None, base[0]), (None, None), (9005, "word " * 200_000)]
    df = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], SCHEMA)
    got = simhash.simhash_dedup(df).collect()
    assert len(got) == len(rows)
    prints = [(d, slow_fingerprint(t)) for d, t in rows if d != 9005] + [(9005, slow_fingerprint("word word word"))]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((d or -1, f"{p:016x}") for d, p in prints)
    known = sorted({(d, p) for d, p in prints if d is not None})
    want = components_of([d for d, _ in known], [(a, b) for (a, p), (b, q) in combinations(known, 2) if (p ^ q).bit_count() <= 2])
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert {r.component_id for r in got if r.doc_id is None} == {want[1], want[9001]}
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    """Rows that share an id are compared by their texts alone; clashing columns are kept as they are."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(2))
    rows = [(1, a, "p", "q"), (1, b, "p", "q"), (2, "x " + b, "p", "q"), (3, a, "p", "q"), (None, a, "p", "q"), (None, "only " * 9, "p", "q"), (None, "only " * 9, "p", "r"), (1, a, "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id string")
    assert (simhash.fingerprint(b) ^ simhash.fingerprint("x " + b)).bit_count() <= 2
    left = simhash.unique_documents(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text, r.component_id) for r in left.collect())[1:] == sorted([(1, a, "q"), (1, b, "q")])
    assert left.where("doc_id is null").count() == 1
    got = simhash.simhash_dedup(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (-1, 1), (-1, -1), (-1, -1), (1, 1)])
    assert simhash.unique_documents(df.limit(0)).count() == 0
