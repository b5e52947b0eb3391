"""Queries that must take in their whole tables, by brute force."""

from collections import Counter

from larkspur import queries
from larkspur.operators import relational

SF = "/root/testdata/sf0.001"


def test_poly_two_level_multiplies_whole_tables(spark):
    sizes = Counter(r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect())
    want = Counter()
    for a, x in sizes.items():
        for b, y in sizes.items():
            for c, z in sizes.items():
                want[a + b + c] += a * x * y * z
    assert {r.d: r.s for r in queries.queries()["poly_two_level"](spark, SF).collect()} == want


def test_contest_rank_counts_all_customers(spark):
    sums = Counter()
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        sums[r.o_custkey] += r.o_orderkey
    want = sorted((sum(t >= s for t in sums.values()), k, s) for k, s in sums.items())[:20]
    assert [(r.above, r.id, r.s) for r in queries.queries()["contest_rank"](spark, SF).collect()] == want


def test_rank_above_with_ties(spark):
    values = [5, 5, -3, 2**60, 0, 5, -3] + list(range(200))
    got = relational.rank_above(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect()
    assert sorted((r.v, r.n) for r in got) == sorted((v, sum(w >= v for w in values)) for v in values)
    assert relational.rank_above(spark.createDataFrame([], "v long"), "v", "n").count() == 0
