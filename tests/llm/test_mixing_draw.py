import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import mixing
from larkspur.llm.common import Scratch, read_table

WANT = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])


def test_drawn_documents_have_the_target_shares(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.dirichlet(a, n) for a, n in (([30, 0.1, 0.1], 30000), ([0.1, 30, 0.1], 5000), ([0.1, 0.1, 30], 5000), ([1, 1, 1], 500))])
    n = rng.integers(50, 150, len(p))
    df = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    steps, total = mixing.fit_rates(df, WANT, sure=0.8)
    rates = mixing.rates_of(p, steps, 0.8)
    assert np.abs(total / total.sum() - WANT).max() < 0.002 and np.allclose(total, (rates * n) @ p)
    assert rates.min() >= 0 and rates.max() <= 1 and not ((rates >= 0.8) & (rates < 1)).any()
    rated = df.join(spark.createDataFrame(list(enumerate(rates.tolist())), "doc_id long, rate double"), "doc_id")
    drawn = np.array([r.doc_id for r in mixing.sampled(rated).select("doc_id").collect()])
    got = n[drawn] @ p[drawn]
    assert np.abs(got / got.sum() - WANT).max() < 0.004
    assert set(np.flatnonzero(rates == 1)) <= set(drawn)


def test_stage_has_the_target_shares(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, data, "documents"), read_table(spark, data, "labels")
    stays = corpus_pipeline.mix(spark, docs, data).select("doc_id").distinct()
    rated = mixing.mixing_rates(docs, labels, scratch=Scratch(spark, "t"), without=("text",)).join(stays, "doc_id", "left_semi")
    got = np.array(rated.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(3)]).first())
    print("shares", got / got.sum())
    assert np.abs(got / got.sum() - WANT).max() < 0.003
