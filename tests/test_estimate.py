"""Sizes from statistics, and that ordering joins runs no job."""

import pytest

from larkspur.engine import Engine
from larkspur.functions.sketches import ColumnStats, TableStats
from larkspur.plans import ast
from larkspur.plans.estimate import estimate, planned_rows, selectivity
from larkspur.plans.parser import parse

STATS = {"k": ColumnStats(0, 100, 50), "s": ColumnStats("a", "z", 20), "one": ColumnStats(7, 7, 1)}


def where(text):
    return parse(f"select 1 from t where {text};").where


@pytest.mark.parametrize(
    ("text", "share"),
    [
        ("k = 3", 1 / 50), ("3 = k", 1 / 50), ("k <> 3", 49 / 50), ("k < 25", 0.25), ("25 < k", 0.75), ("k >= 200", 0), ("k > -5", 1), ("s = 'x'", 1 / 20), ("s < 'm'", 1 / 3), ("nope = 1", 0.1), ("k = s", 0.1),
        ("one < 7", 0), ("one <= 7", 1), ("not (k = 3)", 49 / 50), ("k < 50 and s = 'x'", 0.025), ("k < 50 or k < 50", 0.75), ("k + 1 > 3", 1 / 3), ("1", 1), ("k % 2", 1 / 3),
    ],
)
def test_selectivity(text, share):
    assert selectivity(where(text), lambda r: STATS.get(r.name)) == pytest.approx(share)


def test_estimate(spark):
    df = spark.range(1000).selectExpr("id as c1", "id % 10 as c2")
    found = estimate(df, [("c1", "k"), ("c2", "s")], [where("k < 25")], TableStats(4000, STATS))
    assert found.rows == pytest.approx(1000) and found.distinct == {"c1": 50, "c2": 20}
    guess = estimate(df, [("c1", "k")], [], None)
    assert guess.rows == planned_rows(df) and guess.distinct == {"c1": guess.rows}
    assert estimate(df, [], [where("0")], TableStats(0, {})).rows == 0



def test_statistics_order_joins_without_a_job(spark, tmp_path):
    e = Engine(spark)
    e.attach("big", spark.range(5000).selectExpr("id as a", "id % 50 as b"))
    e.attach("mid", spark.range(500).selectExpr("id as c", "id % 7 as d"))
    e.attach("few", spark.range(50).selectExpr("id as f"))
    sql = "select count(*) from big join mid on a = c join few on b = f;"
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ordering", "")
    want = e.execute(sql).rows()
    before = len(tracker.getJobIdsForGroup("ordering"))
    e.options.cost_based = e.options.transfer = True
    df = e.frame(sql)
    assert len(tracker.getJobIdsForGroup("ordering")) == before
    assert [tuple(r) for r in df.collect()] == want
    for t in ("big", "mid", "few"):
        e.analyze(t)
    before = len(tracker.getJobIdsForGroup("ordering"))
    df = e.frame(sql)
    assert len(tracker.getJobIdsForGroup("ordering")) == before
    assert [tuple(r) for r in df.collect()] == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_follows_the_statistics(spark):
    """Without a where clause too: the join of the two small relations comes first."""
    e = Engine(spark)
    for name, n in (("x", 9000), ("y", 30), ("z", 40)):
        e.attach(name, spark.range(n).selectExpr(f"id as {name}1", f"id % 30 as {name}2"))
        e.analyze(name)
    e.options.cost_based = True
    plan = e.frame("select count(*) from x join y on x2 = y2 join z on y1 = z1;")._jdf.queryExecution().analyzed().toString()
    leaves = [line for line in plan.splitlines() if "Range (0" in line]
    assert [line.split("Range (0, ")[1].split(",")[0] for line in leaves][-1] == "9000" or [line.split("Range (0, ")[1].split(",")[0] for line in leaves][0] == "9000"
    joins = [k for k, line in enumerate(plan.splitlines()) if "Join Inner" in line]
    depth = {line.split("Range (0, ")[1].split(",")[0]: line.index("Range") for line in plan.splitlines() if "Range (0" in line}
    assert len(joins) == 2 and depth["9000"] < depth["30"] and depth["9000"] < depth["40"]


def test_changed_tables_keep_or_lose_statistics(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("create table t(k int64);")
    e.execute("insert into t values (1), (2);")
    assert e.analyze("t").rows == 2 and "t" in e.stats
    e.execute("drop table t;")
    assert "t" not in e.stats and isinstance(parse("select 1;"), ast.Select)
