"""Accepted and rejected statements, expressions against a small evaluator, and what each clause means."""

import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.engine import Engine
from larkspur.errors import ParseError, PlanError
from larkspur.functions.types import wrap
from larkspur.plans import ast
from larkspur.plans.parser import parse
from larkspur.shell import statements


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.attach("A", spark.createDataFrame([(i, i % 3, f"s{i % 4}", i / 2) for i in range(12)], "a int, b long, s string, f double"))
    return e.attach("B", spark.createDataFrame([(i, 10 * i) for i in range(3)], "b long, v long"))


@pytest.mark.parametrize(
    "sql",
    [
        "select", "select 1", "select 1 order by 0;", "select * from values (1);", "select a from A limit 1 order by a asc;", "update A;", "select a as from A;", "select 1 2;",
        "select a from A limit a;", "select a from A offset 3;", "select (1;", "insert into A (1);", "select 99999999999999999999;", "select 1 union select 2;", "select a b from A;",
        "select * from (values (1), (2, 3));", "create table T(a varchar(0));", "create table T(a varchar(257));", "select .5;", "select 1 from;",
    ],
)
def test_rejected_by_the_parser(sql):
    with pytest.raises(ParseError):
        parse(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select sum(sum(a)) from A;", "select count(sum(a) + 1) from A;", "select a from A where 0.0;", "select a from A where 'a';", "select nope from A;", "select b from A, B;", "select A.v from A, B;",
        "select a from Nope;", "select A.a from (A join B on A.a = B.b) t;", "select b from (A join B on A.a = B.b) t;", "select 1 from (A join B on A.a = B.b) t(x);", "select a + s from A;", "select s < 1 from A;", "select f % 2 from A;", "select f & 1 from A;", "select -s from A;", "select -(a < 1) from A;", "select a and b from A;", "select not a from A;",
        "select a from A where sum(a) > 1;", "select a from A group by sum(a);", "select a from A order by sum(a) asc;", "select * from (values (1), (1.5)) t(x);", "select x from A t(x);", "select *;", "select sum(s) from A;",
    ],
)
def test_rejected_by_the_binder(engine, sql):
    with pytest.raises((PlanError, ParseError)):
        engine.execute(sql)


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("select 1 where 0;", []),
        ("select t.v, t.f from (A join B on A.a = B.b) t where t.s = 's1';", [(10, 0.5)]),
        ("select x, z from (B x1 join B y1 on x1.b + 1 = y1.b) as t(x, y, z, w) order by x asc;", [(0, 1), (1, 2)]),
        ("select 114514 group by 1;", [(114514,)]),
        ("select 1 or 1 and 0, 1 and 0 or 1;", [(0, 1)]),
        ("select -9223372036854775808, 9223372036854775807 + 1;", [(-(2**63), -(2**63))]),
        ("select 'it\\'s', \"x\" from (values (1)) t(\"x\");", [("it\\'s", 1)]),
        ('select "" from (values (7)) t("");', [(7,)]),
        ("select 1. / 0, -1. / 0, 1e2;", [(float("inf"), float("-inf"), 100.0)]),
        ("select a / 0, a % 0 from A where a = 1;", [(None, None)]),
        ("select count(*) from A, A t;", [(144,)]),
        ("select distinct * from (values (1, 2), (1, 2), (3, 4)) t order by \"_#1\" desc;", None),
        ("select x.a from (select a from A) x where x.a > 10;", [(11,)]),
        ("select a from A where a % 2 order by a desc limit 1+1 offset 1;", [(9,), (7,)]),
        ("select b, count(*), sum(f), avg(a) from A group by b having count(*) = 4 order by b asc;", [(0, 4, 9.0, 4.5), (1, 4, 11.0, 5.5), (2, 4, 13.0, 6.5)]),
        ("select sum(a > 5), max(a) - min(a), count(1) from A;", [(6, 11, 12)]),
        ("select A.a, v from A join B on A.b = B.b - 1 where A.a < 3 order by a asc;", [(0, 10), (1, 20)]),
        ("SELECT a FROM A WHERE a < 1;", [(0,)]),
        ("select distinct s from A order by a desc;", [("s3",), ("s2",), ("s1",), ("s0",)]),
    ],
)
def test_rows(engine, sql, rows):
    if rows is None:
        with pytest.raises(PlanError):  # without a column list the columns cannot be named in the query
            engine.execute("select nope from (values (1)) t;")
        return
    assert engine.execute(sql).rows() == rows


def test_names_and_repeats(engine):
    r = engine.execute("select a, a, a + 1, b as x from A limit 1;")
    assert r.names == ["a", "a", "_#1", "x"]
    with pytest.raises(PlanError):
        engine.execute("select a from (select a, a from A) t;")


def evaluate(e):
    if isinstance(e, ast.Literal):
        return e.value
    if isinstance(e, ast.Unary):
        return int(not evaluate(e.operand)) if e.op == "not" else wrap(-evaluate(e.operand))
    a, b = evaluate(e.left), evaluate(e.right)
    ops = {"+": operator.add, "-": operator.sub, "*": operator.mul, "&": operator.and_, "|": operator.or_, "^": operator.xor, "<": operator.lt, "=": operator.eq, "<>": operator.ne}
    return wrap(int(ops[e.op](a, b)))


LEVEL = {"=": 1, "<>": 1, "<": 2, "|": 3, "^": 4, "&": 5, "+": 6, "-": 6, "*": 7}


def by_levels(numbers, ops):
    """Precedence climbing over a flat list, as an independent reading of the table of levels."""
    values, stack = [numbers[0]], []

    def reduce():
        b, a, op = values.pop(), values.pop(), stack.pop()
        values.append(evaluate(ast.Binary(op, ast.Literal(a), ast.Literal(b))))

    for n, op in zip(numbers[1:], ops, strict=True):
        while stack and LEVEL[stack[-1]] >= LEVEL[op]:
            reduce()
        stack.append(op)
        values.append(n)
    while stack:
        reduce()
    return values[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), min_size=2, max_size=8), st.data())
def test_levels(numbers, data):
    ops = [data.draw(st.sampled_from(sorted(LEVEL))) for _ in numbers[1:]]
    text = str(numbers[0]) + "".join(f" {o} {n}" for o, n in zip(ops, numbers[1:], strict=True))
    assert parse(f"select {text};").items[0].expr.value == by_levels(numbers, ops)


def test_columns_compute_like_constants(engine):
    """The same expression folded at parse time and computed by Spark."""
    for text in ["{} * 9223372036854775807 - 5", "{} << 62", "-{} >> 1", "({} - 9) / 4", "({} - 9) % 4", "{} ^ 12 | 3 & 5", "({} < 8) + ({} = 7)", "1 - (not ({} < 5))"]:
        for x in (0, 7, 11):
            folded = engine.execute(f"select {text.replace('{}', str(x))};").rows()
            assert engine.execute(f"select {text.replace('{}', 'a')} from A where a = {x};").rows() == folded, text


def test_shell_splits_outside_strings():
    assert statements("select ';'; select \"a;b\" from t; rest") == (["select ';';", 'select "a;b" from t;'], " rest")
