"""Typed scalar expressions as Spark columns.

Conditions stay native booleans, so that filters and joins reach the scan and
the join strategies; they become 0 or 1 only where a number is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from .types import FLOAT, INT, STRING


@dataclass
class Value:
    """A typed column; ``condition`` if it is a native boolean, ``literal`` if it is a constant."""

    column: Column
    type: str | None
    condition: bool = False
    literal: bool = False

    def number(self) -> Column:
        """As stored in a result: a condition is 0 or 1."""
        return self.column.cast("bigint") if self.condition else self.column

    def truth(self) -> Column:
        """As a predicate: an integer is true unless 0."""
        if self.type != INT:
            raise PlanError("a predicate must be an integer")
        return self.column if self.condition else self.column != F.lit(0).cast("bigint")

    def double(self) -> Column:
        return self.number() if self.type == FLOAT else self.number().cast("double")


def literal(value: int | float | str) -> Value:
    if isinstance(value, str):
        return Value(F.lit(value), STRING, literal=True)
    if isinstance(value, float):
        return Value(F.lit(value).cast("double"), FLOAT, literal=True)
    return Value(F.lit(value).cast("bigint"), INT, literal=True)


def _numeric(op: str, *values: Value) -> None:
    if any(v.type not in (INT, FLOAT) for v in values):
        raise PlanError(f"{op} needs numbers")


def _integers(op: str, *values: Value) -> None:
    if any(v.type != INT for v in values):
        raise PlanError(f"{op} needs integers")


def divide_floats(x: Column, y: Column) -> Column:
    """IEEE division, which Spark's operator replaces by null (or an error) for a zero divisor."""
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def _wrapping(op: str, x: Column, y: Column) -> Column:
    """64-bit wrap-around whatever the session's overflow mode is: exact where it fits, else modulo 2^64."""
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    wide_x, wide_y = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
    wide = wide_x + wide_y if op == "+" else wide_x - wide_y if op == "-" else wide_x * wide_y
    two64, half = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    low = F.pmod(wide.cast("decimal(38,0)"), two64)
    folded = F.when(low >= half, low - two64).otherwise(low).cast("bigint")
    return F.coalesce(tried, folded)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    _numeric(op, a, b)
    if FLOAT in (a.type, b.type):
        if op == "%":
            raise PlanError("% needs integers")
        x, y = a.double(), b.double()
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide_floats(x, y)}[op](), FLOAT)
    x, y = a.number(), b.number()
    if op == "/":
        # The quotient truncates; a zero divisor gives null.
        return Value(F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))), INT)
    if op == "%":
        return Value(F.try_mod(x, y), INT)
    return Value(_wrapping(op, x, y), INT)


def bitwise(op: str, a: Value, b: Value) -> Value:
    _integers(op, a, b)
    x, y = a.number(), b.number()
    if op in ("<<", ">>"):
        return Value(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")), INT)
    return Value({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), INT)


def compare(op: str, a: Value, b: Value) -> Value:
    if STRING in (a.type, b.type):
        if a.type != b.type:
            raise PlanError("a string compares with strings only")
        x, y = a.column, b.column
    else:
        _numeric(op, a, b)
        x, y = (a.double(), b.double()) if FLOAT in (a.type, b.type) else (a.number(), b.number())
    made = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "=": x == y, "<>": x != y}[op]
    return Value(made, INT, condition=True)


def logic(op: str, a: Value, b: Value) -> Value:
    for v in (a, b):
        if not (v.condition or v.literal and v.type == INT):
            raise PlanError(f"{op} joins conditions or integer literals")
    x, y = a.truth(), b.truth()
    return Value(x & y if op == "and" else x | y, INT, condition=True)


def negate(a: Value) -> Value:
    if a.condition:
        raise PlanError("- does not apply to a condition")
    _numeric("-", a)
    if a.type == FLOAT:
        return Value(-a.column, FLOAT, literal=a.literal)
    return Value(_wrapping("-", F.lit(0).cast("bigint"), a.column), INT, literal=a.literal)


def invert(a: Value) -> Value:
    if not (a.condition or a.literal and a.type == INT):
        raise PlanError("not applies to a condition or an integer literal")
    return Value(~a.truth(), INT, condition=True)


def aggregate(name: str, a: Value | None) -> Value:
    """sum, count, min, max or avg of a value (count of None counts rows)."""
    if name == "count":
        return Value(F.count(F.lit(1)), INT)
    assert a is not None
    if name in ("sum", "avg"):
        _numeric(name, a)
    if a.type is None:
        raise PlanError(f"{name} does not apply to this type")
    x = a.number()
    if name == "avg":
        return Value(F.avg(x), FLOAT)
    if name == "sum" and a.type == INT:
        # Exact in 38 digits, then wrapped, so a session that checks overflow does not fail.
        return Value(F.coalesce(F.try_sum(x), _wrapped(F.sum(x.cast("decimal(28,0)")))), INT)
    return Value({"sum": F.sum, "min": F.min, "max": F.max}[name](x), a.type)


def _wrapped(total: Column) -> Column:
    two64, half = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    low = F.pmod(total, two64)
    return F.when(low >= half, low - two64).otherwise(low).cast("bigint")
