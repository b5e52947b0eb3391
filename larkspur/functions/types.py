"""The dialect's types: 64-bit integers, doubles and byte-ordered strings, never null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INT, FLOAT, STRING = "INT", "FLOAT", "STRING"
SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType()}
MIN_INT, MAX_INT = -(1 << 63), (1 << 63) - 1
LONGEST = 256


def wrap(x: int) -> int:
    """64-bit wrap-around."""
    return (x - MIN_INT) % (1 << 64) + MIN_INT


@dataclass(frozen=True)
class ColumnType:
    """A stored column's type: int32, int64, float64, char(n) or varchar(n)."""

    name: str
    size: int

    @property
    def logical(self) -> str:
        return FLOAT if self.name == "float64" else STRING if self.name in ("char", "varchar") else INT

    @property
    def spark(self) -> T.DataType:
        return T.IntegerType() if self.name == "int32" else SPARK[self.logical]


#: Keywords of the dialect and the types they stand for (fixed values).
NAMED = {"int32": ColumnType("int32", 4), "int64": ColumnType("int64", 8), "integer": ColumnType("int64", 8), "float64": ColumnType("float64", 8), "real": ColumnType("float64", 8)}


def of_spark(kind: T.DataType) -> str | None:
    """The logical type of a Spark type; None for one outside the dialect (pass-through only)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    return STRING if isinstance(kind, T.StringType) else None
