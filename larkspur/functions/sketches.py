"""Table statistics and sketches: one aggregation each, combined on the map side."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ColumnStats:
    low: object
    high: object
    distinct: int


@dataclass
class TableStats:
    rows: int
    columns: dict[str, ColumnStats]


def analyze(df: DataFrame, rsd: float = 0.02) -> TableStats:
    """Row count, and smallest, largest and approximate number of distinct values of every column, in one pass."""
    columns = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        name = f"`{c}`"
        aggs += [F.min(name).alias(f"lo{i}"), F.max(name).alias(f"hi{i}"), F.approx_count_distinct(name, rsd).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    return TableStats(row["n"], {c: ColumnStats(row[f"lo{i}"], row[f"hi{i}"], min(row[f"d{i}"], row["n"])) for i, c in enumerate(columns)})


def distinct_sketch(df: DataFrame, column: str, log_registers: int = 10) -> int:
    """HyperLogLog estimate of the number of distinct values."""
    return int(df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(log_registers))).alias("n")).first()["n"])


class CountMin:
    """Count-min sketch of a column; estimates are never too low."""

    def __init__(self, df: DataFrame, column: str, error: float = 0.001, confidence: float = 0.99, seed: int = 42):
        self._sketch = df._jdf.stat().countMinSketch(column, error, confidence, seed)

    def estimate(self, value) -> int:
        return int(self._sketch.estimateCount(value))


def frequencies(df: DataFrame, column: str, values: DataFrame, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``values(v)`` with ``estimate``: count-min estimates of how often each is in the column, never too low.

    The counters are rows, ``ceil(2 / error)`` of each of ``log2(1 / (1 - confidence))``
    hashes; they are combined on the map side, and few whatever the input's size.
    """
    width, depth = ceil(2 / error), ceil(log2(1 / (1 - confidence)))

    def cells(c: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(c, F.lit(d)), F.lit(width)).alias("h")) for d in range(depth)])).alias("cell")

    counters = df.select(cells(column)).groupBy("cell.d", "cell.h").agg(F.count(F.lit(1)).alias("n"))
    asked = values.select("v", cells("v")).select("v", "cell.d", "cell.h")
    return asked.join(counters, ["d", "h"], "left").groupBy("v").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


class Bloom:
    """Bloom filter of a column; never misses a value that is there."""

    def __init__(self, df: DataFrame, column: str, expected: int, false_rate: float = 0.01):
        self._filter = df._jdf.stat().bloomFilter(column, max(expected, 1), false_rate)

    def might_contain(self, value) -> bool:
        return bool(self._filter.mightContain(value))
