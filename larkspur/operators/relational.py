"""Operators with semantics of their own; all others are the DataFrame's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_offset(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` in the frame's order; past the end there are none."""
    return (df.offset(skip) if skip else df).limit(n)


def range_scan(df: DataFrame, key: str, low=None, high=None, low_closed: bool = True, high_closed: bool = False, predicate: Column | None = None) -> DataFrame:
    """Rows whose key lies in a range, in key order; an end that is None is open.

    The bounds reach the Parquet scan, where row groups outside are skipped.
    """
    k = F.col(key)
    if low is not None:
        df = df.filter(k >= low if low_closed else k > low)
    if high is not None:
        df = df.filter(k <= high if high_closed else k < high)
    return (df if predicate is None else df.filter(predicate)).orderBy(k)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def distinct_first(df: DataFrame, output: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """Distinct rows of ``output``, each at the place of its first row in the order ``(column, ascending)``."""
    by = [F.asc(c) if asc else F.desc(c) for c, asc in order]
    first = F.row_number().over(Window.partitionBy(*output).orderBy(*by))
    return df.withColumn("_first", first).filter("_first = 1").orderBy(*by).select(*output)


def rank_above(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many of its rows have a ``value`` (a number, not null) of at least the row's own.

    Distinct values are dealt to ranges by quantiles; a running count inside a
    range is shifted by the counts of the ranges above it, so no task sees all.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(counts.approxQuantile(value, [i / parts for i in range(1, parts)], 0.25 / parts)))
    over = F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b > F.col(value))
    ranged = counts.withColumn("_range", F.size(over))
    before = [0] * (len(bounds) + 1)
    for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect():
        before[r["_range"]] = r["n"]
    shift = F.get(F.array(*[F.lit(sum(before[:i])).cast("long") for i in range(len(before))]), F.col("_range"))
    running = F.sum("_n").over(Window.partitionBy("_range").orderBy(F.desc(value)))
    ranks = ranged.withColumn(out, running + shift).select(value, out)
    return df.join(ranks, value).select(*df.columns, out)


def write_sorted(df: DataFrame, path: str, key: str, files: int = 0) -> None:
    """Write clustered by key, so that range scans skip files and row groups."""
    split = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    split.sortWithinPartitions(key).write.parquet(path)
