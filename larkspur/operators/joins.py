"""Join helpers: forced strategies, and reduction over a join graph by Bloom filters or semi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from ..sources.catalog import scratch_root

#: Hints of the physical strategies.
STRATEGIES = {"merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}


@dataclass(frozen=True)
class Edge:
    """``relations[left].left_key = relations[right].right_key``"""

    left: int
    left_key: str
    right: int
    right_key: str


@dataclass
class Measured:
    """Estimated rows, distinct join keys, and the rows before any predicate."""

    rows: float
    distinct: dict[str, float]
    total: float


#: A side is broadcast only if its counted rows times a row's width stay below this.
BROADCAST_BYTES = 64 << 20
#: Join graphs with more edges write the key sets of predicate transfer.
LAZY_EDGES = 12


def join_with(left: DataFrame, right: DataFrame, on: Column, strategy: str | None = None, row_bytes: int = 256) -> DataFrame:
    """Inner join by a strategy, or by the planner's choice.

    ``broadcast`` is asked for if the planner's size of the right side, or else
    its counted rows, prove it small; otherwise the planner chooses.
    """
    if strategy is None:
        return left.join(right, on, "inner")
    if strategy == "broadcast" and planned_bytes(right) > BROADCAST_BYTES and right.count() * row_bytes > BROADCAST_BYTES:
        return left.join(right, on, "inner")
    return left.join(right.hint(STRATEGIES[strategy]), on, "inner")


def _key_sets(df: DataFrame, keys: list[str], path: str) -> dict[str, DataFrame]:
    """The distinct values of every key, written by one scan and read back as column ``_k``."""
    types = [df.schema[k].dataType for k in keys]
    kinds = list(dict.fromkeys(types))

    def tagged(i: int) -> Column:
        return F.struct(F.lit(i).alias("e"), *[(F.col(keys[i]) if t == types[i] else F.lit(None).cast(t)).alias(f"k{n}") for n, t in enumerate(kinds)])

    rows = df.select(F.explode(F.array(*map(tagged, range(len(keys))))).alias("x")).select("x.*").distinct()
    rows.write.partitionBy("e").parquet(path)
    kept = df.sparkSession.read.schema(rows.schema).parquet(path)
    return {k: kept.where(F.col("e") == i).select(F.col(f"k{kinds.index(types[i])}").alias("_k")) for i, k in enumerate(keys)}


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; reads no data."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Bloom filters have so many bits a key; relations with more rows send exact key sets instead, as a filter is held by every task.
BITS_A_KEY, BLOOM_ROWS = 20, 3_000_000
#: When telling another relation pays, by estimated sizes.
KEPT, GAIN = 0.95, 2.0


def _expression(c: Column):
    return SparkSession.active()._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(c._jc)


def _column(expression) -> Column:
    return ClassicColumn(SparkSession.active()._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def bloom_of(key: str, rows: float) -> Column:
    """Aggregate: the bits of a Bloom filter of a column for about ``rows`` keys, merged on the map side; null without rows."""
    made = SparkSession.active()._jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate
    n = max(1, int(rows))
    sizes = [_expression(F.lit(x).cast("long")) for x in (n, max(8192, BITS_A_KEY * n))]
    return _column(made(_expression(F.xxhash64(key)), *sizes).toAggregateExpression())


def may_hold(bits: Column, key: str) -> Column:
    """Whether a filter may hold a key; null if the filter is (a constant, or a scalar subquery)."""
    made = SparkSession.active()._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    return _column(made(_expression(bits), _expression(F.xxhash64(key))))


def _told(df: DataFrame, keys: list[str], rows: float, lazy: bool) -> dict[str, Column]:
    """A Bloom filter of every key: a scalar subquery, or bits from one job over the relation."""
    if lazy:
        return {k: df.agg(bloom_of(k, rows).alias("bits")).scalar() for k in keys}
    found = df.agg(*[bloom_of(k, rows).alias(f"b{n}") for n, k in enumerate(keys)]).first()
    return {k: F.lit(None).cast("binary") if found[n] is None else F.lit(bytes(found[n])) for n, k in enumerate(keys)}


def predicate_transfer(frames: list[DataFrame], edges: list[Edge], order: list[int] | None = None, written: bool | None = None, reduced: list[bool] | None = None, rows: list[float] | None = None, totals: list[float] | None = None) -> list[DataFrame]:
    """Reduce every relation by the keys its neighbours still have: a pass forward, a pass back.

    No row that joins is lost, so the join of the results equals the join of
    the inputs.  ``order`` runs from the most to the least selective relation
    (default: as given).  ``reduced`` tells which relations have lost rows
    already, by predicates of their own; only such, and those that lose rows on
    the way, tell their neighbours (default: all do).

    With ``totals`` too, the sizes before predicates, a relation tells another
    only if that is expected to pay: it keeps less than ``KEPT`` of its rows,
    and ``GAIN`` times fewer than the other has.  So a large relation is not read
    once more to reduce small ones.

    With ``rows``, the estimated sizes, a relation of up to ``BLOOM_ROWS`` tells
    a Bloom filter of its keys: nothing is shuffled, and the receiver tests it
    where it scans.  Others (and all without ``rows``, and keys that are not
    equal exactly if their bits are) tell their distinct keys, and the receiver
    is reduced by a semi-join.

    ``written`` key sets come from one scan per sending relation and pass and
    go to the shared folder, filters come back to the driver: a reduced relation
    is then its scan and one test an edge and pass.  Otherwise they are part of
    the plan, which grows with the square of the edges.  The default writes
    them for more than ``LAZY_EDGES`` edges.
    """
    frames = list(frames)
    tells = [True] * len(frames) if reduced is None else list(reduced)
    order = list(range(len(frames))) if order is None else order
    ends = [(e.left, e.left_key, e.right, e.right_key) for e in edges if e.left != e.right]
    ends += [(c, d, a, b) for a, b, c, d in ends]
    written = len(edges) > LAZY_EDGES if written is None else written
    root = scratch_root(frames[0].sparkSession, "transfer") if written else ""
    now = list(rows or [])

    def pays(source: int, target: int) -> bool:
        return totals is None or now[source] <= KEPT * totals[source] and GAIN * now[source] <= now[target]

    for number, turn in enumerate((order, order[::-1])):
        place = {i: p for p, i in enumerate(turn)}
        sent: dict[int, dict[str, DataFrame | Column]] = {}
        told_by: dict[int, set[int]] = {}  # fixed when a relation's turn comes
        for i in turn:
            for source, source_key, target, key in ends:
                if target == i and source in told_by and i in told_by[source]:
                    tells[i] = True
                    if totals is not None:
                        now[i] *= min(1.0, now[source] / max(totals[source], 1.0))
                    told = sent[source][source_key]
                    frames[i] = frames[i].filter(may_hold(told, key)) if isinstance(told, Column) else frames[i].join(told, F.col(key) == F.col("_k"), "left_semi")
            told_by[i] = {target for source, _, target, _ in ends if source == i and place[target] > place[i] and tells[i] and pays(i, target)}
            keys = sorted({key for source, key, target, _ in ends if source == i and target in told_by[i]})
            bloom = [k for k in keys if rows is not None and rows[i] <= BLOOM_ROWS and dict(frames[i].dtypes)[k] in ("int", "bigint", "string")]
            sets = [k for k in keys if k not in bloom]
            sent[i] = _told(frames[i], bloom, rows[i], not written) if bloom else {}
            if sets and written:
                sent[i] |= _key_sets(frames[i], sets, f"{root}/{number}-{i}")
            else:
                sent[i] |= {k: frames[i].select(F.col(k).alias("_k")).distinct() for k in sets}
    return frames
