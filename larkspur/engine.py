"""The engine: statements in, results out."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError, ExecError, PlanError, TxnAbort
from .functions import sketches
from .functions.types import FLOAT, INT, STRING, of_spark
from .plans import ast
from .plans.binder import Binder, Options, Scope, calls, conjuncts
from .plans.parser import parse
from .sources.catalog import HIDDEN_KEY, Catalog, TableDef
from .sources.locks import LockManager


class Result:
    """Rows of a statement: a DataFrame with the names a user sees, which may repeat.

    A forward cursor (``next``, ``read_int``, ``read_float``, ``read_string``)
    or an iteration holds one partition of the rows at a time; ``rows`` fetches
    them all, for results known to be small.  A statement that failed, asked
    for by ``Engine.attempt``, has an ``error`` and no rows.
    """

    def __init__(self, df: DataFrame | None, names: list[str], types: list[str | None], error: str | None = None):
        self.df, self.names, self.types, self.error = df, names, types, error
        self._cursor: Iterator[tuple] | None = None
        self._row: tuple | None = None
        self._at = 0

    def valid(self) -> bool:
        return self.error is None

    def size(self) -> int:
        return self.df.count() if self.df is not None else 0

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def __iter__(self) -> Iterator[tuple]:
        return map(tuple, self.df.toLocalIterator(prefetchPartitions=True)) if self.df is not None else iter(())

    def next(self) -> bool:
        """Move to the next row; false behind the last."""
        if self._cursor is None:
            self._cursor = iter(self)
        self._row, self._at = next(self._cursor, None), 0
        return self._row is not None

    def _read(self, kind: str, make: Callable) -> object:
        if self._row is None:
            raise ExecError("the cursor is on no row")
        if self._at >= len(self.names):
            raise ExecError("the row has no further column")
        if self.types[self._at] != kind:
            raise ExecError(f"column {self.names[self._at]!r} is no {kind}")
        self._at += 1
        value = self._row[self._at - 1]
        return None if value is None else make(value)

    def read_int(self) -> int | None:
        """The row's next column."""
        return self._read(INT, int)

    def read_float(self) -> float | None:
        return self._read(FLOAT, float)

    def read_string(self) -> str | None:
        return self._read(STRING, str)

    def show(self, most: int = 50) -> str:
        """A table of the rows; of more than twice ``most``, the first and last ``most``.  Rows between are counted and not kept."""
        head, tail, n = [], deque(maxlen=most), 0
        for n, row in enumerate(self, 1):
            (head if n <= most else tail).append(row)
        cut = [*head, ("...",) * len(self.names), *tail] if n > 2 * most else [*head, *tail]
        cells = [[str(x) for x in r] for r in [self.names, *cut]]
        width = [max(len(r[i]) for r in cells) for i in range(len(self.names))]
        return "\n".join(" | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) for r in cells) + f"\n{n} rows"


class Txn:
    """A transaction: its number (older is smaller) and the tables it changed.

    Of a table of which it locked rows only, it keeps their keys and the
    version it started from: others may commit other rows meanwhile.
    """

    def __init__(self, number: int):
        self.number, self.tables, self.state = number, {}, "active"
        self.keys: dict[str, set] = {}
        self.base: dict[str, list[str]] = {}


class Engine:
    """``execute(sql)`` runs a statement; without ``txn`` it commits by itself, or changes nothing if it fails."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.catalog, self.options = spark, Catalog(spark, root), Options()
        self.locks, self._numbers, self.stats = LockManager(), count(1), {}
        self._active: set[int] = set()
        self._committing = threading.Lock()

    def attach(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Engine:
        """Make a frame readable as a table, or a function that opens one when a statement first names it."""
        self.catalog.attached[name] = df
        return self

    # -- transactions -----------------------------------------------------------

    def begin(self) -> Txn:
        txn = Txn(next(self._numbers))
        self._active.add(txn.number)
        return txn

    def commit(self, txn: Txn) -> None:
        self._ended(txn)
        with self._committing:
            for name, table in txn.tables.items():
                if table is None:
                    self.catalog.tables.pop(name, None)
                    self.stats.pop(name, None)
                else:
                    self.catalog.tables[name] = self._rebased(txn, name, table)
            if txn.tables:
                self.catalog.save()
        txn.state = "committed"
        self._active.discard(txn.number)
        self.locks.release_all(txn.number)

    def abort(self, txn: Txn) -> None:
        self._ended(txn)
        txn.state = "aborted"
        self._active.discard(txn.number)
        self.locks.release_all(txn.number)

    @staticmethod
    def _ended(txn: Txn) -> None:
        if txn.state != "active":
            raise TxnAbort(f"the transaction is {txn.state}")

    def _lock(self, txn: Txn, name: str, mode: str) -> None:
        held = self.locks.mode(txn.number, name)
        self.locks.acquire(txn.number, name, "SIX" if {held, mode} == {"S", "IX"} else mode)

    def _table(self, txn: Txn, name: str, mode: str = "S", keys: list | None = None) -> TableDef:
        """A table as the transaction sees it, locked in a mode; with ``keys`` only those rows are, under an intention on the table."""
        if keys is None:
            self._lock(txn, name, mode)
        else:
            self._lock(txn, name, "I" + mode)
            for k in sorted(keys):
                self.locks.acquire(txn.number, (name, k), mode)
        found = self.catalog.tables.get(name)
        if name in txn.tables:
            found = txn.tables[name] = self._rebased(txn, name, txn.tables[name])
        elif name in txn.keys:  # a statement on rows failed before it changed any
            txn.base[name] = list(found.segments)
        if found is None:
            raise PlanError(f"table {name!r} is unknown")
        if mode == "X" and keys is not None:
            if name not in txn.tables and name not in txn.keys:
                txn.keys[name], txn.base[name] = set(), list(found.segments)
            if name in txn.keys:
                txn.keys[name].update(keys)
        elif mode == "X":  # the whole table is the transaction's
            txn.keys.pop(name, None)
        return found

    def _rebased(self, txn: Txn, name: str, table: TableDef | None) -> TableDef | None:
        """The transaction's rows of a table over what others committed since it took them."""
        now = self.catalog.tables.get(name)
        if table is None or name not in txn.keys or now is None or now.segments == txn.base[name]:
            return table
        kind = table.types()[table.primary].spark
        keys = self.spark.createDataFrame([(k,) for k in sorted(txn.keys[name])], T.StructType([T.StructField("_k", kind)]))
        mine = F.col(f"`{table.primary}`") == F.col("_k")
        both = self.catalog.read(now).join(keys, mine, "left_anti").unionByName(self.catalog.read(table).join(keys, mine, "left_semi"))
        made = now.copy()
        made.segments, txn.base[name] = [self.catalog.write(made, both)], list(now.segments)
        return made

    def _point(self, name: str, where: ast.Expr | None, alias: str | None = None) -> list | None:
        """The key that a predicate fixes, if the table has a primary key."""
        table = self.catalog.tables.get(name)
        if table is None or table.primary is None:
            return None
        for p in conjuncts(where):
            if isinstance(p, ast.Binary) and p.op == "=":
                for ref, value in ((p.left, p.right), (p.right, p.left)):
                    if isinstance(ref, ast.Ref) and isinstance(value, ast.Literal) and ref.name == table.primary and ref.table in (None, alias or name):
                        if isinstance(value.value, {"INT": int, "FLOAT": (int, float)}.get(table.types()[table.primary].logical, str)):
                            return [value.value]
        return None

    def _reader(self, txn: Txn, points: dict[str, list] | None = None) -> Callable:
        def read(name: str):
            if name in self.catalog.attached:
                if not isinstance(self.catalog.attached[name], DataFrame):
                    self.catalog.attached[name] = self.catalog.attached[name]()
                return self.catalog.attached[name], frozenset()
            return self.catalog.read(self._table(txn, name, keys=(points or {}).get(name))), frozenset([HIDDEN_KEY])

        return read

    def _binder(self, txn: Txn, points: dict[str, list] | None = None) -> Binder:
        return Binder(self.spark, self._reader(txn, points), self.options, self.stats)

    # -- storage ------------------------------------------------------------------

    def compact(self, name: str, files: int = 0) -> int:
        """Rewrite a table's segments as one, clustered by its primary key; the number of segments it had.

        Many small inserts leave many segments; merged ones let range scans on
        the key skip files and row groups.  ``files`` fixes the number of files.
        """
        txn = self.begin()
        try:
            table = self._table(txn, name, "X").copy()
            had = len(table.segments)
            if had > 1 or had and files:
                rows = self.catalog.read(table)
                if table.primary:
                    key = f"`{table.primary}`"
                    rows = (rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)).sortWithinPartitions(key)
                elif files:
                    rows = rows.repartition(files)
                table.segments = [self.catalog.write(table, rows)]
                txn.tables[name] = table
        except BaseException:
            self.abort(txn)
            raise
        self.commit(txn)
        return had

    def vacuum(self) -> int:
        """Delete folders that no table names: older versions and aborted changes; their number.

        Results that read an older version cannot be read afterwards.  Refused
        while a transaction is open, as its changes are named by it alone.
        """
        found = self.catalog.segment_folders()  # listed first: what later transactions write is not in it
        if self._active:
            raise ExecError("a transaction is open")
        used = {s.rsplit("/", 1)[-1] for t in self.catalog.tables.values() for s in t.segments}
        old = [f for f in found if f not in used]
        for folder in old:
            self.catalog.remove_segment(folder)
        return len(old)

    # -- statements ---------------------------------------------------------------

    def execute(self, sql: str, txn: Txn | None = None) -> Result:
        statement = parse(sql)
        own = txn or self.begin()
        self._ended(own)
        try:
            result = self._run(statement, own)
        except TxnAbort:
            self.abort(own)
            raise
        except BaseException:  # also errors of Spark: no lock outlives its statement
            if txn is None:
                self.abort(own)
            raise
        if txn is None:
            self.commit(own)
        return result

    def attempt(self, sql: str, txn: Txn | None = None) -> Result:
        """``execute``, with errors of the engine told by the result."""
        try:
            return self.execute(sql, txn)
        except EngineError as e:
            return Result(None, [], [], str(e))

    def frame(self, sql: str) -> DataFrame:
        """A query's lazy DataFrame."""
        return self.execute(sql).df

    def explain(self, sql: str) -> str:
        return self.frame(sql)._jdf.queryExecution().toString()

    def analyze(self, name: str) -> sketches.TableStats:
        txn = self.begin()
        try:
            df, _ = self._reader(txn)(name)
            self.stats[name] = sketches.analyze(df)
        except BaseException:
            self.abort(txn)
            raise
        self.commit(txn)
        return self.stats[name]

    def _run(self, s, txn: Txn) -> Result:
        if isinstance(s, ast.Select):
            points = None
            if len(s.sources) == 1 and isinstance(s.sources[0], ast.Table) and s.sources[0].columns is None:
                source = s.sources[0]
                points = {source.name: key} if (key := self._point(source.name, s.where, source.alias)) else None
            result = Result(*self._binder(txn, points).result(s))
            if self.options.print_plan:
                print(result.df._jdf.queryExecution().toString())
            return result
        if isinstance(s, ast.IndexStatement):
            return self._counted("indexes", 0)
        if isinstance(s, ast.CreateTable):
            self.locks.acquire(txn.number, s.name, "X")
            txn.tables[s.name] = self.catalog.define(s, {t.name: t for t in self._all(txn)})
            return self._counted("created tables", 1)
        if isinstance(s, ast.DropTable):
            table = self._table(txn, s.name, "X")
            if self._references(txn, table, self.catalog.read(table)):
                raise ExecError(f"rows reference table {s.name!r}")
            txn.tables[s.name] = None
            return self._counted("dropped tables", 1)
        if isinstance(s, ast.Insert):
            return self._insert(s, txn)
        return self._delete(s, txn) if isinstance(s, ast.Delete) else self._update(s, txn)

    def _counted(self, name: str, n: int) -> Result:
        return Result(self.spark.createDataFrame([(n,)], f"`{name}` long"), [name], [INT])

    # -- changes --------------------------------------------------------------------

    def _all(self, txn: Txn) -> list[TableDef]:
        named = {**self.catalog.tables, **txn.tables}
        return [t for t in named.values() if t is not None]

    def _references(self, txn: Txn, table: TableDef, gone: DataFrame, but: str | None = None) -> bool:
        """Whether rows of other tables reference keys of ``gone``."""
        for other in self._all(txn):
            for column, (name, key) in other.references.items():
                if name == table.name and other.name not in (table.name, but):
                    rows = self.catalog.read(self._table(txn, other.name))
                    if not rows.join(gone.select(F.col(f"`{key}`").alias("_k")), F.col(f"`{column}`") == F.col("_k"), "left_semi").isEmpty():
                        return True
        return False

    def _fit(self, table: TableDef, df: DataFrame, names: list[str], kinds: list[str | None]) -> DataFrame:
        """Columns by place, checked and cast to the table's types."""
        if len(names) != len(table.columns):
            raise PlanError(f"{len(names)} values for {len(table.columns)} columns")
        inner = df.toDF(*[f"_{i}" for i in range(len(names))])
        out = []
        for i, ((name, kind), given) in enumerate(zip(table.types().items(), kinds, strict=True)):
            if given != kind.logical and not (given == INT and kind.logical == FLOAT):
                raise PlanError(f"column {name!r} takes {kind.logical}, not {given}")
            c = F.col(f"_{i}")
            if kind.name == "int32":  # keeps the low 32 bits
                low = F.call_function("shiftright", F.call_function("shiftleft", c, F.lit(32)), F.lit(32))
                c = low.cast("int")
            else:
                c = c.cast(kind.spark)
            out.append(c.alias(name))
        return inner.select(*out)

    def _check(self, txn: Txn, table: TableDef, new: DataFrame, old: DataFrame | None) -> None:
        """Constraints of new rows, given the rows that stay beside them."""
        sized = [F.octet_length(f"`{n}`") > k.size for n, k in table.types().items() if k.logical == "STRING"]
        if sized:
            long = sized[0]
            for x in sized[1:]:
                long = long | x
            if not new.filter(long).isEmpty():
                raise ExecError("a string is too long")
        if table.primary:
            key = f"`{table.primary}`"
            if not new.groupBy(key).count().filter("count > 1").isEmpty() or old is not None and not new.join(old.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi").isEmpty():
                raise ExecError("the primary key repeats")
        for column, (name, key) in table.references.items():
            target = self.catalog.read(self._table(txn, name)) if name != table.name else new if old is None else old.unionByName(new)
            if not new.join(target.select(F.col(f"`{key}`").alias("_k")), F.col(f"`{column}`") == F.col("_k"), "left_anti").isEmpty():
                raise ExecError(f"{column!r} references no row of {name!r}")

    def _insert(self, s: ast.Insert, txn: Txn) -> Result:
        table = self._table(txn, s.table, "X", self._new_keys(s)).copy()
        binder = self._binder(txn)
        if isinstance(s.rows, ast.Values):
            df, kinds = binder.rows(s.rows)
            names = df.columns
        else:
            df, names, kinds = binder.result(s.rows)
        new = self._fit(table, df, names, kinds)
        if table.auto:
            new = self._generate(table, new)
        # Written first: what is checked and counted is what will be read.
        path = self.catalog.write(table, new)
        stored = self.spark.read.schema(table.schema()).parquet(path)
        try:
            self._check(txn, table, stored, self.catalog.read(table) if table.segments else None)
        except EngineError:
            self.catalog.remove_segment(path.rsplit("/", 1)[-1])
            raise
        n = stored.count()
        if table.auto and n:
            table.next_id = max(table.next_id, stored.agg(F.max(f"`{table.auto}`")).first()[0] + 1)
        table.segments.append(path)
        txn.tables[table.name] = table
        return self._counted("inserted rows", n)

    def _new_keys(self, s: ast.Insert) -> list | None:
        """The keys of a few given rows."""
        table = self.catalog.tables.get(s.table)
        if table is None or table.primary is None or table.auto or not isinstance(s.rows, ast.Values) or len(s.rows.rows) > 100:
            return None
        at = [n for n, _, _ in table.columns].index(table.primary)
        kind = {"INT": int, "FLOAT": (int, float)}.get(table.types()[table.primary].logical, str)
        keys = [row[at].value for row in s.rows.rows if at < len(row)]
        return sorted(set(keys)) if keys and all(isinstance(k, kind) for k in keys) else None

    def _generate(self, table: TableDef, new: DataFrame) -> DataFrame:
        """Ids for zeros: numbered inside partitions, then shifted by the counts of earlier ones."""
        key = f"`{table.auto}`"
        row = F.monotonically_increasing_id()
        path = f"{self.catalog.root}/segments/numbered-{uuid.uuid4().hex}"
        new.withColumn("_row", row).write.parquet(path)
        held = self.spark.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
        zero = held.filter(F.col(key) == 0)
        counts = sorted((r["_part"], r["n"]) for r in zero.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
        shift, at = [], table.next_id
        for part, n in counts:
            shift.append((part, at))
            at += n
        if not shift:
            return held.drop("_row", "_part")
        from pyspark.sql import Window

        ranked = zero.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_row")) - 1)
        offsets = self.spark.createDataFrame(shift, "_part long, _at long")
        made = ranked.join(offsets, "_part").withColumn(table.auto, (F.col("_at") + F.col("_rank")).cast(table.types()[table.auto].spark))
        columns = [f"`{n}`" for n, _, _ in table.columns]
        return held.filter(F.col(key) != 0).select(*columns).unionByName(made.select(*columns))

    def _delete(self, s: ast.Delete, txn: Txn) -> Result:
        key = self._point(s.table, s.where)
        table = self._table(txn, s.table, "X", key).copy()
        rows = self.catalog.read(table)
        binder = self._binder(txn, {s.table: key} if key else None)
        bound = binder.source(ast.Table(s.table))
        gone = F.lit(True) if s.where is None else Scope(bound.columns).value(s.where).truth()
        names = [c.name for c in bound.columns]
        out = bound.df.filter(gone).toDF(*names)
        if table.primary and self._references(txn, table, out):
            raise ExecError("other rows reference a deleted row")
        n = out.count()
        if n:
            kept = bound.df.filter(~F.coalesce(gone, F.lit(False))).toDF(*names)
            kept = kept.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in rows.schema.fields])
            table.segments = [self.catalog.write(table, kept)] if s.where is not None else []
        txn.tables[table.name] = table
        return self._counted("deleted rows", n)

    def _update(self, s: ast.Update, txn: Txn) -> Result:
        known = self.catalog.tables.get(s.table)
        key = self._point(s.table, s.where) if not s.sources and known and known.primary not in [n for n, _ in s.changes] else None
        table = self._table(txn, s.table, "X", key).copy()
        types = table.types()
        if any(calls(e) for _, e in s.changes) or calls(s.where):
            raise PlanError("update has no aggregates")
        for name, _ in s.changes:
            if name not in types:
                raise PlanError(f"column {name!r} is unknown")
        binder = self._binder(txn)
        # Row numbers must not change between the passes: the numbered rows are stored.
        numbered = f"{self.catalog.root}/segments/update-{uuid.uuid4().hex}"
        self.catalog.read(table).withColumn("_row", F.monotonically_increasing_id()).write.parquet(numbered)
        base = self.spark.read.parquet(numbered)
        own = binder._named(base, base.columns, [of_spark(f.dataType) for f in base.schema.fields], s.table, None)
        row = own.columns[-1].inner
        own.columns[-1].hidden = True
        df, columns = own.df, list(own.columns)
        for source in s.sources:
            right = binder.source(source)
            df, columns = df.crossJoin(right.df), columns + right.columns
        scope = Scope(columns)
        if s.where is not None:
            df = df.filter(scope.value(s.where).truth())
        new = []
        for name, e in s.changes:
            v = scope.value(e)
            if v.type != types[name].logical and not (v.type == INT and types[name].logical == FLOAT):
                raise PlanError(f"column {name!r} takes {types[name].logical}, not {v.type}")
            new.append(v.number().cast(types[name].spark).alias(f"_new_{len(new)}"))
        # Of several matches one is taken.
        matched = df.select(F.col(row).alias("_row"), F.struct(*new).alias("_new")).groupBy("_row").agg(F.first("_new").alias("_new"))
        joined = base.join(matched, "_row", "left")
        place = {name: i for i, (name, _) in enumerate(s.changes)}
        after = joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new._new_{place[n]}")).otherwise(F.col(f"`{n}`")).alias(n) if n in place else F.col(f"`{n}`") for n, _, _ in table.columns])
        path = self.catalog.write(table, after)
        stored = self.spark.read.schema(table.schema()).parquet(path)
        self._check(txn, table, stored, None)
        if table.primary in place:
            lost = base.join(stored.select(F.col(f"`{table.primary}`").alias("_k")), F.col(f"`{table.primary}`") == F.col("_k"), "left_anti")
            if self._references(txn, table, lost):
                raise ExecError("other rows reference a changed key")
        n = matched.count()
        table.segments = [path]
        txn.tables[table.name] = table
        return self._counted("updated rows", n)


def total_output(df: DataFrame) -> int:
    """Rows that all operators of an executed frame emitted, by Spark's own metrics; the rows stay on the executors."""
    df._jdf.queryExecution().toRdd().count()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            total += metric.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
    return total
