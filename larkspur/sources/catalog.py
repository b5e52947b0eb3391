"""Table definitions and stored versions.

A table is a list of Parquet segments; a statement never changes a segment but
makes a new list.  An insert adds a segment (nothing is rewritten), a delete or
update writes the new state as one.  The catalog file names the present lists,
so readers of an older list are not disturbed and a transaction is rolled back
by forgetting its lists.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.types import ColumnType
from ..plans import ast

HIDDEN_KEY = "__row_key"


@dataclass
class TableDef:
    name: str
    columns: list[tuple[str, str, int]]  # name, type, size
    primary: str | None = None
    auto: str | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    segments: list[str] = field(default_factory=list)
    next_id: int = 1

    def types(self) -> dict[str, ColumnType]:
        return {n: ColumnType(k, s) for n, k, s in self.columns}

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark) for n, k in self.types().items()])

    def copy(self) -> TableDef:
        return TableDef(self.name, list(self.columns), self.primary, self.auto, dict(self.references), list(self.segments), self.next_id)


class Catalog:
    """Definitions by name; ``attached`` frames can be read but not changed."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.tables: dict[str, TableDef] = {}
        self.attached: dict[str, DataFrame] = {}
        if root:
            self._load()

    # -- files, in any store that Spark can write -------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> None:
        fs, path = self._path("catalog.json")
        if fs.exists(path):
            stream = fs.open(path)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            for t in json.loads(text):
                t["columns"] = [tuple(c) for c in t["columns"]]
                t["references"] = {k: tuple(v) for k, v in t["references"].items()}
                self.tables[t["name"]] = TableDef(**t)

    def save(self) -> None:
        if self.root:
            # Written beside and renamed: a reader, or a crash, finds the old file or the new one.
            fs, path = self._path("catalog.json")
            _, fresh = self._path(f"catalog-{uuid.uuid4().hex}.json")
            stream = fs.create(fresh, True)
            stream.write(bytearray(json.dumps([asdict(t) for t in self.tables.values()]).encode()))
            stream.close()
            jvm = self.spark._jvm
            replace = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = replace
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path, kinds)

    def write(self, table: TableDef, rows: DataFrame) -> str:
        """Store rows as a segment and give its path; sorted by the primary key inside each file, so ranges of it skip row groups."""
        if not self.root:
            raise PlanError("an engine without a folder cannot store tables")
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        rows = rows.select(*[f"`{n}`" for n, _, _ in table.columns])
        (rows.sortWithinPartitions(f"`{table.primary}`") if table.primary else rows).write.parquet(path)
        return path

    def read(self, table: TableDef) -> DataFrame:
        if not table.segments:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*table.segments)

    def segment_folders(self) -> list[str]:
        """Names of all folders below ``segments``, in use or not."""
        fs, path = self._path("segments")
        return [f.getPath().getName() for f in fs.listStatus(path)] if self.root and fs.exists(path) else []

    def remove_segment(self, name: str) -> None:
        fs, path = self._path(f"segments/{name}")
        fs.delete(path, True)

    def define(self, statement: ast.CreateTable, tables: dict[str, TableDef]) -> TableDef:
        """Check a definition against the tables a transaction sees, and make it; the caller puts it in place."""
        names = [c.name for c in statement.columns]
        if statement.name in tables or statement.name in self.attached:
            raise PlanError(f"table {statement.name!r} exists")
        if len(set(names)) < len(names):
            raise PlanError("column names repeat")
        primary = [c.name for c in statement.columns if c.primary]
        auto = [c for c in statement.columns if c.auto]
        if len(primary) > 1 or len(auto) > 1:
            raise PlanError("at most one primary key and one auto_increment column")
        for c in auto:
            if not c.primary or c.references or c.type.logical != "INT":
                raise PlanError("auto_increment needs an integer primary key that references nothing")
        made = TableDef(statement.name, [(c.name, c.type.name, c.type.size) for c in statement.columns], primary[0] if primary else None, auto[0].name if auto else None)
        for c in statement.columns:
            if c.references:
                target = tables.get(c.references[0])
                if target is None or target.primary != c.references[1]:
                    raise PlanError(f"{c.references[0]}.{c.references[1]} is no primary key")
                there = target.types()[c.references[1]]
                if (there.logical, there.size) != (c.type.logical, c.type.size):
                    raise PlanError("a foreign key has the type and size of the key it references")
                made.references[c.name] = c.references
        return made


def scratch_root(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; local sessions without ``spark.checkpoint.dir`` use the temporary one."""
    import os
    import tempfile

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.split("[")[0] == "local"
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
