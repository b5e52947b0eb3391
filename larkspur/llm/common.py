"""Shared helpers: table access and intermediate tables that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, falls back to the
    machine's temporary folder; a cluster without it uses the warehouse.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


_gathering: list[list[Scratch]] = []


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder.

    A written table cuts the lineage: losing an executor later costs a reread,
    never the recomputation of earlier iterations.  Results read the tables
    until they are written themselves; ``remove`` deletes them all.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._made = 0
        if _gathering:
            _gathering[-1].append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made:03d}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table nothing refers to any more."""
        self._delete(df._scratch_path)

    def remove(self) -> None:
        """Delete all tables of the run, once nothing refers to any."""
        self._delete(self.root)


@contextmanager
def gathered() -> Iterator[list[Scratch]]:
    """Collects the scratch folders opened inside, so that they can be removed when their results are written."""
    found: list[Scratch] = []
    _gathering.append(found)
    try:
        yield found
    finally:
        _gathering.remove(found)


def held(expression: Column, *arrays: str) -> Column:
    """``expression`` with its use of computed array columns inside lambdas kept apart from their computation.

    The optimizer merges a projection into the next where a column is used once;
    inside a lambda it would then be computed anew for every element.  A second
    use, which cannot be simplified away, prevents that.  Null if an array is.
    """
    here = F.lit(True)
    for a in arrays:
        here = here & (F.size(a) >= 0)
    return F.when(here, expression)
