"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here: every round is written as a parquet table, so a lost executor costs the
tasks it ran and not the rounds before. The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local
mode, where that is unset (tests, a laptop), a folder of this process is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables that operators of this process have written; their results must have been read or written by then."""
    while _ROOTS:
        Scratch.delete(spark, _ROOTS.pop())


class Scratch:
    """The intermediate tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return it read back: a new plan that begins at the files."""
        path = f"{self.root}/{label}-{self._count}"
        self._count += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._factloom_path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of one schema as a single scan, where a union would add a branch to the plan for each."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._factloom_path for t in tables))

    def clear(self) -> None:
        """Remove all tables of this run, once nothing reads them any more."""
        self.delete(self.spark, self.root)

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later plan reads."""
        path = getattr(df, "_factloom_path", None)
        if path:
            self.delete(self.spark, path)

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        """Remove a folder of this session's file system, if it is there."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
