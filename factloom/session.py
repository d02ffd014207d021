"""Sessions and table access."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(app: str = "factloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session and none of these settings."""
    cpus = cpus or min(8, os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks find it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_factloom_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-')}/factloom", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._factloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Parquet gives pushdown and column pruning to whatever is built on it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, in as many; a table of many pieces (any large one) as it is, without a shuffle.

    For steps that work long on each row; small files would leave most cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ntz(df: DataFrame) -> DataFrame:
    """Instant columns as zone-less UTC timestamps, the form in which all results leave the engine."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if c in zoned else F.col(f"`{c}`") for c in df.columns])
