"""Structured Streaming forms of ingest: files arrive, state is kept, results are read as tables.

Each function starts the query with ``trigger(availableNow=True)``, so it drains what is there and ends; a second call with the same
checkpoint continues where the first stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.scratch import Scratch

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream over event files; times become instants for watermarks. Rows without a time are left out, as no window holds them."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # A stream reads folders; a single file is its folder seen through its name.
        reader, path = reader.option("pathGlobFilter", where.getName()), path.rsplit("/", 1)[0]
    raw = reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")


def drain(stream: DataFrame, schema: T.StructType, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is available into a parquet table of the shared folder and return that table."""
    out = f"{scratch.root}/{name}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return scratch.spark.read.schema(schema).parquet(out)


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; late rows beyond ``delay`` are dropped by the watermark, open windows are not yet out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(s, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def _parts(spark: SparkSession, root: str) -> dict[int, str]:
    """The finished parts of a state folder by their numbers."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    names = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in names if p.getName().startswith("n=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName()[2:]): p.toString() for p in done}


def latest_by_key(events: DataFrame, root: str, keys: list[str], order: list[str], compact: int = 20) -> DataFrame:
    """Upsert of the latest row per key, batch by batch, into the folder ``root``, and the state after all that is available.

    Each batch writes the latest row of the keys that it holds as part ``n`` of the state; the state is the latest row per key over all parts. A batch that runs
    again writes its own part again, and a run that continues finds the parts of the runs before, so a restart loses nothing and repeats nothing. When
    ``compact`` parts have come together they are replaced by one, so the state is rewritten once in so many batches. Rows with a null key are a key of
    their own; of equal order the larger remaining columns count.
    """
    spark, schema = events.sparkSession, events.schema
    parts = f"{root}/parts"

    def reduced(rows: DataFrame) -> DataFrame:
        others = [c for c in schema.names if c not in keys]
        best = F.max(F.struct(*order, *[c for c in others if c not in order])).alias("m")
        return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"m.{c}").alias(c) for c in others]).select(*schema.names)

    def merge(batch: DataFrame, number: int) -> None:
        before = {n: p for n, p in _parts(spark, parts).items() if n < number}
        if len(before) < compact:
            reduced(batch).write.mode("overwrite").parquet(f"{parts}/n={number}")
            return
        rows = batch.unionByName(spark.read.schema(schema).parquet(*before.values()))
        reduced(rows).write.mode("overwrite").parquet(f"{parts}/n={number}")
        # The part holds all of theirs; if this ends half way, what is left is merged again.
        for p in before.values():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = _parts(spark, parts)
    return reduced(spark.read.schema(schema).parquet(*found.values())) if found else spark.createDataFrame([], schema)
